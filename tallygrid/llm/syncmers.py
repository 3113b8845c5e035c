"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text is taken as units: words of up to eight characters, pieces of longer ones that begin at
certain letters, and single signs of scripts without spaces. Where a unit begins depends on the
characters next to it alone, so after an edit the units are soon the same again.
Of all runs of ``RUN`` units those are anchors whose smallest inner pair of units, by hash, is
their first or last pair. Whether a run is an anchor depends on nothing outside it, so an edit
changes only anchors that touch it. Before the first unit and after the last one there are ``RUN`` - 1 marks, so that
texts of any size have runs, by one rule; the first and the last run are always anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import unused_names

RUN = 8
#: Signs that are units each: Thai to Khmer, and East Asian letters.
_SINGLE = r"\u0E00-\u0EFF\u1780-\u17FF\u2E80-\uD7AF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
#: Where words of more than eight characters are parted.
_BEGINS = "aeiouAEIOU05"
UNIT = rf"([{_SINGLE}]|[^\s{_SINGLE}]{{1,8}}(?![^\s{_SINGLE}])|[^\s{_SINGLE}][^\s{_SINGLE}{_BEGINS}]{{0,7}})"
#: Documents by bucket of ids, and the most buckets, so both stay small at any size.
DOCS_EACH, MOST_BUCKETS = 256, 100_000


def with_anchors(docs: DataFrame, text: str = "text", output: str = "anchors", places: str | None = None) -> DataFrame:
    """Adds ``output``: 31-bit hashes of the anchors of each whole text, in the order of the text.

    ``places`` names a second column with the number of the unit that each anchor begins with; in the first run that
    is 1 - ``RUN``. A null text, an empty one or one of white space has no anchors. Columns already named so are replaced.
    """
    units, pairs, found = unused_names(docs, "units", "pairs", "found")
    given = F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(UNIT), 1)
    before, after = ([F.lit(f"\x00{side}{at}") for at in range(1, RUN)] for side in "<>")
    padded = F.when(F.size(units) > 0, F.concat(F.array(*before), F.col(units), F.array(*after))).otherwise(F.array().cast("array<string>"))
    rows = docs.withColumn(units, given).withColumn(units, padded)
    rows = rows.withColumn(pairs, F.transform(units, lambda unit, at: F.xxhash64(unit, F.get(F.col(units), at + 1))))
    last = RUN - 2

    def anchor(first: Column, at: Column) -> Column:
        inner = F.least(*(F.get(F.col(pairs), at + step) for step in range(1, last)))
        closed = (first <= inner) | (F.get(F.col(pairs), at + last) <= inner)
        outer = (at == 0) | (at == F.size(units) - RUN)
        whole = F.xxhash64(first, *(F.get(F.col(pairs), at + step) for step in range(2, RUN, 2)))
        short = whole.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
        given = short if places is None else F.struct(short.alias("hash"), (at - RUN + 1).alias("at"))
        return F.when((at <= F.size(units) - RUN) & (closed | outer), given)

    anchors = F.filter(F.transform(pairs, anchor), lambda one: one.isNotNull())
    if places is None:
        return rows.withColumn(output, anchors).drop(units, pairs)
    rows = rows.withColumn(found, anchors)
    named = {output: F.transform(found, lambda one: one["hash"]), places: F.transform(found, lambda one: one["at"])}
    return rows.withColumns(named).drop(units, pairs, found)


def likeness(left: Column, right: Column) -> Column:
    """Twice the anchors in common over the anchors of both, as sets; 1 if neither has any."""
    sizes = F.size(F.array_distinct(left)) + F.size(F.array_distinct(right))
    shared = F.size(F.array_intersect(left, right))
    return F.when(sizes == 0, F.lit(1.0)).otherwise(2.0 * shared / sizes)


def fingerprint(anchors: Column) -> Column:
    """The anchors as text."""
    return F.array_join(anchors.cast("array<string>"), " ")


def with_next(docs: DataFrame, carried: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``next``, a struct of the ``carried`` columns of the document with the next smaller id.

    After the last document comes the first. Rows with the same id follow each other by hash of
    the text; a null id comes last. Ids are cut into ranges, each sorted on its own; every range
    also gets a copy of the first row of the one after it, so only one row for each range, at
    most ``MOST_BUCKETS``, is ever gathered.
    """
    part, copy = unused_names(docs, "range", "copy")
    digest = F.xxhash64(text)
    bounds = docs.agg(F.count(F.lit(1)).alias("n"), F.min(id).alias("low"), F.max(id).alias("high")).first()
    buckets = max(1, min(MOST_BUCKETS, bounds["n"] // DOCS_EACH))
    low = bounds["low"] or 0
    width = ((bounds["high"] or 0) - low) // buckets + 1
    bucket = F.coalesce(F.floor((F.col(id) - F.lit(low)) / F.lit(width)).cast("long"), F.lit(-1))
    firsts = docs.groupBy(bucket.alias("bucket")).agg(F.max(F.struct(F.col(id).alias("id"), digest.alias("digest"))).alias("first"))
    order = Window.orderBy(F.desc("bucket"))
    everything = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = firsts.select(
        "bucket", F.coalesce(F.lead("first").over(order), F.first("first").over(everything)).alias("wanted")
    )
    copies = docs.join(
        F.broadcast(wanted), F.col(id).eqNullSafe(F.col("wanted.id")) & (digest == F.col("wanted.digest"))
    ).select(F.col("bucket").alias(part), *docs.columns).dropDuplicates([part])
    rows = docs.select(bucket.alias(part), *docs.columns, F.lit(False).alias(copy))
    rows = rows.union(copies.select(part, *docs.columns, F.lit(True).alias(copy)))
    sorted_range = Window.partitionBy(part).orderBy(F.asc(copy), F.desc_nulls_last(id), F.desc(digest))
    found = rows.withColumn("next", F.lead(F.struct(*carried)).over(sorted_range))
    return found.where(~F.col(copy)).drop(part, copy)


def edited_rows(docs: DataFrame) -> DataFrame:
    """Every document with its fingerprint, that of its edited text, and how near it is to both that and the next one.

    The edit replaces the last third of the code points by as many from the start of the next
    document. Null texts are empty ones.
    """
    rows = with_anchors(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    near = with_next(rows, ["text", "anchors"])
    n_chars = F.char_length("text")
    taken = F.floor(n_chars / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n_chars - taken), F.substring("next.text", F.lit(1), taken))
    both = near.select(
        "doc_id", n_chars.cast("long").alias("n_chars"), "anchors", F.col("next.anchors").alias("next_anchors"), edited.alias("edited")
    )
    both = with_anchors(both, "edited", "edited_anchors")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
