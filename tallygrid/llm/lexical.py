"""Ranked lexical search of many items over all documents, scoring equal bags of words once.

What a document scores for an item depends on nothing but how often it holds each item term and on its length
value m. So documents are cut down to the vocabulary of the items; documents with the same counts and
the same m form a class, found by a hash and verified by the counts themselves. Every class is scored once
and its members follow in order of their ids.

Items are searched in batches whose terms, weights and vocabulary stay below ``BATCH_TERMS``, so what
is sent to all workers has a bound whatever the number of items. A document is one row throughout: its
counts never leave it until a class is scored, and of a class no more members travel than a ranking can hold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import shipped, stored

TOP, BATCH_TERMS, TEXTS = 50, 200_000, 256
#: Anything but ASCII letters and digits and what is beyond ASCII parts the terms, in UTF-8 byte by byte.
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
TERM_BYTES = bytes(b if b in _KEPT else (b + 32 if 65 <= b <= 90 else 32) for b in range(256))


def text_terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, A to Z in lower case."""
    return text.translate(TERM_BYTES).split()


def _texts(column: pa.Array) -> list[bytes]:
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def item_terms(items: DataFrame, text: str = "text", id: str = "item_id") -> DataFrame:
    """(item, item_id, term): the distinct terms of each item. Rows equal in id and text are one item."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(text_terms(t))) for t in _texts(batch.column("text"))]
            line = np.repeat(np.arange(len(found)), [len(f) for f in found])
            terms = pa.array([term for f in found for term in f], pa.binary())
            taken = [batch.column(name).take(pa.array(line)) for name in ("item", "item_id")]
            yield from pa.table([*taken, terms], names=["item", "item_id", "term"]).to_batches(max_chunksize=10_000)

    one = items.select(F.xxhash64(id, text).alias("item"), F.col(id).alias("item_id"), F.col(text).alias("text")).dropDuplicates()
    kind = items.schema[id].dataType.simpleString()
    return shipped(one).mapInArrow(rows, f"item bigint, item_id {kind}, term binary")


def document_bags(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, n, terms, tfs): the number of all terms, and the numbers and counts of those in the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        # A few texts at a time: a batch of Arrow may hold ten thousand.
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            sizes, ends, terms, tfs = [], [0], [], []
            for data in _texts(batch.column("text")):
                words = text_terms(data)
                counts = Counter(map(number, words))
                counts.pop(None, None)
                held = sorted(counts)
                sizes.append(len(words))
                terms.extend(held)
                tfs.extend(counts[term] for term in held)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(values, kind)) for values, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    kind = docs.schema[id].dataType.simpleString()
    chosen = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return shipped(chosen).mapInArrow(rows, f"doc_id {kind}, n bigint, terms array<int>, tfs array<bigint>")


def length_value(n: Column, documents: int, terms: int) -> Column:
    """m = 100 - 50 + (50 * n * N) div L, in decimals of 38 places as the product may pass 64 bits."""
    product = (n.cast("decimal(18,0)") * F.lit(50 * documents).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.lit(50).cast("bigint") + F.call_function("div", product, F.lit(terms).cast("decimal(38,0)"))


def weight(df: Column, documents: int) -> Column:
    return F.floor(F.lit(1000.0) * F.ln(F.lit(float(2 * documents + 2)) / (2 * df + 1).cast("double")))


def bag_classes(bags: DataFrame, top: int) -> DataFrame:
    """The first ``top`` members by id of each class of equal terms, counts and m: (bag, part, place, doc_id, m, terms, tfs).

    ``bag`` is a hash, ``part`` tells unequal bags of one hash apart. Which members come first is
    settled in the map tasks before anything is exchanged, so a class of very many documents is small from there on.
    """
    content = ("m", "terms", "tfs")
    hashed = bags.withColumn("bag", F.xxhash64(*content))
    place = F.row_number().over(Window.partitionBy("bag", *content).orderBy("doc_id"))
    first = hashed.withColumn("place", place).where(F.col("place") <= top)
    part = F.dense_rank().over(Window.partitionBy("bag").orderBy(*content))
    return first.withColumn("part", part).select("bag", "part", "place", "doc_id", *content)


def search_batch(bags: DataFrame, wanted: DataFrame, documents: int, terms: int, top: int) -> DataFrame:
    """(item, item_id, rank, doc_id, score) of one batch; ``wanted`` has (item, item_id, number), its size is bounded."""
    held = bags.where(F.size("terms") > 0)
    df = held.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("df"))
    weighted = stored(wanted.join(df, "number").withColumn("w", weight(F.col("df"), documents)).drop("df"), "weights")
    members = stored(bag_classes(held.withColumn("m", length_value(F.col("n"), documents, terms)), top), "classes")
    classes = members.where("place = 1").repartition("bag", "part")
    counts = classes.select("bag", "part", "m", F.col("doc_id").alias("first_id"), F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    value = F.expr("(1000000000 * t.tfs) div (1000 * t.tfs + 20 * m)")
    counts = counts.select("bag", "part", "first_id", F.col("t.terms").alias("number"), value.alias("value"))
    scored = counts.join(F.broadcast(weighted), "number").groupBy("bag", "part", "item", "item_id")
    scored = scored.agg(F.sum(F.col("w") * F.col("value")).alias("score"), F.first("first_id").alias("first_id")).where("score > 0")
    # Of classes in this order the first ones hold all documents that can be in the ranking.
    best = Window.partitionBy("item", "item_id").orderBy(F.desc("score"), F.asc("first_id"))
    chosen = scored.withColumn("at", F.row_number().over(best)).where(F.col("at") <= top).drop("at", "first_id")
    found = chosen.join(members.select("bag", "part", "doc_id"), ["bag", "part"])
    order = Window.partitionBy("item", "item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item", "item_id", "rank", "doc_id", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = TOP, text: str = "text", id: str = "doc_id", item_id: str = "item_id", batch_terms: int = BATCH_TERMS
) -> DataFrame:
    """The ``top`` documents of highest score above 0 for each item: item_id, rank, doc_id, score.

    Equal scores go by ascending id, null first. Every row of documents is a document, also if its id or text
    repeats; a null text or one without terms is found by nothing and not counted. Items without terms, or
    whose terms no document has, get no row. Of items equal in id and text there is one. Extra columns are
    not read.
    """
    spark = docs.sparkSession
    pairs = stored(item_terms(items, "text", item_id), "item-terms")
    # By hash of the item; an item with more terms than a batch is to have makes a batch of its own size.
    batches = max(1, -(-pairs.count() // batch_terms))
    kind = docs.schema[id].dataType.simpleString()
    item_kind = items.schema[item_id].dataType.simpleString()
    results, totals = [], None
    for at in range(batches):
        batch = pairs.where(F.pmod("item", F.lit(batches)) == at)
        # All terms of a batch in one task, as their number is bounded.
        numbered = batch.select("term").distinct().withColumn("number", F.row_number().over(Window.orderBy("term")) - 1)
        numbers = stored(numbered, "vocabulary")
        wanted = batch.join(F.broadcast(numbers), "term").drop("term")
        vocabulary = {bytes(row["term"]): row["number"] for row in numbers.collect()}
        bags = stored(document_bags(docs, vocabulary, text, id), "bags")
        if totals is None:
            totals = bags.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if totals[0]:
            results.append(search_batch(bags, wanted, *totals, top))
    empty = spark.createDataFrame([], f"item bigint, item_id {item_kind}, rank int, doc_id {kind}, score bigint")
    return reduce(DataFrame.unionByName, results, empty).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH terms AS (
    SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents
), totals AS (
    SELECT count(*) AS big_n, sum(len(words)) AS big_l FROM terms WHERE len(words) > 0
), lengths AS (
    SELECT doc_id, row, words, 50 + CAST((50 * CAST(len(words) AS HUGEINT) * big_n) // big_l AS BIGINT) AS m
    FROM terms, totals WHERE len(words) > 0
), items AS (
    SELECT DISTINCT item_id, unnest(list_distinct(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)
), counts AS (
    SELECT doc_id, row, m, term, count(*) AS tf
    FROM (SELECT doc_id, row, m, unnest(words) AS term FROM lengths)
    WHERE term IN (SELECT term FROM items) GROUP BY doc_id, row, m, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counts, totals GROUP BY term
), scores AS (
    SELECT item_id, doc_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM counts JOIN weights USING (term) JOIN items USING (term) GROUP BY item_id, doc_id, row
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
