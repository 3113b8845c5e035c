"""Self-join of documents on the Jaccard similarity of their word shingles, by grouped prefixes.

The shingles of a document are put in one order for all documents: frequent ones last, else by
hash. Two sets as similar as asked share a shingle in their prefixes, the first
``n - ceil(0.8 n) + 1``. Documents with the same set are one class, classes with the same prefix
and size one group. Groups that share a prefix shingle are candidates; pairs of groups whose
sizes or prefixes differ too much are dropped, the rest expanded to their classes and verified on
the whole sets. Pairs that can't change the connected components are never formed (``links``).

Two bounds keep near but too unlike texts from becoming pairs, and lose no link. What comes before
the first shared shingle of two sets is not shared, so both stretches together are no longer than
the difference allowed (``slack``). And a set has a sketch of ``SKETCH`` bits, each the parity of
its shingles there: two sets differ in at least as many shingles as their sketches in bits.

Shingles are compared by 62-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import shipped, stored
from tallygrid.llm.links import linked_components

WORDS, PERCENT = 5, 80
#: At most so many of the most frequent shingles are put last: 8 bytes each are sent to workers.
MOST_FREQUENT, FREQUENT = 200_000, 32
#: So many ids of 8 bytes may be broadcast to pick texts; beyond, the join shuffles.
BROADCAST_IDS = 500_000
#: Bits of a sketch: of sets of some hundred shingles that are half unlike, so few places have two that it still tells.
SKETCH = 512
#: Sorted stretches in which equal shingles are found next to each other.
STRETCHES = 1 << 16
LAST = 1 << 62
PARTS = [f"s{i}" for i in range(SKETCH // 64)]
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_HASHES = _WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text.

    Words are parted by space and the characters 9 to 13, only A to Z change case. Fewer words
    than a shingle takes are one shingle; a text without words has none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    hashes = np.array(list(map(_HASHES.__getitem__, words)), np.uint64)
    size = min(WORDS, len(words))
    mixed = np.full(len(words) - size + 1, size, np.uint64)
    for at in range(size):
        part = hashes[at : at + len(mixed)] * _FACTORS[at]
        mixed += part ^ (part >> np.uint64(29))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique((mixed ^ (mixed >> np.uint64(32))) & np.uint64(LAST - 1)).astype(np.int64)


def ordered(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles as numbers in the common order: those in ``frequent`` (sorted) come last."""
    if len(frequent):
        at = np.searchsorted(frequent, shingles)
        common = frequent[np.minimum(at, len(frequent) - 1)] == shingles
        shingles = np.sort(shingles + np.where(common, LAST, 0))
    return shingles


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def least_common(sizes: Column) -> Column:
    """The least intersection of two sets of that many shingles together."""
    return F.ceil(sizes * PERCENT / (100.0 + PERCENT) - 1e-9)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The parities of the numbers of shingles in ``SKETCH`` places, as 64-bit numbers."""
    odd = np.bincount(shingles & (SKETCH - 1), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def slack(n: Column, before: Column) -> Column:
    """What a set has left, if ``before`` of its shingles are not shared; of two linked sets the sum is not negative."""
    return n * (100 - PERCENT) - before * (100 + PERCENT)


def alike_sketches(left: Column, right: Column) -> Column:
    """Whether two sets (n and the parts of the sketch) may still be linked."""
    bits = sum(F.bit_count(left[part].bitwiseXOR(right[part])) for part in PARTS)
    sizes = left["n"] + right["n"]
    return bits <= sizes - 2 * least_common(sizes)


def _signed(data: np.ndarray, seed: int) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(data.tobytes(), seed)).astype(np.int64))


def _prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, number of shingles, hash of the whole set, hash of size and prefix, the sketch and the prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part, rows = batch.iloc[at : at + 512], []
                for text in part["text"]:
                    shingles = shingle_set(text)
                    prefix = ordered(shingles, shared.value)[: prefix_length(len(shingles))]
                    group = _signed(np.append(prefix, len(shingles)), 2)
                    rows.append((len(shingles), _signed(shingles, 1), group, *sketch(shingles), prefix))
                names = ["n", "whole", "group", *PARTS, "prefix"]
                yield pd.DataFrame({"doc_id": part["doc_id"].array, **dict(zip(names, zip(*rows)))})

    parts = "".join(f"{part} long, " for part in PARTS)
    schema = f"doc_id long, n long, whole long, group long, {parts}prefix array<long>"
    return shipped(docs).mapInPandas(work, schema)


def _frequent(docs: DataFrame) -> np.ndarray:
    """The most frequent prefix shingles, counted over all documents: a whole number of doublings of them."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                sets = [shingle_set(text) for text in batch["text"].iloc[at : at + 512]]
                found, n = np.unique(np.concatenate([s[: prefix_length(len(s))] for s in sets]), return_counts=True)
                yield pd.DataFrame({"shingle": found, "n": n})

    tokens = shipped(docs).select("text").mapInPandas(work, "shingle long, n long")
    counts = stored(tokens.groupBy("shingle").agg(F.sum("n").alias("count")).where(F.col("count") > FREQUENT), "counts")
    level = F.floor(F.log2("count")).cast("int")
    least, taken = None, 0
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        taken += row["count"]
        if taken > MOST_FREQUENT:
            break
        least = row["level"]
    if least is None:
        return np.zeros(0, np.int64)
    found = counts.where(level >= least).select("shingle").toPandas()
    return np.sort(found["shingle"].to_numpy(np.int64))


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(whole, shingles) of the documents with the given ids (doc_id, whole)."""
    few = ids.count() <= BROADCAST_IDS
    wanted = ids.select(F.col("doc_id").alias("wanted"), F.col("whole").alias("asked"))
    chosen = docs.join(F.broadcast(wanted) if few else wanted, docs["doc_id"].eqNullSafe(F.col("wanted")))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                sets = [shingle_set(text) for text in part["text"]]
                whole = [_signed(s, 1) for s in sets]
                yield pd.DataFrame({"asked": part["asked"].array, "hash": whole, "shingles": sets})

    found = chosen.select("text", "asked").mapInPandas(work, "asked long, hash long, shingles array<long>")
    return found


def similar_documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    ``component_id`` is the smallest id that links lead to, the row's own included. Rows with a
    null or empty text have no shingles and no links. Rows that agree in id are rows of their own;
    a null id is never the smallest unless there is no other. Other columns are not read.
    """
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    frequent = _frequent(docs)
    found = _prefixes(docs, frequent)
    rows = stored(found.select("doc_id", "n", "whole", "group", *PARTS, F.when(F.col("n") > 0, F.col("prefix")).alias("prefix")), "rows")
    # One row for each different set. Which copy gives the prefix does not matter: they are equal.
    first = rows.where("n > 0").groupBy("whole").agg(
        F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("group").alias("group"), *(F.max(part).alias(part) for part in PARTS)
    )
    classes = stored(first.withColumn("item", F.monotonically_increasing_id()), "classes")
    grouped = classes.groupBy("group").agg(F.count(F.lit(1)).alias("classes"), F.min("item").alias("item"))
    heads = grouped.join(classes.select("item", "whole", "doc_id"), "item").select("group", "classes", "whole", "doc_id")
    prefixes = rows.select("whole", "doc_id", "prefix", "n").join(heads, ["whole", "doc_id"]).dropDuplicates(["group"])
    groups = stored(prefixes.select("group", "n", "classes", "prefix"), "groups")

    # Shingles of one group only can't give a candidate; equal ones lie side by side once sorted.
    tokens = groups.select("group", "n", F.posexplode("prefix").alias("at", "bucket"))
    tokens = tokens.select("group", "bucket", slack(F.col("n"), F.col("at")).alias("slack"))
    stretch = Window.partitionBy(F.pmod(F.xxhash64("bucket"), F.lit(STRETCHES))).orderBy("bucket")
    beside = tokens.select("group", "bucket", "slack", F.lag("bucket").over(stretch).alias("before"), F.lead("bucket").over(stretch).alias("after"))
    shared = beside.where("bucket = before or bucket = after").select("group", "bucket", "slack")
    alone = groups.where("classes > 1").select("group", F.col("group").bitwiseOR(F.lit(-(1 << 63))).alias("bucket"), slack(F.col("n"), F.lit(0)).alias("slack"))
    # The set with the fewest shingles of its own is tried with all others first: it is what copies were made from.
    members = shared.union(alone).join(classes.select("group", "item", "n"), "group")
    members = stored(members.select("bucket", "item", F.col("slack").alias("weight"), F.struct("n", "slack").alias("mark")), "members")
    details = classes.select("item", F.struct("n", *PARTS).alias("detail"))

    def near_sizes(left: Column, right: Column) -> Column:
        sizes = F.least(left["n"], right["n"]) * 100 >= F.greatest(left["n"], right["n"]) * PERCENT
        return sizes & (left["slack"] + right["slack"] >= 0)

    def verify(pairs: DataFrame) -> DataFrame:
        of = classes.select("item", "group", "whole", "doc_id", "n", F.struct("n", *PARTS).alias("detail"))
        sides = [of.select(*(F.col(c).alias(f"{side}_{c}" if c != "item" else side) for c in of.columns)) for side in ("a", "b")]
        named = pairs.join(sides[0], "a").join(sides[1], "b")
        named = stored(named.where(alike_sketches(F.col("a_detail"), F.col("b_detail"))).drop("a_detail", "b_detail"), "named")
        between = named.select("a_group", "b_group").distinct()
        ends = [groups.select(F.col("group").alias(f"{s}_group"), F.col("prefix").alias(f"{s}_prefix"), F.col("n").alias(f"{s}_size")) for s in ("a", "b")]
        between = between.join(ends[0], "a_group").join(ends[1], "b_group")
        # Up to where both prefixes reach, the sets may not differ in more than they may altogether.
        reach = F.least(F.element_at("a_prefix", -1), F.element_at("b_prefix", -1))
        between = between.withColumn("reach", reach)
        seen = sum(F.size(F.filter(f"{s}_prefix", lambda x: x <= F.col("reach"))) for s in ("a", "b"))
        sizes = F.col("a_size") + F.col("b_size")
        differ = seen - 2 * F.size(F.array_intersect("a_prefix", "b_prefix"))
        possible = between.where(differ <= sizes - 2 * least_common(sizes)).select("a_group", "b_group")
        rest = stored(named.join(possible, ["a_group", "b_group"]), "expanded")
        # Each side by itself: a set that many pairs share is counted off before the sides meet.
        asked = [rest.select(F.col(f"{s}_doc_id").alias("doc_id"), F.col(f"{s}_whole").alias("whole")).distinct() for s in ("a", "b")]
        asked = stored(asked[0].union(asked[1]).distinct(), "asked")
        sets = _sets_of(docs, asked)
        sets = stored(sets.where("asked = hash").select("asked", "shingles").dropDuplicates(["asked"]), "sets")
        left = sets.select(F.col("asked").alias("a_whole"), F.col("shingles").alias("left"))
        right = sets.select(F.col("asked").alias("b_whole"), F.col("shingles").alias("right"))
        both = rest.join(left, "a_whole").join(right, "b_whole")
        common = F.size(F.array_intersect("left", "right"))
        return both.where(100 * common >= PERCENT * (F.col("a_n") + F.col("b_n") - common)).select("a", "b")

    linked = linked_components(members, verify, near_sizes, details, alike_sketches).withColumnRenamed("node", "item")
    labelled = classes.join(linked, "item", "left").withColumn("component", F.coalesce("component", "item"))
    smallest = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = labelled.join(smallest, "component").select("whole", "component_id")
    answer = rows.join(labels, "whole", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return answer.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
