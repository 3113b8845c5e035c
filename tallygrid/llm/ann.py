"""Approximate nearest neighbours by cross-polytope hashing, with an exact ranking of candidates.

A table turns unit vectors by a pseudo-rotation (three rounds of random signs and a fast
Hadamard transform) and hashes each to its nearest signed axis. A query looks into the buckets
of its ``PROBES`` nearest signed axes in each of ``TABLES`` tables. Buckets are cut into slots of
bounded size; each slot meets the queries that probe it in one group, which gives back only the
nearest few by exact Euclidean distance of the original vectors.

Equal vectors are one class, searched once: whatever their number, a query needs only the
smallest few ids of each class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import shipped, stored

TABLES, PROBES, SLOT, SEED = 20, 5, 2048, 17


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row, at unit scale; the width is a power of two."""
    width, half = rows.shape[1], 1
    while half < width:
        pairs = rows.reshape(len(rows), -1, 2, half)
        rows = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(rows), width)
        half *= 2
    return rows / np.sqrt(width)


def signed_axes(vectors: np.ndarray, tables: int, probes: int, seed: int = SEED) -> np.ndarray:
    """The nearest ``probes`` signed axes of each vector in each table, nearest first: (rows, tables, probes).

    Axis i is number i, its opposite number width + i; ties go to the smaller number.
    """
    width = 1 << max(0, int(np.ceil(np.log2(max(1, vectors.shape[1])))))
    padded = np.zeros((len(vectors), width))
    # Scaled by the largest component first, so that tiny and huge vectors keep their direction.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    padded[:, : vectors.shape[1]] = scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))
    random, found = np.random.default_rng(seed), []
    for _ in range(tables):
        turned = padded
        for _ in range(3):
            turned = hadamard(turned * random.choice((-1.0, 1.0), width))
        found.append(np.argsort(-np.hstack((turned, -turned)), axis=1, kind="stable")[:, :probes])
    return np.stack(found, axis=1)


def _hashed(classes: DataFrame, tables: int, probes: int, axes: int) -> DataFrame:
    """(key, class, first, embedding) for each probe of each table; ``key`` numbers tables and axes."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                codes = signed_axes(np.stack(part["embedding"].to_numpy()).astype(float), tables, probes)
                keys = (codes + (np.arange(tables) * axes)[None, :, None]).reshape(len(part), -1)
                yield part.assign(keys=list(keys.astype(np.int32)))

    kind = classes.schema["embedding"].dataType.simpleString()
    coded = classes.select("class", "first", "embedding").mapInPandas(hashes, f"class long, first long, embedding {kind}, keys array<int>")
    return coded.select(F.explode("keys").alias("key"), "class", "first", "embedding")


def _nearest_in_slot(keep: int):
    def nearest(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(members) and len(queries):
            ids, first = members["class"].to_numpy(), members["first"].to_numpy()
            rows = np.stack(members["embedding"].to_numpy()).astype(float)
            for query, vector in zip(queries["class"], queries["embedding"]):
                away = np.sqrt(((rows - np.asarray(vector, float)) ** 2).sum(axis=1))
                best = np.lexsort((ids, first, away))[:keep]
                found.append(pd.DataFrame({"query": query, "class": ids[best], "first": first[best], "distance": away[best]}))
        empty = pd.DataFrame({name: np.zeros(0, int) for name in ("query", "class", "first")} | {"distance": np.zeros(0)})
        return pd.concat(found, ignore_index=True) if found else empty

    return nearest


def _search(index: DataFrame, slots: DataFrame, probed: DataFrame, keep: int) -> DataFrame:
    """The nearest ``keep`` classes of every probed slot: (query, class, first, distance)."""
    placed = index.join(slots, "key").select("key", F.pmod(F.xxhash64("class"), "slots").alias("slot"), "class", "first", "embedding")
    asked = probed.join(slots, "key").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), "class", "embedding")
    grouped = placed.groupBy("key", "slot").cogroup(asked.groupBy("key", "slot"))
    return grouped.applyInPandas(_nearest_in_slot(keep), "query long, class long, first long, distance double")


def _best(found: DataFrame, keep: int) -> DataFrame:
    once = found.groupBy("query", "class", "first").agg(F.min("distance").alias("distance"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "first", "class"))
    return once.withColumn("place", place).where(F.col("place") <= keep).drop("place")


def usable(embedding: Column, size: int) -> Column:
    """Of the given length, not all zero, and every component finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return (F.size(embedding) == size) & finite & F.exists(embedding, lambda x: x != 0)


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, neighbours: int = 10, tables: int = TABLES, probes: int = PROBES,
    id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the nearest other rows that were found.

    Rows whose id or vector is null, or whose vector is all zero, holds a null or non-finite
    component or is not as long as most, take no part. Rows that agree in id and vector count
    once. ``score`` is the Euclidean distance in double precision; ties go to the smaller id. A query
    with fewer than ``neighbours`` found is searched again in all buckets of one table, which
    hold every row.
    """
    # Floats stay floats; any other numbers are held as doubles.
    kind = "float" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "double"
    rows = shipped(vectors).select(F.col(id).alias("id"), F.col(embedding).cast(f"array<{kind}>").alias("embedding"), is_query.alias("asks"))
    lengths = rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("n")).count()
    usual = lengths.orderBy(F.desc("count"), "n").first()
    size = usual["n"] if usual else 1
    axes = 2 << max(0, int(np.ceil(np.log2(size))))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("embedding"), size))
    keep = neighbours + 1
    # The smallest ids of each class of equal vectors, counted off before and after the shuffle.
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("id"))
    small = rows.select("id", "embedding").distinct().withColumn("place", place).where(F.col("place") <= keep)
    classes = small.groupBy("embedding").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # A class goes by the hash of its vector: an id may come with several vectors.
    classes = stored(classes.select(F.xxhash64("embedding").alias("class"), F.col("ids")[0].alias("first"), "embedding", "ids"), "classes")
    asking = rows.where("asks").select("id", "embedding").distinct()
    queries = stored(asking.join(classes.select("class", "embedding"), "embedding").select(F.col("id").alias("query_id"), "class"), "queries")
    wanted = classes.join(queries.select("class").distinct(), "class", "left_semi")
    index = _hashed(classes, tables, 1, axes)
    # One row for each bucket, at most tables times axes whatever the number of vectors.
    counts = index.groupBy("key").count().limit(tables * axes)
    slots = F.broadcast(stored(counts.select("key", F.ceil(F.col("count") / SLOT).alias("slots")), "slots"))
    best = stored(_best(_search(index, slots, _hashed(wanted, tables, probes, axes), keep), keep), "best")
    reached = best.join(classes.select("class", F.size("ids").alias("n")), "class").groupBy("query").agg(F.sum("n").alias("n"))
    thin = wanted.join(reached.where(F.col("n") >= keep), wanted["class"] == F.col("query"), "left_anti")
    everywhere = thin.select(F.explode(F.sequence(F.lit(0), F.lit(axes - 1))).alias("key"), "class", "first", "embedding")
    again = _search(index.where(F.col("key") < axes), slots, everywhere, keep)
    best = _best(best.union(again), keep)
    ids = best.join(classes.select("class", "ids"), "class").select("query", "distance", F.explode("ids").alias("id"))
    lists = ids.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))
    own = queries.join(lists, queries["class"] == lists["query"])
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, neighbours)
    ranked = own.select("query_id", F.posexplode(others).alias("at", "found"))
    return ranked.select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("found.id").alias("vec_id"), F.col("found.distance").alias("score")
    )
