"""Groups of linked items: candidates that share a bucket, verified, without all pairs of a bucket.

Only DataFrame operations. Links are facts that ``verify`` has established, so which pairs are
tried first changes the work and never the groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import stored


def components(links: DataFrame, longest: int = 100) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Large-star and small-star steps in turn, each a minimum by node and a join, until nothing
    changes; the number of rounds grows with the logarithm of the longest chain. A node with very
    many links is summed in the map tasks and its join can be split, so it needs no task alone.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = stored(edges, "edges"), None
    for _ in range(longest):
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % (1 << 31))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
            ).distinct()
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a").where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
        edges = stored(small.union(least).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {longest} rounds")


def linked_components(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    near: Callable[[Column, Column], Column],
    details: DataFrame | None = None,
    alike: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(node, component) of all items linked to another one.

    ``members`` has bucket, item, weight and mark; two items may be linked only if in a bucket
    that they share ``near`` holds for their marks, and ``alike`` for their ``details``, a table
    (item, detail) joined only to what the second pass is about. ``verify`` gets distinct pairs (a, b)
    and returns those that are linked. In a first pass every item is tried with the heaviest and
    the smallest item of its bucket. That joins what is a group of copies. In a second pass pairs
    are tried that share a bucket and are still in different components; pairs within a
    component need no test, as they could not change it, and a bucket of two was tried in full.
    """
    centers = members.groupBy("bucket").agg(
        F.max_by("item", "weight").alias("heavy"),
        F.max_by("mark", "weight").alias("heavy_mark"),
        F.min("item").alias("low"),
        F.max("item").alias("high"),
        F.min_by("mark", "item").alias("low_mark"),
    ).where("low < high")
    shared = stored(members.join(centers, "bucket"), "members")

    def pairs_with(center: str) -> DataFrame:
        found = shared.where((F.col("item") != F.col(center)) & near(F.col("mark"), F.col(f"{center}_mark")))
        return found.select(F.least("item", center).alias("a"), F.greatest("item", center).alias("b"))

    tried = stored(pairs_with("heavy").union(pairs_with("low")).distinct(), "pairs")
    links = stored(verify(tried), "links")
    labels = stored(components(links), "labels")
    named = shared.select("bucket", "item", "mark").join(labels.withColumnRenamed("node", "item"), "item", "left")
    named = named.select("bucket", "item", "mark", F.coalesce("component", "item").alias("part"))
    split = named.groupBy("bucket").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count(F.lit(1)).alias("items"))
    open_members = named.join(split.where("least < most and items > 2").select("bucket"), "bucket", "left_semi")
    if details is not None:
        open_members = open_members.join(details, "item")
    open_members = stored(open_members, "open")
    names = [c for c in open_members.columns if c != "bucket"]
    left, right = (open_members.select("bucket", *(F.col(c).alias(f"{side}_{c}") for c in names)) for side in ("l", "r"))
    apart = (F.col("l_item") < F.col("r_item")) & (F.col("l_part") != F.col("r_part")) & near(F.col("l_mark"), F.col("r_mark"))
    if details is not None and alike is not None:
        apart = apart & alike(F.col("l_detail"), F.col("r_detail"))
    rest = left.join(right, (left["bucket"] == right["bucket"]) & apart)
    rest = rest.select(F.col("l_item").alias("a"), F.col("r_item").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = stored(verify(stored(rest, "pairs")), "links")
    return components(links.union(more))
