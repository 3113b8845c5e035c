"""Uniform shuffle of rows into shards of exact sizes, by a hypergeometric communication matrix.

A uniform random permutation of all rows, cut into blocks of given sizes, sends to each block a
number of rows of each input partition that follows a multivariate hypergeometric law. These counts
are drawn first, the communication matrix. Each task then deals its rows out by a random order of
the targets in its line of the matrix, rows are exchanged, and every block is put in random order.
Together that is one permutation, all of them equally likely.

No matrix is ever held: partitions are the leaves of a binary tree, each inner node has a random
generator of its own and splits the room left in all blocks between its two halves, and a task draws
along its own path only. So tasks agree without talking to each other, and a task that runs again
on another executor draws the same numbers. Blocks are of ``block_rows`` rows at most, whatever the size of
a shard, and texts or ids play no part, so no key makes one task larger than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.llm.common import shipped, stored, text_of, unused_names

SHARDS, BLOCK_ROWS, SEED = 24, 16_384, 7
#: What numpy draws from must be smaller.
NUMPY_TOTAL = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows drawn without return are among ``good``, for totals of any size.

    Beyond numpy's bound the probabilities around the mode are summed from the ratios of
    neighbours; what is left out beyond 15 deviations is far below the precision of a double.
    """
    if good + bad < NUMPY_TOTAL:
        return int(rng.hypergeometric(good, bad, draws)) if good and bad else (draws if good else 0)
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    share = good / total
    spread = 15 * (draws * share * (1 - share) * (total - draws) / max(1, total - 1)) ** 0.5 + 50
    mode = min(high, max(low, int((draws + 1) * (good + 1) / (total + 2))))
    first, last = max(low, int(mode - spread)), min(high, int(mode + spread))
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    chances = np.cumsum(np.exp(logs - logs.max()))
    return first + int(min(np.searchsorted(chances, rng.random() * chances[-1], side="right"), last - first))


def draw_counts(rng: np.random.Generator, room: np.ndarray, draws: int) -> np.ndarray:
    """How many of ``draws`` rows drawn without return fall into each block with the given room."""
    total = int(room.sum())
    if total < NUMPY_TOTAL:
        return rng.multivariate_hypergeometric(room, draws, method="marginals")
    if len(room) == 1:
        return np.array([draws], np.int64)
    half = len(room) // 2
    left = int(room[:half].sum())
    taken = hypergeometric(rng, left, total - left, draws)
    return np.concatenate((draw_counts(rng, room[:half], taken), draw_counts(rng, room[half:], draws - taken)))


def matrix_line(starts: np.ndarray, room: np.ndarray, part: int, seed: int) -> np.ndarray:
    """The line of partition ``part`` in the communication matrix: its rows for each block.

    ``starts`` has the number of rows before each partition, and the total; ``room`` the size of
    every block.
    """
    low, high = 0, len(starts) - 1
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = draw_counts(rng, room, int(starts[middle] - starts[low]))
        room, low, high = (left, low, middle) if part < middle else (room - left, middle, high)
    return room


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart, the larger ones first."""
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def block_sizes(rows: int, shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shard, first slot and size of each block; the blocks of a shard are equal but for one row."""
    owner, first, sizes = [], [], []
    for shard, size in enumerate(shard_sizes(rows, shards)):
        parts = np.array(shard_sizes(size, -(-size // block_rows)) if size else [], np.int64)
        owner.append(np.full(len(parts), shard, np.int32))
        first.append(np.cumsum(parts) - parts)
        sizes.append(parts)
    return np.concatenate(owner), np.concatenate(first).astype(np.int64), np.concatenate(sizes).astype(np.int64)


def shuffle_into_shards(
    frame: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS, from_files: bool = False
) -> DataFrame:
    """All rows and columns in uniformly random order, with ``shard`` (int) and ``slot`` (long).

    Shard sizes are at most one apart; slots count from 0 without gaps in each shard. The same input
    files, settings and seed give the same result. Repeated rows, nulls and empty texts are rows like any
    other; an empty table gives no row. Input columns called shard or slot are replaced by the
    result's. ``from_files`` says that the frame is a scan of files, whose partitions are the
    same in every job; any other frame is written out first, as its partitions may change between jobs. A
    partition that did change fails the job.
    """
    spark = frame.sparkSession
    frame = frame.drop("shard", "slot")
    if not from_files:
        frame = stored(frame, "rows-to-shuffle")
    result = T.StructType(frame.schema.fields + [T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    # One number for each partition.
    counted = dict(frame.groupBy(F.spark_partition_id()).count().collect())
    if not counted:
        return spark.createDataFrame([], result)
    parts = max(counted) + 1
    starts = np.concatenate(([0], np.cumsum([counted.get(part, 0) for part in range(parts)]))).astype(np.int64)
    block, origin, place = unused_names(frame, "block", "origin", "place")
    rows = int(starts[-1])
    plan = spark.sparkContext.broadcast((starts, *block_sizes(rows, shards, block_rows)))

    names = [*frame.columns, "shard", "slot", block, origin, place]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        starts, owner, first, sizes = plan.value
        line = matrix_line(starts, sizes, part, seed) if part < len(starts) - 1 else np.zeros(len(sizes), np.int64)
        targets = np.repeat(np.arange(len(line), dtype=np.int64), line)
        np.random.default_rng([seed, part, len(starts), 1]).shuffle(targets)
        done = 0
        for batch in batches:
            mine = targets[done : done + batch.num_rows]
            if len(mine) < batch.num_rows:
                raise RuntimeError(f"partition {part} has more rows than when they were counted")
            columns = [*batch.columns, pa.array(owner[mine]), pa.array(first[mine]), pa.array(mine)]
            columns += [pa.array(np.full(len(mine), part, np.int64)), pa.array(np.arange(done, done + len(mine)))]
            done += len(mine)
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if done < len(targets):
            raise RuntimeError(f"partition {part} has fewer rows than when they were counted")

    dealt = T.StructType(result.fields + [T.StructField(name, T.LongType()) for name in (block, origin, place)])
    sent = shipped(frame).mapInArrow(deal, dealt)
    # The second permutation: the rows of a block, whose size is bounded, by a hash of where they came from.
    order = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed), origin, place), origin, place)
    placed = sent.withColumn(place, F.row_number().over(order))
    kept = [F.col(f"`{name}`") for name in frame.columns]
    return placed.select(*kept, "shard", (F.col("slot") + F.col(place) - 1).alias("slot"))


def write_shards(frame: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Writes the shuffled rows as Parquet, a folder ``shard=N`` for each shard; ``slot`` has the order.

    A shard is written by as many tasks as it has blocks, since rows of a block stay together.
    """
    shuffle_into_shards(frame, shards, seed).write.partitionBy("shard").parquet(path)


def shard_digests(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, from the shuffled texts."""
    text = text_of().cast("binary")
    dealt = shuffle_into_shards(docs.select("doc_id", "text"), shards, from_files=True)
    return dealt.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
