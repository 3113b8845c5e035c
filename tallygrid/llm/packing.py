"""Packing of documents into sequences of several permitted lengths.

Best fit over open bins of all sizes: a piece goes where it leaves the least room. If it fits
nowhere, that size is opened whose cost for each word it may come to hold is least. In the end
every bin is cut down to the smallest permitted length that holds its contents.

Documents longer than the largest length are cut into pieces of it. Pieces are dealt over shards
of bounded size by a hash and every shard is packed on its own, so no task grows with the input,
whatever the lengths or ids; a shard leaves at most a few bins part full.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import shipped, stored

CAPACITIES = (512, 1024, 2048, 4096)
SHARD_PIECES = 20_000
PACKED = "row long, piece int, bin_id long, capacity int, offset int"


def bin_cost(capacity: int) -> float:
    """What a sequence costs: a fixed part, one for each word, and one that grows with its square."""
    return 64 + capacity + capacity**2 / 32768


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, int, int]]:
    """(bin, capacity, offset) of each piece; the longest are placed first, ties in the given order.

    ``lengths`` are from 1 to the largest capacity.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    left = sum(lengths)
    rooms: list[int] = []  # the different free rooms of open bins, ascending
    open_bins: dict[int, list[int]] = {}  # bins by their room
    size, used, placed = [], [], [(0, 0)] * len(lengths)
    for i in order:
        length = lengths[i]
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
        else:
            # A bin comes to hold its capacity at most, and no more than is still to be placed.
            room = min((c for c in capacities if c >= length), key=lambda c: (bin_cost(c) / min(c, left), c))
            chosen = len(size)
            size.append(room)
            used.append(0)
        placed[i] = (chosen, used[chosen])
        used[chosen] += length
        left -= length
        room -= length
        if room:
            if room not in open_bins:
                insort(rooms, room)
                open_bins[room] = []
            open_bins[room].append(chosen)
    final = [min(c for c in capacities if c >= held) for held in used]
    return [(chosen, final[chosen], offset) for chosen, offset in placed]


def pack_documents(docs: DataFrame, text: str = "text", id: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """One row for each piece: id, piece, first_word, n_words, bin_id, capacity, offset.

    Lengths count words parted by white space. ``offset`` is where the piece begins in its bin,
    ``bin_id`` is unique over all bins. A null text or one without words takes no room: it has one
    row of 0 words whose bin is null. Repeated rows are packed each for itself. Other columns are
    not read.
    """
    largest = max(capacities)
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0))
    # Written out, so that row numbers stay what they are.
    rows = stored(docs.select(F.col(id).alias("id"), words.alias("words"), F.monotonically_increasing_id().alias("row")), "lengths")
    starts = F.sequence(F.lit(0), F.greatest(F.col("words") - 1, F.lit(0)), F.lit(largest))
    pieces = rows.select("id", "row", "words", F.posexplode(starts).alias("piece", "first_word"))
    pieces = pieces.withColumn("n_words", F.least(F.col("words") - F.col("first_word"), F.lit(largest))).drop("words")
    shards = max(1, -(-pieces.where("n_words > 0").count() // SHARD_PIECES))

    def pack_shard(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["id", "row", "piece"], kind="stable")
        placed = np.array(pack(shard["n_words"].tolist(), capacities), np.int64).reshape(-1, 3)
        return pd.DataFrame(
            {
                "row": shard["row"].to_numpy(),
                "piece": shard["piece"].to_numpy(),
                "bin_id": (key[0] << 32) + placed[:, 0],
                "capacity": placed[:, 1],
                "offset": placed[:, 2],
            }
        )

    shard = F.pmod(F.xxhash64("id", "row", "piece"), F.lit(shards)).alias("shard")
    dealt = shipped(pieces).where("n_words > 0").select(shard, "id", "row", "piece", "n_words")
    packed = dealt.groupBy("shard").applyInPandas(pack_shard, PACKED)
    found = pieces.join(packed, ["row", "piece"], "left")
    return found.select(F.col("id").alias(id), "piece", "first_word", "n_words", "bin_id", "capacity", "offset")
