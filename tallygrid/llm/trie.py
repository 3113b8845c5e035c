"""Trie of conversation prefixes from sorted matrices of turn ids.

Every turn becomes a 126-bit id, a conversation the array of its ids. Conversations are dealt out in
the order of these arrays, then conv_id, to range shards, so that all that begin alike are next to
each other and even a group of equal ones is spread over shards. In a shard the ids lie
in a matrix padded to a common length, whose rows are put in order by lexsort; where a column differs
from the row above, or one before it did, a node begins, and ``reduceat`` sums up the rows of every
node at every depth. Long conversations do not widen the matrix of all: it is made in bands of
``BAND`` turns, and a band has only the rows that reach it.

A node that is not on the way to the first or the last row of its shard lies in that shard whole
and is done there. The others, at most two for each depth and shard, carry partial figures: these are
added up over groups of neighbouring shards, again and again, until one group is left; in each round
only what lies on the outer edges of a group stays open. The hash over the ids that end at an open
node needs them in order; they pass as pieces through one task a node, which holds one piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.llm.common import shipped, stored, text_of

WORD = r"[^\x20\x09-\x0D]+"
#: Turns in a shard, unless that makes more than so many shards; columns of a matrix; shards added up at once.
SHARD_TURNS, MOST_SHARDS, BAND, FAN = 20_000, 10_000, 32, 64
#: Ids in a piece of an unfinished list.
PIECE = 4_096
NO_ENDS = hashlib.sha256(b"").hexdigest()
INSIDE, EDGE, ENDS = 0, 1, 2
SHARD_ROWS = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),
        T.StructField("shard", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("above", T.BinaryType()),
        T.StructField("edge", T.IntegerType()),
        T.StructField("conv_id", T.LongType()),
        T.StructField("depth", T.LongType()),
        T.StructField("parent_conv_id", T.LongType()),
        T.StructField("n_convs", T.LongType()),
        T.StructField("n_children", T.LongType()),
        T.StructField("n_leaves", T.LongType()),
        T.StructField("saved_tokens", T.LongType()),
        T.StructField("words", T.LongType()),
        T.StructField("ends_sha256", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ids", T.StringType()),
    ]
)
ARROW = {"integer": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (turn, high, low, words).

    The order is by turn, null first; turns of equal number are ordered by their ids, which depend on role
    and text alone. A null role or text counts as empty. Rows without a conv_id belong to no
    conversation and are left out.
    """
    role, text = text_of("role"), text_of("text")
    positive = F.lit((1 << 63) - 1)
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).bitwiseAND(positive).alias("high"),
        F.xxhash64(F.lit(2), text, role).bitwiseAND(positive).alias("low"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def shared_heads(sequences: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """The conversations with their first h turns taken from conversation c - c % every, h = crc32(c) % heads.

    If that has fewer turns all of them are taken, if there is none nothing; then the own turns after the first h
    follow. A conversation may be left without turns.
    """
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    given = sequences.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head")
    )
    joined = sequences.select(base, "conv_id", "turns").join(given, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def sorted_rows(rows: np.ndarray, group: np.ndarray, conv: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The order of the rows by group, columns of the matrix, conv_id."""
    columns = [matrix[:, at] for at in range(matrix.shape[1] - 1, -1, -1)]
    return np.lexsort((conv[rows], *columns, group))


def trie_levels(conv: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, ids: np.ndarray, words: np.ndarray, band: int = BAND) -> list[dict]:
    """For every depth the nodes in order: parent, first row, figures, and the rows that end there.

    ``ids`` has two columns, high and low; the turns of row r are those from ``offsets[r]`` on.
    """
    count = len(conv)
    levels = [
        {
            "parent": np.zeros(1, np.int64),
            "row": np.zeros(1, np.int64),
            "n": np.array([count]),
            "conv": np.array([conv.min()]),
            "words": np.zeros(1, np.int64),
        }
    ]
    node_of = np.zeros(count, np.int64)
    ended = np.sort(conv[lengths == 0])
    levels[0]["ends"], levels[0]["ends_at"] = ended, np.array([0, len(ended)])
    rows, start = np.flatnonzero(lengths > 0), 0
    group = np.zeros(len(rows), np.int64)
    while len(rows):
        width = int(min(band, lengths[rows].max() - start))
        held = np.minimum(lengths[rows] - start, width)
        matrix = np.full((len(rows), 2 * width), -1, np.int64)
        line = np.repeat(np.arange(len(rows)), held)
        place = np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held)
        taken = np.repeat(offsets[rows] + start, held) + place
        matrix[line, 2 * place], matrix[line, 2 * place + 1] = ids[taken, 0], ids[taken, 1]
        order = sorted_rows(rows, group, conv, matrix)
        rows, group, matrix = rows[order], group[order], matrix[order]
        starts = np.empty(len(rows), bool)
        starts[0] = True
        starts[1:] = group[1:] != group[:-1]
        for at in range(width):
            pair = matrix[:, 2 * at : 2 * at + 2]
            starts[1:] |= (pair[1:] != pair[:-1]).any(axis=1)
            depth = start + at + 1
            here = np.flatnonzero(lengths[rows] >= depth)
            of = np.cumsum(starts)[here]
            first = np.flatnonzero(np.diff(of, prepend=-1))
            members, heads = rows[here], rows[here[first]]
            n = np.diff(first, append=len(here))
            level = {
                "parent": node_of[heads],
                "row": heads,
                "n": n,
                "conv": np.minimum.reduceat(conv[members], first),
                "words": words[offsets[heads] + depth - 1],
            }
            node_of[members] = np.repeat(np.arange(len(first)), n)
            # Rows that end in one node are neighbours in order of conv_id.
            last = members[lengths[members] == depth]
            level["ends"] = conv[last]
            level["ends_at"] = np.searchsorted(node_of[last], np.arange(len(first) + 1))
            levels.append(level)
        group = np.cumsum(starts)
        more = lengths[rows] > start + width
        rows, group, start = rows[more], group[more], start + width
    return levels


def outer_paths(levels: list[dict]) -> list[dict[int, int]]:
    """For every depth the nodes on the way to the first row (bit 1) and to the last row (bit 2) in order."""
    marks: list[dict[int, int]] = [{0: 3}] + [{} for _ in levels[1:]]
    for bit in (1, 2):
        node = 0
        for depth in range(len(levels)):
            marks[depth][node] = marks[depth].get(node, 0) | bit
            level = levels[depth]
            if depth + 1 == len(levels) or (bit == 1 and level["ends_at"][node + 1] > level["ends_at"][node]):
                break  # shorter rows come first
            parents = levels[depth + 1]["parent"]
            low, high = np.searchsorted(parents, [node, node + 1])
            if low == high:
                break
            node = int(low if bit == 1 else high - 1)
    return marks


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _batch(size: int, **columns) -> pa.RecordBatch:
    """Rows of ``SHARD_ROWS``; a column is an array, one value for all, or left out for nulls."""
    arrays = []
    for field in SHARD_ROWS.fields:
        kind, column = ARROW[field.dataType.typeName()], columns.get(field.name)
        if isinstance(column, pa.Array):
            arrays.append(column)
        elif isinstance(column, np.ndarray | list | range):
            arrays.append(pa.array(column, kind))
        else:
            arrays.append(pa.repeat(pa.scalar(column, kind), size))
    return pa.RecordBatch.from_arrays(arrays, names=SHARD_ROWS.names)


def shard_table(
    shard: int, conv: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, ids: np.ndarray, words: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """The rows of ``SHARD_ROWS`` that one shard gives: whole nodes, partial ones, and lists of ids."""
    levels = trie_levels(conv, lengths, offsets, ids, words)
    marks = outer_paths(levels)
    keys: list[dict[int, bytes]] = [{0: b""}]
    for depth in range(1, len(levels)):
        level = levels[depth]
        keys.append({})
        for node in marks[depth]:
            turn = ids[offsets[level["row"][node]] + depth - 1].tobytes()
            path = keys[depth - 1][int(level["parent"][node])] + turn
            keys[depth][node] = hashlib.blake2b(path, digest_size=16).digest()
    below = None
    for depth in range(len(levels) - 1, -1, -1):
        level, open_nodes = levels[depth], marks[depth]
        size = len(level["n"])
        children, leaves, saved = (np.zeros(size, np.int64) for _ in range(3))
        if below is not None and len(below["at"]):
            at = below["at"]
            runs = np.flatnonzero(np.diff(at, prepend=-1))
            children[at[runs]] = np.diff(runs, append=len(at))
            leaves[at[runs]] = np.add.reduceat(below["leaves"], runs)
            saved[at[runs]] = np.add.reduceat(below["saved"], runs)
        done = np.ones(size, bool)
        done[list(open_nodes)] = False
        leaves[done & (children == 0)] = 1
        saved[done] += (level["n"][done] - 1) * level["words"][done]
        digests, cuts = [NO_ENDS] * size, level["ends_at"]
        for node in np.flatnonzero((np.diff(cuts) > 0) & done):
            digests[node] = hashlib.sha256(_joined(level["ends"][cuts[node] : cuts[node + 1]]).encode()).hexdigest()
        above, key, edge = [None] * size, [None] * size, np.zeros(size, np.int32)
        parent_conv = pa.nulls(size, pa.int64())
        if depth:
            open_above = np.isin(level["parent"], list(marks[depth - 1]))
            parent_conv = pa.array(levels[depth - 1]["conv"][level["parent"]], pa.int64(), mask=open_above)
            for node in np.flatnonzero(open_above):
                above[node] = keys[depth - 1][int(level["parent"][node])]
        for node, bits in open_nodes.items():
            key[node], edge[node] = keys[depth][node], bits
        yield _batch(
            size,
            kind=np.where(done, INSIDE, EDGE),
            shard=shard,
            key=key,
            above=above,
            edge=edge,
            conv_id=level["conv"],
            depth=depth,
            parent_conv_id=parent_conv,
            n_convs=level["n"],
            n_children=children,
            n_leaves=leaves,
            saved_tokens=saved,
            words=level["words"],
            ends_sha256=digests,
        )
        for node in open_nodes:
            ends = level["ends"][cuts[node] : cuts[node + 1]]
            pieces = [_joined(ends[at : at + PIECE]) for at in range(0, len(ends), PIECE)]
            yield _batch(len(pieces), kind=ENDS, shard=shard, key=keys[depth][node], seq=range(len(pieces)), ids=pieces)
        below = {"at": level["parent"][done], "leaves": leaves[done], "saved": saved[done]}


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    turns, words = (rows.column(name).combine_chunks() for name in ("path", "words"))
    offsets = words.offsets.to_numpy().astype(np.int64)
    yield from shard_table(
        TaskContext.get().partitionId(),
        rows.column("conv_id").to_numpy(),
        np.diff(offsets),
        offsets[:-1],
        turns.values.to_numpy().reshape(-1, 2),
        words.values.to_numpy(),
    )


EDGE_ROWS = T.StructType([f for f in SHARD_ROWS.fields if f.name not in ("ends_sha256", "seq", "ids", "parent_conv_id")])


def add_edges(part: pd.DataFrame, last: bool) -> pd.DataFrame:
    """One row for each open node of some neighbouring shards; those that lie in them whole are completed.

    Completed rows get kind ``INSIDE`` and have passed their leaves and savings on to the node above.
    """
    first_shard, last_shard = part["shard"].min(), part["shard"].max()
    outer: dict[bytes, int] = {}
    for key, shard, edge in zip(part["key"], part["shard"], part["edge"], strict=True):
        bits = (edge & 1 if shard == first_shard else 0) | (edge & 2 if shard == last_shard else 0)
        outer[key] = outer.get(key, 0) | int(bits)
    whole = part.groupby("key", sort=False).agg(
        {"above": "first", "conv_id": "min", "depth": "first", "n_convs": "sum", "words": "first"}
        | {name: "sum" for name in ("n_children", "n_leaves", "saved_tokens")}
    )
    nodes = {key: row for key, row in zip(whole.index, whole.reset_index().to_dict("records"), strict=True)}
    for key in sorted(nodes, key=lambda k: -nodes[k]["depth"]):
        node = nodes[key]
        node["edge"], node["kind"] = outer[key], EDGE if outer[key] and not last else INSIDE
        if node["kind"] == EDGE:
            continue
        if not node["n_children"]:
            node["n_leaves"] = 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
        if node["depth"]:
            up = nodes[node["above"]]
            up["n_children"] += 1
            up["n_leaves"] += node["n_leaves"]
            up["saved_tokens"] += node["saved_tokens"]
    return pd.DataFrame(list(nodes.values())).assign(shard=first_shard)[[f.name for f in EDGE_ROWS.fields]]


def _adder(last: bool):
    def add(part: pd.DataFrame) -> pd.DataFrame:
        return add_edges(part, last)

    return add


def _open_nodes(edges: DataFrame, shards: int) -> DataFrame:
    """The partial nodes of all shards, completed: by groups of ``FAN`` neighbours, then groups of groups."""
    complete, apart, width = None, shards, 1
    while True:
        width *= FAN
        last = apart <= FAN

        group = F.floor(F.col("shard") / width).alias("group")
        made = stored(edges.groupBy(group).applyInPandas(_adder(last), EDGE_ROWS), "edges")
        done = made.where(F.col("kind") == INSIDE)
        complete = done if complete is None else complete.unionByName(done)
        if last:
            return complete
        edges, apart = made.where(F.col("kind") == EDGE), -(-apart // FAN)


def _list_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of lists whose pieces come in order, one list after the other."""
    names, digest, key = ["key", "ends_sha256"], None, None

    def finished() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=names)

    for batch in batches:
        for piece_key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if digest is None or piece_key != key:
                if digest is not None:
                    yield finished()
                digest, key = hashlib.sha256(ids.encode()), piece_key
            else:
                digest.update(b"," + ids.encode())
    if digest is not None:
        yield finished()


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each node of the trie over (conv_id, turns), as ``turn_sequences`` gives them.

    conv_id is the smallest member; parent_conv_id that of the node above (null at the root); n_convs
    the members; n_leaves and saved_tokens sum over the subtree; ends_sha256 hashes the ids of members that
    end at the node, in ascending order, joined by commas. A conversation without turns is a member of the root
    alone. No conversations give no rows, not even a root. Turns are told apart by 126 bits of hashes. One conversation is
    one row, 24 bytes a turn.
    """
    rows = sequences.select(
        "conv_id",
        F.flatten(F.transform("turns", lambda t: F.array(t["high"], t["low"]))).alias("path"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
    )
    rows = stored(rows, "sequences")
    turns = rows.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    shards = int(min(MOST_SHARDS, max(1, -(-turns // shard_turns))))
    dealt = shipped(rows).repartitionByRange(shards, "path", "conv_id")
    made = stored(dealt.mapInArrow(_shard_nodes, SHARD_ROWS), "shard-nodes")
    # A run that deals to more shards than asked for is told by the numbers of the shards.
    shards = (made.agg(F.max("shard")).first()[0] or 0) + 1
    edges = made.where(F.col("kind") == EDGE)
    opened = _open_nodes(edges.select(*(f.name for f in EDGE_ROWS.fields)), shards)
    pieces = made.where(F.col("kind") == ENDS).select("key", "shard", "seq", "ids")
    hashes = pieces.repartition("key").sortWithinPartitions("key", "shard", "seq").select("key", "ids")
    hashes = hashes.mapInArrow(_list_hashes, "key binary, ends_sha256 string")
    smallest = opened.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    opened = opened.join(hashes, "key", "left").join(smallest, "above", "left")
    opened = opened.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    # By shard and node above: no more rows of one key than a shard has nodes.
    of_shard = edges.select("shard", F.col("key").alias("above")).join(smallest, "above")
    of_shard = of_shard.withColumnRenamed("parent_conv_id", "found")
    inside = made.where(F.col("kind") == INSIDE).join(of_shard, ["shard", "above"], "left")
    inside = inside.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "found"))
    return inside.select(*NODE).unionByName(opened.select(*NODE))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations whose first turns were taken from every twentieth one."""
    return prefix_trie(shared_heads(turn_sequences(conversations)))


ORACLE = r"""
WITH bits AS (
    SELECT list_transform(range(256), lambda byte: list_reduce(
        [byte] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS steps
), turns AS (
    SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
        ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
    SELECT conv_id, turns, CAST(xor(4294967295, list_reduce([4294967295] || list_transform(
        string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
        lambda c, b: xor(steps[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8))) % 4 AS BIGINT) AS h
    FROM turns, bits
), rebuilt AS (
    SELECT a.conv_id, coalesce(b.turns[1:a.h], []) || a.turns[a.h + 1:] AS turns
    FROM heads a LEFT JOIN heads b ON b.conv_id = a.conv_id - a.conv_id % 20
), members AS (
    SELECT conv_id, len(turns) AS size, d AS depth, sha256(CAST(turns[1:d] AS VARCHAR)) AS node,
        CASE WHEN d > 0 THEN sha256(CAST(turns[1:d - 1] AS VARCHAR)) END AS above,
        CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
    FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT depth, node, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
        max(words) AS words,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
    FROM members GROUP BY depth, node
), children AS (
    SELECT depth - 1 AS depth, above AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), figures AS (
    SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, node)
), paths AS (
    SELECT DISTINCT m.depth AS depth, m.node AS node, a.depth AS up_depth, a.node AS up
    FROM members m JOIN members a ON a.conv_id = m.conv_id AND a.depth <= m.depth
), sums AS (
    SELECT p.up_depth AS depth, p.up AS node, count(*) FILTER (f.n_children = 0) AS n_leaves,
        sum((f.n_convs - 1) * f.words) AS saved_tokens
    FROM paths p JOIN figures f ON f.depth = p.depth AND f.node = p.node GROUP BY p.up_depth, p.up
)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children,
    s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM figures f JOIN sums s ON s.depth = f.depth AND s.node = f.node
LEFT JOIN nodes u ON u.depth = f.depth - 1 AND u.node = f.above
"""
