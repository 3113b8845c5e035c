import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import lexical, sharding, trie

TURNS = "conv_id bigint, turn bigint, role string, text string"
NODE = list(trie.NODE)


# -- prefix trie -----------------------------------------------------------------------


def plain_trie(rows):
    """Every node from the sequences themselves."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        rebuilt = own.get(conv - math.fmod(conv, 20), [])[:h] + turns[h:]
        for depth in range(len(rebuilt) + 1):
            members[tuple(rebuilt[:depth])].append((conv, len(rebuilt)))
    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    found = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        has_child = {n[:-1] for n in members if n}
        ends = sorted(c for c, size in convs if size == len(node))
        found.append(
            (
                min(convs)[0],
                len(node),
                min(members[node[:-1]])[0] if node else None,
                len(convs),
                sum(n[:-1] == node for n in below if n),
                sum(n not in has_child for n in below),
                sum((len(members[n]) - 1) * words(n) for n in below),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(found, key=str)


def trie_rows(frame):
    return sorted((tuple(r[c] for c in NODE) for r in frame.select(*NODE).collect()), key=str)


def made_up(count, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        size = rng.choice([1, 2, 3, 5]) if conv % 17 else 70
        kind = rng.randrange(4)
        for turn in range(size):
            text = f"turn {turn if rng.random() < 0.8 else rng.randrange(9)} of {kind}" if rng.random() < 0.95 else None
            rows.append((conv, turn if rng.random() < 0.97 else None, rng.choice(["user", "user", None]), text))
    return rows


@pytest.mark.parametrize("shard_turns", [20_000, 60, 7])
def test_trie_equals_plain_one(spark, shard_turns, monkeypatch):
    monkeypatch.setattr(trie, "FAN", 4)
    rows = made_up(90, 3)
    frame = spark.createDataFrame(rows, TURNS)
    found = trie.prefix_trie(trie.shared_heads(trie.turn_sequences(frame)), shard_turns)
    assert trie_rows(found) == plain_trie(rows)


def test_group_of_equal_conversations_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 16)
    rows = [(20 * c + 1, t, "user", f"line {t}") for c in range(400) for t in range(3)]
    frame = spark.createDataFrame(rows, TURNS)
    assert trie_rows(trie.prefix_trie(trie.shared_heads(trie.turn_sequences(frame)), 100)) == plain_trie(rows)


def test_odd_conversations(spark):
    rows = [
        (0, None, None, None),
        (0, 1, "user", "a b"),
        (0, 1, "user", "a b"),
        (2, 0, "", ""),
        (7, 5, "user", "x" * 5000),
        (23, 1, "a", "no base"),
        (-21, 1, "a", "below zero"),
        (-20, 1, "a", "base below zero"),
        (None, 1, "a", "no id"),
    ]
    frame = spark.createDataFrame(rows, TURNS).select("*", F.lit("own").alias("turns"), F.lit(1).alias("path"), F.lit(2).alias("base"))
    assert trie_rows(trie.conversation_trie(frame)) == plain_trie(rows)


def test_no_conversations(spark):
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []


def test_bands_do_not_change_levels():
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 9, 200)
    offsets = np.cumsum(lengths) - lengths
    ids = rng.integers(0, 2, (int(lengths.sum()), 2))
    conv, words = rng.permutation(200), np.ones(len(ids), np.int64)
    wide = trie.trie_levels(conv, lengths, offsets, ids, words)
    for band in (1, 2, 3):
        for left, right in zip(wide, trie.trie_levels(conv, lengths, offsets, ids, words, band), strict=True):
            assert all(np.array_equal(left[name], right[name]) for name in ("parent", "n", "conv", "words", "ends", "ends_at"))


# -- ranked search -----------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, top):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    sizes = [sum(bag.values()) for _, bag in bags]
    documents, terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(term for _, bag in bags for term in bag)
    found = []
    for item, text in set(items):
        ranked = []
        for (doc, bag), n in zip(bags, sizes, strict=True):
            if not n:
                continue
            m = 50 + (50 * n * documents) // terms
            score = sum(
                math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
                for t in set(plain_terms(text))
                if bag[t]
            )
            if score > 0:
                ranked.append((-score, doc is not None, doc or 0))
        for rank, (score, _, doc) in enumerate(sorted(ranked)[:top], 1):
            found.append((item, rank, doc, -score))
    return sorted(found)


def search_rows(frame):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect())


@pytest.mark.parametrize("batch_terms", [200_000, 40])
def test_search_equals_plain_one(spark, sf_dir, batch_terms):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id < 12")
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 50)
    assert search_rows(lexical.ranked_search(docs, items, batch_terms=batch_terms)) == want


def test_search_of_copies_and_odd_rows(spark):
    docs = [(i, "Same words, same words here") for i in range(200, 80, -1)] + [
        (1, None), (2, ""), (3, "?!"), (4, "ÄÖ äö SAME é１"), (4, "words words"), (5, "word " * 30_000 + "rare"), (6, "same\x00here"),
    ]
    items = [(1, "same WORDS"), (2, None), (3, "..."), (4, "ÄÖ rare"), (4, "here"), (4, "here"), (5, "unheard of")]
    frames = [spark.createDataFrame(rows, f"{name} bigint, text string") for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    frames = [f.select("*", *(F.lit("own").alias(c) for c in ("terms", "tfs", "m", "bag", "score", "n"))) for f in frames]
    for top in (50, 7):
        assert search_rows(lexical.ranked_search(*frames, top=top)) == plain_search(docs, items, top)


def test_search_in_empty_tables(spark, no_docs):
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.ranked_search(no_docs, items).collect() == []
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    assert lexical.ranked_search(docs, items.where("false")).collect() == []


def test_length_value_beyond_64_bits(spark):
    n, documents, terms = 10**8, 3 * 10**10, 10**13
    row = spark.range(1).select(lexical.length_value(F.lit(n), documents, terms).alias("m")).first()
    assert row.m == 50 + 50 * n * documents // terms


def test_scores_need_no_exchange_of_their_own(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    found = lexical.ranked_search(docs, items)
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.count("WindowGroupLimit") >= 3 and "CartesianProduct" not in plan
    assert "hashpartitioning(bag#" in plan and ", item#" not in "".join(x for x in plan.split("\n") if "hashpartitioning(bag" in x)


# -- sharding ----------------------------------------------------------------------------


def test_digests_of_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sharding.shard_digests(docs).collect()
    want = {r.doc_id: (len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == want and len(rows) == len(want)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(by_shard[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert rows and [tuple(r) for r in sharding.shard_digests(docs).sort("doc_id").collect()] == sorted(map(tuple, rows))


def test_whole_rows_in_blocks(spark, clashing_docs, edge_docs):
    extra = clashing_docs  # among them block and place
    found = sharding.shuffle_into_shards(extra, shards=3, block_rows=2)
    assert found.columns == [*extra.columns, "shard", "slot"]
    key = lambda rows: sorted(map(str, rows))
    assert key(found.select(*edge_docs.columns).collect()) == key(edge_docs.collect())
    assert sorted((r.shard, r.slot) for r in found.collect()) == [(s, i) for s in range(3) for i in range(5 if s < 2 else 4)]


def test_no_rows_and_fewer_rows_than_shards(spark, no_docs):
    assert sharding.shard_digests(no_docs).collect() == []
    few = sharding.shuffle_into_shards(spark.range(3), shards=5).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]


def test_written_shards(spark, tmp_path, real_docs):
    sharding.write_shards(real_docs, str(tmp_path / "out"), shards=5)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert {r.shard: r["count"] for r in found.groupBy("shard").count().collect()} == dict.fromkeys(range(5), 40)


@pytest.mark.parametrize("limit", [sharding.NUMPY_TOTAL, 30])
def test_lines_of_the_matrix_add_up(monkeypatch, limit):
    monkeypatch.setattr(sharding, "NUMPY_TOTAL", limit)
    parts = np.array([0, 7, 100, 1, 0, 23, 369])
    starts = np.concatenate(([0], np.cumsum(parts)))
    _, _, sizes = sharding.block_sizes(int(parts.sum()), 7, 40)
    lines = np.array([sharding.matrix_line(starts, sizes, p, 11) for p in range(len(parts))])
    assert (lines.sum(axis=1) == parts).all() and (lines.sum(axis=0) == sizes).all() and (lines >= 0).all()


@pytest.mark.parametrize("limit", [sharding.NUMPY_TOTAL, 2])
def test_counts_follow_the_hypergeometric_law(monkeypatch, limit):
    monkeypatch.setattr(sharding, "NUMPY_TOTAL", limit)
    rng = np.random.default_rng(1)
    drawn = Counter(sharding.hypergeometric(rng, 5, 7, 4) for _ in range(20_000))
    for k in range(5):
        chance = math.comb(5, k) * math.comb(7, 4 - k) / math.comb(12, 4)
        assert abs(drawn[k] / 20_000 - chance) < 5 * math.sqrt(chance / 20_000)


def test_counts_of_very_large_totals():
    rng = np.random.default_rng(2)
    good, bad, draws = 12 * 10**9, 18 * 10**9, 5 * 10**9
    drawn = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(200)], float)
    mean = draws * good / (good + bad)
    deviation = math.sqrt(mean * (bad / (good + bad)) * (good + bad - draws) / (good + bad - 1))
    assert abs(drawn.mean() - mean) < 5 * deviation / math.sqrt(200) and 0.8 < drawn.std() / deviation < 1.2


def test_every_order_is_about_as_likely(spark):
    """Four rows in two partitions, two shards of two: all 24 orders, over many seeds."""
    frame = spark.range(0, 4, 1, 2).cache()
    orders = Counter()
    for seed in range(240):
        rows = sharding.shuffle_into_shards(frame, 2, seed, from_files=True).collect()
        orders[tuple(r.id for r in sorted(rows, key=lambda r: (r.shard, r.slot)))] += 1
    # chi-square of 23 degrees of freedom: above 50 with a chance of 0.001
    assert len(orders) >= 22 and sum((orders[o] - 10) ** 2 / 10 for o in orders) + 10 * (24 - len(orders)) < 50
