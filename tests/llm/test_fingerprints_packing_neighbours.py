import functools
import hashlib
import math
import random
import struct

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallygrid.llm import ann, packing, syncmers


def test_edited_texts_and_likeness(spark, edge_docs, real_docs, no_docs):
    for docs in (edge_docs.where("doc_id is null or doc_id <> 12"), real_docs):
        rows = docs.select("doc_id", "text").collect()
        order = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
        texts = [r.text or "" for r in order]
        found = {r.doc_id: r for r in syncmers.edited_rows(docs).collect()}
        assert len(found) == len(rows)
        prints = {}
        for at, row in enumerate(order):
            text, after = texts[at], texts[(at + 1) % len(texts)]
            taken = len(text) // 3
            edited = text[: len(text) - taken] + after[:taken]
            got = found[row.doc_id]
            assert got.n_chars == len(text)
            assert got.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= got.near_edited <= 1 and 0 <= got.near_next <= 1
            assert prints.setdefault(text, got.fingerprint) == got.fingerprint
        near = [found[r.doc_id].near_edited for r, t in zip(order, texts) if len(t) > 300 and " " in t]
        assert np.mean(near) > 0.4
    assert syncmers.edited_rows(no_docs).count() == 0


def plain_units(text):
    """The units of a text, found character by character."""
    single = lambda c: any(a <= ord(c) <= b for a, b in ((0xE00, 0xEFF), (0x1780, 0x17FF), (0x2E80, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)))
    word = lambda c: c not in " \t\n\x0b\f\r" and not single(c)
    found, at = [], 0
    while at < len(text):
        end = at
        if single(text[at]):
            end = at + 1
        elif word(text[at]):
            while end < len(text) and end - at <= 8 and word(text[end]):
                end += 1
            if end - at > 8:
                end = at + 1
                while end - at < 8 and text[end] not in "aeiouAEIOU05":
                    end += 1
        if end == at:
            at += 1
            continue
        found.append(text[at:end])
        at = end
    return found


def plain_anchors(text):
    hashed = lambda *parts: functools.reduce(lambda seed, part: xxhash.xxh64(part, seed=seed).intdigest(), parts, 42)
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    units = plain_units(text)
    if not units:
        return []
    run = syncmers.RUN
    units = [f"\0<{i}" for i in range(1, run)] + units + [f"\0>{i}" for i in range(1, run)]
    pairs = [signed(hashed(a.encode(), b.encode())) for a, b in zip(units, units[1:])]
    found = []
    for at in range(len(units) - run + 1):
        window = pairs[at : at + run - 1]
        if min(window[0], window[-1]) <= min(window[1:-1]) or at in (0, len(units) - run):
            whole = hashed(*(struct.pack("<q", window[k]) for k in range(0, run - 1, 2)))
            found.append((whole & 0x7FFFFFFF, at - run + 1))
    return found


def test_anchors_and_places_equal_plain_ones(spark, edge_docs):
    rng = random.Random(4)
    texts = ["", " ", "a", "two words", "internationalization of extraordinarily long wordings", "本网站所有内容 abc未经许可", "ไทย text", "x" * 100]
    texts += ["".join(rng.choices("abcdefghij klm05\n", k=rng.randint(1, 400))) for _ in range(40)]
    texts += [r.text for r in edge_docs.collect() if r.text and len(r.text) < 30_000]
    frame = spark.createDataFrame([(t, "own") for t in texts], "text string, units string")
    found = syncmers.with_anchors(frame, places="places")
    assert found.columns == ["text", "units", "anchors", "places"]
    for row in found.collect():
        want = plain_anchors(row.text)
        assert (row.anchors, row.places) == ([h for h, _ in want], [at for _, at in want]), row.text[:80]
    same = syncmers.with_anchors(frame).select("text", "anchors").collect()
    assert {r.text: r.anchors for r in same} == {r.text: r.anchors for r in found.collect()}


def like(left, right):
    left, right = ({h for h, _ in plain_anchors(t)} for t in (left, right))
    return 2 * len(left & right) / (len(left) + len(right))


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "本网站所有内容未经许可不得转载或用于商业途违者必究"])
def test_one_character_in_a_long_text_without_spaces(letters):
    rng = random.Random(9)
    text = "".join(rng.choices(letters, k=3000))
    for at in (5, 1500):
        assert like(text, text[:at] + rng.choice(letters) + text[at:]) > 0.9


def test_one_rule_for_all_sizes():
    words = [f"word{i}" for i in range(60)]
    # A word more at the end touches the last RUN runs of the shorter text and RUN + 1 of the longer one, at any size.
    for size in range(2, 60):
        left, right = " ".join(words[:size]), " ".join(words[: size + 1])
        kept = {h for h, at in plain_anchors(left) if at < size - syncmers.RUN}
        assert kept <= {h for h, _ in plain_anchors(right)}
        assert like(left, right) > (0.5 if size >= 30 else 0.0)
    assert like("one", "other") < 1


def test_repeated_ids_have_one_row_each(edge_docs):
    assert syncmers.edited_rows(edge_docs).where("doc_id = 12").count() == 2


def test_ranges_of_ids_do_not_change_the_next_document(spark, monkeypatch):
    rows = [(int(i), f"text {i}") for i in np.random.default_rng(1).permutation(2000)[:300] ** 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(syncmers, "DOCS_EACH", 7)
    found = {r.doc_id: r.next.text for r in syncmers.with_next(docs, ["text"]).collect()}
    order = sorted(rows, reverse=True)
    assert found == {i: order[(at + 1) % len(order)][1] for at, (i, _) in enumerate(order)}


def test_anchors_do_not_depend_on_what_stands_around(spark):
    random = np.random.default_rng(2)
    words = [f"w{x}" for x in random.integers(0, 10**6, 400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "other start " + " ".join(words[20:]))], "doc_id long, text string")
    first, second = (set(r.anchors) for r in syncmers.with_anchors(docs).orderBy("doc_id").collect())
    assert len(first & second) > 0.85 * len(second) and 60 < len(first) < 180
    clash = docs.withColumn("anchors", F.lit("own"))
    assert syncmers.with_anchors(clash).columns == clash.columns


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4096), max_size=120))
def test_packing_holds_every_piece_once(lengths):
    placed = packing.pack(lengths)
    held = {}
    for length, (chosen, capacity, offset) in zip(lengths, placed):
        held.setdefault(chosen, (capacity, []))[1].append((offset, length))
        assert held[chosen][0] == capacity
    for capacity, parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        used = sum(n for _, n in parts)
        assert used <= capacity and capacity == min(c for c in packing.CAPACITIES if c >= used)
    # Two open bins of best fit can't both be less than half full of the largest size.
    assert sum(sum(n for _, n in p) * 2 <= 512 for _, p in held.values()) <= 1


def test_packing_of_documents(edge_docs, no_docs, clashing_docs, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 5)
    for docs in (edge_docs, clashing_docs):
        rows = packing.pack_documents(docs).collect()
        words = sorted(len((r.text or "").split()) for r in docs.collect())
        assert sum(r.n_words for r in rows) == sum(words)
        assert sum(r.bin_id is None for r in rows) == words.count(0) == 3
        assert sum(r.doc_id == 8 for r in rows) == -(-60_000 // 4096)
        for bin_id in {r.bin_id for r in rows} - {None}:
            parts = sorted((r.offset, r.n_words, r.capacity) for r in rows if r.bin_id == bin_id)
            assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))
            assert parts[-1][0] + parts[-1][1] <= parts[0][2]
    assert packing.pack_documents(no_docs).count() == 0


def brute(rows, queries, k=10):
    ids = np.array([i for i, _ in rows])
    data = np.array([v for _, v in rows], float)
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        away = np.sqrt(((data - data[at]) ** 2).sum(axis=1))
        yield q, [(int(ids[i]), away[i]) for i in np.lexsort((ids, away)) if i != at][:k]


@pytest.mark.parametrize("every", [10, 100])
@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_and_scores(spark, folder, every):
    vectors = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    found = ann.nearest_neighbours(vectors, F.col("vec_id") % every == 0).toPandas().sort_values(["query_id", "rank"])
    hits = total = 0
    for query, want in brute(rows, [i for i, _ in rows if i % every == 0]):
        mine = found[found["query_id"] == query]
        assert list(mine["rank"]) == list(range(1, len(want) + 1))
        exact = dict(next(brute(rows, [query], len(rows)))[1])
        assert np.allclose(mine["score"], [exact[i] for i in mine["vec_id"]], rtol=1e-12)
        hits += len(set(mine["vec_id"]) & {i for i, _ in want})
        total += len(want)
    assert hits / total >= 0.9


def test_doubles_and_an_id_with_two_vectors(spark):
    """Distances that floats cannot tell apart, and two vectors of one id."""
    rows = [(0, [1.0, 0.0]), (1, [1.0 + 2e-9, 0.0]), (2, [1.0 + 1e-9, 0.0]), (3, [0.0, 1.0]), (3, [5.0, 5.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((r["rank"], r.vec_id, r.score) for r in ann.nearest_neighbours(vectors, F.col("vec_id") == 0).collect())
    assert [i for _, i, _ in found] == [2, 1, 3, 3]
    assert [s for *_, s in found] == pytest.approx([1e-9, 2e-9, math.sqrt(2), math.sqrt(41)], rel=1e-6)


def test_odd_vectors_ties_and_few_candidates(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [-1.0, 0.0, 0.0]),
        (5, [2.0, 0.0, 0.0]), (6, [0.0, 0.0, 0.0]), (7, [nan, 0.0, 1.0]), (8, [inf, 0.0, 1.0]), (9, None), (10, [None, 1.0, 0.0]),
        (11, [1.0]), (None, [1.0, 1.0, 0.0]), (100, [1e-30, 0.0, 0.0]), (100, [1e-30, 0.0, 0.0]),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("query", F.lit("own"))
    found = ann.nearest_neighbours(vectors, F.col("vec_id") % 100 == 0).collect()
    usable = [(i, v) for i, v in rows[:6]] + [(100, [float(np.float32(1e-30)), 0.0, 0.0])]
    for query, want in brute(usable, [0, 100]):
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == query)
        assert [(i, pytest.approx(s)) for _, i, s in mine] == want
    assert ann.nearest_neighbours(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.lit(0.5)).cast("array<float>").alias("embedding"))
    found = ann.nearest_neighbours(hot, F.col("vec_id") % 100 == 0).collect()
    assert len(found) == 300 and {r.vec_id for r in found if r.query_id == 200} == set(range(10))
