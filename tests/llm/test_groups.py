"""Line deduplication, Jaccard join, and the components behind both, against brute force."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import jaccard, linededup
from tallygrid.llm.links import components


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (205, 200), (200, 203)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = Sets()
    for a, b in links:
        want.join(a, b)
    assert found == {n: want.find(n) for n in found} and len(found) == 41 + 30 + 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_sets(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_groups(rows):
    sets = [(i, plain_sets(t)) for i, t in rows]
    groups = Sets()
    for at, (_, left) in enumerate(sets):
        for other in range(at):
            both = len(left & sets[other][1])
            if left and 100 * both >= 80 * len(left | sets[other][1]):
                groups.join(at, other)
    smallest = defaultdict(list)
    for at, (i, _) in enumerate(sets):
        smallest[groups.find(at)].append(i)
    return sorted(
        ((i, len(s), min((x for x in smallest[groups.find(at)] if x is not None), default=None)) for at, (i, s) in enumerate(sets)),
        key=str,
    )


def found_groups(docs):
    return sorted((tuple(r) for r in jaccard.similar_documents(docs).collect()), key=str)


def test_jaccard_join_equals_brute_force(edge_docs, edge_rows, no_docs, clashing_docs, real_docs):
    want = plain_groups([r[:2] for r in edge_rows])
    assert found_groups(edge_docs) == want
    assert found_groups(clashing_docs) == want
    assert found_groups(no_docs) == []
    assert found_groups(real_docs) == plain_groups([(r.doc_id, r.text) for r in real_docs.collect()])


def test_jaccard_join_of_copies_and_a_shared_passage(spark, monkeypatch):
    """Groups of copies and of near copies, and a passage that many unlike documents share."""
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, "  ".join(f"a{j}" for j in range(60)) + (f" end{i}" if i % 3 else "")) for i in range(40)]
    rows += [(100 + i, passage + " " + " ".join(f"d{i}x{j}" for j in range(60))) for i in range(30)]
    rows += [(200 + i, " ".join(f"c{j}" for j in range(i, i + 60))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_groups(docs) == plain_groups(rows)


def distance(a, b):
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[start:], b[start:]
    end = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - end], b[: len(b) - end]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(left, right):
    """The rule for two normal forms, one pair at a time."""
    allowed = int((1 - linededup.SIMILARITY) * max(len(left), len(right)) + 1e-9)
    if abs(len(left) - len(right)) > allowed:
        return False
    same = next((i for i, (x, y) in enumerate(zip(left, right)) if x != y), min(len(left), len(right)))
    left, right = left[same:], right[same:]
    same = next((i for i, (x, y) in enumerate(zip(left[::-1], right[::-1])) if x != y), min(len(left), len(right)))
    left, right = left[: len(left) - same], right[: len(right) - same]
    if max(len(left), len(right)) > linededup.EDITED:
        return len(set(left.split(" ")) ^ set(right.split(" "))) <= allowed
    return distance(left, right) <= allowed


def plain_dedup(spark, docs):
    """Kept texts by position in order of id, from all pairs of lines."""
    rows = sorted({(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.text is not None}, key=str)
    lines = [(i, t, at, line) for i, t in rows for at, line in enumerate(t.split("\n"))]
    frame = spark.createDataFrame([(k, l[3], l[1]) for k, l in enumerate(lines)], "k long, line string, text string")
    known = {
        r.k: r for r in frame.select("k", linededup.normal_line(F.col("line")).alias("normal"), F.xxhash64("text").alias("digest")).collect()
    }
    usable = [k for k in known if known[k].normal]
    distinct = sorted({known[k].normal for k in usable})
    groups = Sets()
    for at, left in enumerate(distinct):
        for other in range(at):
            if alike(left, distinct[other]):
                groups.join(at, other)
    number = {normal: groups.find(at) for at, normal in enumerate(distinct)}
    keeper = {}
    order = sorted(usable, key=lambda k: (lines[k][0] is not None, lines[k][0] or 0, known[k].digest, lines[k][2]))
    for k in order:
        keeper.setdefault(number[known[k].normal], k)
    gone = {k for k in usable if keeper[number[known[k].normal]] != k}
    kept = defaultdict(list)
    for k, (i, t, _, line) in enumerate(lines):
        kept[i, t] += [] if k in gone else [line]
    return {key: "\n".join(value) for key, value in kept.items()}


def test_line_dedup_equals_brute_force(spark, edge_docs, no_docs, clashing_docs):
    base = " ".join(f"boiler{i}" for i in range(60))
    rows = [
        (1, f"{base}\nonly one here today"),
        (2, f"{base.replace('boiler7 ', 'boiler8 ')}\nshort\nshort"),
        (3, f"unlike lines stand here\n{base.upper()}!\n{base}"),
        (4, "Page 12 of 40 pages\nshort"),
        (5, "page 13 of 41 pages\n"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for frame in (docs, edge_docs):
        want = plain_dedup(spark, frame)
        before = frame.withColumn("old", F.col("text"))
        found = linededup.dedup_lines(before).collect()
        assert len(found) == frame.count()
        for row in found:
            assert row.text == (None if row.old is None else want[row.doc_id, row.old])
    assert linededup.dedup_lines(no_docs).count() == 0
    assert linededup.dedup_lines(clashing_docs).columns == clashing_docs.columns
    assert linededup.line_digests(no_docs).count() == 0


def test_line_dedup_takes_fuzzy_lines(spark):
    base = " ".join(f"boiler{i} plate{i}" for i in range(150))
    rows = [(i, base.replace(f" plate{i} ", f" plates{i} ")) for i in range(12)]
    kept = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.text != "" for r in kept) < 6 and {r.doc_id: r.text for r in kept}[0] == rows[0][1]


def kept_lines(spark, lines):
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return [r.doc_id for r in linededup.dedup_lines(docs).orderBy("doc_id").collect() if r.text]


def test_line_dedup_finds_typos_and_changed_words(spark):
    first = "please accept all cookies before reading this nice page today"
    second = "the museum opens every morning except monday and closes late on every second friday evening in summer"
    lines = [first, first.replace("reading", "readimg"), second, second.replace("monday", "sunday"), first + " unlike altogether"]
    assert kept_lines(spark, lines) == [0, 2, 4]


def test_line_dedup_of_short_lines_and_lines_without_spaces(spark):
    clause = "本网站所有内容未经许可不得转载或用于商业用途违者必究"
    lines = ["Read more", "read more!", "Alle Rechte", "Alle Rechte", clause, clause, clause.replace("许可", "允可"), "Seite", "Seite"]
    assert kept_lines(spark, lines) == [0, 2, 4, 7]
    # Below 20 characters one edit is allowed, wherever it is.
    for line in ("contact us", "subscribe to this", "all rights reserve"):
        for at in range(len(line)):
            for other in (line[:at] + "q" + line[at + 1 :], line[:at] + "q" + line[at:]):
                assert linededup_share(spark, line, other)


def linededup_share(spark, left, right, seen={}):
    if not seen:
        lines = ["contact us", "subscribe to this", "all rights reserve"]
        texts = {line[:at] + "q" + line[at + skip :] for line in lines for at in range(len(line)) for skip in (0, 1)} | set(lines)
        frame = spark.createDataFrame([(t,) for t in texts], "normal string")
        seen.update((r.normal, set(r["keys"])) for r in frame.select("normal", linededup.half_keys(F.col("normal")).alias("keys")).collect())
    return seen[left] & seen[right]


def edited(line, count, letters, rng):
    line = list(line)
    for _ in range(count):
        at, kind = rng.randrange(len(line)), rng.random()
        if kind < 0.6:
            line[at] = rng.choice(letters)
        elif kind < 0.8:
            line.insert(at, rng.choice(letters))
        else:
            line.pop(at)
    return "".join(line)


def shared_blocks(spark, pairs):
    """For each pair of normal forms, whether they have a bucket in common."""
    rows = [(2 * at + side, text) for at, pair in enumerate(pairs) for side, text in enumerate(pair)]
    lines = spark.createDataFrame(rows, "line long, normal string").repartition(4, "line")
    buckets = defaultdict(set)
    for r in linededup.line_blocks(lines).collect():
        buckets[r.line].add(r.bucket)
    return [bool(buckets[2 * at] & buckets[2 * at + 1]) for at in range(len(pairs))]


def test_few_edits_always_leave_a_block(spark):
    """With B blocks, fewer than B / (2 * GRAM) edits cannot reach all of them."""
    rng = random.Random(8)
    pairs = []
    for _ in range(200):
        line = " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(rng.randint(60, 90)))
        blocks = max(linededup.LEAST_BLOCKS, 2 ** int(math.log2(len(line) * 0.9)) // linededup.RUNS)
        # A block with too few runs is left out, which may cost a few more.
        pairs.append((line, edited(line, max(1, blocks // (2 * linededup.GRAM) - 2), "abcdefghijklmnop", rng)))
    assert all(shared_blocks(spark, pairs))


@pytest.mark.parametrize("script", ["words", "no spaces"])
def test_recall_of_blocks(spark, script):
    """Pairs of lines with a share of their characters edited at random places."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz" if script == "words" else "".join(chr(0x4E00 + 7 * i) for i in range(900))
    words = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(3000)]
    found = {}
    for share in (0.01, 0.02, 0.03, 0.05, 0.07, 0.1):
        pairs = []
        for _ in range(300):
            line = " ".join(rng.choices(words, k=rng.randint(8, 40)))
            line = line if script == "words" else line.replace(" ", "")
            pairs.append((line, edited(line, max(1, int(share * len(line))), letters, rng)))
        found[share] = sum(shared_blocks(spark, pairs)) / len(pairs)
    print(script, found)
    assert found[0.01] >= 0.97 and found[0.02] >= 0.9 and found[0.03] >= 0.75


def test_unlike_lines_of_few_words_share_few_blocks(spark):
    """Lines drawn from the same few syllables: the most frequent runs must not make the same block in all of them."""
    rng = random.Random(12)
    syllables = "the ing and ion ent ter for her tha ati hat tio ere ate his con res ver all ons".split()
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(3000)]
    lines = [(i, " the ".join(rng.choices(words, k=60))) for i in range(300)]
    found = linededup.line_blocks(spark.createDataFrame(lines, "line long, normal string").repartition(4, "line"))
    sizes = [r["count"] for r in found.groupBy("bucket").count().collect()]
    pairs = sum(size * (size - 1) // 2 for size in sizes)
    assert pairs < 100_000  # 805,432 when each run counted as often as it came


def test_lines_of_words_have_few_buckets(spark):
    """With a block of runs of characters for every 6 to 12 characters, most of the disk went to buckets."""
    rng = random.Random(15)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    lines = [(i, " ".join(rng.choices(words, k=rng.randint(40, 90)))) for i in range(200)]
    found = linededup.line_blocks(spark.createDataFrame(lines, "line long, normal string").repartition(4, "line"))
    buckets = defaultdict(set)
    for r in found.collect():
        buckets[r.line].add(r.bucket)
    assert all(buckets[i] for i, _ in lines)
    assert sum(map(len, buckets.values())) < sum(len(line) for _, line in lines) / 13


def test_blocks_are_compiled(spark):
    """The JVM compiles no method of more than 8,000 bytes, and uncompiled it takes several times as long."""
    lines = spark.createDataFrame([(1, "some words")], "line long, normal string").repartition(4, "line")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        query = linededup.line_blocks(lines)._jdf.queryExecution()
        text = spark._jvm.PythonSQLUtils.explainString(query, "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_chunks_lose_no_pair_of_long_lines(spark):
    """Pairs within the edits allowed, spread or together, pass the look for chunks; texts of other words do not."""
    rng = random.Random(16)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    line, rows = " ".join(rng.choices(words, k=700)), []
    for at in range(12):
        rows.append((at, 100 + at, line, edited(line, int(0.09 * len(line)), "abcdefgh", rng)))
    cut = len(line) // 10 - 1
    rows += [(20, 120, line, line[cut:]), (21, 121, line, line[:cut] + "q" + line[cut + 1 :]), (22, 122, line[:-1] + "y", line[:900] + "z" * 200 + line[900:-1])]
    rows += [(30 + at, 130 + at, line, " ".join(rng.choices(words, k=700))) for at in range(5)]
    allowed = linededup.allowed_edits(F.greatest(F.length("left"), F.length("right"))).alias("allowed")
    pairs = spark.createDataFrame(rows, "a long, b long, left string, right string").select("*", allowed)
    assert sorted(r.a for r in linededup._few_chunks_missing(pairs).collect()) == [*range(12), 20, 21, 22]


def test_edit_distance_is_the_rule_at_all_lengths(spark):
    """Lines of over 2,000 characters: a letter changed in each word is within the edits allowed, other orders of words are not."""
    words = [f"w{i % 10}{chr(97 + i % 26)}{i:07d}" for i in range(400)]
    line = " ".join(words)
    letters = " ".join("z" + word[1:] for word in words[:200]) + " " + " ".join("y" + word[1:] for word in words[200:])
    rows = [(1, 2, line, letters), (1, 3, line, " ".join(words[::-1])), (1, 4, line, line[:2000] + "x" * 300 + line[2000:])]
    rows += [(1, 5, line, line[:2000] + "x" * 900 + line[2000:]), (1, 6, line, "q" + line[1:-1] + "q")]
    pairs = spark.createDataFrame(rows, "a long, b long, left string, right string")
    for short in (False, True):
        assert {r.b for r in linededup.similar_pairs(pairs, short).collect()} == {2, 4, 6}


def test_sketches_tell_sets_of_some_hundred_shingles_apart(spark):
    """Sets that share about two thirds are no candidates any more; those alike enough always are."""
    random.seed(4)
    rows = []
    for i in range(60):
        shared = 370 if i % 2 else 405  # of 450 shingles: 0.70 and 0.82
        own = [[random.getrandbits(62) for _ in range(450 - shared)] for _ in range(2)]
        common = [random.getrandbits(62) for _ in range(shared)]
        left, right = (np.unique(np.array(common + part, np.int64)) for part in own)
        rows.append((i, *([len(s), *(int(x) for x in jaccard.sketch(s))] for s in (left, right))))
    names = ["n", *jaccard.PARTS]
    frame = spark.createDataFrame(rows, "i long, l array<long>, r array<long>")
    sides = [F.struct(*(F.get(F.col(side), F.lit(at)).alias(name) for at, name in enumerate(names))) for side in ("l", "r")]
    found = {r.i for r in frame.where(jaccard.alike_sketches(*sides)).collect()}
    assert found >= set(range(0, 60, 2)) and len(found) < 40
