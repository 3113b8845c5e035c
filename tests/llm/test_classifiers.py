from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import langid, quality, queries, toxicity

LABELS = "doc_id long, quality int, toxic int"


def held_out(doc_id, folds, held):
    return crc32(str(doc_id).encode()) % folds == held


@pytest.mark.parametrize("name, folds, held", [("op1_toxicity", 4, 2), ("op2_quality", 5, 0), ("op4_langid", 3, 1)])
def test_one_row_for_each_document_and_the_folds(spark, sf_dir, name, folds, held):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.LLM_QUERIES[name](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.held_out == held_out(r.doc_id, folds, held) and 0 <= r.score <= 1 for r in rows)
    if name != "op4_langid":
        assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    found = [r for r in queries.op4_langid(spark, folder).collect() if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in found]) > 0.97
    found = [r for r in queries.op2_quality(spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id].quality for r in found]) > 0.95
    found = [r for r in queries.op1_toxicity(spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id].toxic for r in found]) > 0.9


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, real_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    from tallygrid.llm.common import fold

    held = fold("doc_id", 5, 0)
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = real_docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    first = quality.quality_rows(real_docs, labels, held).toPandas().sort_values("doc_id")
    second = quality.quality_rows(other, turned, held).toPandas().sort_values("doc_id")
    assert np.allclose(first["score"], second["score"], atol=1e-9)


def test_edge_rows(spark, edge_docs, no_docs, clashing_docs):
    model = langid.fit_languages(edge_docs, training=F.lit(True))
    rows = {r.doc_id: r.found for r in langid.identify(clashing_docs, model, output="found").collect()}
    assert {rows[i].lang for i in (4, 5, 6, 7)} == {"und"} and rows[4].score == 0.0
    assert rows[8].lang == "en" and rows[8].score == 1.0
    nothing = langid.fit_languages(no_docs, training=F.lit(True))
    assert {r.language.lang for r in langid.identify(edge_docs, nothing).collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0

    no_labels = spark.createDataFrame([], LABELS)
    some = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 1, 1), (8, None, None), (None, 1, 1), (9, 0, 0), (11, 1, 1)], LABELS)
    for labels in (no_labels, some):
        for found in (
            quality.quality_rows(clashing_docs, labels, F.col("doc_id") == 2),
            toxicity.toxicity_rows(clashing_docs, labels, F.coalesce(F.col("doc_id") == 2, F.lit(False))),
        ):
            scores = [r.score for r in found.collect()]
            assert len(scores) == 14 and all(0 <= s <= 1 for s in scores)
    assert quality.quality_rows(no_docs, some, F.lit(False)).count() == 0
    assert toxicity.toxicity_rows(no_docs, some, F.lit(False)).count() == 0


def test_codewords_differ_and_split_all_ways():
    for classes in (2, 3, 5, 9, 40):
        codes = langid.codewords(classes)
        assert len({row.tobytes() for row in codes}) == classes
        assert all(0 < (column > 0).sum() < classes for column in codes.T)
    assert langid.codewords(4).shape == (4, 7) and langid.codewords(1).shape == (1, 0)


def test_counts_of_long_texts_do_not_depend_on_stretches(monkeypatch):
    text = "Der alte Mann, 12 Jahre! und das Meer " * 50
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "STRETCH", 1 << 20)
    assert (langid.ngram_counts(text) == whole).all()


def test_pooling_of_long_texts_equals_that_of_one_stretch(monkeypatch):
    random = np.random.default_rng(0)
    texts = [toxicity.word_codes(" ".join(random.choice(["bad", "good", "fine", "calm"], 30))) for _ in range(40)]
    labels = np.array([i % 2 for i in range(40)])
    model = toxicity.train(texts, labels, epochs=1)
    long = toxicity.word_codes("good fine bad calm " * 500)
    whole = model.logits([long])
    monkeypatch.setattr(toxicity, "STRETCH", 64)
    assert np.allclose(model.logits([long]), whole, atol=1e-4)


def test_toxicity_learns_from_all_rows_and_whole_texts(spark):
    """Long texts are learnt from like others, and shards together know what none of them could know alone."""
    random = np.random.default_rng(3)
    calm, rows = [f"calm{i}" for i in range(40)], []
    for i in range(160):
        bad = [f"bad{i % 8}"] if i % 2 else []
        words = [*random.choice(calm, 5_000 if i < 40 else 12), *bad]
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    long = F.col("doc_id") < 40
    for training, shard_rows in ((long, 4_096), (F.lit(True), 40)):
        model = toxicity.fit_toxicity(docs, labels, training, shard_rows=shard_rows)
        assert model.constant is None
        scored = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
        assert np.mean([(scored[i] >= 0.3) == bool(t) for i, _, t in rows]) > 0.95
    # In each shard of about 4 rows a word is met too seldom to be learnt; it is counted over all of them.
    model = toxicity.fit_toxicity(docs, labels, F.lit(True), shard_rows=4, epochs=1)
    at = toxicity.buckets(toxicity.word_codes("bad3"))[0][0]
    assert model.tables[0][at].any()


def test_toxicity_of_shards_equals_training_at_hand(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    found = toxicity.fit_toxicity(docs, labels, F.lit(True), epochs=2)
    rows = docs.join(labels.where("toxic in (0, 1)"), "doc_id").select("toxic", "text", F.xxhash64("doc_id", "text").alias("deal"))
    rows = rows.orderBy("deal", "toxic").collect()
    texts = [toxicity.word_codes(r.text) for r in rows]
    want = toxicity.train(texts, np.array([r.toxic for r in rows]), epochs=2)
    assert np.allclose(found.logits(texts), want.logits(texts), atol=1e-3)
    assert np.allclose(found.thresholds, want.thresholds, atol=1e-2)


def test_logits_do_not_depend_on_the_texts_beside(monkeypatch):
    random = np.random.default_rng(1)
    texts = [toxicity.word_codes(" ".join(random.choice(["bad", "good", "fine", "calm"], 30))) for _ in range(40)]
    model = toxicity.train(texts, np.array([i % 2 for i in range(40)]), epochs=2)
    alone = np.concatenate([model.logits([codes]) for codes in texts])
    assert np.allclose(model.logits(texts), alone, atol=1e-5)
    monkeypatch.setattr(toxicity, "STRETCH", 7)
    assert np.allclose(model.logits(texts), alone, atol=1e-5)


def test_faded_filters_count_as_zero():
    """Products with numbers too small for a normal float take many times as long, and change nothing."""
    texts = [toxicity.word_codes(f"good calm {word} fine") for word in ("bad", "mild") * 10]
    model = toxicity.train(texts, np.array([i % 2 for i in range(20)]), epochs=1)
    codes, starts = toxicity.joined(texts)
    for width in toxicity.WIDTHS:
        model.filters[width][...], model.biases[width][...] = 1e-40, 0
    responses = model.responses(codes, starts)
    assert all((responses[width][starts] == 0).all() for width in toxicity.WIDTHS)


def test_texts_of_shards_stay_packed_and_few_labels_are_sent_to_them(spark, monkeypatch):
    rows = [(i, " ".join(f"word{(i + j) % 50}" for j in range(400)), i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    kept, plans, stored = {}, {}, toxicity.stored

    def noted(frame, name, **options):
        plans[name] = frame._jdf.queryExecution().toString()
        kept[name] = stored(frame, name, **options)
        return kept[name]

    monkeypatch.setattr(toxicity, "stored", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        toxicity.fit_toxicity(docs, labels, F.lit(True), shard_rows=20, epochs=1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plans["coded"] and "SortMergeJoin" not in plans["coded"]
    assert kept["shards"].agg(F.sum(F.octet_length("codes"))).first()[0] < 60 * 400 * 8 / 4
    found = [codes.tobytes() for _, texts, _ in toxicity._shards([kept["shards"].toPandas()]) for codes in texts]
    assert sorted(found) == sorted(toxicity.word_codes(r[1]).tobytes() for r in rows)
