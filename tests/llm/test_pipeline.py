import sys

import pytest

sys.path.insert(0, ".")

import corpus_pipeline
from tallygrid.llm import langid, linededup, pii
from test_groups import plain_groups


@pytest.fixture(scope="module")
def folder(tmp_path_factory, edge_docs):
    path = tmp_path_factory.mktemp("edge")
    edge_docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_of_the_pipeline(spark, folder, clashing_docs, no_docs):
    (_, language), (_, lines), (_, near), (_, private), (_, packed) = corpus_pipeline.STAGES
    kept = language(spark, clashing_docs, folder)
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(r.doc_id) for r in clashing_docs.collect() if langid.ngram_counts(r.text or "") is not None
    )
    fresh = lines(spark, kept, folder)
    assert tuple(fresh.columns) == corpus_pipeline.COLUMNS and fresh.count() == kept.count()
    assert all(r.n_chars == len(r.text) for r in fresh.collect())
    want = {str((r.doc_id, r.text)) for r in linededup.dedup_lines(kept).collect()}
    assert {str((r.doc_id, r.text)) for r in fresh.collect()} == want

    alone = near(spark, kept, folder)
    groups = plain_groups([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(str(r.doc_id) for r in alone.collect()) == sorted(str(i) for i, _, first in groups if i is None or i == first)
    masked = private(spark, kept, folder)
    for row in masked.collect():
        assert not [s for s in pii.find_spans(row.text) if s[0] in ("email", "phone")]
        assert row.n_chars == len(row.text)
    assert packed(spark, masked, folder).count() >= masked.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, folder).count() == 0


def test_whole_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "bin_id", "capacity", "offset", "n_words"} <= set(rows.columns)
    assert 0 < rows.select("doc_id").distinct().count() <= spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
