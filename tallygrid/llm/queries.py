"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm import ann, bpe, jaccard, langid, lexical, linededup, packing, pii, quality, sharding, syncmers, toxicity, trie
from tallygrid.llm.common import fold, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.toxicity_rows(docs, labels, held_out=fold("doc_id", 4, 2))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.quality_rows(docs, labels, held_out=fold("doc_id", 5, 0))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 3, 1)
    model = langid.fit_languages(docs, training=~held_out)
    found = langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), "language.score", "language.ambiguous"
    )


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 100 == 0)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digests(table(spark, sf_dir, "documents"))


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_rows(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


LLM_QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_langid": op4_langid,
    "op5_jaccard": op5_jaccard,
    "op6_packing": op6_packing,
    "op7_ann": op7_ann,
    "op8_bpe": op8_bpe,
    "op9_linededup": op9_linededup,
    "op10_syncmers": op10_syncmers,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lexical_search": op12_lexical_search,
    "op13_sharding": op13_sharding,
    "pipeline": pipeline,
}
LLM_ORACLES: dict[str, str] = {"op11_prefix_trie": trie.ORACLE, "op12_lexical_search": lexical.ORACLE}
