"""Registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hoardlens.llm import (
    alignment,
    bpe,
    decontaminate,
    jaccard,
    language,
    negatives,
    quality,
    secrets,
    shards,
    suffixes,
    token_counts,
    topk,
    toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.contamination_digest(docs, benchmark)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_digest(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = jaccard.jaccard_components(_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "n_shingles", "component_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(_table(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_digest(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.shifted_labels(_table(spark, sf_dir, "embeddings")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digest(_table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_language_id,
        op3_ngram_jaccard,
        op4_sharding,
        op5_bpe_codec,
        op6_token_counts,
        op7_secret_scan,
        op8_toxicity,
        op9_suffix_dedup,
        op10_topk_search,
        op11_hard_negatives,
        op12_token_alignment,
        op13_quality_rules,
    )
}

ORACLES = {
    "op1_decontamination": decontaminate.ORACLE,
    "op3_ngram_jaccard": jaccard.ORACLE,
    "op7_secret_scan": secrets.ORACLE,
    "op10_topk_search": topk.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op13_quality_rules": quality.ORACLE,
}
