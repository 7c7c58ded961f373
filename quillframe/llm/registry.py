"""The corpus queries over the test tables, with production parameters, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import decontaminate, filter_audit, jaccard_join, line_dedup, mixing, oracles, phrase_mining, quality_model, quality_rules, secrets_scan, substring_dedup, suffix_dedup, token_count, vector_dedup
from quillframe.llm.common import read


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(read(spark, sf_dir, "documents"), 13)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(read(spark, sf_dir, "documents"), 400)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.report(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"), 5, 75)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read(spark, sf_dir, "documents"), "piece_bpe_32k.model", 4096)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 10)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.join(read(spark, sf_dir, "embeddings"), 0.9)


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine(read(spark, sf_dir, "documents"), 10, 2000)


def queries() -> dict:
    own = [
        op1_substring_dedup, op2_source_mixing, op3_quality_rules, op4_suffix_dedup, op5_secrets, op6_line_dedup, op7_jaccard_join, op8_token_counts, op9_quality_classifier, op10_decontamination,
        op11_filter_audit, op12_vector_dedup, op13_phrase_mining,
    ]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against plain restatements in tests/llm."""
    return {
        "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op2_source_mixing": oracles.SOURCE_MIXING,
        "op3_quality_rules": oracles.QUALITY_RULES,
        "op6_line_dedup": oracles.LINE_DEDUP,
        "op7_jaccard_join": oracles.JACCARD_JOIN,
        "op10_decontamination": oracles.DECONTAMINATION,
        "op11_filter_audit": oracles.FILTER_AUDIT,
        "op12_vector_dedup": oracles.VECTOR_DEDUP,
        "op13_phrase_mining": oracles.PHRASE_MINING,
    }
