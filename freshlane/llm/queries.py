"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freshlane.llm import (align, decontaminate, divergence, langid, line_dedup, mixing, near_dup, packing, private, quality,
                           secrets, tokens, winnow)
from freshlane.llm.common import read_documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(read_documents(spark, sf_dir, "doc_id", "text"), labels(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", "score")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.span_digest(read_documents(spark, sf_dir, "doc_id", "text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(read_documents(spark, sf_dir, "doc_id", "text"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprint_digest(read_documents(spark, sf_dir, "doc_id", "text"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_documents(spark, sf_dir, "doc_id", "text"))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(read_documents(spark, sf_dir, "doc_id", "text", "lang"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_documents(spark, sf_dir, "doc_id", "text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(read_documents(spark, sf_dir, "doc_id", "text"), mixing.label_domains(labels(spark, sf_dir)))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_documents(spark, sf_dir, "doc_id", "text"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_documents(spark, sf_dir, "doc_id", "text"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(read_documents(spark, sf_dir, "doc_id", "text"), keep_groups=False)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(read_documents(spark, sf_dir, "doc_id", "text"), items).drop("items")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read_documents(spark, sf_dir, "text", "lang", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_personal_data": op2_personal_data,
        "op3_line_dedup": op3_line_dedup,
        "op4_winnowing": op4_winnowing,
        "op5_near_duplicates": op5_near_duplicates,
        "op6_language_mixture": op6_language_mixture,
        "op7_packing": op7_packing,
        "op8_mixing": op8_mixing,
        "op9_secret_scan": op9_secret_scan,
        "op10_token_counts": op10_token_counts,
        "op11_token_alignment": op11_token_alignment,
        "op12_decontamination": op12_decontamination,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_decontamination": decontaminate.ORACLE, "op13_source_divergence": divergence.ORACLE}
