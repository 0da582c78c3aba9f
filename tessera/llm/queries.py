"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, chat, decontaminate, filter_audit, hard_negatives, line_dedup, near_dup, quality_grade, quality_rules, substring_dedup, suffix_array_dedup, toxicity, url_filter
from tessera.llm.frames import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.with_probe(table(spark, sf_dir, "conversations")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op3_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_grade.selected(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary())


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup.digest(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_windows": op1_chat_windows,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality_grade": op3_quality_grade,
    "op4_decontamination": op4_decontamination,
    "op5_url_cascade": op5_url_cascade,
    "op6_bpe": op6_bpe,
    "op7_order_minhash": op7_order_minhash,
    "op8_host_rules": op8_host_rules,
    "op9_suffix_array": op9_suffix_array,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_line_dedup": op12_line_dedup,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {
    "op1_chat_windows": chat.ORACLE,
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op5_url_cascade": url_filter.ORACLE,
    "op8_host_rules": quality_rules.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_line_dedup": line_dedup.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
