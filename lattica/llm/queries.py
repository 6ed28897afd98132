"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import sql, url_lists
from lattica.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import suffix_dedup

    return suffix_dedup.report(table(spark, sf_dir, "documents")).drop("spans")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import quality

    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.report(table(spark, sf_dir, "pages"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import lm

    return lm.report(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import toxicity

    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import packing

    return packing.report(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import warc

    return warc.report(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import decontam

    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import simhash

    return simhash.report(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm import rules

    return rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality": op2_quality,
    "op3_url_lists": op3_url_lists,
    "op4_lm_score": op4_lm_score,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_decontaminate": op8_decontaminate,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": sql.SUFFIX_DEDUP,
    "op3_url_lists": url_lists.ORACLE,
    "op7_warc": sql.WARC,
    "op8_decontaminate": sql.DECONTAMINATE,
}
