"""A corpus pipeline: toxicity, near-duplicates, repeated strings, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the last return the columns
of `documents`; each stage's rows are written as Parquet and read again.

Rows: a null text counts as empty; it is not toxic, and of all texts without a word one stays. A null id is an id like
any other, but the last to stand for a group. Repeated rows are copies: one stays. Empty tables give empty tables. Further
columns are kept as they are, whatever their names; n_chars, where there is one, follows a text that was cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import decontam, near_copies, packing, suffix_dedup, toxicity
from lattica.llm.common import drop, save, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models score as toxic go."""
    return toxicity.ordinary(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word similarity of at least 0.8, the document with the smallest id stays."""
    return near_copies.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur more than once are cut from all texts."""
    return suffix_dedup.cut(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; passages of a single item are cut."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequence and place."""
    return packing.report(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", one_of_each_group), ("suffix_dedup", cut_repeats), ("decontamination", decontaminate), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop(before)  # all its rows that were kept are in the table just written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
