"""A training-data pipeline of corpus operators over `documents`.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read back as the next one's docs. All but the last return the columns of
documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clarispan.llm import language_id, line_dedup, packing, quality, simhash_neardup
from clarispan.llm.common import materialise, table
from clarispan.shared import release, tables


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not found go."""
    return language_id.keep_identified(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or nearly so, go from their documents; n_chars follows."""
    return line_dedup.keep_first_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash_neardup.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences of related documents."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("line_dedup", fresh_lines),
    ("near_dedup", near_dedup),
    ("packing", packed),
]
ORACLE_SQL = None  # models and searches that SQL cannot express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = tables(spark)
        done = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, tables(spark) - before, keep=done)  # what the stage left behind
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
