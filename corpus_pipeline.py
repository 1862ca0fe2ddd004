"""The corpus pipeline: five stages, each of which calls one operator on all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a table; `run` writes every stage and reads it again.  All
stages but the last return the columns of `documents`.  Any column may be null, ids may repeat, tables
may be empty and further columns are kept; the operators' docstrings state what each case gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellsight.llm import decontaminate, hyperminhash, mixing, quality, suffix_dedup
from cellsight.llm.common import materialise, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels that are not held out."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return hyperminhash.deduplicated(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur more than once; texts left blank by that go."""
    return suffix_dedup.without_repeats(docs, chars_col="n_chars" if "n_chars" in docs.columns else None)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no part of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, with the number of the copy."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("minhash_near_dedup", distinct_documents),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixing", mixed_sources),
]

#: The classifier and the suffix sort are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
