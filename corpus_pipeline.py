"""A corpus pipeline: rules, classifier, near duplicates, mixing, packing. Each stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, near_dedup, packing, quality_classifier, quality_rules
from tidemark.llm.common import documents, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the method's own rules don't reject. The base rule of op8 (ten words, 20 % in repeated windows) is left
    out: it would take clean short documents."""
    return quality_rules.keep_unrepetitive(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good (grade 1 or more) with probability 1/2 or more."""
    return quality_classifier.keep_good(docs, quality_classifier.grades_from_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one with the smallest id; repeated rows once."""
    return near_dedup.keep_one(docs, k=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, end=0)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near duplicates", near_duplicates), ("mixing", mixed), ("packing", packed)]

#: Neither hashing by signature, nor learning, nor tokenizing can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
