"""Queries of the corpus operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, lm_score, mixing, near_dedup, packing, quality_classifier, quality_rules, token_files, toxicity, url_filter
from tidemark.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(documents(spark, sf_dir))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), end=0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    grades = quality_classifier.grades_from_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.grade_documents(documents(spark, sf_dir), grades)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), end=2)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition_rules(documents(spark, sf_dir))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), k=3, percent=85)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 5 == 0
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label"))
    return toxicity.score_toxicity(documents(spark, sf_dir), labelled).withColumn("held_out", held_out)


def queries() -> dict[str, Query]:
    found = (op1_url_filter, op2_fingerprints, op3_lm_score, op4_packing, op5_mixing, op6_quality_classifier, op7_token_files, op8_quality_rules, op9_near_dedup, op10_toxicity)
    return {f.__name__: f for f in found}


def _regex(glob: str) -> str:
    """A glob as a regular expression for SQL."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob[i : i + 2] == "**":
            out += ".*"
            i += 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        else:
            if c == "\\" and i + 1 < len(glob):
                i += 1
                c = glob[i]
            out += c if c.isalnum() or c in "/-_" else f"[{c}]"
        i += 1
    return f"(?s){out}"


def _url_sql() -> str:
    rules = ", ".join(f"('{action}', '{host}', '{path}')" for action, host, path in url_filter.RULES)
    globs = " ".join(f"WHEN regexp_full_match(host || path, '{_regex(g)}') THEN '{g}'" for g in url_filter.GLOBS)
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM cut),
rules(action, rule_host, rule_path) AS (VALUES {rules}),
fits AS (
  SELECT page_id, action, rule_host || rule_path AS rule,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, action DESC) AS place
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
own AS (SELECT page_id, host, path, CASE {globs} END AS glob FROM parts)
SELECT o.page_id, o.host, o.path, f.rule, coalesce(f.action, CASE WHEN o.glob IS NULL THEN 'allow' ELSE 'block' END) AS verdict, o.glob
FROM own o LEFT JOIN fits f ON o.page_id = f.page_id AND f.place = 1"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _url_sql()}
