"""Weighted points of a regression: from text, as scaled columns, and at random. Columns: label, weight, x1, x2 and so on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_points(lines: DataFrame, n_features: int, column: str = "value", delimiter: str = ",") -> DataFrame:
    """Lines such as "label,weight,x1,x2". A line with another number of fields, or one that is no number, is an error
    when it is read; a null line gives nulls."""
    split = F.split(F.col(f"`{column}`"), "\\Q" + delimiter + "\\E")
    wrong = F.raise_error(F.concat(F.lit(f"not {n_features + 2} fields: "), F.col(f"`{column}`"))).cast("array<string>")
    fields = F.when(F.size(split) == n_features + 2, split).when(split.isNotNull(), wrong)
    names = ["label", "weight", *(f"x{i}" for i in range(1, n_features + 1))]
    # a cast that names what it can't read, in ANSI mode or not
    return lines.select(*[_number(F.get(fields, F.lit(i))).alias(n) for i, n in enumerate(names)])


def _number(text: Column) -> Column:
    value = F.trim(text).try_cast("double")
    return F.when(text.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double")).otherwise(value)


def scaled_points(points: DataFrame, features: Sequence[str], label: str = "label", weight: str = "weight", intercept: bool = True) -> DataFrame:
    """row: array of features times the root of the weight (which stands first with an intercept); target: label times it."""
    root = F.sqrt(F.col(f"`{weight}`").cast("double"))
    scaled = [F.col(f"`{c}`").cast("double") * root for c in features]
    return points.select(F.array(*([root] if intercept else []), *scaled).alias("row"), (F.col(f"`{label}`").cast("double") * root).alias("target"))


def sample_points(spark: SparkSession, weights: Sequence[float], intercept: float, n: int = 100, partitions: int = 4, error: float = 1.0, seed: int = 1) -> DataFrame:
    """label = x . weights + intercept + error * noise; features and noise are normal, weights are |normal| + 0.5.
    Equal arguments give equal points."""
    k = len(weights)
    drawn = spark.range(0, n, 1, partitions).select(*[F.randn(seed + i).alias(f"x{i + 1}") for i in range(k)], F.randn(seed + k).alias("e"), F.randn(seed + k + 1).alias("w"))
    label = F.lit(float(intercept)) + F.col("e") * float(error)
    for i, b in enumerate(weights):
        label = label + F.col(f"x{i + 1}") * float(b)
    return drawn.select(label.alias("label"), (F.abs("w") + 0.5).alias("weight"), *[f"x{i + 1}" for i in range(k)])
