"""Synthetic panels: a uniform clock times a random share of ids, with columns from functions of time and id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import TimeSeriesFrame
from tidemark.sources import clocks


def generate(spark: SparkSession, begin, end, frequency, ids: list[int], ratio: float = 1.0, columns: dict[str, Callable[[Column, Column], Column]] | None = None, seed: int = 0, kind: str = "timestamp") -> TimeSeriesFrame:
    """columns: name -> fn(time, id); without it one column "value", uniform in [0, 1) by hash."""
    if not 0 < ratio <= 1:
        raise ValueError("0 < ratio <= 1")
    draw = lambda salt: F.shiftrightunsigned(F.xxhash64("time", "id", F.lit(seed), F.lit(salt)), 11).cast("double") / float(1 << 53)
    base = clocks.uniform_frame(spark, frequency, begin=begin, end=end, kind=kind).withColumn("id", F.explode(F.array(*[F.lit(i) for i in ids])))
    some = base.where(draw("keep") < ratio) if ratio < 1 else base
    made = columns or {"value": lambda t, i: draw("value")}
    return TimeSeriesFrame(some.withColumns({n: fn(F.col("time"), F.col("id")) for n, fn in made.items()}), order_by="id")
