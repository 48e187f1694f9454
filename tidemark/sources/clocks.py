"""Clocks: tables of instants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.time import from_ticks, instant, nanos, per_tick

BEGIN, END = "1970-01-01", "2030-01-01"
KINDS = {"timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "long": T.LongType()}


@dataclass(frozen=True)
class UniformClock:
    """Ticks at first, first + step, ... up to last; all in nanoseconds since the epoch."""

    first: int
    step: int
    last: int  # of the last tick

    @property
    def count(self) -> int:
        return (self.last - self.first) // self.step + 1

    def frame(self, spark: SparkSession, time: str = "time", kind: str = "timestamp") -> DataFrame:
        """Generated in parallel; nothing is held on the driver."""
        t = KINDS[kind]
        unit = per_tick(t)
        at = spark.range(self.count).select((F.lit(self.first) + F.col("id") * self.step).alias("at"))
        return at.select(from_ticks(F.expr(f"(at - pmod(at, {unit}L)) div {unit}L"), t).alias(time))


def uniform(frequency, offset="0s", begin=BEGIN, end=END, end_inclusive: bool = True) -> UniformClock:
    first, step, last = instant(begin), nanos(frequency), instant(end)
    if last < first:
        raise ValueError("end is before begin")
    if step <= 0:
        raise ValueError("the frequency must be positive")
    first += nanos(offset) % step
    if first >= last:
        raise ValueError("no tick between begin and end")
    n = (last - first) // step
    if not end_inclusive and first + n * step == last:
        n -= 1
    return UniformClock(first, step, first + n * step)


def uniform_frame(spark: SparkSession, frequency, offset="0s", begin=BEGIN, end=END, end_inclusive: bool = True, time: str = "time", kind: str = "timestamp") -> DataFrame:
    return uniform(frequency, offset, begin, end, end_inclusive).frame(spark, time, kind)


def random_frame(spark: SparkSession, frequency, offset="0s", begin=BEGIN, end=END, end_inclusive: bool = True, seed: int = 0, time: str = "time", kind: str = "timestamp") -> DataFrame:
    """Gaps drawn evenly from (0, frequency] and rounded up to whole microseconds.

    Slices of 4096 expected gaps start at their own places, so that slices are generated in parallel."""
    clock = uniform(frequency, offset, begin, end, end_inclusive)
    t = KINDS[kind]
    unit = per_tick(t)
    size, limit = 4096, clock.last if end_inclusive else clock.last - 1
    span = size * clock.step // 2
    slices = spark.range(max(1, -(-(clock.last - clock.first) // span))).select((F.lit(clock.first) + F.col("id") * span).alias("from"), F.col("id").alias("slice"))
    steps = slices.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4 * size))))
    unit_draw = (F.shiftrightunsigned(F.xxhash64("slice", "k", F.lit(seed)), 11).cast("double") + 1) / float(1 << 53)
    gap = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.ceil(unit_draw * clock.step / 1000).cast("long") * 1000).cast("long")
    at = F.col("from") + F.sum(gap).over(Window.partitionBy("slice").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    ticks = steps.withColumn("at", at).where((F.col("at") < F.col("from") + span) & (F.col("at") <= limit))
    return ticks.select(from_ticks(F.expr(f"at div {unit}L"), t).alias(time))  # whole microseconds
