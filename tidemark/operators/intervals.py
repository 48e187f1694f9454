"""Intervals between the ticks of a clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import from_ticks, per_tick, time_type
from tidemark.plans.aggregate import TICKS, grouped, prepared, quoted
from tidemark.sources.clocks import UniformClock

TICK = "__tick"


def _checked(inclusion: str, rounding: str) -> None:
    if inclusion not in ("begin", "end") or rounding not in ("begin", "end"):
        raise ValueError("inclusion and rounding: begin or end")


def to_intervals(df: DataFrame, clock: UniformClock | DataFrame, time: str, inclusion: str = "begin", rounding: str = "end", clock_time: str | None = None) -> DataFrame:
    """Prepared rows with TICK, the label of their interval; rows outside the clock are left out.

    inclusion "begin": [c, next), "end": (c, next]; rounding: which end labels the interval. A uniform clock costs
    arithmetic alone; any other is joined by buckets of time, each interval standing in those that it touches."""
    _checked(inclusion, rounding)
    kind = time_type(df, time)
    ready = prepared(df, time)
    if isinstance(clock, UniformClock):
        unit = per_tick(kind)
        if clock.first % unit or clock.step % unit:
            raise ValueError("the clock is finer than the time column")
        first, step, n = clock.first // unit, clock.step // unit, clock.count
        moved = F.expr(f"`{TICKS}` - {first}L" + ("" if inclusion == "begin" else " - 1"))
        number = F.expr(f"(`__moved` - pmod(`__moved`, {step}L)) div {step}L")
        rows = ready.withColumn("__moved", moved).withColumn("__number", number).where((F.col("__number") >= 0) & (F.col("__number") < n - 1))
        return rows.withColumn(TICK, (F.col("__number") + int(rounding == "end")) * F.lit(step) + F.lit(first)).drop("__moved", "__number")
    clock_time = clock_time or (time if time in clock.columns else clock.columns[0])
    marks = prepared(clock, clock_time).select(F.col(TICKS).alias("c"))
    seen = marks.agg(F.count("*"), F.min("c"), F.max("c"), F.count_distinct("c")).first()
    if seen[0] != seen[3]:
        raise ValueError("a clock's ticks must be strictly increasing")
    width = max(1, ((seen[2] or 0) - (seen[1] or 0)) // max(1, seen[0]) * 64)
    # the next tick of each is in its own bucket or the first of the next bucket that has any
    marks = marks.withColumn("b", F.expr(f"(c - pmod(c, {width}L)) div {width}L"))
    firsts = marks.groupBy("b").agg(F.min("c").alias("first"))
    follow = firsts.withColumn("next_first", F.lead("first").over(Window.orderBy("b"))).select("b", "next_first")  # one row per 64 ticks
    spans = marks.withColumn("n", F.lead("c").over(Window.partitionBy("b").orderBy("c"))).join(follow, "b").withColumn("n", F.coalesce("n", "next_first")).where("n IS NOT NULL").select("c", "n")
    touched = spans.withColumn("b", F.explode(F.sequence(F.expr(f"(c - pmod(c, {width}L)) div {width}L"), F.expr(f"(n - pmod(n, {width}L)) div {width}L"))))
    rows = ready.withColumn("__b", F.expr(f"(`{TICKS}` - pmod(`{TICKS}`, {width}L)) div {width}L"))
    t = F.col(TICKS)
    inside = (t >= F.col("c")) & (t < F.col("n")) if inclusion == "begin" else (t > F.col("c")) & (t <= F.col("n"))
    joined = rows.join(touched, (F.col("__b") == F.col("b")) & inside)
    return joined.withColumn(TICK, F.col("n") if rounding == "end" else F.col("c")).select(*[rows[c] for c in rows.columns if c != "__b"], TICK)


def summarize_intervals(df: DataFrame, clock, summarizer, time: str, key: list[str], inclusion: str = "begin", rounding: str = "end", order_by: tuple[str, ...] = (), clock_time: str | None = None) -> DataFrame:
    kind = time_type(df, time)
    rows = to_intervals(df, clock, time, inclusion, rounding, clock_time)
    found = grouped(rows, summarizer, time, [TICK, *key], order_by, df.columns)
    return found.select(from_ticks(F.col(TICK), kind).alias(time), *quoted(key), *quoted([c for c in found.columns if c not in (TICK, *key)]))
