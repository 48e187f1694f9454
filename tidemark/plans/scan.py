"""Running values that depend on the rows before: decayed sums, the previous row, row numbers.

Rows are dealt by (key, bucket of a position). One window pass within a bucket gives the values of its rows; a table with
one row per bucket carries them on from bucket to bucket. The cost is linear in rows, and a key that holds many rows is
spread over its buckets.

Decayed sums. sum of v * exp(-rate * (last - position)) is summed as v * exp(rate * (position - start)) from a bucket's
start; buckets are so short that exponents stay below REACH. Between buckets the same is done over spans of buckets, and
spans three or more apart, whose weights are below e^-450, count as nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans import buckets

REACH = 300.0
SPANS = 3
BUCKET, SPAN, START = "__scan_bucket", "__scan_span", "__scan_start"
_FIRST = Window.unboundedPreceding


def _quoted(names) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def attached(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """rows with the other columns of table, which has one row for each value of `on` (nulls are equal)."""
    if not on:
        return rows.crossJoin(F.broadcast(table))  # one row
    names = {c: f"__on_{i}" for i, c in enumerate(on)}
    table = table.withColumnsRenamed(names)
    condition = F.lit(True)
    for c, n in names.items():
        condition = condition & F.col(f"`{c}`").eqNullSafe(F.col(n))
    return rows.join(table, condition, "left").drop(*names.values())


class Scan:
    """Collects steps; each adds columns. width: of a bucket in ticks, or None for one bucket per key."""

    def __init__(self, key: list[str], ticks: str, order: list[str], width: int | None = None) -> None:
        self.key, self.ticks, self.order, self.width = key, ticks, order, width
        self.steps, self._known = [], {}
        self.bound = False  # a step needs all of a key's rows in one task

    def _once(self, kind: str, given: tuple, names: list[str], step) -> list[str]:
        """The same request twice is one step."""
        mark = (kind, *map(str, given))
        if mark not in self._known:
            self._known[mark] = [f"__scan_{len(self._known)}_{n}" for n in names]
            made = self._known[mark]
            self.steps.append(lambda df: step(df, *made))
        return self._known[mark]

    def applied(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step(df)
        return df

    def _window(self, *more: str):
        return Window.partitionBy(*_quoted(self.key), *more)

    def _carried(self, df: DataFrame, inside: dict[str, Column], table: dict[str, Column], carry: dict[str, Column], merge) -> DataFrame:
        """inside: windowed columns of rows; table: aggregates of a bucket; carry: windowed columns of the table."""
        if self.width is None:
            return df.withColumns({n: c.over(self._window().orderBy(*self.order).rowsBetween(*frame)) for n, (c, frame) in inside.items()})
        dealt = df.withColumn(BUCKET, buckets.home_of(self.ticks, self.width))
        totals = dealt.groupBy(*_quoted(self.key), BUCKET).agg(*[c.alias(n) for n, c in table.items()])
        before = self._window().orderBy(BUCKET).rowsBetween(_FIRST, -1)
        totals = totals.select(*_quoted(self.key), BUCKET, *[c.over(before).alias(n) for n, c in carry.items()])
        rows = dealt.withColumns({n: c.over(self._window(BUCKET).orderBy(*self.order).rowsBetween(*frame)) for n, (c, frame) in inside.items()})
        joined = attached(rows, totals, [*self.key, BUCKET])
        return joined.withColumns({n: merge[n](F.col(n)) for n in inside}).drop(BUCKET, *carry)

    def neighbours(self, good: Column, value: Column) -> tuple[Column, Column]:
        """struct<p, x> (ticks, value) of the last row before that counts, and of the first up to here."""
        row, place = F.when(good, F.struct(F.col(self.ticks).alias("p"), value.alias("x"))), F.when(good, F.struct(*self.order))

        def step(df, prior, first):
            inside = {prior: (F.last(row, True), (_FIRST, -1)), first: (F.first(row, True), (_FIRST, 0))}
            table = {"__last_row": F.max_by(row, place), "__first_row": F.min_by(row, place)}
            carry = {"__prior": F.last("__last_row", True), "__start_row": F.first("__first_row", True)}
            return self._carried(df, inside, table, carry, {prior: lambda c: F.coalesce(c, "__prior"), first: lambda c: F.coalesce("__start_row", c)})

        prior, first = self._once("neighbours", (good, value), ["prior", "first"], step)
        return F.col(prior), F.col(first)

    def numbered(self, good: Column) -> str:
        """Name of a column: how many rows up to here count."""
        one = F.count(F.when(good, 1))

        def step(df, n):
            return self._carried(df, {n: (one, (_FIRST, 0))}, {"__n": one}, {"__before": F.sum("__n")}, {n: lambda c: c + F.coalesce("__before", F.lit(0))})

        return self._once("numbered", (good,), ["n"], step)[0]

    def before(self, good: Column, value: Column) -> Column:
        """struct<last, n, mean, sd>: the last value up to here that counts, and the rows before it. A key's rows in one task."""
        x = F.when(good, value)
        self.bound = True

        def step(df, found):
            part = self._window().orderBy(*_quoted(self.order))
            earlier = part.rowsBetween(_FIRST, -1)
            here = F.struct(value.alias("last"), F.count(x).over(earlier).alias("n"), F.avg(x).over(earlier).alias("mean"), F.stddev_samp(x).over(earlier).alias("sd"))
            return df.withColumn(found, F.when(good, here)).withColumn(found, F.last(found, True).over(part.rowsBetween(_FIRST, 0)))

        return F.col(self._once("before", (good, value), ["rest"], step)[0])

    def decayed(self, good: Column, rate: float, values: list[Column], position: str | None = None) -> tuple[list[Column], Column]:
        """Decayed sums up to each row, as of the last row that counts, and that row's position; null before the first."""
        position = position or self.ticks
        longest = max(1, math.floor(min(REACH / rate, 1 << 61)))
        width = min(longest, self.width) if self.width and position == self.ticks else longest

        def step(df, *names):
            *sums, last = names
            dealt = df.withColumn(BUCKET, buckets.home_of(position, width))
            p, start = F.col(position), F.col(BUCKET) * width

            def weight(of: Column, frm: Column) -> Column:
                return F.exp((of - frm).cast("double") * rate)

            counted = F.when(good, p)
            parts = {n: F.sum(F.when(good, v * weight(p, start))) for n, v in zip(sums, values, strict=True)}
            inside = self._window(BUCKET).orderBy(*self.order).rowsBetween(_FIRST, 0)
            rows = dealt.withColumns({**{n: c.over(inside) for n, c in parts.items()}, last: F.max(counted).over(inside)})
            table = dealt.groupBy(*_quoted(self.key), BUCKET).agg(F.max(counted).alias("__t"), F.min(counted).alias("__f"), *[c.alias(n) for n, c in parts.items()])
            table = table.withColumn(START, start).withColumn(SPAN, buckets.home_of(START, longest))
            table = table.withColumns({n: F.col(n) * weight(F.col(START), F.col("__t")) for n in sums})  # as of the bucket's last row
            t, f, span = F.col("__t"), F.col("__f"), F.col(SPAN)
            here = self._window(SPAN).orderBy(BUCKET).rowsBetween(_FIRST, -1)
            carried = {}
            for n in sums:
                total = F.coalesce(F.sum(F.col(n) * weight(t, span * longest)).over(here) * weight(span * longest, f), F.lit(0.0))
                for k in range(1, SPANS + 1):
                    there = self._window().orderBy(SPAN).rangeBetween(-k, -k)
                    end = (span - (k - 1)) * longest
                    total = total + F.coalesce(F.sum(F.col(n) * weight(t, (span + 1) * longest)).over(there) * weight(end, f), F.lit(0.0))
                carried[f"{n}_full"] = F.col(n) + total * weight(f, t)
            table = table.withColumns(carried)
            before = self._window().orderBy(BUCKET).rowsBetween(_FIRST, -1)
            table = table.select(*_quoted(self.key), BUCKET, F.last("__t", True).over(before).alias("__then"), *[F.last(f"{n}_full", True).over(before).alias(f"{n}_then") for n in sums])
            joined = attached(rows, table, [*self.key, BUCKET])
            then = F.col("__then")
            out = {n: F.when(F.col(last).isNull(), F.col(f"{n}_then")).otherwise(F.col(n) * weight(start, F.col(last)) + F.coalesce(F.col(f"{n}_then") * weight(then, F.col(last)), F.lit(0.0))) for n in sums}
            return joined.withColumns({**out, last: F.coalesce(last, then)}).drop(BUCKET, "__then", *[f"{n}_then" for n in sums])

        *found, last = self._once("decayed", (good, rate, *values, position), [*[f"v{i}" for i in range(len(values))], "last"], step)
        return [F.col(n) for n in found], F.col(last)
