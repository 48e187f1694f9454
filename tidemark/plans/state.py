"""Where a summarizer's primitive aggregates run.

A summarizer asks a State for primitives (sums, counts, extremes, ordered lists) and gets column references; how these
are computed (grouped, over a frame, by a difference of prefix sums) is decided afterwards, once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.plans.scan import Scan


@dataclass(frozen=True)
class Primitive:
    kind: str  # sum, count, min, max, last (the largest time), other
    value: Column
    aggregate: Column


class Primitives:
    """Collects primitives; equal ones are computed once."""

    def __init__(self) -> None:
        self.found: dict[str, Primitive] = {}
        self._names: dict[str, str] = {}

    def name(self, kind: str, value: Column, aggregate: Column) -> str:
        key = str(aggregate)
        if key not in self._names:
            self._names[key] = f"__state_{len(self._names)}"
            self.found[self._names[key]] = Primitive(kind, value, aggregate)
        return self._names[key]

    @property
    def subtractable(self) -> bool:
        return all(p.kind in ("sum", "count", "last") for p in self.found.values())

    @property
    def mergeable(self) -> bool:
        return all(p.kind != "other" for p in self.found.values())


@dataclass(frozen=True)
class State:
    """What a summarizer sees. rows: columns that must not be null for a row to count; condition: a further filter.

    before: aggregates of the group (or of a window's partition) that the caller adds to each row beforehand, by name;
    None where it can't. scan: for running values. origin: ticks from which decaying weights are counted in windows.
    rates: decay rates that were asked for."""

    primitives: Primitives
    time: str
    ticks: Column  # time as a long
    nanos_per_tick: int
    order: tuple[Column, ...] = ()
    names: tuple[str, ...] = ()
    condition: Column | None = None
    before: dict[str, Column] | None = None
    scan: Scan | None = None
    origin: Column | None = None
    rates: list[float] = field(default_factory=list)

    def where(self, condition: Column) -> State:
        return replace(self, condition=condition if self.condition is None else self.condition & condition)

    def counting(self, *columns: str) -> Rows:
        good = self.condition
        for c in columns:
            good = F.col(c).isNotNull() if good is None else good & F.col(c).isNotNull()
        return Rows(self, good)


@dataclass(frozen=True)
class Rows:
    """Primitives over the rows that count."""

    state: State
    good: Column | None

    def _only(self, value: Column) -> Column:
        return value if self.good is None else F.when(self.good, value)

    def _add(self, kind: str, value: Column, fn: Callable[[Column], Column]) -> Column:
        return F.col(self.state.primitives.name(kind, value, fn(value)))

    def sum(self, value: Column) -> Column:
        """0.0 without rows."""
        return F.coalesce(self._add("sum", self._only(value.cast("double")), F.sum), F.lit(0.0))

    def count(self, value: Column | None = None) -> Column:
        return self._add("count", self._only(F.lit(1) if value is None else value), F.count)

    def min(self, value: Column) -> Column:
        return self._add("min", self._only(value), F.min)

    def max(self, value: Column) -> Column:
        return self._add("max", self._only(value), F.max)

    def _before(self, fn: Callable[[Column], Column], value: Column) -> Column:
        made = fn(self._only(value))
        for name, known in self.state.before.items():
            if str(known) == str(made):
                return F.col(name)
        name = f"__before_{len(self.state.before)}"
        self.state.before[name] = made
        return F.col(name)

    def centre(self, value: Column) -> Column:
        """A constant of the group near its mean, to be subtracted before products are summed; 0 where none is at hand."""
        return F.lit(0.0) if self.state.before is None else F.coalesce(self._before(F.avg, value), F.lit(0.0))

    def without_last(self, x: Column) -> tuple[Column, Column, Column, Column]:
        """The last value of the rows that count; and count, mean and sample deviation of the others. These are made from
        the others alone: taking the last out of sums over all leaves mere rounding where the others are equal."""
        state = self.state
        if state.scan is not None:
            found = state.scan.before(F.lit(True) if self.good is None else self.good, x)
            return found["last"], found["n"], found["mean"], found["sd"]
        if state.before is not None and state.origin is None:
            row = F.struct(state.ticks.alias("t"), *[c.alias(f"o{i}") for i, c in enumerate(state.order)], x.alias("x"))
            last = self._before(F.max, row)
            rest, same = (Rows(state, c if self.good is None else self.good & c) for c in (row < last, row == last))
            value, n, copies = self._add("max", self._only(row), F.max)["x"], rest.count(), same.count() - 1
            mean, m2 = F.coalesce(rest.other(x, F.avg), F.lit(0.0)), F.coalesce(rest.other(x, F.var_pop) * n, F.lit(0.0))
            total, apart = n + copies, value - mean  # rows equal to the last are no rows before it, but count but for one
            m2 = m2 + F.coalesce(apart * apart * F.try_divide(n * copies, total), F.lit(0.0))
            return value, total, mean + F.coalesce(apart * F.try_divide(copies, total), F.lit(0.0)), F.sqrt(F.try_divide(m2, total - 1))
        rows = F.transform(self.ordered(x, names=("x",)), lambda v: v["x"])
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

        def step(a, v):
            n = a["n"] + 1
            mean = a["mean"] + (v - a["mean"]) / n
            return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + (v - a["mean"]) * (v - mean)).alias("m2"))

        found = F.aggregate(F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))), start, step)
        return F.element_at(F.when(F.size(rows) > 0, rows), -1), found["n"], found["mean"], F.sqrt(F.try_divide(found["m2"], found["n"] - 1))

    def decayed(self, rate: float, *values: Column) -> list[Column] | None:
        """Sums of value * exp(-rate * (last - t)), t in ticks, last of the last row that counts; None where they would
        have to be taken from a list."""
        state = self.state
        state.rates.append(rate)
        if state.scan is not None:
            return state.scan.decayed(F.lit(True) if self.good is None else self.good, rate, list(values))[0]
        if state.origin is not None:
            last = self._add("last", self._only(state.ticks), F.max)
            fade = F.exp((state.origin - last).cast("double") * rate)
            return [self.sum(v * F.exp((state.ticks - state.origin).cast("double") * rate)) * fade for v in values]
        if state.before is not None:
            last = self._before(F.max, state.ticks)
            return [self.sum(v * F.exp((state.ticks - last).cast("double") * rate)) for v in values]
        return None

    def other(self, value: Column, fn: Callable[[Column], Column]) -> Column:
        """fn(value) with rows that don't count as null."""
        return self._add("other", self._only(value), fn)

    def other2(self, x: Column, y: Column, fn: Callable[[Column, Column], Column]) -> Column:
        a, b = self._only(x), self._only(y)
        return F.col(self.state.primitives.name("other", a, fn(a, b)))

    def ordered(self, *values: Column, names: tuple[str, ...]) -> Column:
        """array<struct<t, o0.., names..>> in row order."""
        row = F.struct(self.state.ticks.alias("t"), *[c.alias(f"o{i}") for i, c in enumerate(self.state.order)], *[v.alias(n) for v, n in zip(values, names, strict=True)])
        return F.sort_array(self._add("other", self._only(row), F.collect_list))
