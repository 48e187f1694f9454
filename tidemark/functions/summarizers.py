"""Summarizers: composable aggregates for whole tables, cycles, intervals, windows and running summaries.

A summarizer skips rows where any of its own columns is null. On no rows it gives 0 (counts), 0.0 (sums, means, raw
moments), null (extremes), an empty array (rows), else NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import least_squares
from tidemark.functions.udf import arrow_file
from tidemark.functions.time import nanos
from tidemark.plans.state import Rows, State

NAN = float("nan")
Outputs = list[tuple[str, Column]]


def _nan(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(NAN))


def _ratio(a: Column, b: Column) -> Column:
    """a / b; NaN where b is 0 (or either is null)."""
    return _nan(F.try_divide(a.cast("double"), b.cast("double")))


def _root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x)).otherwise(F.lit(NAN))


def _d(column: str) -> Column:
    return F.col(column).cast("double")


@dataclass(frozen=True)
class Summarizer:
    """Subclasses say which columns they need and how outputs come from primitives."""

    def columns(self) -> tuple[str, ...]:
        return ()

    def render(self, rows: Rows) -> Outputs:
        raise NotImplementedError

    def outputs(self, state: State) -> Outputs:
        return self.render(state.counting(*self.columns()))

    def prefix(self, name: str) -> Summarizer:
        return Prefixed(self, name)

    def where(self, predicate: Column | Callable[..., Column], *columns: str) -> Summarizer:
        """Only rows where the predicate holds and the named columns aren't null. A callable gets these columns."""
        return Filtered(self, predicate, columns)


@dataclass(frozen=True)
class Prefixed(Summarizer):
    inner: Summarizer
    name: str

    def outputs(self, state):
        return [(f"{self.name}_{n}", c) for n, c in self.inner.outputs(state)]


@dataclass(frozen=True)
class Filtered(Summarizer):
    inner: Summarizer
    predicate: object
    on: tuple[str, ...]

    def outputs(self, state):
        condition = self.predicate(*[F.col(c) for c in self.on]) if callable(self.predicate) and not isinstance(self.predicate, Column) else self.predicate
        for c in self.on:
            condition = condition & F.col(c).isNotNull()
        return self.inner.outputs(state.where(F.coalesce(condition, F.lit(False))))


@dataclass(frozen=True)
class Composed(Summarizer):
    parts: tuple[Summarizer, ...]

    def outputs(self, state):
        found = [x for p in self.parts for x in p.outputs(state)]
        names = [n for n, _ in found]
        if len(set(names)) < len(names):
            raise ValueError(f"duplicate output columns: {sorted({n for n in names if names.count(n) > 1})}")
        return found


@dataclass(frozen=True)
class Stacked(Summarizer):
    parts: tuple[Summarizer, ...]

    def outputs(self, state):
        each = [p.outputs(state) for p in self.parts]
        if len({tuple(n for n, _ in x) for x in each}) > 1:
            raise ValueError("stacked summarizers need the same output columns")
        return [("stack", F.array(*[F.struct(*[c.alias(n) for n, c in x]) for x in each]))]


@dataclass(frozen=True)
class Simple(Summarizer):
    """One or more columns and a function from rows to outputs."""

    needs: tuple[str, ...]
    body: Callable[[Rows], Outputs] = field(compare=False)

    def columns(self):
        return self.needs

    def render(self, rows):
        return self.body(rows)


@dataclass(frozen=True)
class Custom(Summarizer):
    """An extension point: fn(state) gives (name, column) pairs."""

    fn: Callable[[State], Outputs]

    def outputs(self, state):
        return self.fn(state)


def compose(*summarizers) -> Summarizer:
    return Composed(tuple(as_summarizer(s) for s in summarizers))


def stack(*summarizers) -> Summarizer:
    return Stacked(tuple(summarizers))


def as_summarizer(s) -> Summarizer:
    return compose(*s) if isinstance(s, (list, tuple)) else s


def count(column: str | None = None) -> Summarizer:
    if column is None:
        return Custom(lambda state: [("count", state.counting(state.time).count())])
    return Simple((column,), lambda r: [(f"{column}_count", r.count(F.col(column)))])


def sum(column: str) -> Summarizer:  # noqa: A001
    return Simple((column,), lambda r: [(f"{column}_sum", r.sum(_d(column)))])


def mean(column: str) -> Summarizer:
    return Simple((column,), lambda r: [(f"{column}_mean", F.coalesce(F.try_divide(r.sum(_d(column)), r.count(F.col(column))), F.lit(0.0)))])


def stddev(column: str) -> Summarizer:
    return Simple((column,), lambda r: [(f"{column}_stddev", _nan(r.other(_d(column), F.stddev_samp)))])


def variance(column: str) -> Summarizer:
    return Simple((column,), lambda r: [(f"{column}_variance", _nan(r.other(_d(column), F.var_samp)))])


def covariance(x: str, y: str) -> Summarizer:
    """Population covariance."""
    return Simple((x, y), lambda r: [(f"{x}_{y}_covariance", _nan(r.other2(_d(x), _d(y), F.covar_pop)))])


def min(column: str) -> Summarizer:  # noqa: A001
    return Simple((column,), lambda r: [(f"{column}_min", r.min(F.col(column)))])


def max(column: str) -> Summarizer:  # noqa: A001
    return Simple((column,), lambda r: [(f"{column}_max", r.max(F.col(column)))])


def dot_product(x: str, y: str) -> Summarizer:
    return Simple((x, y), lambda r: [(f"{x}_{y}_dotProduct", r.sum(_d(x) * _d(y)))])


def _log_parts(r: Rows, column: str) -> tuple[Column, Column, Column, Column]:
    """count, zeros, negatives, sum of ln|x| over x != 0."""
    x = _d(column)
    one = lambda c: r.sum(F.when(c, 1.0).otherwise(0.0))
    return r.count(F.col(column)), one(x == 0), one(x < 0), r.sum(F.when(x == 0, 0.0).otherwise(F.ln(F.abs(x))))


def product(column: str) -> Summarizer:
    """Sign parity times exp(sum of logarithms); 0 if any value is 0."""

    def body(r):
        n, zeros, negative, logs = _log_parts(r, column)
        return [(f"{column}_product", F.when(n == 0, F.lit(NAN)).when(zeros > 0, F.lit(0.0)).otherwise(F.when(negative % 2 == 1, -1.0).otherwise(1.0) * F.exp(logs)))]

    return Simple((column,), body)


def geometric_mean(column: str) -> Summarizer:
    def body(r):
        n, zeros, negative, logs = _log_parts(r, column)
        value = F.when(negative % 2 == 1, -1.0).otherwise(1.0) * F.exp(F.try_divide(logs, n))
        return [(f"{column}_geometricMean", F.when(n == 0, F.lit(NAN)).when(zeros > 0, F.lit(0.0)).otherwise(value))]

    return Simple((column,), body)


def nth_moment(column: str, n: int) -> Summarizer:
    if n < 0:
        raise ValueError("n must be 0 or more")
    return Simple((column,), lambda r: [(f"{column}_{n}thMoment", F.coalesce(F.try_divide(r.sum(F.pow(_d(column), F.lit(n))), r.count(F.col(column))), F.lit(0.0)))])


def nth_central_moment(column: str, n: int) -> Summarizer:
    """Population. Up to the fourth from Spark's own central moments; above, by expansion of raw power sums, which lose
    digits where the mean is large against the deviation."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    name = f"{column}_{n}thCentralMoment"

    def body(r):
        x = _d(column)
        if n == 1:
            return [(name, r.sum(F.lit(0.0)))]
        m2 = r.other(x, F.var_pop)
        if n == 2:
            return [(name, _nan(m2))]
        if n == 3:
            return [(name, _nan(F.when(m2 == 0, F.when(r.count(F.col(column)) > 0, 0.0)).otherwise(r.other(x, F.skewness) * F.pow(m2, F.lit(1.5)))))]
        if n == 4:
            return [(name, _nan(F.when(m2 == 0, F.when(r.count(F.col(column)) > 0, 0.0)).otherwise((r.other(x, F.kurtosis) + 3) * m2 * m2)))]
        amount = r.count(F.col(column))
        raw = [F.lit(1.0)] + [F.try_divide(r.sum(F.pow(x, F.lit(i))), amount) for i in range(1, n + 1)]
        total = F.lit(0.0)
        for i in range(n + 1):
            total = total + raw[i] * F.pow(-raw[1], F.lit(n - i)) * float(math.comb(n, i))
        return [(name, _nan(total))]

    return Simple((column,), body)


def skewness(column: str) -> Summarizer:
    return Simple((column,), lambda r: [(f"{column}_skewness", _nan(r.other(_d(column), F.skewness)))])


def kurtosis(column: str) -> Summarizer:
    return Simple((column,), lambda r: [(f"{column}_kurtosis", _nan(r.other(_d(column), F.kurtosis)))])


def z_score(column: str, in_sample: bool) -> Summarizer:
    """(last value - mean) / sample deviation; out of sample, the statistics leave the last value out."""

    def body(r):
        x = _d(column)
        if in_sample:
            last = r.other2(x, F.struct(r.state.ticks, *r.state.order), F.max_by)
            n, mu, m2 = r.count(F.col(column)), r.other(x, F.avg), r.other(x, F.var_pop) * r.count(F.col(column))
            sd = _root(F.try_divide(m2, n - 1))
        else:
            last, n, mu, sd = r.without_last(x)
        return [(f"{column}_zScore", F.when(n > 1, _ratio(last - mu, sd)).otherwise(F.lit(NAN)))]

    return Simple((column,), body)


def _correlation(x: str, y: str) -> Summarizer:
    def body(r):
        corr = r.other2(_d(x), _d(y), F.corr)
        c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _nan(corr)))
        c = F.when(F.isnan(_nan(corr)), F.lit(NAN)).otherwise(c)
        n = r.count()
        rest = F.greatest(1 - c * c, F.lit(0.0))
        t = F.when(F.isnan(c) | (n < 2), F.lit(NAN)).when(rest == 0, F.when(n > 2, F.signum(c) * F.lit(float("inf"))).otherwise(F.lit(NAN))).otherwise(c * _root(F.try_divide(n - 2, rest)))
        return [(f"{x}_{y}_correlation", c), (f"{x}_{y}_correlationTStat", t)]

    return Simple((x, y), body)


def correlation(columns: str | Sequence[str], other: str | Sequence[str] | None = None) -> Summarizer:
    """All pairs of columns, or each of columns with each of other."""
    listed = lambda c: [c] if isinstance(c, str) else list(c)
    if other is None:
        return compose(*[_correlation(x, y) for x, y in combinations(listed(columns), 2)])
    if set(listed(columns)) & set(listed(other)):
        raise ValueError("columns and other overlap")
    return compose(*[_correlation(x, y) for x in listed(columns) for y in listed(other)])


def _weighted_parts(r: Rows, x: str, y: str, w: str) -> tuple[Column, ...]:
    """W, sum of w^2, and the weighted sums of dx dy, dx^2, dy^2; products are of differences from centres."""
    x, y, w = _d(x), _d(y), _d(w)
    x, y = x - r.centre(x), y - r.centre(y)
    total, squares, wx, wy = r.sum(w), r.sum(w * w), r.sum(w * x), r.sum(w * y)

    def centred(a, b, wa, wb):
        return r.sum(w * a * b) - F.try_divide(wa * wb, total)

    return total, squares, centred(x, y, wx, wy), F.greatest(centred(x, x, wx, wx), F.lit(0.0)), F.greatest(centred(y, y, wy, wy), F.lit(0.0))


def _middle(r: Rows, centre: Column) -> Column:
    """A centre as an aggregate: it is the same in all rows of a group (or of a window's partition)."""
    return F.coalesce(r.max(centre), F.lit(0.0))


def weighted_covariance(x: str, y: str, w: str) -> Summarizer:
    def body(r):
        total, squares, xy, _, _ = _weighted_parts(r, x, y, w)
        return [(f"{x}_{y}_{w}_weightedCovariance", _ratio(xy, total - F.try_divide(squares, total)))]

    return Simple((x, y, w), body)


def weighted_correlation(x: str, y: str, w: str) -> Summarizer:
    def body(r):
        _, _, xy, xx, yy = _weighted_parts(r, x, y, w)
        return [(f"{x}_{y}_{w}_weightedCorrelation", _ratio(xy, F.sqrt(xx) * F.sqrt(yy)))]

    return Simple((x, y, w), body)


def weighted_mean(value: str, weight: str) -> Summarizer:
    """Rows of weight 0 are skipped; a negative weight turns its value's sign."""

    def body(r):
        w, v = F.abs(_d(weight)), _d(value) * F.signum(_d(weight))
        some = Rows(r.state, (r.good if r.good is not None else F.lit(True)) & (_d(weight) != 0))
        centre = some.centre(v)
        dv = v - centre
        total, squares, wv, n = some.sum(w), some.sum(w * w), some.sum(w * dv), some.count()
        off = F.try_divide(wv, total)
        average = _middle(some, centre) + off
        spread = F.greatest(some.sum(w * dv * dv) - F.coalesce(off, F.lit(0.0)) * wv, F.lit(0.0))
        var = F.try_divide(spread * total, total * total - squares)
        sd = _root(F.coalesce(var, F.lit(NAN)))
        t = F.when(n == 0, F.lit(NAN)).otherwise(_root(F.coalesce(F.try_divide(total * total, squares), F.lit(NAN))) * _ratio(average, sd))
        name = f"{value}_{weight}"
        return [(f"{name}_weightedMean", _nan(average)), (f"{name}_weightedStandardDeviation", _nan(sd)), (f"{name}_weightedTStat", t), (f"{name}_observationCount", n)]

    return Simple((value, weight), body)


def weighted_mean_test(value: str, weight: str) -> Summarizer:
    """The other definition: variance SS / W, t = sqrt(n) mean / deviation, rows of weight 0 count."""

    def body(r):
        w, v = _d(weight), _d(value)
        centre = r.centre(v)
        dv = v - centre
        total, wv, n = r.sum(w), r.sum(w * dv), r.count()
        off = F.try_divide(wv, total)
        average = _middle(r, centre) + off
        sd = _root(F.greatest(F.coalesce(F.try_divide(r.sum(w * dv * dv), total) - off * off, F.lit(NAN)), F.lit(0.0)))
        name = f"{value}_{weight}"
        return [(f"{name}_mean", _nan(average)), (f"{name}_stddev", _nan(sd)), (f"{name}_tStat", F.sqrt(n.cast("double")) * _ratio(average, sd)), (f"{name}_count", n)]

    return Simple((value, weight), body)


def quantile(column: str, ps: float | Sequence[float]) -> Summarizer:
    """Exact, with linear interpolation between order statistics."""
    some = [ps] if isinstance(ps, (int, float)) else list(ps)
    if any(not 0 < p <= 1 for p in some):
        raise ValueError("0 < p <= 1")
    return Simple((column,), lambda r: [(f"{column}_{float(p)}quantile", _nan(r.other(_d(column), lambda v, p=p: F.percentile(v, float(p))))) for p in some])


def rows(column: str = "rows") -> Summarizer:
    """All rows as structs, in order; nulls stay."""

    def fn(state: State):
        found = Rows(state, state.condition).ordered(F.struct(*[F.col(n) for n in state.names]), names=("row",))
        return [(column, F.transform(found, lambda v: v["row"]))]

    return Custom(fn)


def arrow(columns: Sequence[str], include_base_rows: bool = False) -> Summarizer:
    """A group's rows of these columns, in order, as the bytes of an Arrow file; with include_base_rows also as structs."""

    def fn(state: State):
        found = Rows(state, state.condition).ordered(F.struct(*[F.col(c) for c in columns]), names=("row",))
        rows = F.transform(found, lambda v: v["row"])
        return [*([("__baseRows", rows)] if include_base_rows else []), ("arrow_bytes", arrow_file(rows))]

    return Custom(fn)


def lag_sum(column: str, lookback) -> Summarizer:
    """Sum over the window and over the stretch of `lookback` before it; for summarize_windows only."""
    return LagSum(column, nanos(lookback))


@dataclass(frozen=True)
class LagSum(Summarizer):
    column: str
    lookback: int

    def columns(self):
        return (self.column,)

    def render(self, rows):
        raise ValueError("lag_sum needs a window: use summarize_windows")


def exponential_smoothing(column: str, alpha: float = 0.05, priming_periods: float = 1.0, period="1d", interpolation: str = "current", convention: str = "core") -> Summarizer:
    """Exponential moving average over irregular times; `period` is the length of one period."""
    if interpolation not in ("previous", "current", "linear") or convention not in ("core", "convolution", "legacy"):
        raise ValueError("interpolation: previous, current, linear; convention: core, convolution, legacy")
    log_decay, unit = math.log(1 - alpha), float(nanos(period))

    def decay(p: Column) -> Column:
        return F.exp(p * log_decay)

    def between(a: Column, b: Column, p: Column) -> Column:
        d = decay(p)
        if interpolation == "previous":
            v = (1 - d) * a
        elif interpolation == "current":
            v = (1 - d) * b
        else:
            i = F.try_divide(d - 1, p * log_decay)
            v = (i - d) * a + (1 - i) * b
        return F.when(p == 0, F.lit(0.0)).otherwise(v)

    def finished(e: Column, a: Column, t: Column, first: Column, scale: float) -> Column:
        """e, a: decayed sums as of the last row, at t; first: struct<p, x> of the first row."""
        primed = first["p"].cast("double") * scale if convention == "legacy" else F.lit(float(priming_periods))
        fade = decay(F.greatest((t - first["p"]).cast("double") * scale, F.lit(0.0)))
        e = fade * between(F.lit(0.0), first["x"], primed) + e
        return _ratio(e, fade * between(F.lit(0.0), F.lit(1.0), primed) + a) if convention == "core" else e

    def body(r):
        scale = r.state.nanos_per_tick / unit
        one = F.lit(1.0)
        if r.state.scan:  # running: what each row adds, decayed
            x = _d(column)
            prior, first = r.state.scan.neighbours(r.good, x)
            p = (r.state.ticks - prior["p"]).cast("double") * scale
            added = [F.when(prior.isNull(), 0.0).otherwise(v) for v in (between(prior["x"], x, p), between(one, one, p))]
            (e, a), last = r.state.scan.decayed(r.good, -log_decay * scale, added)
            return [(f"{column}_ema", F.when(last.isNull(), F.lit(NAN)).otherwise(finished(e, a, last, first, scale)))]
        fields = ("n", "e", "a", "x", "t", "x0", "t0")

        def made(*v):
            return F.struct(*[c.alias(n) for n, c in zip(fields, v, strict=True)])

        zero = made(F.lit(0), *[F.lit(0.0)] * 3, F.lit(0).cast("long"), F.lit(0.0), F.lit(0).cast("long"))

        def step(s, v):
            p = (v["t"] - s["t"]).cast("double") * scale
            first = s["n"] == 0
            e = F.when(first, F.lit(0.0)).otherwise(decay(p) * s["e"] + between(s["x"], v["x"], p))
            a = F.when(first, F.lit(0.0)).otherwise(decay(p) * s["a"] + between(one, one, p))
            return made(s["n"] + 1, e, a, v["x"], v["t"], F.when(first, v["x"]).otherwise(s["x0"]), F.when(first, v["t"]).otherwise(s["t0"]))

        def finish(s):
            first = F.struct(s["t0"].alias("p"), s["x0"].alias("x"))
            return F.when(s["n"] == 0, F.lit(NAN)).otherwise(finished(s["e"], s["a"], s["t"], first, scale))

        return [(f"{column}_ema", F.aggregate(r.ordered(_d(column), names=("x",)), zero, step, finish))]

    return Simple((column,), body)


def ema_half_life(column: str, half_life, interpolation: str = "previous", convention: str = "legacy") -> Summarizer:
    return exponential_smoothing(column, 0.5, 0.0, half_life, interpolation, convention)


def ewma(column: str, alpha: float = 0.05, duration_per_period="1d", convention: str = "legacy") -> Summarizer:
    """Sum of x * (1 - alpha)^(periods to the last row); "core" divides by the sum of weights. "constant": a row is a period."""
    if convention not in ("core", "legacy"):
        raise ValueError("convention: core, legacy")
    log_decay = math.log(1 - alpha)

    constant = duration_per_period == "constant"

    def body(r):
        x, one = _d(column), F.lit(1.0)
        if constant:
            scan = r.state.scan
            found = scan and scan.decayed(r.good, -log_decay, [x, one], scan.numbered(r.good))[0]
        else:
            found = r.decayed(-log_decay * r.state.nanos_per_tick / float(nanos(duration_per_period)), x, one)
        if not found:
            return [(f"{column}_ewma", F.transform(F.array(r.ordered(x, names=("x",))), lambda values: from_list(values, r))[0])]  # the list is sorted once
        value = _ratio(*found) if convention == "core" else found[0]
        return [(f"{column}_ewma", F.when(r.count(F.col(column)) == 0, F.lit(NAN)).otherwise(value))]

    def from_list(values: Column, r: Rows) -> Column:
        """Where weights count rows, or fade so fast that a window's sums can't be differences of prefix sums."""
        n = F.size(values)

        def periods(v, i):
            if constant:
                return (n - 1 - i).cast("double")
            return (F.get(values, n - 1)["t"] - v["t"]).cast("double") * (r.state.nanos_per_tick / float(nanos(duration_per_period)))

        weighted = F.transform(values, lambda v, i: F.struct((F.exp(periods(v, i) * log_decay)).alias("w"), v["x"].alias("x")))
        zero = F.struct(F.lit(0.0).alias("e"), F.lit(0.0).alias("a"))
        total = F.aggregate(weighted, zero, lambda s, v: F.struct((s["e"] + v["w"] * v["x"]).alias("e"), (s["a"] + v["w"]).alias("a")), lambda s: _ratio(s["e"], s["a"]) if convention == "core" else s["e"])
        return F.when(n == 0, F.lit(NAN)).otherwise(total)

    return Simple((column,), body)


def _shown(value: Column, kind: str) -> Column:
    """NaNs, which come back from Python as nulls."""
    if kind == "array<double>":
        return F.transform(value, _nan)
    return _nan(value) if kind == "double" else value


def linear_regression(y: str, xs: Sequence[str], weight: str | None = None, use_intercept: bool = True, ignore_const: bool = False, const_bound: float = 1e-12) -> Summarizer:
    """Ordinary (or weighted) least squares from sums of products; the solution is found in vectorized Python."""
    names = list(xs)

    def body(r):
        w = _d(weight) if weight else F.lit(1.0)
        centres = [r.centre(_d(c)) if use_intercept else F.lit(0.0) for c in (*names, y)]
        *each, label = [_d(c) - m for c, m in zip((*names, y), centres, strict=True)]
        columns = [*([F.lit(1.0)] if use_intercept else []), *each]
        gram = [r.sum(w * a * b) for i, a in enumerate(columns) for b in columns[i:]]
        moments = [r.sum(w * a * label) for a in columns]
        spread = [F.coalesce(r.other(_d(x), F.var_pop), F.lit(0.0)) for x in names]
        rest = [r.sum(w * label * label), r.sum(w), r.sum(F.ln(w)) if weight else F.lit(0.0), r.sum(w * label), r.count().cast("double")]
        rest += [_middle(r, c) if use_intercept else c for c in centres]
        solved = least_squares.solver(names, use_intercept, ignore_const, const_bound)(F.array(*gram, *moments, *spread, *rest))
        return [(n, _shown(solved[n], kind)) for n, kind in least_squares.KINDS.items()]

    return Simple((y, *names, *([weight] if weight else [])), body)

