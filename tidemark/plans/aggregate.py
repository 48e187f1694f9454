"""Runs a summarizer's primitives: grouped, over frames, over time windows, or as running values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import summarizers as S
from tidemark.functions.time import from_ticks, length_in_ticks, per_tick, ticks, time_type
from tidemark.functions.windows import TimeWindow
from tidemark.plans import buckets
from tidemark.plans.scan import REACH, Scan, attached
from tidemark.plans.state import Primitive, Primitives, State

TICKS, ROW = "__ticks", "__row"
TASK_ROWS, TASK_BYTES = 500_000, 2 << 20  # of the input, for each task of a window


def quoted(names) -> list[Column]:
    """Columns by their names, dots and all."""
    return [F.col(f"`{n}`") for n in names]


def prepared(df: DataFrame, time: str) -> DataFrame:
    """df with time as a long, computed once."""
    return df.withColumn(TICKS, ticks(F.col(time), time_type(df, time)))


def state_for(df: DataFrame, time: str, order_by: tuple[str, ...], names: list[str], **more) -> State:
    return State(Primitives(), time, F.col(TICKS), per_tick(time_type(df, time)), tuple(F.col(c) for c in order_by), tuple(names), **more)


def with_group_values(df: DataFrame, values: dict[str, Column], keys: list[str]) -> DataFrame:
    """df with aggregates of each row's group."""
    return attached(df, df.groupBy(*quoted(keys)).agg(*[c.alias(n) for n, c in values.items()]), keys) if values else df


def grouped(df: DataFrame, summarizer, time: str, keys: list[str], order_by: tuple[str, ...] = (), names: list[str] | None = None) -> DataFrame:
    """keys, then outputs. df has been prepared()."""
    state = state_for(df, time, order_by, names or [c for c in df.columns if c != TICKS], before={})
    outputs = S.as_summarizer(summarizer).outputs(state)
    df = with_group_values(df, state.before, keys)
    parts = [p.aggregate.alias(n) for n, p in state.primitives.found.items()]
    if not parts:
        parts = [F.count(F.lit(1)).alias("__none")]
    by = df.groupBy(*quoted(keys)).agg(*parts)
    own = [c for c in by.columns if c not in state.primitives.found and c != "__none"]
    return by.select(*[F.col(f"`{c}`") for c in own], *[c.alias(n) for n, c in outputs])


def summarize(df: DataFrame, summarizer, time: str, key: list[str], order_by: tuple[str, ...] = ()) -> DataFrame:
    """One row per key, at time 0; an empty table gives no row."""
    kind = time_type(df, time)
    found = grouped(prepared(df, time), S.compose(S.as_summarizer(summarizer), S.Custom(lambda st: [("__rows", st.counting().other(F.lit(1), F.count))])), time, key, order_by, df.columns)
    outputs = [c for c in found.columns if c not in key and c != "__rows"]
    return found.where(F.col("__rows") > 0).select(from_ticks(F.lit(0).cast("long"), kind).alias(time), *quoted(key), *quoted(outputs))


def summarize_state(df: DataFrame, summarizer, time: str, key: list[str], order_by: tuple[str, ...] = ()) -> DataFrame:
    """The primitives themselves, which can be merged further, beside the outputs."""
    ready = prepared(df, time)
    state = state_for(ready, time, order_by, df.columns, before={})
    outputs = S.as_summarizer(summarizer).outputs(state)
    ready = with_group_values(ready, state.before, key)
    by = ready.groupBy(*key).agg(*[p.aggregate.alias(n) for n, p in state.primitives.found.items()])
    return by.select(*key, *[F.col(n).alias(f"state_{i}") for i, n in enumerate(state.primitives.found)], *[c.alias(n) for n, c in outputs])


def cycles(df: DataFrame, summarizer, time: str, key: list[str], order_by: tuple[str, ...] = ()) -> DataFrame:
    found = grouped(prepared(df, time), summarizer, time, [time, *key], order_by, df.columns)
    return found.select(*quoted([time, *key]), *quoted([c for c in found.columns if c not in (time, *key)]))


def _even_width(ready: DataFrame) -> int:
    """A bucket's width that cuts the table's range of time into several buckets for each shuffle partition."""
    first, last = ready.agg(F.min(TICKS), F.max(TICKS)).first()
    pieces = 4 * int(ready.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-(last - first + 1) // pieces)) if first is not None else 1


def running(df: DataFrame, summarizer, time: str, key: list[str], order_by: tuple[str, ...] = (), bucket=None) -> DataFrame:
    """Row by row; ties follow order_by.

    bucket (a duration): for sums, counts and extremes, running values are computed within buckets of time and the
    totals of earlier buckets are added, so that no key is bound to one task; without a key it is chosen by the table's
    range of time (one query for it). Moving averages are computed by buckets in any case. Summarizers of other parts
    (quantiles, central moments) keep a key's rows in one task, and a series without a key, too."""
    columns = df.columns
    ready = prepared(df, time)
    order = [TICKS, *order_by]
    if not order_by:
        ready = ready.withColumn(ROW, F.monotonically_increasing_id())
        order.append(ROW)

    def asked(width: int | None):
        state = state_for(ready, time, order_by, columns, before={}, scan=Scan(key, TICKS, order, width))
        return state, S.as_summarizer(summarizer).outputs(state)

    width = None if bucket is None else length_in_ticks(bucket, time_type(df, time))
    state, outputs = asked(width)
    parts = state.primitives.found
    others = state.scan.bound or any(p.kind == "other" for p in parts.values())
    if bucket is not None and others:
        raise ValueError("bucket: only for summarizers made of sums, counts and extremes")
    if bucket is None and not key and not others:
        width = _even_width(ready)
        state, outputs = asked(width)
        parts = state.primitives.found
    ready = with_group_values(ready, state.before, key)
    ready = state.scan.applied(ready)
    if width is None or not parts:
        frame = Window.partitionBy(*quoted(key)).orderBy(*quoted(order)).rowsBetween(Window.unboundedPreceding, 0)
        with_parts = ready.withColumns({n: p.aggregate.over(frame) for n, p in parts.items()})
        return with_parts.select(*quoted(columns), *[c.alias(n) for n, c in outputs])
    merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "last": F.max}
    dealt = ready.withColumn(buckets.BUCKET, buckets.home_of(TICKS, width))
    before = Window.partitionBy(*quoted(key)).orderBy(buckets.BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*quoted(key), buckets.BUCKET).agg(*[p.aggregate.alias(n) for n, p in parts.items()])
    totals = totals.select(*quoted(key), buckets.BUCKET, *[merge[p.kind](n).over(before).alias(f"{n}_before") for n, p in parts.items()])
    inside = Window.partitionBy(*quoted(key), buckets.BUCKET).orderBy(*quoted(order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumns({n: p.aggregate.over(inside) for n, p in parts.items()})
    joined = attached(rows, totals, [*key, buckets.BUCKET])
    both = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "min": F.least, "max": F.greatest, "last": F.greatest}
    both["count"] = both["sum"]
    joined = joined.withColumns({n: both[p.kind](F.col(n), F.col(f"{n}_before")) for n, p in parts.items()})
    return joined.select(*quoted(columns), *[c.alias(n) for n, c in outputs])


def windows(df: DataFrame, summarizer, time: str, window: TimeWindow, key: list[str], order_by: tuple[str, ...] = (), strategy: str = "auto", factor: int = buckets.FACTOR) -> DataFrame:
    """Every row with the summary of the rows of its key whose time lies in its window.

    strategy: "prefix" takes differences of prefix sums (sums and counts only); "blocks" merges running values of buckets
    (sums, counts and extremes). Their cost is the same whatever the window. "frame" slides a range frame (cost: rows
    times rows in a window) where blocks can't serve. "auto": for moving averages, and for centred moments without a key,
    prefix; else blocks where possible, else frame. Without a key, blocks also serve for prefix, as prefix keeps 16
    window lengths in one task. In any case rows are dealt by key and time bucket."""
    summarizer = S.as_summarizer(summarizer)
    kind, columns = time_type(df, time), df.columns
    reach = buckets.reach_of(length_in_ticks(window.length, kind))
    if isinstance(summarizer, S.LagSum):
        return _lag_windows(df, summarizer, time, window, key)
    ready = prepared(df, time)
    state = state_for(ready, time, order_by, columns, before={}, origin=F.lit(0))
    summarizer.outputs(state)
    fastest = max(state.rates, default=0.0) * reach  # a bucket's exponents must fit a double
    fits = fastest * 2 <= 2 * REACH
    factor = max(1, min(factor, int(2 * REACH / fastest) - 1)) if fits and fastest else factor
    width = buckets.width_for(reach, factor)
    state = state_for(ready, time, order_by, columns, before={} if fits else None, origin=F.col(buckets.BUCKET) * width if fits else None)
    outputs = summarizer.outputs(state)
    found = state.primitives
    merging = found.found and found.mergeable and not state.rates and not state.before
    if strategy == "auto":
        linear = found.found and (not key or state.rates)
        strategy = "prefix" if linear and found.subtractable else "frame"
    if merging and (strategy == "frame" or strategy == "prefix" and not key and found.subtractable):
        strategy = "blocks"
    if strategy == "prefix" and not found.subtractable:
        raise ValueError("prefix: only for summarizers made of sums and counts")
    if strategy == "blocks" and not found.mergeable:
        raise ValueError("blocks: only for summarizers made of sums, counts and extremes")
    if strategy == "blocks":
        if state.rates:
            raise ValueError("blocks: not for moving averages")
        found = _blocks(ready, found.found, columns, key, reach, window.future)
        return found.select(*quoted(columns), *[c.alias(n) for n, c in outputs])
    dealt = buckets.repeated(ready, TICKS, width, reach, window.future, "__own")
    if state.before:
        part = Window.partitionBy(*quoted(key), buckets.BUCKET)
        dealt = dealt.withColumns({n: c.over(part) for n, c in state.before.items()})
    if strategy == "prefix":
        return _prefix(dealt, state, outputs, columns, key, reach, window.future)
    low, high = (0, reach) if window.future else (-reach, 0)
    frame = Window.partitionBy(*quoted(key), buckets.BUCKET).orderBy(TICKS).rangeBetween(low, high)
    with_parts = dealt.withColumns({n: p.aggregate.over(frame) for n, p in state.primitives.found.items()})
    return with_parts.where("__own").select(*[F.col(f"`{c}`") for c in columns], *[c.alias(n) for n, c in outputs])


def _prefix(dealt: DataFrame, state: State, outputs, columns: list[str], key: list[str], reach: int, future: bool) -> DataFrame:
    """Sums up to the window's end less sums before its start, without a sliding frame.

    Within a bucket, each own row sends one probe before the rows at its window's start and one behind those at its end;
    one pass of prefix sums (peers included) serves rows and probes, and a row meets its probes by number within the
    same partition, without a further shuffle. NaNs are counted apart, so that one doesn't spoil all later sums."""
    parts = state.primitives.found
    values, kinds = {}, {}
    for n, p in parts.items():
        if p.kind == "count":
            values[n] = F.when(p.value.isNotNull(), 1).otherwise(0).cast("long")
        elif p.kind == "last":
            values[n] = p.value
        else:
            values[n] = F.when(F.isnan(p.value), 0.0).otherwise(F.coalesce(p.value, F.lit(0.0)))
            values[f"{n}_nan"] = F.when(F.isnan(p.value), 1).otherwise(0).cast("long")
            values[f"{n}_some"] = F.when(p.value.isNotNull(), 1).otherwise(0).cast("long")
        for v in values:
            kinds.setdefault(v, "double" if v == n and p.kind == "sum" else "long")
    start, end = (F.col(TICKS), F.col(TICKS) + reach) if future else (F.col(TICKS) - reach, F.col(TICKS))
    place = lambda at, side: F.struct(at.alias("at"), F.lit(side).alias("side"))
    row = place(F.col(TICKS), 1)
    numbered = dealt.withColumns(values).withColumn(ROW, F.monotonically_increasing_id())
    placed = numbered.withColumn("__p", F.explode(F.when(F.col("__own"), F.array(place(start, 0), row, place(end, 2))).otherwise(F.array(row))))
    side = F.col("__p.side")
    latest = {n for n, p in parts.items() if p.kind == "last"}  # the last up to the window's end, as rows come in order of time
    placed = placed.withColumns({v: F.when(side == 1, F.col(v)).otherwise(F.lit(None if v in latest else 0).cast(kinds[v])) for v in values})
    upto = Window.partitionBy(*key, buckets.BUCKET).orderBy("__p.at", "__p.side").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumns({v: (F.max if v in latest else F.sum)(v).over(upto) for v in values})
    mine = Window.partitionBy(*key, buckets.BUCKET, ROW)
    signed = {v: F.sum(F.when(side == 2, F.col(v)).when(side == 0, -F.col(v)).otherwise(F.lit(0).cast(kinds[v]))).over(mine) for v in values if v not in latest}
    signed |= {v: F.max(F.when(side == 2, F.col(v))).over(mine) for v in latest}
    found = summed.withColumns(signed).where(F.col("__own") & (side == 1))
    shown = {n: F.when(F.col(f"{n}_nan") > 0, F.lit(S.NAN)).when(F.col(f"{n}_some") == 0, F.lit(None).cast("double")).otherwise(F.col(n)) for n, p in parts.items() if p.kind == "sum"}
    return found.withColumns(shown).select(*[F.col(f"`{c}`") for c in columns], *[c.alias(n) for n, c in outputs])


def _even_buckets(ready: DataFrame, reach: int) -> tuple[int, int, int]:
    """For a series without a key (one query for its range of time and rows): the bucket's width, partitions, and the
    window's length, which need not pass the range. Partitions grow with rows, so that a task's memory doesn't."""
    first, last, rows = ready.agg(F.min(TICKS), F.max(TICKS), F.count(F.lit(1))).first()
    pieces = max(int(ready.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    if first is None:
        return 1, pieces, 0
    reach = min(reach, last - first)
    return min(reach + 1, -(-(last - first + 1) // (4 * pieces))), pieces, reach


def _partitions_for(df: DataFrame) -> int:
    """Shuffle partitions, or more for a large table, by the planner's estimate of its size."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // TASK_BYTES), 16 * least))


def _merged(a: Column, b: Column, kind: str) -> Column:
    if kind in ("sum", "count"):
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return F.least(a, b) if kind == "min" else F.greatest(a, b)


def _blocks(ready: DataFrame, parts: dict[str, Primitive], columns: list[str], key: list[str], reach: int, future: bool, shift: int = 0) -> DataFrame:
    """columns and each part over the rows in [t - reach, t] (future: [t, t + reach]), once these are moved by shift ticks.

    A window is the end of a bucket k buckets back, the buckets between, and the start of its row's bucket up to the row.
    Ends and starts are running values, those between come from a table of buckets; merging them subtracts nothing. The
    grid of the buckets back is moved, so that all windows of a bucket begin in one of them. With a key, buckets are
    one tick longer than a window; without, they are even pieces of the table's range of time, but no longer than that.

    A bucket's partition has its own rows, those of the bucket back, and a row for what lies between; each own row sends
    one probe to where its window begins, and meets it by number within the same partition."""
    width, pieces = reach + 1, 0
    if key:
        pieces = _partitions_for(ready)
    else:
        width, pieces, reach = _even_buckets(ready, reach)
    back = max(1, -(-reach // width))
    moved = back * width - reach  # of the grid of the buckets back
    t, u = "__t", "__u"
    rows = ready.withColumns({n: p.value for n, p in parts.items()}).withColumn(t, -F.col(TICKS) if future else F.col(TICKS))
    rows = rows.withColumn(u, F.col(t) + shift).withColumn("__e", F.col(u) - moved)
    numbered = rows.withColumn(ROW, F.monotonically_increasing_id())
    home, mine, far = buckets.home_of(t, width), buckets.home_of(u, width), buckets.home_of("__e", width) + back
    place = lambda bucket, pos, kind: F.struct(bucket.alias("b"), pos.alias("pos"), F.lit(kind).alias("kind"))
    own, near, theirs, probe = place(home, F.col(t), 1), place(mine, F.col(u), 3), place(far, -F.col(u), 0), place(home, reach - F.col(t), 2)
    seen = [own, near, probe] if shift else [own, probe]
    none = F.array(own, near) if shift else F.array(own)
    placed = F.when(F.col(t).isNull(), none).when(far > mine, F.array(*seen, theirs)).otherwise(F.array(*seen))
    dealt = numbered.withColumn("__p", F.explode(placed)).withColumns({buckets.BUCKET: F.col("__p.b"), "__pos": F.col("__p.pos"), "__kind": F.col("__p.kind")})
    kind = F.col("__kind")  # 1: own row, 3: what it adds if moved, 0: the bucket back's, 2: probe; null: between
    adds = kind.isin(0, 3 if shift else 1)
    dealt = dealt.withColumns({**{c: F.when(kind == 1, F.col(f"`{c}`")) for c in columns if c not in key}, **{n: F.when(adds, F.col(n)) for n in parts}})
    dealt = dealt.withColumn("__back", kind.isin(0, 2)).select(*quoted(columns), ROW, buckets.BUCKET, "__pos", "__kind", "__back", *parts)
    fold = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "last": F.max}
    between = {n: f"{n}_between" for n in parts}
    if back > 1:
        merge = fold | {"count": F.sum}
        cell = "__cell"
        cells = rows.where(F.col(u).isNotNull()).withColumn(cell, mine * 2 + F.when(F.pmod(F.col(u), F.lit(width)) >= moved, 1).otherwise(0))
        cells = cells.groupBy(*quoted(key), cell).agg(*[fold[p.kind](n).alias(n) for n, p in parts.items()]).withColumn("__ask", F.lit(False))
        asks = rows.where(F.col(t).isNotNull()).select(*quoted(key), (home * 2).alias(cell)).distinct().withColumn("__ask", F.lit(True))
        inside = Window.partitionBy(*quoted(key)).orderBy(cell).rangeBetween(3 - 2 * back, -1)
        found = cells.unionByName(asks, allowMissingColumns=True).withColumns({between[n]: merge[p.kind](n).over(inside) for n, p in parts.items()})
        found = found.where("__ask").select(*quoted(key), F.expr("__cell div 2").alias(buckets.BUCKET), F.lit(-(1 << 63)).alias("__pos"), F.lit(False).alias("__back"), *between.values())
        dealt = dealt.unionByName(found, allowMissingColumns=True)
    dealt = dealt.repartition(pieces, *quoted(key), buckets.BUCKET)
    upto = Window.partitionBy(*quoted(key), buckets.BUCKET, "__back").orderBy("__pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumns({**{n: fold[p.kind](n).over(upto) for n, p in parts.items()}, **({b: F.max(b).over(upto) for b in between.values()} if back > 1 else {})})
    pair = Window.partitionBy(*quoted(key), buckets.BUCKET, ROW)
    met = summed.where(kind.isin(1, 2)).withColumns({f"{n}_far": F.max(F.when(kind == 2, F.col(n))).over(pair) for n in parts}).where(kind == 1)
    total = {n: _merged(F.col(f"{n}_far"), F.col(n), p.kind) for n, p in parts.items()}
    if back > 1:
        total = {n: _merged(F.col(between[n]), c, parts[n].kind) for n, c in total.items()}
    return met.select(*quoted(columns), *[c.alias(n) for n, c in total.items()])


def _lag_windows(df: DataFrame, s: S.LagSum, time: str, window: TimeWindow, key: list[str]) -> DataFrame:
    """Sum in the window, and in the stretch of `lookback` that ends just before it."""
    if window.future:
        raise ValueError("lag_sum looks back")
    kind, columns = time_type(df, time), df.columns
    reach, lag = (min(length_in_ticks(x, kind), buckets.LONGEST // 2) for x in (window.length, s.lookback))
    x = F.col(s.column).cast("double")
    part = Primitive("sum", x, F.sum(x))
    found = _blocks(prepared(df, time), {"__now": part}, columns, key, reach, False)
    if lag:
        found = _blocks(prepared(found, time), {"__lag": part}, [*columns, "__now"], key, lag - 1, False, reach + 1)
    else:
        found = found.withColumn("__lag", F.lit(None).cast("double"))
    return found.select(*quoted(columns), F.coalesce("__lag", F.lit(0.0)).alias("lagSum"), F.coalesce("__now", F.lit(0.0)).alias("sum"))
