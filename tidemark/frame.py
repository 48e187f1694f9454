"""TimeSeriesFrame: a DataFrame with a time column, and the operators on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.group import GroupedData

from tidemark.functions import summarizers as S
from tidemark.functions import udf as U
from tidemark.functions.time import from_ticks, length_in_ticks, literal, nanos, ticks, time_type
from tidemark.functions.windows import TimeWindow
from tidemark.operators import intervals, joins
from tidemark.plans import aggregate, buckets


def _listed(key) -> list[str]:
    return [] if key is None else [key] if isinstance(key, str) else list(key)


class TimeSeriesFrame:
    """Wraps a DataFrame; every operator gives a new one, lazily.

    time: the time column (long nanoseconds, timestamp or timestamp_ntz). order_by: columns that order rows of equal
    time, where an operator depends on it. Any other DataFrame method may be called, too."""

    def __init__(self, df: DataFrame, time: str = "time", order_by=()) -> None:
        if len(set(df.columns)) < len(df.columns):
            raise ValueError(f"duplicate columns: {sorted({c for c in df.columns if df.columns.count(c) > 1})}")
        if time not in df.columns:
            raise ValueError(f"no column {time}")
        time_type(df, time)
        self.df, self.time, self.order_by = df, time, tuple(_listed(order_by))

    # -- construction and plain access

    @classmethod
    def from_pandas(cls, spark: SparkSession, frame, time: str = "time", schema=None, order_by=()) -> TimeSeriesFrame:
        return cls(spark.createDataFrame(frame, schema), time, order_by)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows, schema, time: str = "time", order_by=()) -> TimeSeriesFrame:
        return cls(spark.createDataFrame(rows, schema), time, order_by)

    def _with(self, df: DataFrame, time: str | None = None) -> TimeSeriesFrame:
        time = time or self.time
        return TimeSeriesFrame(df, time, [c for c in self.order_by if c in df.columns])

    def __getattr__(self, name: str):
        if name.startswith("__") or name in ("df", "time", "order_by"):
            raise AttributeError(name)
        found = getattr(self.df, name)
        if not callable(found):
            return found

        def called(*args, **kwargs):
            out = found(*[a.df if isinstance(a, TimeSeriesFrame) else a for a in args], **{k: v.df if isinstance(v, TimeSeriesFrame) else v for k, v in kwargs.items()})
            return self._rewrapped(out)

        return called

    def _rewrapped(self, out):
        """Still a series if the time column survived as it was."""
        if isinstance(out, DataFrame) and self.time in out.columns and out.schema[self.time].dataType == self.df.schema[self.time].dataType and len(set(out.columns)) == len(out.columns):
            return self._with(out)
        return out

    def __getitem__(self, item):
        return self._rewrapped(self.df[item])

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self):
        return self.df.schema

    def to_df(self, sort: bool = False) -> DataFrame:
        return self.df.orderBy(self.time, *self.order_by) if sort else self.df

    def to_pandas(self):
        return self.to_df(True).toPandas()

    def collect(self) -> list:
        return self.to_df(True).collect()

    def first(self):
        return self.to_df(True).first()

    def preview(self, n: int = 10):
        return self.to_df(True).limit(n).toPandas()

    def timestamp_df(self) -> DataFrame:
        """With time as a timestamp."""
        kind = time_type(self.df, self.time)
        if kind.typeName() != "long":
            return self.df
        return self.df.withColumn(self.time, F.timestamp_micros(F.expr(f"(`{self.time}` - pmod(`{self.time}`, 1000L)) div 1000L")))

    def validate(self) -> int:
        """How many rows break the ascending order of time within their partition; 0 if sorted."""
        from pyspark.sql import Window

        numbered = self.df.select(F.col(self.time).alias("t"), F.monotonically_increasing_id().alias("i"), F.spark_partition_id().alias("p"))
        before = F.lag("t").over(Window.partitionBy("p").orderBy("i"))
        return numbered.withColumn("b", before).where("b > t").count()

    # -- rows and columns

    def keep_rows(self, predicate: Column | Callable) -> TimeSeriesFrame:
        return self._with(self.df.where(self._predicate(predicate)))

    def delete_rows(self, predicate: Column | Callable) -> TimeSeriesFrame:
        return self._with(self.df.where(~F.coalesce(self._predicate(predicate), F.lit(False))))

    def _predicate(self, predicate) -> Column:
        return predicate if isinstance(predicate, Column) else F.udf(predicate, "boolean")(F.struct(*[F.col(f"`{c}`") for c in self.columns]))

    def filter(self, condition) -> TimeSeriesFrame:
        return self._with(self.df.where(condition))

    def keep_columns(self, *columns: str) -> TimeSeriesFrame:
        """Time stays, and comes first."""
        return self._with(self.df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([self.time, *columns])]))

    def delete_columns(self, *columns: str) -> TimeSeriesFrame:
        self._not_time(columns)
        return self._with(self.df.drop(*columns))

    def rename_columns(self, names: dict[str, str]) -> TimeSeriesFrame:
        self._not_time(names)
        order = [names.get(c, c) for c in self.order_by]
        return TimeSeriesFrame(self.df.withColumnsRenamed(names), self.time, order)

    def add_columns(self, columns: dict) -> TimeSeriesFrame:
        """name -> Column, or name -> (type, fn(row)); replaces columns of the same name."""
        row = F.struct(*[F.col(f"`{c}`") for c in self.columns])
        return self._with(self.df.withColumns({n: v if isinstance(v, Column) else F.udf(v[1], v[0])(row) for n, v in columns.items()}))

    def cast(self, types: dict) -> TimeSeriesFrame:
        self._not_time(types)
        return self._with(self.df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in types.items()}))

    def set_time(self, value: Column | Callable) -> TimeSeriesFrame:
        kind = time_type(self.df, self.time)
        column = value if isinstance(value, Column) else F.udf(value, kind)(F.struct(*[F.col(f"`{c}`") for c in self.columns]))
        return self._with(self.df.withColumn(self.time, column.cast(kind)))

    def shift(self, length, backwards: bool = False) -> TimeSeriesFrame:
        """Moves all times by a duration, or to the far end of a window; saturates. A move into the past is rounded to the next whole microsecond away, one into the future down."""
        if isinstance(length, TimeWindow):
            length, backwards = length.length, not length.future
        amount = nanos(length)
        if amount < 0:
            amount, backwards = -amount, not backwards
        kind = time_type(self.df, self.time)
        unit = 1 if kind.typeName() == "long" else 1000
        moved = -(-amount // unit) if backwards else amount // unit
        t = ticks(F.col(self.time), kind)
        if unit == 1:
            edge = F.lit(-(1 << 63)) if backwards else F.lit((1 << 63) - 1)
            out = F.coalesce(F.try_subtract(t, F.lit(moved)) if backwards else F.try_add(t, F.lit(moved)), F.when(t.isNotNull(), edge))
        else:
            out = t - moved if backwards else t + moved
        return self._with(self.df.withColumn(self.time, from_ticks(out, kind)))

    shift_time = shift

    def look_back_clock(self, length) -> TimeSeriesFrame:
        return self.shift(length, True)

    def look_forward_clock(self, length) -> TimeSeriesFrame:
        return self.shift(length)

    def between(self, begin=None, end=None) -> TimeSeriesFrame:
        """begin <= time < end."""
        from tidemark.functions.time import instant

        kind, out = time_type(self.df, self.time), self.df
        if begin is not None:
            out = out.where(F.col(self.time) >= literal(instant(begin), kind))
        if end is not None:
            out = out.where(F.col(self.time) < literal(instant(end), kind))
        return self._with(out)

    def _not_time(self, columns) -> None:
        if self.time in columns:
            raise ValueError(f"{self.time} can't be dropped, renamed or cast")

    def repartition(self, n: int) -> TimeSeriesFrame:
        return self._with(self.df.repartitionByRange(n, self.time).sortWithinPartitions(self.time, *self.order_by))

    def coalesce(self, n: int) -> TimeSeriesFrame:
        return self._with(self.df.coalesce(n))

    def with_partitions_preserved(self, fn: Callable[[DataFrame], DataFrame]) -> TimeSeriesFrame:
        return self._with(fn(self.df))

    def group_by(self, *columns) -> GroupedData:
        return self.df.groupBy(*columns)

    # -- temporal joins

    def left_join(self, right: TimeSeriesFrame, tolerance="0ns", key=None, left_alias: str | None = None, right_alias: str | None = None) -> TimeSeriesFrame:
        return self._with(joins.as_of(self.df, right.df, self.time, _listed(key), tolerance, False, False, left_alias, right_alias, right.order_by, right.time))

    def future_left_join(self, right: TimeSeriesFrame, tolerance="0ns", key=None, left_alias: str | None = None, right_alias: str | None = None, strict_lookahead: bool = False) -> TimeSeriesFrame:
        return self._with(joins.as_of(self.df, right.df, self.time, _listed(key), tolerance, True, strict_lookahead, left_alias, right_alias, right.order_by, right.time))

    def symmetric_join(self, right: TimeSeriesFrame, tolerance="0ns", key=None, left_alias: str | None = None, right_alias: str | None = None) -> TimeSeriesFrame:
        return self._with(joins.symmetric(self.df, right.df, self.time, _listed(key), tolerance, left_alias, right_alias, self.order_by, right.order_by))

    def merge(self, other: TimeSeriesFrame) -> TimeSeriesFrame:
        return self._with(joins.merge(self.df, other.df))

    def merge_either(self, other: TimeSeriesFrame) -> TimeSeriesFrame:
        return self._with(joins.either(self.df, other.df, self.time))

    # -- aggregation

    def _needs_plain(self, summarizer) -> None:
        if isinstance(summarizer, S.LagSum):
            raise ValueError("lag_sum needs a window")

    def summarize(self, summarizer, key=None) -> TimeSeriesFrame:
        self._needs_plain(summarizer)
        return self._with(aggregate.summarize(self.df, summarizer, self.time, _listed(key), self.order_by))

    def summarize_state(self, summarizer, key=None) -> DataFrame:
        return aggregate.summarize_state(self.df, summarizer, self.time, _listed(key), self.order_by)

    def summarize_cycles(self, summarizer, key=None) -> TimeSeriesFrame:
        """One row per time (and key). A dict of Python functions may stand for a summarizer."""
        self._needs_plain(summarizer)
        if isinstance(summarizer, dict):
            return self._with(U.aggregate(self.df, [self.time, *_listed(key)], summarizer, list(self.order_by)))
        return self._with(aggregate.cycles(self.df, summarizer, self.time, _listed(key), self.order_by))

    def group_by_cycle(self, key=None) -> TimeSeriesFrame:
        return self.summarize_cycles(S.rows("rows"), key)

    def summarize_intervals(self, clock, summarizer, key=None, inclusion: str = "begin", rounding: str = "end") -> TimeSeriesFrame:
        self._needs_plain(summarizer)
        clock_df, clock_time = (clock.df, clock.time) if isinstance(clock, TimeSeriesFrame) else (clock, None)
        if isinstance(summarizer, dict):
            kind = time_type(self.df, self.time)
            rows = intervals.to_intervals(self.df, clock_df, self.time, inclusion, rounding, clock_time)
            labelled = rows.withColumn("__label", from_ticks(F.col(intervals.TICK), kind))
            found = U.aggregate(labelled, ["__label", *_listed(key)], summarizer, [aggregate.TICKS, *self.order_by])
            return self._with(found.withColumnRenamed("__label", self.time))
        return self._with(intervals.summarize_intervals(self.df, clock_df, summarizer, self.time, _listed(key), inclusion, rounding, self.order_by, clock_time))

    def group_by_interval(self, clock, key=None, inclusion: str = "begin", rounding: str = "end") -> TimeSeriesFrame:
        return self.summarize_intervals(clock, S.rows("rows"), key, inclusion, rounding)

    def summarize_windows(self, window: TimeWindow, summarizer, key=None, strategy: str = "auto", factor: int = buckets.FACTOR) -> TimeSeriesFrame:
        if isinstance(summarizer, dict):
            for _, b in U.outputs_of(summarizer):
                if len(b.arguments) != 1:
                    raise ValueError("a window function takes one argument: a column or a list of columns")
            reach = buckets.reach_of(length_in_ticks(window.length, time_type(self.df, self.time)))
            dealt = buckets.repeated(aggregate.prepared(self.df, self.time), aggregate.TICKS, buckets.width_for(reach, factor), reach, window.future, "__own")
            low, high = (0, reach) if window.future else (-reach, 0)
            return self._with(U.windowed(dealt, [*_listed(key), buckets.BUCKET], aggregate.TICKS, "__own", low, high, summarizer, [aggregate.TICKS, "__own", buckets.BUCKET], list(self.order_by)))
        return self._with(aggregate.windows(self.df, summarizer, self.time, window, _listed(key), self.order_by, strategy, factor))

    def summarize_window_batches(self, window: TimeWindow, fn: Callable, outputs: dict, key=None, max_size: int = 500_000, factor: int = buckets.FACTOR) -> TimeSeriesFrame:
        """Window functions that see many windows at once: fn(left, right, begins, ends), see udf.window_batches. outputs: name -> type."""
        reach = buckets.reach_of(length_in_ticks(window.length, time_type(self.df, self.time)))
        dealt = buckets.repeated(aggregate.prepared(self.df, self.time), aggregate.TICKS, buckets.width_for(reach, factor), reach, window.future, "__own")
        low, high = (0, reach) if window.future else (-reach, 0)
        fields = [T.StructField(n, U._type(t)) for n, t in outputs.items()]
        return self._with(U.window_batches(dealt, [*_listed(key), buckets.BUCKET], aggregate.TICKS, "__own", low, high, fn, fields, [aggregate.TICKS, "__own", buckets.BUCKET], list(self.order_by), max_size))

    def add_windows(self, window: TimeWindow, key=None) -> TimeSeriesFrame:
        return self.summarize_windows(window, S.rows(window.name), key)

    def add_summary_columns(self, summarizer, key=None, bucket=None) -> TimeSeriesFrame:
        self._needs_plain(summarizer)
        return self._with(aggregate.running(self.df, summarizer, self.time, _listed(key), self.order_by, bucket))

    def add_columns_for_cycle(self, columns: dict, key=None) -> TimeSeriesFrame:
        """name -> Column over the cycle (an aggregate), a Python function, or (type, fn(rows))."""
        from pyspark.sql import Window

        by = [self.time, *_listed(key)]
        first = next(iter(columns.values()))
        if isinstance(first, Column):
            cycle = Window.partitionBy(*[F.col(f"`{c}`") for c in by])
            return self._with(self.df.withColumns({n: c.over(cycle) for n, c in columns.items()}))
        if isinstance(first, tuple):
            return self._with(U.append_from_rows(self.df, by, columns, list(self.order_by)))
        return self._with(U.append(self.df, by, columns, list(self.order_by)))


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.title() for x in rest)


for _name in [n for n in vars(TimeSeriesFrame) if "_" in n.strip("_") and not n.startswith("_")]:
    if _name not in ("to_df",):
        setattr(TimeSeriesFrame, _camel(_name), vars(TimeSeriesFrame)[_name])
TimeSeriesFrame.toDF = TimeSeriesFrame.to_df
