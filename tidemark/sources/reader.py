"""Reading series: parquet, CSV, pandas, DataFrames and clocks, with a time range."""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import TimeSeriesFrame
from tidemark.functions.time import instant, literal, nanos, time_type
from tidemark.sources import clocks

UNITS = {"s": 10**9, "ms": 10**6, "us": 10**3, "ns": 1}


class Reader:
    """Fluent: option(s), range, expand, then parquet, csv, pandas, dataframe or clock.

    Options: time_unit (of long time columns; ns), time_column ("time"), columns (a list, or names joined by commas),
    is_sorted (kept for callers; nothing depends on it), and whatever a CSV reader takes."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.options_, self.begin, self.end, self.before, self.after = spark, {}, None, None, 0, 0

    def _copy(self) -> Reader:
        out = copy.copy(self)
        out.options_ = dict(self.options_)
        return out

    def option(self, name: str, value) -> Reader:
        out = self._copy()
        out.options_[name] = value
        return out

    def options(self, **values) -> Reader:
        out = self._copy()
        out.options_ |= values
        return out

    def range(self, begin=None, end=None) -> Reader:
        """begin <= time < end."""
        out = self._copy()
        out.begin, out.end = (None if x is None else instant(x) for x in (begin, end))
        return out

    def expand(self, begin=None, end=None) -> Reader:
        """Widens the range by durations."""
        out = self._copy()
        out.before, out.after = (0 if x is None else nanos(x) for x in (begin, end))
        return out

    @property
    def bounds(self) -> tuple[int | None, int | None]:
        return None if self.begin is None else self.begin - self.before, None if self.end is None else self.end + self.after

    def dataframe(self, df: DataFrame) -> TimeSeriesFrame:
        """Filter and projection are left to the optimizer, which hands them to the source."""
        column = self.options_.get("time_column", "time")
        kind = time_type(df, column)
        low, high = self.bounds
        unit = UNITS[self.options_.get("time_unit", "ns")] if kind.typeName() == "long" else 1
        at = lambda ns: F.lit(-(-ns // unit)) if kind.typeName() == "long" else literal(ns, kind)
        if low is not None:
            df = df.where(F.col(column) >= at(low))
        if high is not None:
            df = df.where(F.col(column) < at(high))
        columns = self.options_.get("columns")
        if columns:
            wanted = columns.split(",") if isinstance(columns, str) else list(columns)
            df = df.select(*dict.fromkeys([column, *wanted]))
        else:
            df = df.select(column, *[c for c in df.columns if c != column])
        if unit != 1:
            df = df.withColumn(column, F.col(column) * unit)
        if column != "time":
            if "time" in df.columns:
                raise ValueError("there is another column named time")
            df = df.withColumnRenamed(column, "time")
        return TimeSeriesFrame(df)

    def parquet(self, *paths: str) -> TimeSeriesFrame:
        return self.dataframe(self.spark.read.parquet(*paths))

    def pandas(self, frame, schema=None) -> TimeSeriesFrame:
        return self.dataframe(self.spark.createDataFrame(frame, schema))

    def csv(self, path, schema=None, header: bool = True, keep_time: bool = False, date_format: str | None = None, **options) -> TimeSeriesFrame:
        """Without header and schema the first column is time. keep_time keeps the column as it was, as time_.

        With the option epoch_ms a timestamp or date becomes a long of milliseconds since the epoch. Other types than
        integers, dates and timestamps can't be a time column."""
        read = self.spark.read.options(header=header, inferSchema=schema is None, **options)
        if date_format:
            read = read.option("timestampFormat", date_format)
        df = read.csv(path, schema=schema)
        column = self.options_.get("time_column") or (df.columns[0] if not header and schema is None else "time")
        kind = df.schema[column].dataType.typeName()
        if keep_time:
            df = df.withColumn("time_", F.col(column))
        if kind in ("integer", "short", "byte"):
            df = df.withColumn(column, F.col(column).cast("long"))
        elif kind == "date":
            df = df.withColumn(column, F.col(column).cast("timestamp"))
        if self.options_.get("epoch_ms") and kind in ("date", "timestamp", "timestamp_ntz"):
            df = df.withColumn(column, F.unix_millis(F.col(column).cast("timestamp")))
        return self.option("time_column", column).dataframe(df)

    def clock(self, name: str = "uniform", frequency="1d", offset="0s", end_inclusive: bool = True, kind: str = "timestamp", **more) -> TimeSeriesFrame:
        low, high = self.bounds
        if low is None or high is None:
            raise ValueError("a clock needs a range")
        if name not in ("uniform", "random"):
            raise ValueError(f"no clock {name}")
        import pandas as pd

        make = clocks.uniform_frame if name == "uniform" else clocks.random_frame
        return TimeSeriesFrame(make(self.spark, frequency, offset, pd.Timestamp(low), pd.Timestamp(high), end_inclusive, kind=kind, **more))


def read(spark: SparkSession) -> Reader:
    return Reader(spark)
