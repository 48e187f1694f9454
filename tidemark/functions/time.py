"""Durations, instants and time columns.

A time column is a timestamp, a timestamp without zone, or a long of nanoseconds. Inside, all arithmetic is on longs in
the column's own resolution ("ticks"): microseconds for timestamps, nanoseconds for longs.
"""

from __future__ import annotations

import datetime
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NANOS = {"ns": 1, "nano": 1, "us": 10**3, "micro": 10**3, "ms": 10**6, "milli": 10**6, "s": 10**9, "sec": 10**9, "second": 10**9, "m": 60 * 10**9, "min": 60 * 10**9, "minute": 60 * 10**9, "h": 3600 * 10**9, "hour": 3600 * 10**9, "d": 86400 * 10**9, "day": 86400 * 10**9}
_DURATION = re.compile(r"\s*(-?\d+(?:\.\d+)?)\s*([a-z]+?)(s?)\s*", re.I)
EPOCH = pd.Timestamp(0)


def nanos(duration) -> int:
    """A duration in nanoseconds: '5s', '1 day', '100ns', '2hours', a timedelta, or nanoseconds themselves."""
    if isinstance(duration, int):
        return duration
    if isinstance(duration, datetime.timedelta):
        return pd.Timedelta(duration).value
    m = _DURATION.fullmatch(duration)
    if m:
        number, unit, plural = m[1], m[2].lower(), m[3].lower()
        for u in (unit + plural, unit):
            if u in NANOS:
                return round(float(number) * NANOS[u]) if "." in number else int(number) * NANOS[u]
    return pd.Timedelta(duration).value


def instant(value) -> int:
    """A date in nanoseconds since the epoch: YYYYMMDD as int or text, ISO text, datetime; zones are taken to UTC."""
    if isinstance(value, bool):
        raise TypeError("not a date")
    if isinstance(value, int):
        value = str(value) if 10**7 <= value < 10**8 else pd.Timestamp(value)
    stamp = pd.Timestamp(value)
    return (stamp.tz_convert("UTC") if stamp.tzinfo else stamp.tz_localize("UTC")).value


def time_type(df: DataFrame, time: str) -> T.DataType:
    kind = df.schema[time].dataType
    if not isinstance(kind, (T.LongType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{time} is {kind.simpleString()}; a time column is long (nanoseconds), timestamp or timestamp_ntz")
    return kind


def ticks(col: Column, kind: T.DataType) -> Column:
    """A time column as a long in its own resolution."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.TimestampNTZType):
        return (((col - F.expr("timestamp_ntz'1970-01-01'")).cast("interval second")).cast("decimal(20,6)") * 1_000_000).cast("long")
    return col.cast("long")


def from_ticks(col: Column, kind: T.DataType) -> Column:
    """The inverse of ticks()."""
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(col)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr("timestamp_ntz'1970-01-01'") + F.make_dt_interval(secs=(col.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)"))
    return col.cast("long")


def per_tick(kind: T.DataType) -> int:
    """Nanoseconds in a tick."""
    return 1 if isinstance(kind, T.LongType) else 1000


def length_in_ticks(duration, kind: T.DataType) -> int:
    """Rounded down to whole ticks."""
    return nanos(duration) // per_tick(kind)


def literal(value: int, kind: T.DataType) -> Column:
    """Nanoseconds since the epoch as a value of a time column."""
    return from_ticks(F.lit(value // per_tick(kind)), kind)
