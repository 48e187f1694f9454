"""Time buckets: parallel windows and as-of joins without a key, or with one that holds many rows.

Rows are dealt by (key, bucket of time). A bucket is several times as long as the window or tolerance, and only rows
within its reach of a bucket's edge are repeated in the neighbouring bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTOR = 16
LONGEST = 1 << 61  # so that sums of a time and a length stay within a long
BUCKET = "__bucket"


def reach_of(ticks: int) -> int:
    return min(ticks, LONGEST)


def width_for(reach: int, factor: int = FACTOR) -> int:
    return max(1, min(reach * factor, LONGEST))


def home_of(ticks: str, width: int) -> Column:
    """Floor division in whole numbers, also before the epoch."""
    return F.expr(f"(`{ticks}` - pmod(`{ticks}`, {width}L)) div {width}L")


def repeated(df: DataFrame, ticks: str, width: int, reach: int, future: bool, own: str | None = None) -> DataFrame:
    """Each row in its bucket, and in the next (future: the one before) if a row there can see it.

    own: name of a column that is true for the row in its own bucket."""
    inside = F.pmod(F.col(ticks), F.lit(width))
    home = home_of(ticks, width)
    seen_beyond = (inside < reach) if future else (inside >= width - reach)
    other = home - 1 if future else home + 1
    out = df.withColumn(BUCKET, F.explode(F.when(seen_beyond, F.array(home, other)).otherwise(F.array(home))))
    return out.withColumn(own, F.col(BUCKET) == home) if own else out
