"""Temporal joins: as-of into the past or the future, symmetric, and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import length_in_ticks, ticks, time_type
from tidemark.plans import buckets

TICKS, SIDE, LEFT, RIGHT = "__ticks", "__side", "__left", "__right"


def _aliased(df: DataFrame, kept: set[str], alias: str | None) -> dict[str, str]:
    return {c: c if c in kept or not alias else f"{alias}_{c}" for c in df.columns}


def as_of(left: DataFrame, right: DataFrame, time: str, key: list[str], tolerance="0ns", future: bool = False, strict: bool = False, left_alias: str | None = None, right_alias: str | None = None, right_order: tuple[str, ...] = (), right_time: str | None = None) -> DataFrame:
    """Each left row with the nearest right row of equal key (nulls are equal) within tolerance, or nulls.

    Past: the latest with t - tolerance <= rt <= t, of equal times the last by right_order; future: the earliest with
    t <= rt <= t + tolerance (strict: t < rt), of equal times the first. Both sides are dealt by (key, bucket of time)
    and one window pass carries the nearest right row along; there is no join and no product of rows."""
    right_time = right_time or time
    kind = time_type(left, time)
    if type(kind) is not type(time_type(right, right_time)):
        raise TypeError("the time columns have different types")
    reach = buckets.reach_of(length_in_ticks(tolerance, kind))
    if reach < 0:
        raise ValueError("a tolerance can't be negative")
    shared = {time, *key}
    names_l = _aliased(left, shared, left_alias)
    names_r = {c: n for c, n in _aliased(right, {right_time, *key}, right_alias).items() if c not in (right_time, *key)}
    clash = set(names_l.values()) & set(names_r.values())
    if clash:
        raise ValueError(f"duplicate columns: {sorted(clash)}")
    width = buckets.width_for(reach)
    payload_l = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    payload_r = F.struct(F.lit(True).alias("__here"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names_r)])
    # sides: on equal times the right row comes first, unless a strict look ahead must not see it
    right_side = 0 if not future or strict else 2
    own = left.withColumn(TICKS, ticks(F.col(time), kind))
    other = right.withColumn(TICKS, ticks(F.col(right_time), kind)).where(F.col(TICKS).isNotNull())
    own = own.withColumn(buckets.BUCKET, buckets.home_of(TICKS, width))
    other = buckets.repeated(other, TICKS, width, reach, future)
    ordinal = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(right_order)]) if right_order else F.monotonically_increasing_id()
    other = other.withColumn("__ord", ordinal)
    ordinal_type = other.schema["__ord"].dataType
    rows_l = own.select(*[F.col(f"`{k}`") for k in key], buckets.BUCKET, TICKS, F.lit(1).alias(SIDE), F.lit(None).cast(ordinal_type).alias("__ord"), payload_l.alias(LEFT), F.lit(None).cast(other.select(payload_r.alias("x")).schema["x"].dataType).alias(RIGHT))
    rows_r = other.select(*[F.col(f"`{k}`") for k in key], buckets.BUCKET, TICKS, F.lit(right_side).alias(SIDE), "__ord", F.lit(None).cast(own.select(payload_l.alias("x")).schema["x"].dataType).alias(LEFT), payload_r.alias(RIGHT))
    both = rows_l.unionByName(rows_r)
    # the future is read backwards: a frame that ends with its partition is folded anew for each row
    order = [F.col(c).desc() if future else F.col(c).asc() for c in (TICKS, SIDE, "__ord")]
    part = Window.partitionBy(*[F.col(f"`{k}`") for k in key], buckets.BUCKET).orderBy(*order)
    found = F.when(F.col(RIGHT).isNotNull(), F.struct(F.col(TICKS).alias("t"), F.col(RIGHT).alias("r")))
    seen = F.last(found, ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, 0))
    near = F.abs(F.col("__seen.t") - F.col(TICKS)) <= reach
    out = both.withColumn("__seen", seen).where(F.col(LEFT).isNotNull()).withColumn("__seen", F.when(near, F.col("__seen")))
    return out.select(
        *[F.col(f"{LEFT}.`{c}`").alias(names_l[c]) for c in left.columns],
        *[F.col(f"__seen.r.c{i}").alias(n) for i, n in enumerate(names_r.values())],
    )


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both; names and types must agree, in order."""
    if [(f.name, f.dataType) for f in left.schema] != [(f.name, f.dataType) for f in right.schema]:
        raise ValueError("merge needs equal columns")
    return left.unionByName(right)


def symmetric(left: DataFrame, right: DataFrame, time: str, key: list[str], tolerance="0ns", left_alias: str | None = None, right_alias: str | None = None, left_order: tuple[str, ...] = (), right_order: tuple[str, ...] = ()) -> DataFrame:
    """Each side joined to the past of the other, one under the other. Of equal times the last by the other side's order."""
    a = as_of(left, right, time, key, tolerance, left_alias=left_alias, right_alias=right_alias, right_order=right_order)
    b = as_of(right, left, time, key, tolerance, left_alias=right_alias, right_alias=left_alias, right_order=left_order)
    return a.unionByName(b)


def either(left: DataFrame, right: DataFrame, time: str) -> DataFrame:
    """Merge of different columns: time, and each side's row as a struct that is null for the other's rows."""
    one, two = F.struct(*[F.col(f"`{c}`") for c in left.columns]), F.struct(*[F.col(f"`{c}`") for c in right.columns])
    a = left.select(F.col(time), one.alias("left"))
    b = right.select(F.col(time), two.alias("right"))
    return a.unionByName(b, allowMissingColumns=True)

