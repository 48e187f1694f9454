"""Queries over the test tables, with equivalent SQL.

Floats are rounded to six places on both sides; NaN is shown as null.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import TimeSeriesFrame
from tidemark.functions import summarizers as S
from tidemark.functions import windows as W
from tidemark.functions.regression import regression
from tidemark.functions.udf import udf
from tidemark.sources import clocks
from tidemark.sources.reader import read
from tidemark.streaming.intervals import summarize_stream

Query = Callable[[SparkSession, str], DataFrame]
DAY = "1 day"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def kept(fn):
        _QUERIES[name or fn.__name__] = fn
        if sql:
            _SQL[name or fn.__name__] = sql
        return fn

    return kept


def shown(df: DataFrame | TimeSeriesFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, NaN as null."""
    df = df.df if isinstance(df, TimeSeriesFrame) else df
    return df.select(*[F.round(F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema])


def events(spark: SparkSession, sf_dir: str, *kinds: str) -> TimeSeriesFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("ts", "time")
    return TimeSeriesFrame(df.where(F.col("event_type").isin(*kinds)) if kinds else df, order_by="event_id")


def table(spark: SparkSession, sf_dir: str, name: str, time: str, order_by) -> TimeSeriesFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if df.schema[time].dataType.typeName() == "date":
        df = df.withColumn(time, F.col(time).cast("timestamp_ntz"))
    return TimeSeriesFrame(df.withColumnRenamed(time, "time"), order_by=order_by)


# -- temporal joins


def _asof_sql(key: bool, future: bool, strict: bool, tolerance: str) -> str:
    op = "<" if strict else "<=" if future else ">="
    near = f"b.ts <= a.ts + INTERVAL {tolerance}" if future else f"b.ts >= a.ts - INTERVAL {tolerance}"
    return f"""SELECT a.event_id, CASE WHEN {near} THEN b.event_id END AS right_event_id, CASE WHEN {near} THEN b.value END AS right_value
FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b
ON {"a.user_id = b.user_id AND " if key else ""}a.ts {op} b.ts"""


def _asof(name: str, key: bool, future: bool, strict: bool, tolerance: str) -> None:
    def run(spark, sf_dir):
        left, right = events(spark, sf_dir, "click"), events(spark, sf_dir, "view").keep_columns("user_id", "event_id", "value")
        by = "user_id" if key else None
        left = left.keep_columns("user_id", "event_id")
        if not key:
            left, right = left.keep_columns("event_id"), right.keep_columns("event_id", "value")
        right = TimeSeriesFrame(right.df, order_by="event_id")
        out = left.future_left_join(right, tolerance, by, right_alias="right", strict_lookahead=strict) if future else left.left_join(right, tolerance, by, right_alias="right")
        return out.df.select("event_id", "right_event_id", "right_value")

    query(_asof_sql(key, future, strict, tolerance), name)(run)


_asof("asof_left_join", True, False, False, DAY)
_asof("asof_left_join_keyless", False, False, False, "1 hour")
_asof("asof_future_join", True, True, False, DAY)
_asof("asof_future_strict", True, True, True, DAY)
_asof("asof_future_keyless", False, True, False, "1 hour")


@query("""SELECT a.l_orderkey, a.l_linenumber, CASE WHEN b.l_shipdate >= a.l_shipdate - INTERVAL 30 DAY THEN b.l_quantity END AS last_quantity
FROM (SELECT * FROM lineitem WHERE l_returnflag = 'R') a ASOF LEFT JOIN (
  SELECT l_partkey, l_suppkey, l_shipdate, max_by(l_quantity, l_orderkey * 10 + l_linenumber) AS l_quantity FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL) b
ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_shipdate >= b.l_shipdate""")
def asof_multi_key(spark, sf_dir):
    """Two keys, and ties on time: the last by order and line number wins."""
    lines = table(spark, sf_dir, "lineitem", "l_shipdate", ["l_orderkey", "l_linenumber"])
    left = lines.filter("l_returnflag = 'R'").keep_columns("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    right = TimeSeriesFrame(lines.filter("l_returnflag = 'N'").df.select("time", "l_partkey", "l_suppkey", F.col("l_quantity").alias("last_quantity"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")), order_by=["o", "n"])
    return left.left_join(right, "30 days", ["l_partkey", "l_suppkey"]).df.select("l_orderkey", "l_linenumber", "last_quantity")


@query("SELECT ts AS time, event_id, user_id, value FROM events WHERE event_type IN ('click', 'view')")
def merge_series(spark, sf_dir):
    a, b = (events(spark, sf_dir, k).keep_columns("event_id", "user_id", "value") for k in ("click", "view"))
    return a.merge(b).df


@query("""WITH c AS (SELECT ts, user_id, event_id FROM events WHERE event_type = 'click'), v AS (SELECT ts, user_id, event_id FROM events WHERE event_type = 'view')
SELECT c.event_id AS click_event_id, CASE WHEN v.ts >= c.ts - INTERVAL 1 DAY THEN v.event_id END AS view_event_id FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts
UNION ALL
SELECT CASE WHEN c.ts >= v.ts - INTERVAL 1 DAY THEN c.event_id END, v.event_id FROM v ASOF LEFT JOIN c ON v.user_id = c.user_id AND v.ts >= c.ts""")
def symmetric_join(spark, sf_dir):
    a, b = (events(spark, sf_dir, k).keep_columns("user_id", "event_id") for k in ("click", "view"))
    return a.symmetric_join(b, DAY, "user_id", "click", "view").df.select("click_event_id", "view_event_id")


@query("""WITH r AS (SELECT l_suppkey, l_shipdate, l_orderkey * 10 + l_linenumber AS line FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT l_suppkey, l_shipdate, l_orderkey * 10 + l_linenumber AS line FROM lineitem WHERE l_returnflag = 'A'),
rl AS (SELECT l_suppkey, l_shipdate, max(line) AS line FROM r GROUP BY ALL), al AS (SELECT l_suppkey, l_shipdate, max(line) AS line FROM a GROUP BY ALL)
SELECT r.line AS r_line, CASE WHEN al.l_shipdate >= r.l_shipdate - INTERVAL 20 DAY THEN al.line END AS a_line FROM r ASOF LEFT JOIN al ON r.l_suppkey = al.l_suppkey AND r.l_shipdate >= al.l_shipdate
UNION ALL
SELECT CASE WHEN rl.l_shipdate >= a.l_shipdate - INTERVAL 20 DAY THEN rl.line END, a.line FROM a ASOF LEFT JOIN rl ON a.l_suppkey = rl.l_suppkey AND a.l_shipdate >= rl.l_shipdate""")
def symmetric_join_ties(spark, sf_dir):
    """Many rows of equal time: each side takes the other's last."""
    lines = table(spark, sf_dir, "lineitem", "l_shipdate", ["l_orderkey", "l_linenumber"]).add_columns({"line": F.col("l_orderkey") * 10 + F.col("l_linenumber")})
    r, a = (TimeSeriesFrame(lines.filter(F.col("l_returnflag") == k).df.select("time", "l_suppkey", "line"), order_by="line") for k in "RA")
    return r.symmetric_join(a, "20 days", "l_suppkey", "r", "a").df.select("r_line", "a_line")


@query("""SELECT ts AS time, event_type = 'click' AS "left", event_id FROM events WHERE event_type IN ('click', 'view')""")
def merge_either(spark, sf_dir):
    a, b = (events(spark, sf_dir, k).keep_columns("event_id", "value") for k in ("click", "view"))
    found = a.merge_either(TimeSeriesFrame(b.df.drop("value"))).df
    return found.select("time", F.col("left").isNotNull().alias("left"), F.coalesce("left.event_id", "right.event_id").alias("event_id"))


# -- whole-table, cycle and interval summaries

_BASIC = [S.count(), S.sum("value"), S.mean("value"), S.stddev("value"), S.variance("value"), S.min("value"), S.max("value"), S.skewness("value"), S.kurtosis("value")]
_BASIC_SQL = """count(*) AS "count", round(sum(value), 6) AS value_sum, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_stddev, round(var_samp(value), 6) AS value_variance,
round(min(value), 6) AS value_min, round(max(value), 6) AS value_max,
round(CASE WHEN var_pop(value) > 0 AND count(value) > 1 THEN (avg(value**3) - 3 * avg(value) * avg(value**2) + 2 * avg(value)**3) / var_pop(value)**1.5 END, 6) AS value_skewness,
round(CASE WHEN var_pop(value) > 0 AND count(value) > 1 THEN (avg(value**4) - 4 * avg(value) * avg(value**3) + 6 * avg(value)**2 * avg(value**2) - 3 * avg(value)**4) / var_pop(value)**2 - 3 END, 6) AS value_kurtosis"""


@query(f"SELECT make_timestamp(0) AS time, {_BASIC_SQL} FROM events")
def summarize_all(spark, sf_dir):
    return shown(events(spark, sf_dir).summarize(_BASIC))


@query(f"SELECT make_timestamp(0) AS time, event_type, {_BASIC_SQL} FROM events GROUP BY event_type")
def summarize_keyed(spark, sf_dir):
    return shown(events(spark, sf_dir).summarize(_BASIC, "event_type"))


_O = "CAST(o_orderdate AS TIMESTAMP)"


@query(f'SELECT {_O} AS time, o_orderpriority, count(*) AS "count", round(sum(o_totalprice), 4) AS o_totalprice_sum, max(o_totalprice) AS o_totalprice_max, count(o_custkey) AS o_custkey_count FROM orders GROUP BY ALL')
def cycle_sum(spark, sf_dir):
    s = [S.count(), S.sum("o_totalprice"), S.max("o_totalprice"), S.count("o_custkey")]
    return shown(table(spark, sf_dir, "orders", "o_orderdate", "o_orderkey").summarize_cycles(s, "o_orderpriority"), 4)


@query(f"""SELECT {_O} AS time, round(avg(o_totalprice), 6) AS o_totalprice_mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(o_totalprice) END, 6) AS o_totalprice_stddev,
round(quantile_cont(o_totalprice, 0.25), 6) AS "o_totalprice_0.25quantile", round(quantile_cont(o_totalprice, 0.9), 6) AS "o_totalprice_0.9quantile",
round(covar_pop(o_totalprice, o_custkey) / 1e6, 5) AS o_totalprice_o_custkey_covariance FROM orders GROUP BY ALL""")
def cycle_moments(spark, sf_dir):
    s = [S.mean("o_totalprice"), S.stddev("o_totalprice"), S.quantile("o_totalprice", [0.25, 0.9]), S.covariance("o_totalprice", "o_custkey")]
    out = table(spark, sf_dir, "orders", "o_orderdate", "o_orderkey").summarize_cycles(s).df
    return shown(out.withColumn("o_totalprice_o_custkey_covariance", F.round(F.col("o_totalprice_o_custkey_covariance") / 1e6, 5)))


@query(f"SELECT {_O} AS time, count(*) AS n_rows, min(o_orderkey) AS first_order FROM orders GROUP BY ALL")
def group_by_cycle(spark, sf_dir):
    found = table(spark, sf_dir, "orders", "o_orderdate", "o_orderkey").keep_columns("o_orderkey").group_by_cycle()
    return found.df.select("time", F.size("rows").cast("long").alias("n_rows"), F.col("rows")[0]["o_orderkey"].alias("first_order"))


@query(f"SELECT {_O} AS time, o_orderkey, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderdate, o_orderpriority) > 0.5 AS heavy, count(*) OVER (PARTITION BY o_orderdate, o_orderpriority) AS n FROM orders")
def add_columns_for_cycle(spark, sf_dir):
    found = table(spark, sf_dir, "orders", "o_orderdate", "o_orderkey").add_columns_for_cycle({"total": F.sum("o_totalprice"), "n": F.count("*")}, "o_orderpriority")
    return found.df.select("time", "o_orderkey", (F.col("o_totalprice") / F.col("total") > 0.5).alias("heavy"), "n")


@query(f"SELECT {_O} AS time, o_orderkey, CAST(rank() OVER (PARTITION BY o_orderdate ORDER BY o_totalprice) AS DOUBLE) AS place FROM orders")
def cycle_udf_rank(spark, sf_dir):
    """A vectorized Python function over cycles."""

    @udf("double")
    def place(v):
        return v.rank(method="min")

    return table(spark, sf_dir, "orders", "o_orderdate", "o_orderkey").keep_columns("o_orderkey", "o_totalprice").add_columns_for_cycle({"place": place("o_totalprice")}).df.select("time", "o_orderkey", "place")


@query(f"SELECT {_O} AS time, round(max(o_totalprice) - min(o_totalprice), 4) AS spread, count(*) AS n FROM orders GROUP BY ALL")
def cycle_udf_summary(spark, sf_dir):
    @udf(("double", "long"))
    def spread(v):
        return v.max() - v.min(), len(v)

    return shown(table(spark, sf_dir, "orders", "o_orderdate", "o_orderkey").summarize_cycles({("spread", "n"): spread("o_totalprice")}), 4)


def _hours(spark, sf_dir) -> clocks.UniformClock:
    """Hours from the day before the table's first row to the day after its last."""
    first, last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    return clocks.uniform("1h", begin=first - timedelta(1), end=last + timedelta(2))


_HOURS_SQL = "c AS (SELECT t, t + INTERVAL 1 HOUR AS n FROM (SELECT unnest(generate_series(date_trunc('day', min(ts)) - INTERVAL 1 DAY, date_trunc('day', max(ts)) + INTERVAL 47 HOUR, INTERVAL 1 HOUR)) AS t FROM events))"


def _interval(inclusion: str, rounding: str) -> None:
    before, after = (">=", "<") if inclusion == "begin" else (">", "<=")
    sql = f"""WITH {_HOURS_SQL}
SELECT {"c.n" if rounding == "end" else "c.t"} AS time, event_type, count(*) AS "count", round(sum(value), 6) AS value_sum
FROM events e JOIN c ON e.ts {before} c.t AND e.ts {after} c.n GROUP BY ALL"""

    def run(spark, sf_dir):
        return shown(events(spark, sf_dir).summarize_intervals(_hours(spark, sf_dir), [S.count(), S.sum("value")], "event_type", inclusion, rounding))

    query(sql, f"interval_{inclusion}_{rounding}")(run)


for _i in ("begin", "end"):
    for _r in ("begin", "end"):
        _interval(_i, _r)


@query(f"""WITH {_HOURS_SQL} SELECT c.n AS time, user_id, count(*) AS n_rows, min(event_id) AS first_event FROM events e JOIN c ON e.ts >= c.t AND e.ts < c.n GROUP BY ALL""")
def group_by_interval(spark, sf_dir):
    found = events(spark, sf_dir).keep_columns("event_id", "user_id").group_by_interval(_hours(spark, sf_dir), "user_id").df
    rows = F.col("rows")
    return found.select("time", "user_id", F.size(rows).cast("long").alias("n_rows"), F.array_min(F.transform(rows, lambda r: r["event_id"])).alias("first_event"))


@query("""SELECT user_id, count(value) AS n, round(sum(value), 6) AS total, round(sum(value) / count(value) + 1e-9, 6) AS value_mean FROM events GROUP BY user_id""")
def summarize_state(spark, sf_dir):
    """The sums and counts behind a mean, merged over event types afterwards."""
    found = events(spark, sf_dir).summarize_state(S.mean("value"), ["user_id", "event_type"])
    sums = found.groupBy("user_id").agg(F.sum("state_0").alias("total"), F.sum("state_1").alias("n"))
    return shown(sums.select("user_id", "n", "total", (F.col("total") / F.col("n") + 1e-9).alias("value_mean")))


@query("""SELECT date_trunc('day', l_shipdate::TIMESTAMP) AS time, count(*) AS n, round(sum(l_quantity), 4) AS quantity, round(min(l_extendedprice), 4) AS low FROM lineitem GROUP BY ALL""")
def arrow_rows(spark, sf_dir):
    """Groups as Arrow files, read again by a Python function."""
    lines = table(spark, sf_dir, "lineitem", "l_shipdate", ["l_orderkey", "l_linenumber"]).keep_columns("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    found = lines.cast({"l_quantity": "double", "l_extendedprice": "double"}).summarize_cycles(S.arrow(["l_quantity", "l_extendedprice"])).df

    @F.arrow_udf("n long, quantity double, low double")
    def opened(files: pa.Array) -> pa.Array:
        made = []
        for f in files:  # one at a time, read where it lies
            t = pa.ipc.open_file(f.as_buffer()).read_all()
            made.append({"n": len(t), "quantity": pc.sum(t["l_quantity"]).as_py(), "low": pc.min(t["l_extendedprice"]).as_py()})
        return pa.array(made, pa.struct([("n", pa.int64()), ("quantity", pa.float64()), ("low", pa.float64())]))

    return shown(found.select("time", opened("arrow_bytes").alias("x")).select("time", "x.*"), 4)


@query("""WITH k AS (SELECT DISTINCT date_trunc('hour', ts) AS t FROM events WHERE event_type = 'signup'), c AS (SELECT t, lead(t) OVER (ORDER BY t) AS n FROM k)
SELECT c.n AS time, count(*) AS "count" FROM events e JOIN c ON e.ts >= c.t AND e.ts < c.n GROUP BY ALL""")
def interval_other_clock(spark, sf_dir):
    """A clock from data: the hours in which somebody signed up."""
    signups = events(spark, sf_dir, "signup").df
    clock = TimeSeriesFrame(signups.select(F.date_trunc("hour", F.col("time").cast("timestamp")).cast("timestamp_ntz").alias("time")).distinct())
    return events(spark, sf_dir).summarize_intervals(clock, S.count()).df


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS time, user_id, count(*) AS "count", round(sum(value), 6) AS value_sum FROM events GROUP BY ALL""")
def stream_intervals(spark, sf_dir):
    found = summarize_stream(events(spark, sf_dir).df.withColumn("time", F.col("time").cast("timestamp")), [S.count(), S.sum("value")], "time", "1 day", "1 hour", ["user_id"])
    return shown(found.withColumn("time", F.col("time").cast("timestamp_ntz")))


# -- windows and running summaries


def _window_sql(select: str, key: bool, frame: str) -> str:
    return f"SELECT event_id, {select} FROM events WINDOW w AS ({'PARTITION BY user_id ' if key else ''}ORDER BY ts RANGE BETWEEN {frame})"


_PAST, _FUTURE = "INTERVAL 1 DAY PRECEDING AND CURRENT ROW", "CURRENT ROW AND INTERVAL 1 DAY FOLLOWING"
_SUMS_SQL = 'count(*) OVER w AS "count", round(sum(value) OVER w, 6) AS value_sum, round(avg(value) OVER w + 1e-9, 6) AS value_mean'
_SUMS = [S.count(), S.sum("value"), S.mean("value")]


def _windowed(name: str, future: bool, key: bool, sql: str, summarizer, length: str = DAY, strategy: str = "auto") -> None:
    def run(spark, sf_dir):
        window = (W.future_absolute_time if future else W.past_absolute_time)(length)
        found = events(spark, sf_dir).summarize_windows(window, summarizer, "user_id" if key else None, strategy=strategy)
        found = found.df.drop("time", "user_id", "event_type", "value", "props")
        if "value_mean" in found.columns:  # means of cents often end in a 5 just behind the last place
            found = found.withColumn("value_mean", F.col("value_mean") + 1e-9)
        return shown(found)

    query(sql, name)(run)


_windowed("window_past_keyed", False, True, _window_sql(_SUMS_SQL, True, _PAST), _SUMS)
_windowed("window_future_keyed", True, True, _window_sql(_SUMS_SQL, True, _FUTURE), _SUMS)
_windowed("window_past_keyless", False, False, _window_sql(_SUMS_SQL, False, _PAST), _SUMS)
_windowed("window_future_keyless", True, False, _window_sql(_SUMS_SQL, False, _FUTURE), _SUMS)
_windowed("window_past_frame", False, False, _window_sql(_SUMS_SQL, False, "INTERVAL 1 HOUR PRECEDING AND CURRENT ROW"), _SUMS, "1 hour", "frame")
_windowed("window_extremes", False, True, _window_sql("min(value) OVER w AS value_min, max(value) OVER w AS value_max, round(quantile_cont(value, 0.5) OVER w, 6) AS \"value_0.5quantile\", round(CASE WHEN count(value) OVER w > 1 THEN stddev_samp(value) OVER w END, 6) AS value_stddev", True, "INTERVAL 7 DAY PRECEDING AND CURRENT ROW"), [S.min("value"), S.max("value"), S.quantile("value", 0.5), S.stddev("value")], "7 days")

_windowed("window_minmax_blocks", False, True, _window_sql('count(*) OVER w AS "count", min(value) OVER w AS value_min, max(value) OVER w AS value_max', True, "INTERVAL 7 DAY PRECEDING AND CURRENT ROW"), [S.count(), S.min("value"), S.max("value")], "7 days", "blocks")
_windowed("window_minmax_future", True, False, _window_sql("min(value) OVER w AS value_min, max(value) OVER w AS value_max", False, _FUTURE), [S.min("value"), S.max("value")])
_windowed("window_prefix_keyed", False, True, _window_sql(_SUMS_SQL, True, "INTERVAL 7 DAY PRECEDING AND CURRENT ROW"), _SUMS, "7 days", "prefix")


@query(_window_sql("round(sum(value) OVER w, 6) AS total, count(*) OVER w AS n", True, _PAST))
def window_batches(spark, sf_dir):
    """One Python call for many windows."""

    def sums(left, right, begins, ends):
        total = np.concatenate([[0.0], np.cumsum(right["value"].fillna(0).to_numpy())])
        return total[ends] - total[begins], ends - begins

    found = events(spark, sf_dir).keep_columns("event_id", "user_id", "value").summarize_window_batches(W.past_absolute_time(DAY), sums, {"total": "double", "n": "long"}, "user_id")
    return shown(found.df.select("event_id", "total", "n"))


@query(_window_sql("count(*) OVER w AS n_rows, round(coalesce(sum(value) OVER w, 0), 6) AS total", True, _PAST))
def add_windows(spark, sf_dir):
    found = events(spark, sf_dir).keep_columns("event_id", "user_id", "value").add_windows(W.past_absolute_time("1d"), "user_id").df
    rows = F.col("window_past_1d")
    return shown(found.select("event_id", F.size(rows).cast("long").alias("n_rows"), F.aggregate(rows, F.lit(0.0), lambda a, r: a + F.coalesce(r["value"], F.lit(0.0))).alias("total")))


@query(_window_sql("round(max(value) OVER w - min(value) OVER w, 6) AS spread", True, _PAST))
def window_udf(spark, sf_dir):
    @udf("double", arg_type="numpy")
    def spread(v):
        return float(v.max() - v.min())

    found = events(spark, sf_dir).keep_columns("event_id", "user_id", "value").summarize_windows(W.past_absolute_time(DAY), {"spread": spread("value")}, "user_id")
    return shown(found.df.select("event_id", "spread"))


@query("""WITH e AS (SELECT event_id, sum(value) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS s,
sum(value) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 3 HOUR PRECEDING AND INTERVAL 3600000001 MICROSECOND PRECEDING) AS l FROM events)
SELECT event_id, round(coalesce(l, 0), 6) AS "lagSum", round(coalesce(s, 0), 6) AS "sum" FROM e""")
def window_lag_sum(spark, sf_dir):
    found = events(spark, sf_dir).keep_columns("event_id", "value").summarize_windows(W.past_absolute_time("1 hour"), S.lag_sum("value", "2 hours"))
    return shown(found.df.select("event_id", "lagSum", "sum"))


_RUNNING_SQL = 'SELECT event_id, count(*) OVER w AS "count", round(sum(value) OVER w, 5) AS value_sum, max(value) OVER w AS value_max FROM events WINDOW w AS ({}ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)'


@query(_RUNNING_SQL.format("PARTITION BY user_id "))
def running_keyed(spark, sf_dir):
    found = events(spark, sf_dir).keep_columns("event_id", "user_id", "value").add_summary_columns([S.count(), S.sum("value"), S.max("value")], "user_id")
    return shown(found.df.drop("time", "user_id", "value"), 5)


@query(_RUNNING_SQL.format(""))
def running_keyless(spark, sf_dir):
    """Without a key: dealt by days, with the totals of the days before added."""
    found = events(spark, sf_dir).keep_columns("event_id", "value").add_summary_columns([S.count(), S.sum("value"), S.max("value")], bucket=DAY)
    return shown(found.df.drop("time", "value"), 5)


# -- summarizers

_N = "count(value)"


@query("""SELECT make_timestamp(0) AS time, event_type, round(avg(value**3) / 1e3, 6) AS "value_3thMoment_k", round(var_pop(value), 6) AS "value_2thCentralMoment",
round((avg(value**3) - 3 * avg(value) * avg(value**2) + 2 * avg(value)**3) / 1e3, 6) AS "value_3thCentralMoment_k", round(exp(avg(ln(value))), 6) AS "value_geometricMean", round(sum(value * user_id) / 1e6, 6) AS "value_user_id_dotProduct_m"
FROM events GROUP BY event_type""")
def moments(spark, sf_dir):
    found = events(spark, sf_dir).summarize([S.nth_moment("value", 3), S.nth_central_moment("value", 2), S.nth_central_moment("value", 3), S.geometric_mean("value"), S.dot_product("value", "user_id")], "event_type").df
    for c, unit, label in (("value_3thMoment", 1e3, "k"), ("value_3thCentralMoment", 1e3, "k"), ("value_user_id_dotProduct", 1e6, "m")):
        found = found.withColumn(f"{c}_{label}", F.col(c) / unit).drop(c)
    return shown(found)


@query(f"SELECT {_O} AS time, round(product(1 + o_custkey % 3), 4) AS p_product FROM orders GROUP BY ALL")
def product(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderdate", "o_orderkey").add_columns({"p": 1 + F.col("o_custkey") % 3})
    return shown(orders.summarize_cycles(S.product("p")), 4)


@query("""SELECT make_timestamp(0) AS time, l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS "l_quantity_l_extendedprice_correlation",
round(corr(l_quantity, l_extendedprice) * sqrt(count(*) - 2) / sqrt(1 - corr(l_quantity, l_extendedprice)**2), 3) AS "l_quantity_l_extendedprice_correlationTStat" FROM lineitem GROUP BY l_returnflag""")
def correlation(spark, sf_dir):
    found = shown(table(spark, sf_dir, "lineitem", "l_shipdate", ["l_orderkey", "l_linenumber"]).summarize(S.correlation("l_quantity", "l_extendedprice"), "l_returnflag"))
    return found.withColumn("l_quantity_l_extendedprice_correlationTStat", F.round("l_quantity_l_extendedprice_correlationTStat", 3))


@query("""WITH s AS (SELECT l_returnflag, sum(w) AS w, sum(w * w) AS w2, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * y) AS wxy, sum(w * x * x) AS wxx, sum(w * y * y) AS wyy, count(*) AS n
  FROM (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS x, l_extendedprice / 1000.0 AS y, 1 + l_discount AS w FROM lineitem) GROUP BY l_returnflag)
SELECT make_timestamp(0) AS time, l_returnflag, round((wxy - wx * wy / w) / (w - w2 / w), 5) AS "x_y_w_weightedCovariance",
round((wxy - wx * wy / w) / sqrt((wxx - wx * wx / w) * (wyy - wy * wy / w)), 6) AS "x_y_w_weightedCorrelation",
round(wx / w, 6) AS "x_w_weightedMean", round(sqrt((wxx - wx * wx / w) * w / (w * w - w2)), 5) AS "x_w_weightedStandardDeviation", n AS "x_w_observationCount" FROM s""")
def weighted(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_shipdate", ["l_orderkey", "l_linenumber"]).add_columns({"x": F.col("l_quantity").cast("double"), "y": F.col("l_extendedprice") / 1000.0, "w": 1 + F.col("l_discount")})
    found = lines.summarize([S.weighted_covariance("x", "y", "w"), S.weighted_correlation("x", "y", "w"), S.weighted_mean("x", "w")], "l_returnflag").df.drop("x_w_weightedTStat")
    for c in ("x_y_w_weightedCovariance", "x_w_weightedStandardDeviation"):
        found = found.withColumn(c, F.round(c, 5))
    return shown(found)


def _z(in_sample: bool) -> None:
    if in_sample:
        sql = """WITH r AS (SELECT event_id, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""
    else:
        sql = """WITH r AS (SELECT event_id, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
    sql += ' SELECT event_id, round(CASE WHEN n > 1 AND s > 1e-9 THEN (value - m) / s END, 4) AS "value_zScore" FROM r'

    def run(spark, sf_dir):
        found = events(spark, sf_dir).keep_columns("event_id", "user_id", "value").add_summary_columns(S.z_score("value", in_sample), "user_id")
        return shown(found.df.select("event_id", "value_zScore"), 4)

    query(sql, f"zscore_{'in' if in_sample else 'out'}")(run)


_z(True)
_z(False)


def _ewma(convention: str, period: str) -> None:
    weight = "0.95 ** ((epoch_us(a.ts) - epoch_us(b.ts)) / 86400000000.0)" if period != "constant" else "0.95 ** (a.k - b.k)"
    value = f"sum(b.value * {weight})" + (f" / sum({weight})" if convention == "core" else "")
    sql = f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT a.event_id, round({value} + 1e-8, 5) AS value_ewma FROM e a JOIN e b ON a.user_id = b.user_id AND b.k <= a.k GROUP BY a.event_id"""

    def run(spark, sf_dir):
        found = events(spark, sf_dir).keep_columns("event_id", "user_id", "value").add_summary_columns(S.ewma("value", 0.05, period, convention), "user_id")
        return shown(found.df.select("event_id", (F.col("value_ewma") + 1e-8).alias("value_ewma")), 5)

    query(sql, f"ewma_{'constant' if period == 'constant' else convention}")(run)


_ewma("core", "1d")
_ewma("legacy", "1d")
_ewma("legacy", "constant")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, value, epoch_us(ts) / 86400000000.0 AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT event_id, user_id, value, d, k, 0.0::DOUBLE AS ema FROM e WHERE k = 1
  UNION ALL SELECT e.event_id, e.user_id, e.value, e.d, e.k, f.ema * 0.5 ** (e.d - f.d) + (1 - 0.5 ** (e.d - f.d)) * f.value FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT event_id, round(ema, 5) AS value_ema FROM f""")
def ema_halflife(spark, sf_dir):
    found = events(spark, sf_dir).keep_columns("event_id", "user_id", "value").add_summary_columns(S.ema_half_life("value", "1d", "previous", "convolution"), "user_id")
    return shown(found.df.select("event_id", "value_ema"), 5)


@query("""SELECT a.event_id, round(sum(b.value * 0.95 ** ((epoch_us(a.ts) - epoch_us(b.ts)) / 86400000000.0)) / sum(0.95 ** ((epoch_us(a.ts) - epoch_us(b.ts)) / 86400000000.0)) + 1e-8, 5) AS value_ewma
FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 7 DAY AND a.ts GROUP BY a.event_id""")
def ewma_window(spark, sf_dir):
    """Moving averages in windows, as differences of prefix sums."""
    found = events(spark, sf_dir).keep_columns("event_id", "user_id", "value").summarize_windows(W.past_absolute_time("7 days"), S.ewma("value", 0.05, "1d", "core"), "user_id")
    return shown(found.df.select("event_id", (F.col("value_ewma") + 1e-8).alias("value_ewma")), 5)


@query("""SELECT a.event_id, round(sum(b.value * 0.5 ** ((epoch_us(a.ts) - epoch_us(b.ts)) / 3600000000.0)) + 1e-8, 5) AS value_ewma
FROM events a JOIN events b ON (b.ts, b.event_id) <= (a.ts, a.event_id) AND b.ts >= a.ts - INTERVAL 3 DAY GROUP BY a.event_id""")
def ewma_keyless(spark, sf_dir):
    """One series without a key, half of a weight gone in an hour: weights of three days ago are below 1e-21."""
    found = events(spark, sf_dir).keep_columns("event_id", "value").add_summary_columns(S.ewma("value", 0.5, "1h"))
    return shown(found.df.select("event_id", (F.col("value_ewma") + 1e-8).alias("value_ewma")), 5)


@query("""WITH t AS (SELECT user_id, max(ts) AS last FROM events GROUP BY ALL)
SELECT make_timestamp(0) AS time, e.user_id, round(sum(value * 0.95 ** ((epoch_us(last) - epoch_us(ts)) / 86400000000.0)) + 1e-8, 5) AS value_ewma FROM events e JOIN t ON e.user_id = t.user_id GROUP BY e.user_id""")
def ewma_summary(spark, sf_dir):
    return shown(events(spark, sf_dir).summarize(S.ewma("value"), "user_id").df.withColumn("value_ewma", F.col("value_ewma") + 1e-8), 5)


def _ema(name: str, base: float, interpolation: str, convention: str, priming: float, summarizer) -> None:
    """Step by step in SQL: e and a after each row, then the part of the first value."""
    p, fade = "(e.d - f.d)", f"{base} ** (e.d - f.d)"
    share = f"(({fade} - 1) / ({p} * ln({base})))"
    between = {"previous": f"(1 - {fade}) * f.value", "current": f"(1 - {fade}) * e.value", "linear": f"CASE WHEN {p} = 0 THEN 0 ELSE ({share} - {fade}) * f.value + (1 - {share}) * e.value END"}[interpolation]
    primed = "d0" if convention == "legacy" else str(priming)
    start = {"previous": "0", "current": f"(1 - {base} ** {primed})", "linear": f"(1 - ({base} ** {primed} - 1) / ({primed} * ln({base})))"}[interpolation]
    value = f"{base} ** (d - d0) * {start} * x0 + ema"
    if convention == "core":
        value = f"({value}) / ({base} ** (d - d0) * {start} + a)"
    sql = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, value, epoch_us(ts) / 86400000000.0 AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT event_id, user_id, value, d, k, 0.0::DOUBLE AS ema, 0.0::DOUBLE AS a, value AS x0, d AS d0 FROM e WHERE k = 1
  UNION ALL SELECT e.event_id, e.user_id, e.value, e.d, e.k, f.ema * {fade} + {between}, f.a * {fade} + 1 - {fade}, f.x0, f.d0 FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT event_id, round({value} + 1e-8, 5) AS value_ema FROM f"""

    def run(spark, sf_dir):
        found = events(spark, sf_dir).keep_columns("event_id", "user_id", "value").add_summary_columns(summarizer, "user_id")
        return shown(found.df.select("event_id", (F.col("value_ema") + 1e-8).alias("value_ema")), 5)

    query(sql, name)(run)


_ema("ema_legacy", 0.5, "current", "legacy", 0.0, S.ema_half_life("value", "1d", "current"))
_ema("smoothing_core", 0.95, "current", "core", 1.0, S.exponential_smoothing("value"))
_ema("smoothing_previous", 0.95, "previous", "convolution", 1.0, S.exponential_smoothing("value", interpolation="previous", convention="convolution"))
_ema("smoothing_linear", 0.95, "linear", "core", 1.0, S.exponential_smoothing("value", interpolation="linear"))


@query("""SELECT l_returnflag, count(*) AS samples, round(regr_slope(l_extendedprice, l_quantity), 4) AS beta, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS "rSquared" FROM lineitem GROUP BY l_returnflag""")
def ols_simple(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem", "l_shipdate", ["l_orderkey", "l_linenumber"]).summarize(S.linear_regression("l_extendedprice", ["l_quantity"]), "l_returnflag").df
    return found.select("l_returnflag", "samples", F.round(F.col("beta")[0], 4).alias("beta"), F.round("intercept", 3).alias("intercept"), F.round("rSquared", 6).alias("rSquared"))


_C = """WITH l AS (SELECT l_returnflag AS g, 1e8 + l_quantity::DOUBLE AS x, 10 * l_discount::DOUBLE AS z, l_extendedprice::DOUBLE / 100 AS y, 1 + l_tax::DOUBLE AS w FROM lineitem),
m AS (SELECT g, sum(w * (x - 1e8)) / sum(w) AS mx, sum(w * z) / sum(w) AS mz, sum(w * y) / sum(w) AS my FROM l GROUP BY g),
s AS (SELECT l.g, count(*) AS n, any_value(mx) AS mx, any_value(mz) AS mz, any_value(my) AS my, sum(w * (x - 1e8 - mx) ** 2) AS xx, sum(w * (z - mz) ** 2) AS zz, sum(w * (x - 1e8 - mx) * (z - mz)) AS xz, sum(w * (x - 1e8 - mx) * (y - my)) AS xy, sum(w * (z - mz) * (y - my)) AS zy, sum(w * (y - my) ** 2) AS yy FROM l JOIN m ON l.g = m.g GROUP BY l.g),
b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM s)"""


@query(_C + """ SELECT g AS l_returnflag, n AS samples, round(b1, 5) AS b1, round(b2, 4) AS b2, round(my - b1 * mx - b2 * mz, 3) AS at_offset, round((b1 * xy + b2 * zy) / yy, 6) AS r2, round(sqrt((yy - b1 * xy - b2 * zy) / (n - 3) * zz / (xx * zz - xz * xz)), 5) AS error1 FROM b""")
def ols_weighted(spark, sf_dir):
    """Two regressors and a weight; one regressor is large against its spread."""
    columns = {"x": 1e8 + F.col("l_quantity").cast("double"), "z": 10 * F.col("l_discount").cast("double"), "y": F.col("l_extendedprice").cast("double") / 100, "w": 1 + F.col("l_tax").cast("double")}
    found = table(spark, sf_dir, "lineitem", "l_shipdate", ["l_orderkey", "l_linenumber"]).add_columns(columns).summarize(S.linear_regression("y", ["x", "z"], "w"), "l_returnflag").df
    b = F.col("beta")
    out = found.select("l_returnflag", "samples", F.round(b[0], 5).alias("b1"), F.round(b[1], 4).alias("b2"), F.round(F.col("intercept") + 1e8 * b[0], 3).alias("at_offset"), F.round("rSquared", 6).alias("r2"), F.round(F.col("stdErr_beta")[0], 5).alias("error1"))
    return out


@query("""WITH s AS (SELECT l_returnflag, sum(w) AS w, sum(w * x) / sum(w) AS m, count(*) AS n FROM (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS x, 1 + l_discount::DOUBLE AS w FROM lineitem) GROUP BY l_returnflag),
v AS (SELECT l.l_returnflag, sqrt(sum((1 + l_discount::DOUBLE) * (l_quantity::DOUBLE - m) ** 2) / any_value(w)) AS sd, any_value(m) AS m, any_value(n) AS n FROM lineitem l JOIN s ON l.l_returnflag = s.l_returnflag GROUP BY l.l_returnflag)
SELECT make_timestamp(0) AS time, l_returnflag, round(m, 6) AS x_w_mean, round(sd, 6) AS x_w_stddev, round(sqrt(n) * m / sd, 3) AS "x_w_tStat", n AS x_w_count FROM v""")
def weighted_mean_test(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_shipdate", ["l_orderkey", "l_linenumber"]).add_columns({"x": F.col("l_quantity").cast("double"), "w": 1 + F.col("l_discount").cast("double")})
    found = lines.summarize(S.weighted_mean_test("x", "w"), "l_returnflag").df
    return shown(found.withColumn("x_w_tStat", F.round("x_w_tStat", 3)))


@query("""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxx(l_extendedprice, l_quantity) AS sxx, count(*) AS n FROM lineitem)
SELECT n, round(b, 4) AS slope, round(a, 3) AS intercept, round(r2, 6) AS r_squared, round(sqrt(syy * (1 - r2) / (n - 2) / sxx), 4) AS slope_error FROM m""")
def regression_model(spark, sf_dir):
    m = regression(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice", ["l_quantity"])
    row = (int(m.n), round(float(m.beta[1]), 4), round(float(m.beta[0]), 3), round(float(m.r_squared), 6), round(float(m.standard_errors[1]), 4))
    return spark.createDataFrame([row], "n long, slope double, intercept double, r_squared double, slope_error double")


@query("""SELECT make_timestamp(0) AS time, user_id, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 6) AS click_value_sum, round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 6) AS view_value_sum FROM events GROUP BY user_id""")
def where_and_prefix(spark, sf_dir):
    of = lambda kind: S.sum("value").where(lambda c: c == kind, "event_type").prefix(kind)
    return shown(events(spark, sf_dir).summarize([of("click"), of("view")], "user_id"))


@query("""SELECT make_timestamp(0) AS time, event_type, round(sum(value), 6) AS total, round(coalesce(sum(value) FILTER (value > 50), 0), 6) AS large FROM events GROUP BY event_type""")
def stacked(spark, sf_dir):
    found = events(spark, sf_dir).summarize(S.stack(S.sum("value"), S.sum("value").where(F.col("value") > 50)), "event_type").df
    return shown(found.select("time", "event_type", F.col("stack")[0]["value_sum"].alias("total"), F.col("stack")[1]["value_sum"].alias("large")))


# -- rows, columns, clocks


@query("SELECT ts + INTERVAL 90 MINUTE AS time, event_id FROM events")
def shift_time(spark, sf_dir):
    return events(spark, sf_dir).keep_columns("event_id").shift("90 minutes").df


@query("SELECT ts AS time, event_id, CAST(value AS FLOAT)::DOUBLE AS amount FROM events WHERE event_type = 'click' AND value > 10 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'")
def rowwise(spark, sf_dir):
    clicks = events(spark, sf_dir).between("2024-01-05", "2024-01-10").filter("event_type = 'click'").keep_rows(F.col("value") > 10)
    return clicks.rename_columns({"value": "amount"}).cast({"amount": "float"}).cast({"amount": "double"}).keep_columns("event_id", "amount").df


@query("SELECT ts AS time, event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-04' AND ts < TIMESTAMP '2024-01-12'")
def reader_parquet(spark, sf_dir):
    """A range widened at both ends; the filter and the columns reach the scan."""
    found = read(spark).options(time_column="ts", columns="event_id,value").range("2024-01-05", "2024-01-11").expand("1 day", "1 day").parquet(f"{sf_dir}/events.parquet")
    return found.df


@query("SELECT t AS time FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 20 MINUTE) g(t)")
def reader_clock(spark, sf_dir):
    return read(spark).range("2024-01-01", "2024-02-01").clock("uniform", "20m", kind="timestamp_ntz").df


@query("SELECT TRUE AS starts_at_begin, TRUE AS inside, TRUE AS whole_micros, 0 AS wide_gaps, TRUE AS about_as_many")
def random_clock(spark, sf_dir):
    """Gaps are random, so only what holds for all of them is shown."""
    from pyspark.sql import Window

    ticks = clocks.random_frame(spark, "1h", begin="2024-01-01", end="2024-04-01", seed=3, kind="long")
    part = ticks.withColumn("day", F.floor(F.col("time") / 86_400_000_000_000))
    gaps = part.withColumn("gap", F.col("time") - F.lag("time").over(Window.partitionBy("day").orderBy("time")))
    first, last = 1_704_067_200_000_000_000, 1_711_929_600_000_000_000
    n = F.count("*")
    return gaps.agg(
        (F.min("time") == first).alias("starts_at_begin"), (F.max("time") <= last).alias("inside"), F.every(F.col("time") % 1000 == 0).alias("whole_micros"),
        F.count(F.when((F.col("gap") > 3_600_000_000_000) | (F.col("gap") < 0), 1)).cast("int").alias("wide_gaps"), ((n > 4000) & (n < 4800)).alias("about_as_many"),
    )


@query("SELECT ts + to_microseconds(user_id) AS time, event_id, value * 2 AS twice, event_type FROM events WHERE event_type <> 'view' AND user_id % 2 = 0")
def row_functions(spark, sf_dir):
    """Python functions of rows, and a new time for each."""
    found = events(spark, sf_dir).delete_rows(F.col("event_type") == "view").keep_rows(lambda r: r.user_id % 2 == 0)
    found = found.add_columns({"twice": ("double", lambda r: None if r.value is None else r.value * 2)}).set_time(F.col("time") + F.make_dt_interval(secs=F.col("user_id") / 1_000_000))
    return found.delete_columns("user_id", "value", "props").df


@query(f"SELECT {_O} AS time, o_orderkey, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_orderdate) AS n FROM orders")
def cycle_row_dicts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderdate", "o_orderkey").keep_columns("o_orderkey")
    return orders.add_columns_for_cycle({"place": ("long", lambda rows: dict(enumerate(range(len(rows))))), "n": ("long", lambda rows: [len(rows)] * len(rows))}).df


@query("""(SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup') EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90""")
def set_operations(spark, sf_dir):
    of = lambda *kinds: events(spark, sf_dir, *kinds)
    return of("click").select("user_id").intersect(of("signup").select("user_id")).subtract(of("purchase").where("value > 90").select("user_id"))


@query("SELECT ts AS time, event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 25")
def top_values(spark, sf_dir):
    return events(spark, sf_dir).keep_columns("event_id", "value").orderBy(F.col("value").desc_nulls_last(), "event_id").limit(25).df


@query("SELECT ts - INTERVAL 1 DAY AS time, event_id FROM events UNION ALL SELECT ts + INTERVAL 2 DAY, event_id FROM events")
def look_clocks(spark, sf_dir):
    base = events(spark, sf_dir).keep_columns("event_id")
    return base.look_back_clock("1 day").merge(base.look_forward_clock("2 days")).df


@query("SELECT e.event_id, u.n FROM events e JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY ALL) u ON e.user_id = u.user_id WHERE event_type = 'purchase'")
def equi_join(spark, sf_dir):
    base = events(spark, sf_dir)
    return base.filter("event_type = 'purchase'").join(base.group_by("user_id").agg(F.count("*").alias("n")), "user_id").select("event_id", "n")


@query("SELECT t AS time FROM generate_series(TIMESTAMP '2024-01-01 00:05:00', TIMESTAMP '2024-03-01', INTERVAL 15 MINUTE) g(t)")
def uniform_clock(spark, sf_dir):
    return clocks.uniform_frame(spark, "15m", "5m", "2024-01-01", "2024-03-01", kind="timestamp_ntz")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
