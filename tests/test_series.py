"""Operators on small hand-made series, against hand-checked values and brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.frame import TimeSeriesFrame
from tidemark.functions import summarizers as S
from tidemark.functions import windows as W
from tidemark.functions.regression import regression, two_sided_p
from tidemark.functions.time import instant, nanos
from tidemark.functions.udf import udf
from tidemark.sources import clocks, generator
from tidemark.sources.reader import read

SECOND = 10**9
TIMES = [t * SECOND for t in range(1000, 1251, 50)]


def panel(spark, name, first, step, kind):
    rows, value = [], first
    for n, t in enumerate(TIMES):
        for i in (7, 3) if n == 0 else (3, 7):
            rows.append((t, i, float(value), len(rows)))
            value += step
    df = spark.createDataFrame(rows, f"time long, id int, {name} double, seq int")
    if kind == "timestamp":
        df = df.withColumn("time", F.timestamp_micros((F.col("time") / 1000).cast("long")))
    elif kind == "ntz":
        df = df.withColumn("time", F.timestamp_micros((F.col("time") / 1000).cast("long")).cast("timestamp_ntz"))
    return TimeSeriesFrame(df, order_by="seq")


@pytest.fixture(params=["long", "timestamp", "ntz"])
def kind(request):
    return request.param


def values(frame, *columns):
    df = frame.df if isinstance(frame, TimeSeriesFrame) else frame
    order = [c for c in ("time", "seq", "id") if c in df.columns]
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.orderBy(*order).collect()]


def close(a, b):
    return all((x is None and y is None) or (x is not None and y is not None and (math.isnan(x) and math.isnan(y) or abs(x - y) < 1e-8)) for x, y in zip(a, b, strict=True))


def test_durations():
    assert nanos("100ns") == 100 and nanos("1 day") == 86400 * SECOND and nanos("2hours") == 7200 * SECOND and nanos("1micro") == 1000
    assert nanos(pd.Timedelta("5s")) == 5 * SECOND and nanos("1.5s") == 1_500_000_000
    assert instant(20240102) == pd.Timestamp("2024-01-02").value == instant("2024-01-02") == instant("2024-01-02T01:00:00+01:00")


def test_as_of_past(spark, kind):
    price, volume = panel(spark, "price", 0.5, 0.5, kind), panel(spark, "volume", 100, 100, kind)
    exact = price.left_join(volume.delete_columns("seq"), key="id")
    assert values(exact, "volume") == [100.0 * k for k in range(1, 13)]
    later = TimeSeriesFrame(volume.shift("50s").df.drop("seq"))
    assert values(price.left_join(later, "50s", "id"), "volume") == [None, None, 200, 100, 300, 400, 500, 600, 700, 800, 900, 1000]
    assert values(price.left_join(later, "49s", "id"), "volume")[:4] == [None, None, 200, 100]
    far = TimeSeriesFrame(volume.shift("51s").df.drop("seq"))
    assert values(price.left_join(far, "50s", "id"), "volume")[2:4] == [None, None]


def test_as_of_future(spark, kind):
    price, volume = panel(spark, "price", 0.5, 0.5, kind), panel(spark, "volume", 100, 100, kind).delete_columns("seq")
    strict = price.future_left_join(volume, "50s", "id", strict_lookahead=True)
    assert values(strict, "volume") == [400, 300, 500, 600, 700, 800, 900, 1000, 1100, 1200, None, None]
    assert values(price.future_left_join(volume, "50s", "id"), "volume") == [100.0 * k for k in range(1, 13)]


def test_as_of_ties_and_null_keys(spark):
    left = TimeSeriesFrame(spark.createDataFrame([(100, None), (100, 1)], "time long, id int"))
    right = TimeSeriesFrame(spark.createDataFrame([(100, None, "a", 1), (100, None, "b", 2), (90, 1, None, 3)], "time long, id int, v string, n int"), order_by="n")
    assert sorted(values(left.left_join(right, 10, "id"), "n")) == [2, 3]  # the last of equal times; a null payload is still a match
    assert sorted(values(left.future_left_join(right, 10, "id"), "n"), key=str) == [1, None]
    with pytest.raises(ValueError):
        right.left_join(right, "1s", "id")
    assert right.left_join(right, 0, "id", right_alias="r").columns == ["time", "id", "v", "n", "r_v", "r_n"]


def test_keyless_as_of_against_brute_force(spark):
    rnd = random.Random(1)
    a = sorted(rnd.randrange(-500, 3000) for _ in range(200))
    b = sorted(rnd.randrange(-500, 3000) for _ in range(150))
    left = TimeSeriesFrame(spark.createDataFrame([(t, n) for n, t in enumerate(a)], "time long, seq int"))
    right = TimeSeriesFrame(spark.createDataFrame([(t, n) for n, t in enumerate(b)], "time long, n int"), order_by="n")
    for tol in (0, 7, 100):
        past = [max((n for n, t in enumerate(b) if x - tol <= t <= x), default=None) for x in a]
        assert values(left.left_join(right, tol), "seq", "n") == list(enumerate(past))
        future = [min((n for n, t in enumerate(b) if x < t <= x + tol), default=None) for x in a]
        assert values(left.future_left_join(right, tol, strict_lookahead=True), "seq", "n") == list(enumerate(future))


def test_merge_and_symmetric(spark, kind):
    price = panel(spark, "price", 0.5, 0.5, kind)
    assert price.merge(price).count() == 24
    with pytest.raises(ValueError):
        price.merge(price.rename_columns({"price": "x"}))
    both = price.delete_columns("seq").symmetric_join(panel(spark, "volume", 100, 100, kind).delete_columns("seq"), "0ns", "id")
    assert both.count() == 24


def test_moments(spark, kind):
    price = panel(spark, "price", 0.5, 0.5, kind)
    s = [S.count(), S.sum("price"), S.mean("price"), S.stddev("price"), S.variance("price"), S.skewness("price"), S.kurtosis("price"), S.min("price"), S.max("price"), S.quantile("price", [0.25]), S.nth_moment("price", 2), S.dot_product("price", "price"), S.nth_central_moment("price", 5)]
    row = price.summarize(s).collect()[0]
    x = np.arange(0.5, 6.1, 0.5)
    assert close(row[1:], [12, 39, 3.25, 1.802775638, 3.25, 0, -1.2167832167832167, 0.5, 6, np.quantile(x, 0.25), (x**2).mean(), (x**2).sum(), 0])
    by = {r.id: r for r in price.summarize([S.product("price"), S.geometric_mean("price"), S.dot_product("price", "price"), S.covariance("price", "price")], "id").collect()}
    assert close([by[3].price_product, by[3].price_geometricMean, by[3].price_price_dotProduct, by[7].price_price_dotProduct], [324.84375, 2.621877636494, 72.25, 90.25])
    z = price.summarize([S.z_score("price", True)]).collect()[0][1], price.summarize([S.z_score("price", False)]).collect()[0][1]
    assert close(z, [1.5254255396193801, 1.8090680674665818])


def test_weighted(spark):
    rnd = np.random.default_rng(5)
    x, y, w = rnd.normal(size=50), rnd.normal(size=50), rnd.uniform(0.1, 2, 50)
    frame = TimeSeriesFrame(spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))], "time long, x double, y double, w double"))
    row = frame.summarize([S.weighted_covariance("x", "y", "w"), S.weighted_correlation("x", "y", "w"), S.weighted_mean("x", "w"), S.correlation(["x", "y"])]).collect()[0]
    mx, my, total = (w * x).sum() / w.sum(), (w * y).sum() / w.sum(), w.sum()
    cov = (w * (x - mx) * (y - my)).sum() / (total - (w**2).sum() / total)
    corr = (w * (x - mx) * (y - my)).sum() / math.sqrt((w * (x - mx) ** 2).sum() * (w * (y - my) ** 2).sum())
    sd = math.sqrt((w * (x - mx) ** 2).sum() * total / (total**2 - (w**2).sum()))
    r = np.corrcoef(x, y)[0, 1]
    assert close(row[1:], [cov, corr, mx, sd, math.sqrt(total**2 / (w**2).sum()) * mx / sd, 50, r, r * math.sqrt(48) / math.sqrt(1 - r * r)])


def test_nothing_and_nulls(spark):
    schema = "time long, id int, x double, y double"
    every = [S.count(), S.count("x"), S.sum("x"), S.mean("x"), S.stddev("x"), S.variance("x"), S.product("x"), S.geometric_mean("x"), S.covariance("x", "y"), S.min("x"), S.quantile("x", 0.5), S.skewness("x"), S.ewma("x"), S.exponential_smoothing("x"), S.weighted_mean("x", "y"), S.linear_regression("x", ["y"]), S.rows()]
    empty = TimeSeriesFrame(spark.createDataFrame([], schema))
    for found in (empty.summarize(every), empty.summarize(every, "id"), empty.summarize_cycles(every), empty.add_summary_columns(every), empty.summarize_windows(W.past_absolute_time(5), every)):
        assert found.count() == 0
    nulls = TimeSeriesFrame(spark.createDataFrame([(1, None, None, 1.0), (2, None, None, None)], schema))
    row = nulls.summarize(every, "id").collect()[0]
    assert row["count"] == 2 and row.x_count == 0 and row.x_sum == 0 and row.x_mean == 0 and row.x_min is None and row.samples == 0 and len(row.rows) == 2
    assert all(math.isnan(row[c]) for c in ("x_stddev", "x_variance", "x_product", "x_geometricMean", "x_y_covariance", "x_0.5quantile", "x_skewness", "x_ewma", "x_ema", "x_y_weightedMean", "intercept"))


def test_where_prefix_stack(spark, kind):
    price = panel(spark, "price", 0.5, 0.5, kind)
    row = price.summarize([S.sum("price").where(lambda i: i == 3, "id").prefix("three"), S.sum("price")]).collect()[0]
    assert row.three_price_sum == 18.5 and row.price_sum == 39
    stacked = price.summarize(S.stack(S.sum("price"), S.sum("price").where(F.col("id") == 7))).collect()[0].stack
    assert [x.price_sum for x in stacked] == [39, 20.5]
    with pytest.raises(ValueError):
        price.summarize([S.sum("price"), S.sum("price")])


def test_cycles(spark, kind):
    volume = panel(spark, "volume", 100, 100, kind)
    assert values(volume.summarize_cycles(S.sum("volume")), "volume_sum") == [300, 700, 1100, 1500, 1900, 2300]
    assert [len(r) for r in values(volume.group_by_cycle(), "rows")] == [2] * 6
    assert values(volume.add_columns_for_cycle({"total": F.sum("volume")}), "total")[:4] == [300, 300, 700, 700]

    @udf("double")
    def rank(v):
        return v.rank(pct=True)

    assert values(volume.add_columns_for_cycle({"r": rank("volume")}), "r") == [0.5, 1.0] * 6

    @udf(("double", "long"))
    def both(v):
        return v.sum(), len(v)

    assert values(volume.summarize_cycles({("s", "n"): both("volume")}), "s", "n")[0] == (300, 2)
    rows = volume.add_columns_for_cycle({"n": ("int", lambda rows: {0: len(rows)})})
    assert values(rows, "n")[:2] == [2, None]


@pytest.mark.parametrize("inclusion", ["begin", "end"])
@pytest.mark.parametrize("rounding", ["begin", "end"])
def test_intervals(spark, inclusion, rounding):
    rnd = random.Random(3)
    rows = [(rnd.randrange(0, 1000), float(i)) for i in range(300)] + [(100, 5.0), (900, 7.0)]
    frame = TimeSeriesFrame(spark.createDataFrame(rows, "time long, v double"))
    ticks = [100 + 50 * i for i in range(17)]
    want = {}
    for t, v in rows:
        for a, b in zip(ticks, ticks[1:]):
            if (a <= t < b) if inclusion == "begin" else (a < t <= b):
                want[b if rounding == "end" else a] = want.get(b if rounding == "end" else a, 0) + v
    uniform = clocks.UniformClock(100, 50, 900)
    table = TimeSeriesFrame(spark.createDataFrame([(t,) for t in ticks], "time long"))
    for clock in (uniform, table):
        found = frame.summarize_intervals(clock, S.sum("v"), inclusion=inclusion, rounding=rounding)
        assert values(found, "time", "v_sum") == sorted(want.items())
    with pytest.raises(ValueError):
        frame.summarize_intervals(table.merge(table), S.sum("v"))


def test_interval_default(spark, kind):
    volume = panel(spark, "volume", 100, 100, kind)
    clock = clocks.uniform("100s", begin=pd.Timestamp(1000 * SECOND), end=pd.Timestamp(1300 * SECOND))
    assert values(volume.summarize_intervals(clock, S.sum("volume")), "volume_sum") == [1000, 2600, 4200]


@pytest.mark.parametrize("future", [False, True])
@pytest.mark.parametrize("key", [None, "id"])
@pytest.mark.parametrize("factor", [1, 3, 16])
@pytest.mark.parametrize("strategy", ["frame", "prefix"])
def test_windows_against_brute_force(spark, future, key, factor, strategy):
    rnd = random.Random(7)
    rows = [(rnd.randrange(-200, 400), rnd.randrange(3), rnd.choice([None, float("nan"), 1.5, -2.0, 3.25]), i) for i in range(150)]
    frame = TimeSeriesFrame(spark.createDataFrame(rows, "time long, id int, v double, seq int"))
    window = (W.future_absolute_time if future else W.past_absolute_time)(25)
    found = frame.summarize_windows(window, [S.count(), S.sum("v"), S.count("v")], key, strategy=strategy, factor=factor)
    got = {r.seq: r for r in found.collect()}
    assert len(got) == len(rows)
    for t, i, _, n in rows:
        inside = [v for u, j, v, _ in rows if (t <= u <= t + 25 if future else t - 25 <= u <= t) and (key is None or i == j)]
        some = [v for v in inside if v is not None]
        assert got[n]["count"] == len(inside) and got[n].v_count == len(some)
        assert close([got[n].v_sum], [sum(some) if some else 0.0])


def test_window_rows_and_functions(spark, kind):
    volume = panel(spark, "volume", 100, 100, kind)
    window = W.past_absolute_time("50s")
    assert [len(r) for r in values(volume.add_windows(window, "id"), "window_past_50s")] == [1, 1] + [2] * 10

    @udf("double", arg_type="numpy")
    def total(v):
        return v.sum()

    by_function = volume.summarize_windows(window, {"s": total("volume")}, "id")
    assert values(by_function, "s") == values(volume.summarize_windows(window, S.sum("volume"), "id"), "volume_sum")
    every = [S.mean("volume"), S.quantile("volume", 0.5), S.ewma("volume", 0.05, "50s", "core"), S.linear_regression("volume", ["seq"])]
    assert volume.summarize_windows(window, every, "id").count() == 12


def test_lag_sum(spark):
    times, v = [1, 2, 3, 4, 5, 20, 21, 22, 23, 24, 25, 26], [1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 6, 6]
    frame = TimeSeriesFrame(spark.createDataFrame([(t * SECOND, float(x)) for t, x in zip(times, v)], "time long, value double"))
    found = frame.summarize_windows(W.past_absolute_time("3s"), S.lag_sum("value", "2s"))
    assert values(found, "lagSum", "sum")[:5] == [(0, 1), (0, 3), (0, 6), (0, 10), (1, 14)]


def test_running(spark, kind):
    price = panel(spark, "price", 0.5, 0.5, kind)
    found = price.add_summary_columns([S.sum("price"), S.count()])
    assert values(found, "price_sum", "count") == [(sum(0.5 * k for k in range(1, n + 1)), n) for n in range(1, 13)]
    dealt = price.add_summary_columns([S.sum("price"), S.count(), S.max("price")], "id", bucket="70s")
    assert values(dealt, "price_sum", "count", "price_max") == values(price.add_summary_columns([S.sum("price"), S.count(), S.max("price")], "id"), "price_sum", "count", "price_max")


def brute_ema(xs, alpha, priming, interpolation, convention):
    log = math.log(1 - alpha)

    def between(a, b, p):
        if p == 0:
            return 0.0
        d = math.exp(p * log)
        i = (d - 1) / (p * log)
        return {"previous": (1 - d) * a, "current": (1 - d) * b, "linear": (i - d) * a + (1 - i) * b}[interpolation]

    e = a = 0.0
    out = []
    for n, (t, x) in enumerate(xs):
        if n:
            p = t - xs[n - 1][0]
            e, a = math.exp(p * log) * e + between(xs[n - 1][1], x, p), math.exp(p * log) * a + between(1, 1, p)
        primed = xs[0][0] if convention == "legacy" else priming
        d = math.exp((t - xs[0][0]) * log)
        fe, fa = d * between(0, xs[0][1], primed) + e, d * between(0, 1, primed) + a
        out.append(fe if convention != "core" else fe / fa if fa else math.nan)
    return out


@pytest.mark.parametrize("interpolation", ["previous", "current", "linear"])
@pytest.mark.parametrize("convention", ["core", "convolution", "legacy"])
def test_smoothing(spark, interpolation, convention):
    xs = [(1, 0.5), (2, 2.0), (4, 1.0), (4, 3.0), (7, -1.0)]
    frame = TimeSeriesFrame(spark.createDataFrame([(t * SECOND, n, x) for n, (t, x) in enumerate(xs)], "time long, seq int, x double"), order_by="seq")
    found = frame.add_summary_columns(S.exponential_smoothing("x", 0.5, 0.0, "1s", interpolation, convention))
    assert close(values(found, "x_ema"), brute_ema(xs, 0.5, 0.0, interpolation, convention))
    whole = frame.summarize(S.exponential_smoothing("x", 0.5, 1.0, "1s", interpolation, convention)).collect()[0].x_ema
    assert close([whole], brute_ema(xs, 0.5, 1.0, interpolation, convention)[-1:])


def test_ewma(spark):
    frame = TimeSeriesFrame(spark.createDataFrame([(100 * SECOND, 1.0), (200 * SECOND, 1.5)], "time long, x double"))
    core = frame.add_summary_columns(S.ewma("x", 0.05, "100s", "core"))
    assert close(values(core, "x_ewma"), [1.0, 1.2564102564102564])
    assert close(values(frame.add_summary_columns(S.ewma("x", 0.05, "100s")), "x_ewma"), [1.0, 2.45])
    assert close(values(frame.add_summary_columns(S.ewma("x", 0.05, "constant")), "x_ewma"), [1.0, 2.45])


def test_regression(spark):
    rnd = np.random.default_rng(2)
    x1, x2, w = rnd.normal(size=80), rnd.normal(size=80), rnd.uniform(0.5, 2, 80)
    y = 1 + 2 * x1 - 3 * x2 + rnd.normal(size=80) * 0.1
    df = spark.createDataFrame([(i, *map(float, v), 4.0) for i, v in enumerate(zip(y, w, x1, x2))], "time long, y double, w double, x1 double, x2 double, c double")
    a = np.column_stack([np.ones(80), x1, x2]) * np.sqrt(w)[:, None]
    beta = np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0]
    row = TimeSeriesFrame(df).summarize(S.linear_regression("y", ["x1", "x2"], "w")).collect()[0]
    assert close([row.intercept, *row.beta], beta) and row.samples == 80
    e = y - np.column_stack([np.ones(80), x1, x2]) @ beta
    cov = (w * e * e).sum() / 77 * np.linalg.inv(a.T @ a)
    assert close([row.stdErr_intercept, *row.stdErr_beta], np.sqrt(np.diag(cov)))
    model = regression(df, "y", ["x1", "x2"], "w")
    assert close(model.beta, beta) and close(model.standard_errors, np.sqrt(np.diag(cov))) and abs(model.r_squared - row.rSquared) < 1e-8
    assert (model.p_values < 1e-6).all() and abs(two_sided_p(2.228138852, 10) - 0.05) < 1e-8
    assert len(model.robust_errors("HC1")) == 3
    const = TimeSeriesFrame(df).summarize(S.linear_regression("y", ["x1", "c"], ignore_const=True)).collect()[0]
    assert const.const_columns == ["c"] and const.beta[1] == 0 and math.isnan(const.tStat_beta[1])
    singular = TimeSeriesFrame(df).summarize(S.linear_regression("y", ["x1", "c"])).collect()[0]
    assert math.isnan(singular.intercept)


def test_rowwise(spark, kind):
    price = panel(spark, "price", 0.5, 0.5, kind)
    assert price.keep_columns("id").columns == ["time", "id"]
    assert price.keep_rows(lambda r: r.id == 3).count() == 6 == price.delete_rows(F.col("id") == 3).count()
    assert price.rename_columns({"price": "p"}).cast({"p": "int"}).schema["p"].dataType.simpleString() == "int"
    assert price.add_columns({"twice": ("double", lambda r: r.price * 2)}).first().twice == 1.0
    with pytest.raises(ValueError):
        price.delete_columns("time")
    there = price.shift("1h")
    assert values(there.shift("1h", backwards=True), "time") == values(price, "time") != values(there, "time")
    assert price.withColumn("x", F.lit(1)).filter("x = 1").count() == 12
    assert isinstance(price.withColumn("x", F.lit(1)), TimeSeriesFrame) and not isinstance(price.withColumn("time", F.lit("a")), TimeSeriesFrame)
    assert price.summarizeCycles(S.count()).count() == 6
    assert price.repartition(3).validate() == 0


def test_shift_saturates_and_rounds(spark):
    longs = TimeSeriesFrame(spark.createDataFrame([((1 << 63) - 5,), (5,)], "time long"))
    assert values(longs.shift(10), "time") == [15, (1 << 63) - 1]
    stamps = TimeSeriesFrame(spark.sql("SELECT timestamp'1970-01-01 00:00:01' AS time"))
    micros = lambda f: f.df.select(F.unix_micros("time")).first()[0]
    assert micros(stamps.shift("500ns")) == 10**6 and micros(stamps.shift("500ns", backwards=True)) == 10**6 - 1


def test_zones(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00' AS time, 1 AS v UNION ALL SELECT timestamp_ntz'2024-03-10 01:30:00', 2")
        frame = TimeSeriesFrame(df)
        assert values(frame.summarize_windows(W.past_absolute_time("1h"), S.count()), "count") == [1, 2]
        assert str(values(frame.shift("1h"), "time")[0]) == "2024-03-10 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_clocks(spark):
    assert [r[0].minute for r in clocks.uniform_frame(spark, "20m", "5m", "2024-01-01", "2024-01-01T01:00").orderBy("time").collect()] == [5, 25, 45]
    assert clocks.uniform("1d", begin="2024-01-01", end="2024-01-03", end_inclusive=False).count == 2
    for bad in ({"frequency": "0s"}, {"frequency": "1d", "begin": "2024-01-02", "end": "2024-01-01"}, {"frequency": "1d", "offset": "12h", "begin": "2024-01-01", "end": "2024-01-01T06:00"}):
        with pytest.raises(ValueError):
            clocks.uniform(**bad)
    t = [r[0] for r in clocks.random_frame(spark, "1h", begin="2024-01-01", end="2024-03-01", seed=1, kind="long").orderBy("time").collect()]
    assert 2000 < len(t) < 4000 and all(b >= a for a, b in zip(t, t[1:]))
    panel_ = generator.generate(spark, "2024-01-01", "2024-01-02", "1h", [1, 2, 3], 0.5)
    assert 10 < panel_.count() < 65


def test_reader(spark, tmp_path):
    df = spark.createDataFrame([(20240101 + i, float(i), f"2024-01-{i + 1:02d} 00:00:00") for i in range(9)], "n int, v double, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "p"))
    base = read(spark).option("time_column", "at").options(columns="v")
    got = base.range("2024-01-03", "2024-01-06").parquet(str(tmp_path / "p"))
    assert got.columns == ["time", "v"] and values(got, "v") == [2, 3, 4]
    assert values(base.range(20240103, 20240106).expand("1d", "1d").parquet(str(tmp_path / "p")), "v") == [1, 2, 3, 4, 5]
    plan = got.df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(at), GreaterThanOrEqual" in plan and "n#" not in plan.split("ReadSchema")[1]
    (tmp_path / "a.csv").write_text("1000,7,0.5\n900,3,1.0\n")
    csv = read(spark).csv(str(tmp_path / "a.csv"), header=False)
    assert csv.columns[0] == "time" and csv.schema["time"].dataType.simpleString() == "bigint"
    assert read(spark).range("2024-01-01", "2024-01-02").clock("uniform", "1h").count() == 25
    with pytest.raises(ValueError):
        read(spark).clock()
    assert read(spark).options(time_unit="s").range(pd.Timestamp("1970-01-01"), pd.Timestamp("1970-01-01T00:00:05")).pandas(pd.DataFrame({"time": [1, 5]})).first().time == SECOND


def test_stream_and_batch_agree(spark, tmp_path):
    from tidemark.streaming.intervals import summarize_stream

    df = spark.range(100).select(F.timestamp_micros(F.col("id") * 10_000_000).alias("time"), F.col("id").cast("double").alias("v"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = summarize_stream(stream, [S.sum("v"), S.count()], "time", "1 minute", "1 minute").writeStream.format("memory").queryName("got").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = summarize_stream(df, [S.sum("v"), S.count()], "time", "1 minute", "1 minute")
    assert sorted(spark.table("got").collect()) == sorted(batch.collect())


def near(a, b, relative=1e-9):
    return all(x == pytest.approx(y, rel=relative, abs=1e-12, nan_ok=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("factor", [1, 40, 4000])
def test_running_averages_over_many_buckets(spark, factor):
    """Weights fade within a few rows (4000: within one), or hardly at all; long gaps, ties, nulls, and keys of their own."""
    rnd = random.Random(factor)
    rows, t = [], 0
    for i in range(160):
        t += rnd.choice([0, 1, 2, 5, 60, 900])
        rows.append((t * SECOND, rnd.randrange(2), i, rnd.choice([None, 1.0, -2.5, 3.0, 8.0])))
    frame = TimeSeriesFrame(spark.createDataFrame(rows, "time long, id int, seq int, x double").repartition(3), order_by="seq")
    period = f"{20_000_000_000 // factor}ns"
    s = [S.ewma("x", 0.3, period, "core").prefix("c"), S.ewma("x", 0.3, period).prefix("l"), S.ewma("x", 0.3, "constant").prefix("k"), S.exponential_smoothing("x", 0.3, 1.0, period, "current", "core").prefix("e"), S.exponential_smoothing("x", 0.3, 1.0, period, "linear", "convolution").prefix("p"), S.count("x")]
    got = {r.seq: r for r in frame.add_summary_columns(s, "id").collect()}
    whole = {r.id: r for r in frame.summarize(s[:2], "id").collect()}
    unit, log = 20 / factor, math.log(0.7)
    for i, (_, key, seq, _) in enumerate(rows):
        some = [(u / SECOND / unit, x) for u, j, _, x in rows[: i + 1] if j == key and x is not None]
        r = got[seq]
        assert r.x_count == len(some)
        if not some:
            assert all(math.isnan(v) for v in (r.c_x_ewma, r.l_x_ewma, r.k_x_ewma, r.e_x_ema, r.p_x_ema))
            continue
        weights = [math.exp((some[-1][0] - u) * log) for u, _ in some]
        total = sum(w * x for w, (_, x) in zip(weights, some))
        constant = sum(0.7 ** (len(some) - 1 - k) * x for k, (_, x) in enumerate(some))
        assert near((r.c_x_ewma, r.l_x_ewma, r.k_x_ewma), (total / sum(weights), total, constant), 1e-8), (seq, r)
        assert near((r.e_x_ema, r.p_x_ema), (brute_ema(some, 0.3, 1.0, "current", "core")[-1], brute_ema(some, 0.3, 1.0, "linear", "convolution")[-1]), 1e-8), (seq, r)
    for key, r in whole.items():
        last = [s for *_, s, _ in rows if rows[s][1] == key][-1]
        assert near((r.c_x_ewma, r.l_x_ewma), (got[last].c_x_ewma, got[last].l_x_ewma), 1e-8)
    keyless = {r.seq: r for r in frame.add_summary_columns([s[0], S.count("x"), S.exponential_smoothing("x", 0.3, 1.0, period).prefix("e")]).collect()}
    some = [(u / SECOND / unit, x) for u, _, _, x in rows if x is not None]
    weights = [math.exp((some[-1][0] - u) * log) for u, _ in some]
    assert near((keyless[159].c_x_ewma, keyless[159].e_x_ema), (sum(w * x for w, (_, x) in zip(weights, some)) / sum(weights), brute_ema(some, 0.3, 1.0, "current", "core")[-1]), 1e-8)


@pytest.mark.parametrize("future", [False, True])
@pytest.mark.parametrize("half", [2, 400])
def test_window_averages_and_extremes(spark, future, half):
    rnd = random.Random(half)
    rows = [(rnd.randrange(-200, 500), rnd.randrange(2), i, rnd.choice([None, 1.0, -2.0, 7.5])) for i in range(140)]
    frame = TimeSeriesFrame(spark.createDataFrame(rows, "time long, id int, seq int, x double"), order_by="seq")
    window = (W.future_absolute_time if future else W.past_absolute_time)(30)
    means = {r.seq: r for r in frame.summarize_windows(window, [S.ewma("x", 0.5, half, "core"), S.count("x")], "id").collect()}
    extremes = {r.seq: r for r in frame.summarize_windows(window, [S.min("x"), S.max("x"), S.sum("x"), S.count()], "id", strategy="blocks").collect()}
    keyless = {r.seq: r for r in frame.summarize_windows(window, [S.min("x"), S.max("x")]).collect()}
    assert len(means) == len(extremes) == len(keyless) == len(rows)
    for t, key, seq, _ in rows:
        inside = [(u, x, j) for u, j, _, x in rows if (t <= u <= t + 30 if future else t - 30 <= u <= t)]
        some = sorted((u, x) for u, x, j in inside if j == key and x is not None)
        values = [x for _, x in some]
        e = extremes[seq]
        assert (e.x_min, e.x_max, e["count"]) == (min(values, default=None), max(values, default=None), sum(j == key for *_, j in inside)) and abs(e.x_sum - sum(values)) < 1e-9
        assert keyless[seq].x_min == min((x for _, x, _ in inside if x is not None), default=None)
        weights = [0.5 ** ((some[-1][0] - u) / half) for u, _ in some]
        want = sum(w * x for w, (_, x) in zip(weights, some)) / sum(weights) if some else math.nan
        assert near([means[seq].x_ewma], [want], 1e-8)


def test_large_offsets(spark):
    """Weighted moments and regressions keep their digits where values are large against their spread."""
    x, y, w = [1e9 + k for k in range(5)], [2e9 + 2 * k + (0.5 if k == 3 else 0) for k in range(5)], [1.0, 2.0, 1.5, 0.5, 3.0]
    frame = TimeSeriesFrame(spark.createDataFrame([(i, 0, *v) for i, v in enumerate(zip(x, y, w))], "time long, id int, x double, y double, w double"))
    s = [S.weighted_covariance("x", "y", "w"), S.weighted_correlation("x", "y", "w"), S.weighted_mean("x", "w"), S.weighted_mean_test("x", "w"), S.linear_regression("y", ["x"], "w")]
    a, b, c = np.array(x) - 1e9, np.array(y) - 2e9, np.array(w)
    ma, mb, total = (c * a).sum() / c.sum(), (c * b).sum() / c.sum(), c.sum()
    cov, va, vb = (c * (a - ma) * (b - mb)).sum(), (c * (a - ma) ** 2).sum(), (c * (b - mb) ** 2).sum()
    want = [cov / (total - (c**2).sum() / total), cov / math.sqrt(va * vb), 1e9 + ma, math.sqrt(va * total / (total**2 - (c**2).sum())), math.sqrt(va / total), cov / va]
    found = [frame.summarize(s, "id"), frame.summarize(s), frame.add_summary_columns(s, "id").filter("time = 4"), frame.summarize_windows(W.past_absolute_time(10), s, "id").filter("time = 4"), frame.summarize_cycles(s, "id").filter("time > 4").merge(frame.summarize(s, "id").cast({"id": "int"}))]
    for f in found:
        (r,) = f.collect()
        got = [r.x_y_w_weightedCovariance, r.x_y_w_weightedCorrelation, r.x_w_weightedMean, r.x_w_weightedStandardDeviation, r.x_w_stddev, r.beta[0]]
        assert near(got, want, 1e-6) and near([r.x_w_mean, r.intercept + r.beta[0] * (1e9 + ma)], [1e9 + ma, 2e9 + mb], 1e-9)


def test_long_windows_of_nanoseconds(spark):
    """Lengths whose buckets would pass the largest long."""
    frame = TimeSeriesFrame(spark.createDataFrame([(-SECOND, 1.0), (1_700_000_000 * SECOND, 2.0)], "time long, v double"))
    for length in ("1000 days", "7300 days", "100000 days"):
        assert values(frame.summarize_windows(W.past_absolute_time(length), S.sum("v"), strategy="prefix"), "v_sum") == [1, 3 if length == "100000 days" else 2]
        assert values(frame.summarize_windows(W.past_absolute_time(length), S.sum("v"), strategy="frame"), "v_sum")[0] == 1
        found = frame.left_join(TimeSeriesFrame(frame.df.where("time < 0").withColumnRenamed("v", "r")), length)
        assert values(found, "r") == [1, 1 if length == "100000 days" else None]


def test_symmetric_join_takes_the_last_of_ties(spark):
    rows = [(100, n) for n in range(50)]
    one = TimeSeriesFrame(spark.createDataFrame(rows, "time long, a int").repartition(4), order_by="a")
    two = TimeSeriesFrame(spark.createDataFrame(rows, "time long, b int").repartition(4), order_by="b")
    got = one.symmetric_join(two, 10).df.collect()
    assert sorted((r.a, r.b) for r in got) == sorted([(n, 49) for n in range(50)] + [(49, n) for n in range(50)])


def test_window_batches_arrow_and_csv_times(spark, tmp_path):
    frame = TimeSeriesFrame(spark.createDataFrame([(t, t % 2, float(t)) for t in range(40)], "time long, id int, v double"))

    def sums(left, right, begins, ends):
        total = np.concatenate([[0], np.cumsum(right["v"].to_numpy())])
        return total[ends] - total[begins]

    got = frame.summarize_window_batches(W.past_absolute_time(6), sums, {"s": "double"}, "id", max_size=3)
    assert values(got, "s") == values(frame.summarize_windows(W.past_absolute_time(6), S.sum("v"), "id"), "v_sum")
    import pyarrow as pa

    for r in frame.summarize([S.arrow(["time", "v"], True)], "id").collect():
        table = pa.ipc.open_file(r.arrow_bytes).read_all()
        assert table.column("time").to_pylist() == list(range(r.id, 40, 2)) == [x.time for x in r["__baseRows"]]
    (tmp_path / "t.csv").write_text("time,v\n2024-01-01 00:00:01,1\n")
    assert read(spark).option("epoch_ms", True).csv(str(tmp_path / "t.csv")).first().time == 1_704_067_201_000
