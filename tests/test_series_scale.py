"""Steps whose cost must stay linear in rows, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.frame import TimeSeriesFrame
from tidemark.functions import summarizers as S
from tidemark.functions import windows as W


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("strict", [False, True])
def test_future_join_folds_each_row_once(spark, strict):
    """Many rows in one bucket, with ties on time; a frame up to the partition's end would be folded anew for each row."""
    rnd = random.Random(5)
    left = [(rnd.randrange(-500, 500), i) for i in range(3000)]
    right = [(rnd.randrange(-450, 450), i) for i in range(400)]
    a = TimeSeriesFrame(spark.createDataFrame(left, "time long, a int"))
    b = TimeSeriesFrame(spark.createDataFrame(right, "time long, b int"), order_by="b")
    out = a.future_left_join(b, 7, strict_lookahead=strict).df
    assert "unboundedfollowing" not in plan_of(out).lower()
    got = {r.a: r.b for r in out.collect()}
    later = sorted(right)
    want = {i: next((j for u, j in later if (u > t if strict else u >= t) and u <= t + 7), None) for t, i in left}
    assert got == want


def test_z_score_out_of_sample_with_equal_values_before(spark):
    """The deviation of equal values is 0, whatever the last one is; rounding must not make it a small number."""
    rnd = random.Random(2)
    xs = [29.27] * 60 + [1209.13, 0.1] + [rnd.uniform(0, 100) for _ in range(20)]
    rows = [(t // 2, t, x if t != 70 else None) for t, x in enumerate(xs)]
    frame = TimeSeriesFrame(spark.createDataFrame(rows, "time long, seq int, x double"), order_by="seq")
    z = S.z_score("x", False)

    def brute(upto):
        some = [x for _, _, x in rows[: upto + 1] if x is not None]
        before = np.array(some[:-1])
        return None if len(before) < 2 or before.std() < 1e-9 else (some[-1] - before.mean()) / before.std(ddof=1)

    running = {r.seq: r.x_zScore for r in frame.add_summary_columns(z).collect()}
    windows = {r.seq: r.x_zScore for r in frame.summarize_windows(W.past_absolute_time(1000), z).where("seq % 2 = 1").collect()}
    for seq in range(len(rows)):
        grouped = [frame.filter(f"seq <= {seq}").summarize(z).collect()[0].x_zScore] if seq in (1, 59, 60, 61, 70, 81) else []
        for got in [running[seq], *([windows[seq]] if seq in windows else []), *grouped]:
            want = brute(seq)
            assert np.isnan(got) if want is None else got == pytest.approx(want, rel=1e-9), (seq, got, want)


def test_z_score_out_of_sample_with_ties(spark):
    """Of rows that nothing tells apart one is the last; the others count."""
    frame = TimeSeriesFrame(spark.createDataFrame([(0, 1.0), (0, 4.0), (1, 7.0), (1, 7.0), (1, 7.0), (1, 2.0)], "time long, x double"))
    before = np.array([1.0, 4.0, 7.0, 7.0, 2.0])
    want = (7.0 - before.mean()) / before.std(ddof=1)
    assert frame.summarize(S.z_score("x", False)).collect()[0].x_zScore == pytest.approx(want)


@pytest.mark.parametrize("key", [None, "id"])
def test_windows_merge_buckets_and_slide_nothing(spark, key):
    """Windows of many buckets, sums before the window, and ties, against brute force; no frame slides over rows."""
    rnd = random.Random(9)
    rows = [(rnd.randrange(-200, 500), rnd.randrange(2), i, rnd.choice([None, 1.0, -2.0, 7.5])) for i in range(150)]
    frame = TimeSeriesFrame(spark.createDataFrame(rows, "time long, id int, seq int, x double"), order_by="seq")

    def inside(t, k, low, high):
        return [x for u, j, _, x in rows if t + low <= u <= t + high and (key is None or j == k)]

    lags = frame.summarize_windows(W.past_absolute_time(40), S.lag_sum("x", 90), key).df
    sums = frame.summarize_windows(W.past_absolute_time(400), [S.sum("x"), S.min("x"), S.count()], key, strategy="frame").df
    for plan in (plan_of(lags), plan_of(sums)):
        assert "RangeFrame, -40," not in plan and "RangeFrame, -400," not in plan and "RangeFrame, -130," not in plan
    lags, sums = ({r.seq: r for r in df.collect()} for df in (lags, sums))
    for t, k, seq, _ in rows:
        near, far, long = (inside(t, k, *w) for w in ((-40, 0), (-130, -41), (-400, 0)))
        assert (lags[seq]["sum"], lags[seq].lagSum) == (sum(x or 0 for x in near), sum(x or 0 for x in far))
        assert (sums[seq].x_sum, sums[seq].x_min, sums[seq]["count"]) == (sum(x or 0 for x in long), min((x for x in long if x is not None), default=None), len(long))


def test_one_call_sees_windows_of_many_keys(spark):
    rows = [(t, k, float(t * k)) for k in range(300) for t in range(4)]
    frame = TimeSeriesFrame(spark.createDataFrame(rows, "time long, id int, v double"))

    def sums(left, right, begins, ends):
        return [right["v"].iloc[i:j].sum() for i, j in zip(begins, ends)], np.full(len(left), len(left))

    for most in (7, 500_000):
        got = frame.summarize_window_batches(W.past_absolute_time(1), sums, {"s": "double", "seen": "long"}, "id", max_size=most).df.collect()
        assert {(r.time, r.id): r.s for r in got} == {(t, k): float(t * k + max(t - 1, 0) * k) for t, k, _ in rows}
        assert max(r.seen for r in got) <= most and (most == 7 or max(r.seen for r in got) > 4)


def test_arrow_files_keep_types(spark):
    """Files are made from Arrow's arrays and not from Python objects, so a column of nulls keeps its type."""
    import pyarrow as pa

    frame = TimeSeriesFrame(spark.createDataFrame([(2, 1, None), (1, 1, None), (1, 2, 0.5)], "time long, id int, v double"))
    for r in frame.summarize(S.arrow(["time", "v"]), "id").collect():
        table = pa.ipc.open_file(r.arrow_bytes).read_all()
        assert table.column("time").to_pylist() == [1, 2][: len(table)] and table.schema.field("v").type == pa.float64()
