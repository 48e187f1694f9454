"""Times the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "asof_left_join", "asof_left_join_keyless", "asof_future_join", "symmetric_join", "summarize_keyed", "cycle_sum", "interval_begin_end", "window_past_keyed", "window_past_keyless",
    "window_extremes", "running_keyed", "running_keyless", "ewma_core", "ema_halflife", "weighted", "ols_simple", "cycle_udf_summary",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from tidemark import catalogue

    at, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    times = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):  # the first run compiles
            start = time.perf_counter()
            queries[name](spark, at).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": at.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
