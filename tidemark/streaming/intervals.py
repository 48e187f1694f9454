"""Interval summaries over streams: tumbling windows with a watermark, by the same summarizers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import summarizers as S
from tidemark.functions.time import time_type
from tidemark.plans.aggregate import prepared, state_for


def summarize_stream(df: DataFrame, summarizer, time: str, interval: str, late: str, key: list[str] = ()) -> DataFrame:
    """[begin, end) intervals labelled by their end; rows later than `late` are dropped. Also runs on batches."""
    time_type(df, time)
    ready = prepared(df.withWatermark(time, late) if df.isStreaming else df, time)
    state = state_for(ready, time, (), [c for c in df.columns])
    outputs = S.as_summarizer(summarizer).outputs(state)
    by = ready.groupBy(F.window(time, interval).alias("__interval"), *key).agg(*[p.aggregate.alias(n) for n, p in state.primitives.found.items()])
    return by.select(F.col("__interval.end").alias(time), *key, *[c.alias(n) for n, c in outputs])


__all__ = ["summarize_stream"]
