"""A stream as a sequence without order, and its windowed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinate.seq import Seq


def from_stream(df: DataFrame) -> Seq:
    """where, select and select_many work; what needs positions raises."""
    if not df.isStreaming:
        raise ValueError("not a stream; use Seq.of with an order")
    return Seq(df, [], df.columns)


def keyed_windows(df: DataFrame, time: str, length: str, late: str, keys: tuple[str, ...] = (), slide: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates of each key in event-time windows; rows later than ``late`` are dropped and state is bounded by it."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    grouped = df.withWatermark(time, late).groupBy(window, *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggregates)
