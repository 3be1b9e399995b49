"""Streaming forms: windows over events, and segments as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) in tumbling windows; works on a batch and on a stream alike."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")
