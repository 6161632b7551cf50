"""Windowed counts of events, the same for tables and streams. The reference has no streams: this goes beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """event_type, start, n, total of each window; of a stream, events later than `late` behind the watermark are left out."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")
