"""Event-time windows and sessions on streams, with late data dropped by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Session counts and values by key; the same on a batch and a stream."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("_ts", late)
    found = rows.groupBy(key, F.session_window("_ts", gap).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return found.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Counts by event type and window."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("_ts", late)
    return rows.groupBy(F.window("_ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
