"""Event-time windows over the events table: an extension beyond the literature operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Events and values of each type in windows of a fixed width. Works on streams and on tables; on a stream, put a
    watermark on ts first."""
    w = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("total_value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n_events", "total_value")


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Sessions of each user on a table: a gap of that many minutes starts a new one. On a stream, use session_window."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    late = F.col("ts") >= F.lag("ts").over(order) + F.expr(f"INTERVAL {int(gap_minutes)} MINUTES")
    starts = events.withColumn("new", F.coalesce(late.cast("int"), F.lit(1)))
    numbered = starts.withColumn("session", F.sum("new").over(order))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n_events")).select("user_id", F.col("session_window.start").alias("start"), "n_events")
