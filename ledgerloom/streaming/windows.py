"""Windows over event streams. The records' own tools have none; these are additions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; works on a stream or a table. ``events``: ts, event_type, value."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "1 day") -> DataFrame:
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def unique_events(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each event once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
