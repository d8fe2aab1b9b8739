"""Event-time windows and upserts; every function takes a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, time: str, late: str) -> DataFrame:
    if not events.isStreaming:
        return events
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)  # watermarks need a time zone


def tumbling(events: DataFrame, time: str, length: str, keys: list[str], value: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and sum by key and window; with ``slide`` the windows overlap. Events later than ``late`` are dropped from a stream, as its watermark says."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = _late(events, time, late).groupBy(*keys, w.alias("_w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", "total")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Count and sum by key and session; a gap without events ends a session."""
    out = _late(events, time, late).groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", "total")


def latest(descriptors: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last value of each (keys, descriptor): on a stream the state is the aggregate's, in update mode an upsert."""
    return descriptors.groupBy(*keys, "descriptor").agg(F.max_by("value", order).alias("value"))
