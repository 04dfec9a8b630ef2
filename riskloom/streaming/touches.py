"""Streaming counts of touches. The batch operators have no stream form to match; this is an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_touches(events: DataFrame, days: int = 30, slide_days: int = 1, late_days: int = 1) -> DataFrame:
    """events (file, ts timestamp) -> (window_start, window_end, file, touches) over sliding windows; later events than the watermark are dropped."""
    w = F.window("ts", f"{days} days", f"{slide_days} days")
    g = events.withWatermark("ts", f"{late_days} days").groupBy(w.alias("w"), "file").agg(F.count("*").alias("touches"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "file", "touches")
