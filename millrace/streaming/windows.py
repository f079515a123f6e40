"""Windowed queries on event streams; the same functions work on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """The stream with a watermark; zone-less times are read in the session's zone, which watermarks need."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def sliding_ratio(stream: DataFrame, ts: str, bad: Column, window: str, slide: str, bound: float, least: int) -> DataFrame:
    """``starts, ends, bad, total, firing`` of sliding windows; events later than the watermark are left out."""
    w = stream.groupBy(F.window(ts, window, slide)).agg(F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("total"))
    ratio = F.try_divide(F.col("bad"), F.col("total"))
    return w.select(F.col("window.start").alias("starts"), F.col("window.end").alias("ends"), "bad", "total", ((ratio > bound) & (F.col("total") > least)).alias("firing"))


def tumbling(stream: DataFrame, ts: str, keys: list[str], width: str) -> DataFrame:
    w = stream.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("starts"), *keys, "n")


def sessions(stream: DataFrame, ts: str, keys: list[str], gap: str) -> DataFrame:
    s = stream.groupBy(*keys, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select(*keys, F.col("session_window.start").alias("starts"), F.col("session_window.end").alias("ends"), "n")
