"""Follower counts of a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def follower_count_stream(edges: DataFrame, every: int = 100) -> DataFrame:
    """Running ``(dst, cnt)`` of a streaming edge list; write it in update or complete mode."""
    return edges.filter(F.col("dst") % every == 0).groupBy("dst").agg(F.count(F.lit(1)).alias("cnt"))


def windowed_follower_count(edges: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(start, dst, cnt)`` in tumbling windows; the watermark bounds the state kept."""
    grouped = edges.withWatermark(ts, late).groupBy(F.window(ts, width), "dst")
    return grouped.agg(F.count(F.lit(1)).alias("cnt")).select(F.col("window.start").alias("start"), "dst", "cnt")
