"""Columns processed per minute from a stream of log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def throughput_stream(log: DataFrame, ts: str = "ts", delay: str = "2 minutes") -> DataFrame:
    """(minute, columns_processed); append mode emits a minute once it can no longer change."""
    timed = log.select(F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return (timed.groupBy(F.window("ts", "1 minute")).agg(F.count(F.lit(1)).alias("columns_processed"))
            .select(F.col("window.start").alias("minute"), "columns_processed"))
