"""Windowed counts of arriving rows, by event time with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(rows: DataFrame, column: str, ts: str = "ts", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, column, n); the same on a batch and on a stream."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), column).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), column, "n")
