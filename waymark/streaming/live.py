"""Tracks as they are recorded: gap sessions and windowed distance over a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(stream: DataFrame, gap: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows track_id, start, end, n_points of a stream of points (track_id, ts timestamp): sessions without a gap as long as
    ``gap``. Points later than ``late`` behind the newest are dropped, as the batch rule drops points out of order."""
    return (
        stream.withWatermark("ts", late)
        .groupBy("track_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n_points"))
        .select("track_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_points")
    )


def bounds_by_window(stream: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows track_id, start, n_points and bounds of tumbling windows of a stream of points."""
    return (
        stream.withWatermark("ts", late)
        .groupBy("track_id", F.window("ts", length).alias("w"))
        .agg(F.count("*").alias("n_points"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("lat", "lon", "ele") for f in (F.min, F.max)))
        .select("track_id", F.col("w.start").alias("start"), "n_points", *(f"{f}_{c}" for c in ("lat", "lon", "ele") for f in ("min", "max")))
    )
