"""Track points out of ordinary tables.

A points table has track_id, seq (order within the track), ts_ms (epoch milliseconds or null), lat, lon, ele, segment and
what an operator asks for besides. Each adapter makes one of ``events``, ``orders`` or ``lineitem``; the coordinates are a
fixed function of the keys, as these tables hold none.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in a partition that dealt() aims at.
ROWS_A_TASK = 200_000


def dealt(rows: DataFrame) -> DataFrame:
    """rows, each track's together, in so many partitions that these don't grow with the table (only with the longest track).
    Small tables are left to Spark, which deals them itself and joins small partitions."""
    n = math.ceil(rows.count() / ROWS_A_TASK)
    return rows.repartition(max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "track_id") if n > 1 else rows


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("track_id").orderBy(*order)))


def sparse_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track for each user of ``events``, with the events' own times: hours between points."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("track_id"), "event_id", "ts", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ts_ms"), F.col("value").alias("ele"), "event_type"
    )
    return _numbered(dealt(rows), "ts", "event_id").select(
        "track_id", "seq", "ts_ms",
        (43 + F.col("event_id") % 1000 * 1e-5).alias("lat"), (42 + F.col("event_id") % 777 * 1e-5).alias("lon"),
        "ele", F.floor((F.col("seq") - 1) / 10).cast("int").alias("segment"), "event_type",
    )


def dense_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track for each user of ``events``, a point every 1 to 4 seconds, with faults: jumps, repeated times, few
    satellites, missing and leaping elevations, and a new segment after each 40 points."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("track_id"), F.col("event_id").alias("e"), "ts", "value")
    w = Window.partitionBy("track_id").orderBy("ts", "e")
    step, e = 1 + F.col("e") % 4, F.col("e")
    return (
        dealt(rows).withColumn("seq", F.row_number().over(w))
        .withColumn("run", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .select(
            "track_id", "seq",
            ((F.col("run") - F.when(e % 53 == 0, step).otherwise(0)) * 1000).alias("ts_ms"),
            (43 + F.col("seq") * 3e-5 + F.when(e % 97 == 0, 0.01).otherwise(0.0)).alias("lat"), (42 + e % 5 * 1e-6).alias("lon"),
            F.when(e % 61 != 0, 100 + F.col("value") / 50 + F.when(e % 37 == 0, 80.0).otherwise(0.0)).alias("ele"),
            F.floor((F.col("seq") - 1) / 40).cast("int").alias("segment"),
            F.when(e % 41 == 0, 2).otherwise(9).alias("satellites"),
            F.when(F.floor((F.col("seq") - 1) / 20) % 2 == 0, "barometric").otherwise("gpx").alias("ele_source"),
        )
    )


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long track for each supplier of ``lineitem``, a point every 2 to 5 seconds. Lines of one order and number, which
    the table has, follow each other by price, so that no two runs differ."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("track_id"), "l_orderkey", "l_linenumber", "l_extendedprice")
    w = Window.partitionBy("track_id").orderBy("l_orderkey", "l_linenumber", "l_extendedprice")
    return (
        dealt(rows).withColumn("seq", F.row_number().over(w))
        .withColumn("run", F.sum(2 + F.col("l_orderkey") % 4).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .select(
            "track_id", "seq", (F.col("run") * 1000).alias("ts_ms"), (43 + F.col("seq") * 4e-5).alias("lat"), (42 + F.col("l_orderkey") % 5 * 1e-6).alias("lon"),
            (100 + F.col("l_extendedprice") / 2000).alias("ele"), F.floor((F.col("seq") - 1) / 500).cast("int").alias("segment"),
        )
    )


def tailed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier_points with what elevation sensors do wrong, by supplier: pits below the sea with and without shoulders, high
    beginnings, a high end behind a pause of 40 minutes toward which the elevation only settles, a low beginning that the
    way explains, and pits too long to be errors."""
    kind, k = F.col("track_id") % 6, (F.col("seq") - 1) % 500 + 1
    settling = F.when(k <= 488, 20.0).when(k == 489, 21.0).when(k == 490, 23.0).when(k == 491, 26.0).when(k == 492, 31.0).otherwise(75.0)
    base = 12 + (F.col("ele") - 100) * 0.4
    ele = (
        F.when((kind == 0) & k.between(200, 209), -14.0 - k % 3).when((kind == 0) & k.between(196, 213), base * 0.2)
        .when((kind == 1) & (k <= 8), base + 75).when((kind == 2) & (k >= 486), settling).when((kind == 3) & (k <= 12), -15.0)
        .when((kind == 4) & k.between(200, 240), -14.0).when((kind == 5) & k.between(200, 209), -14.0).when((kind == 5) & k.between(180, 240), base * 0.1).otherwise(base)
    )
    pause = F.when((kind == 2) & (k >= 493), 2_400_000).otherwise(0)
    return supplier_points(spark, sf_dir).withColumns({"ele": ele, "ts_ms": F.col("ts_ms") + pause, "lat": F.when(kind == 3, 43 + F.col("seq") * 4e-4).otherwise(F.col("lat"))})


def pacing_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier_points at 0.4 m/s: of three suppliers one paces to and fro in legs of 225 s, one in legs of 250 s, and one
    walks on."""
    t, kind = F.col("ts_ms") / 1000.0, F.col("track_id") % 3
    leg = F.when(kind == 0, 225.0).otherwise(250.0)
    metres = F.when(kind == 2, 0.4 * t).otherwise(0.4 * F.least(t % (2 * leg), 2 * leg - t % (2 * leg)))
    return supplier_points(spark, sf_dir).withColumn("lat", 43 + metres / 111320.0)
