"""Pairs of neighbouring points, gaps, continuous segments, jitter, durations and sampling."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from waymark import ship
from waymark.functions.geo import distance
from waymark.functions.rules import metres

Place = namedtuple("Place", ("lat", "lon"))


def in_order() -> WindowSpec:
    """A track's points in order."""
    return Window.partitionBy("track_id").orderBy("seq")


def run_order() -> WindowSpec:
    """An elevation run's samples in order."""
    return Window.partitionBy("track_id", "run").orderBy("i")


def whole_run() -> WindowSpec:
    return Window.partitionBy("track_id", "run")


def with_pairs(points: DataFrame) -> DataFrame:
    """Every point with its pair to the point before: same_segment, dt (seconds, 0 at least, null if a time is missing), metres.
    The first point of a track has null in all three."""
    before = {c: F.lag(c).over(in_order()) for c in ("lat", "lon", "ts_ms", "segment", "seq")}
    return points.withColumns(
        {
            "same_segment": F.when(before["seq"].isNotNull(), F.col("segment") == before["segment"]),
            "dt": F.when(F.col("ts_ms") < before["ts_ms"], 0.0).otherwise((F.col("ts_ms") - before["ts_ms"]) / 1000.0),
            "metres": distance(before["lat"], before["lon"], F.col("lat"), F.col("lon")),
        }
    )


def time_gaps(points: DataFrame) -> DataFrame:
    """Rows track_id, n_gaps, median_gap_s, threshold_s: positive intervals within segments, their median, and the length
    beyond which an interval breaks the track. Tracks without a positive interval have null median and threshold."""
    m = F.col("median_gap_s")
    positive = F.when(F.col("same_segment") & (F.col("dt") > 0), F.col("dt"))
    return (
        with_pairs(points)
        .groupBy("track_id")
        .agg(F.count(positive).alias("n_gaps"), F.median(positive).alias("median_gap_s"))
        .withColumn("threshold_s", F.when(m <= 10, F.greatest(5 * m, F.lit(30.0))).otherwise(F.greatest(3 * m, F.lit(120.0))))
    )


def with_gaps(points: DataFrame) -> DataFrame:
    """with_pairs, and is_gap: the interval within a segment is longer than the track's threshold. One shuffle: the
    median is a window aggregate over the track."""
    whole = Window.partitionBy("track_id")
    positive = F.when(F.col("same_segment") & (F.col("dt") > 0), F.col("dt"))
    m = F.col("median_gap_s")
    return (
        with_pairs(points)
        .withColumn("median_gap_s", F.median(positive).over(whole))
        .withColumn("threshold_s", F.when(m <= 10, F.greatest(5 * m, F.lit(30.0))).otherwise(F.greatest(3 * m, F.lit(120.0))))
        .withColumn("is_gap", F.coalesce(F.col("same_segment") & (F.col("dt") > F.col("threshold_s")), F.lit(False)))
    )


def with_bridges(gapped: DataFrame, on_kmh: float = 1.5, most_kmh: float = 180.0) -> DataFrame:
    """is_bridge: a gap of a sparse track (median interval above 15 s) that was crossed at a moving speed: ``on_kmh``, or the
    column of that name, or more."""
    kmh = F.try_divide("metres", "dt") * 3.6
    on_kmh = F.col("on_kmh") if "on_kmh" in gapped.columns else F.lit(on_kmh)
    return gapped.withColumn("is_bridge", F.coalesce(F.col("is_gap") & (F.col("median_gap_s") > 15) & kmh.between(on_kmh, most_kmh), F.lit(False)))


def with_continuous_segment(gapped: DataFrame) -> DataFrame:
    """cont_segment: 0, 1, ..., one more after each change of segment and each gap."""
    breaks = F.when(~F.coalesce("same_segment", F.lit(True)) | F.col("is_gap"), 1).otherwise(0)
    return gapped.withColumn("cont_segment", F.sum(breaks).over(in_order()).cast("int"))


def continuous_segments(points: DataFrame) -> DataFrame:
    """Rows track_id, cont_segment, first_seq, last_seq, n_points, duration_s (first to last known time)."""
    return (
        with_continuous_segment(with_gaps(points))
        .groupBy("track_id", "cont_segment")
        .agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n_points"), ((F.max("ts_ms") - F.min("ts_ms")) / 1000.0).alias("duration_s"))
    )


def elapsed(points: DataFrame) -> DataFrame:
    """Rows track_id, total_s, has_breaks: the sum over spans of one segment of last minus first known time."""
    span = F.sum(F.when(~F.coalesce("same_segment", F.lit(True)), 1).otherwise(0)).over(in_order())
    return (
        with_pairs(points)
        .withColumn("span", span)
        .groupBy("track_id", "span")
        .agg((F.max_by("ts_ms", F.when(F.col("ts_ms").isNotNull(), F.col("seq"))) - F.min_by("ts_ms", F.when(F.col("ts_ms").isNotNull(), F.col("seq")))).alias("ms"))
        .groupBy("track_id")
        .agg((F.sum(F.greatest(F.lit(0), "ms")) / 1000.0).alias("total_s"), (F.count("*") > 1).alias("has_breaks"))
    )


def sampling(points: DataFrame) -> DataFrame:
    """Rows track_id, n_points, n_timed, n_intervals, nominal_s, longest_s, mode: dense (nominal interval up to 2 s), regular
    (15), smart (60), sparse, or untimed; flag of the last two that have times."""
    positive = F.when(F.col("same_segment") & (F.col("dt") > 0), F.col("dt"))
    m = F.col("nominal_s")
    return (
        with_pairs(points)
        .groupBy("track_id")
        .agg(F.count("*").alias("n_points"), F.count("ts_ms").alias("n_timed"), F.count(positive).alias("n_intervals"), F.median(positive).alias("nominal_s"), F.max(positive).alias("longest_s"))
        .withColumn("mode", F.when(m.isNull(), "untimed").when(m <= 2, "dense").when(m <= 15, "regular").when(m <= 60, "smart").otherwise("sparse"))
        .withColumn("flag", F.when(F.col("mode") == "smart", "sampling_smart_recording").when(F.col("mode") == "sparse", "sampling_sparse"))
    )


def span_metres(points: DataFrame) -> DataFrame:
    """Rows track_id, min and max coordinates, span_m: the longer of the north-south and east-west extents through the middle."""
    mid_lat, mid_lon = (F.col("min_lat") + F.col("max_lat")) / 2, (F.col("min_lon") + F.col("max_lon")) / 2
    return (
        points.groupBy("track_id")
        .agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))
        .withColumn("span_m", F.greatest(distance(F.col("min_lat"), mid_lon, F.col("max_lat"), mid_lon), distance(mid_lat, F.col("min_lon"), mid_lat, F.col("max_lon"))))
    )


def with_jitter(gapped: DataFrame, most_kmh: float = 0.9, radius_m: float = 5.0) -> DataFrame:
    """is_jitter: a pair slower than ``most_kmh`` that stays within ``radius_m`` of an anchor, unless the column
    is_slow_progress, where there is one, is true. The anchor is the last point that wasn't jitter; a segment change or gap
    sets it anew.

    Only pairs that are slow enough can be jitter, so the anchor is carried through stretches of these alone. A task reads
    its tracks one after another in batches, so it holds a batch and one anchor, and its time grows with its rows, however
    many stretches they fall into.
    """
    slow = F.coalesce("same_segment", F.lit(False)) & ~F.col("is_gap") & (F.col("dt") > 0) & (F.col("metres") > 0) & (F.try_divide("metres", "dt") * 3.6 <= most_kmh)
    if "is_slow_progress" in gapped.columns:
        slow = slow & ~F.coalesce("is_slow_progress", F.lit(False))
    rows = gapped.withColumn("_slow", F.coalesce(slow, F.lit(False)))
    names = list(gapped.columns)
    schema = StructType([*gapped.schema.fields, StructField("is_jitter", BooleanType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = None  # a pair that isn't slow, as the first of each track, sets it
        for batch in batches:
            flags = []
            for lat, lon, slow in zip(*(batch.column(c).to_pylist() for c in ("lat", "lon", "_slow")), strict=True):
                here = Place(lat, lon)
                flags.append(slow and metres(anchor, here) <= radius_m)
                anchor = anchor if flags[-1] else here
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(flags, pa.bool_())], [*names, "is_jitter"])

    ship(gapped.sparkSession)
    return rows.repartition("track_id").sortWithinPartitions("track_id", "seq").mapInArrow(fold, schema)


def with_route_jitter(jittered: DataFrame) -> DataFrame:
    """is_route_jitter: jitter in runs of 25 pairs or more, in continuous segments that are all jitter, and in those of 8
    pairs or more that are two fifths jitter and span 25 m at most."""
    rows = with_continuous_segment(jittered)
    whole = Window.partitionBy("track_id", "cont_segment")
    run = F.sum(F.when(F.col("is_jitter"), 0).otherwise(1)).over(in_order())
    rows = rows.withColumn("run", run).withColumns(
        {
            "run_pairs": F.sum(F.col("is_jitter").cast("int")).over(Window.partitionBy("track_id", "run")),
            "pairs": F.count("*").over(whole) - 1,
            "shaken": F.sum(F.col("is_jitter").cast("int")).over(whole),
            **{f"{f.__name__}_{c}": f(c).over(whole) for f in (F.min, F.max) for c in ("lat", "lon")},
        }
    )
    mid_lat, mid_lon = (F.col("min_lat") + F.col("max_lat")) / 2, (F.col("min_lon") + F.col("max_lon")) / 2
    span = F.greatest(distance(F.col("min_lat"), mid_lon, F.col("max_lat"), mid_lon), distance(mid_lat, F.col("min_lon"), mid_lat, F.col("max_lon")))
    flag = F.col("is_jitter") & ((F.col("run_pairs") >= 25) | ((F.col("pairs") > 0) & (F.col("shaken") == F.col("pairs"))) | ((F.col("pairs") >= 8) & (F.col("shaken") >= 0.4 * F.col("pairs")) & (span <= 25)))
    return rows.withColumn("is_route_jitter", flag).drop("run", "run_pairs", "pairs", "shaken", "min_lat", "max_lat", "min_lon", "max_lon")
