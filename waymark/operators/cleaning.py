"""Removal of points that can't be right. Each rule compares a point with the last one kept."""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from waymark import ship
from waymark.functions.geo import bearing, distance, turn, valid
from waymark.functions.rules import reasons
from waymark.functions.stats import half_up
from waymark.operators.continuity import in_order, with_pairs

#: What the rules look at in a row.
Judged = namedtuple("Judged", ("track_id", "lat", "lon", "ts_ms", "segment", "rejected", "ceiling_mps", "inferred"))

#: Speeds in m/s above which a profile's jump is impossible.
CEILINGS = {"slow": 6.0, "moderate": 10.0, "fast": 25.0, "unrestricted": 50.0, "unknown": 50.0}


def with_fix_quality(points: DataFrame) -> DataFrame:
    """rejected and warned, from whichever of satellites, pdop, hdop, vdop and fix the table has."""
    has = set(points.columns)
    bad, weak = [], []
    if "fix" in has:
        bad.append(F.lower(F.trim("fix")).isin("none", "unknown"))
    if "satellites" in has:
        bad.append(F.col("satellites") < 3)
        weak.append(F.col("satellites") < 4)
    if "hdop" in has:
        weak.append(F.col("hdop") > 5)
    bad += [F.col(c) > most for c, most in (("pdop", 6), ("hdop", 8), ("vdop", 8)) if c in has]
    any_of = lambda tests: F.coalesce(F.array_contains(F.array(*(F.coalesce(t, F.lit(False)) for t in tests)), True), F.lit(False)) if tests else F.lit(False)
    return points.withColumns({"rejected": any_of(bad), "warned": any_of(weak)})


def motion_profile(points: DataFrame) -> DataFrame:
    """Rows track_id, n, median_mps, p75_mps, p90_mps (lower rank), slow_share, moderate_share, fast_share (of speeds above
    these ceilings), profile, profile_source, confidence, ceiling_mps, from the speeds of raw pairs within 0.3 to 50 m/s.
    Signals are rounded to two digits before they are compared; fewer than five speeds are unknown.

    Points may have explicit_profile: one that isn't blank is taken in place of the speeds' profile (unknown if no profile
    has that name), also for tracks without any such speed, whose numbers are null."""
    mps = F.try_divide("metres", "dt")
    speeds = with_pairs(points.filter(valid(F.col("lat"), F.col("lon")))).filter("same_segment and dt > 0").select("track_id", mps.alias("v")).filter("v between 0.3 and 50")
    shares = [half_up(F.avg((F.col("v") > CEILINGS[k]).cast("int")), 2).alias(f"{k}_share") for k in ("slow", "moderate", "fast")]
    rows = speeds.groupBy("track_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("v")).alias("v"), *shares)
    ranks = (("median_mps", 0.5), ("p75_mps", 0.75), ("p90_mps", 0.9))
    rows = rows.select("track_id", "n", *(half_up(F.get("v", F.floor((F.col("n") - 1) * p).cast("int")), 2).alias(name) for name, p in ranks), "slow_share", "moderate_share", "fast_share")

    def within(kind: str, median: float, p75: float) -> Column:
        return (F.col("median_mps") <= median) & (F.col("p75_mps") <= p75) & (F.col(f"{kind}_share") <= 0.25)

    slow, moderate, fast = within("slow", 2.2, 3.2), within("moderate", 4.5, 7.5), within("fast", 12, 20)
    profile = F.when(F.col("n") < 5, "unknown").when(slow, "slow").when(moderate, "moderate").when(fast, "fast").otherwise("unknown")
    rows = rows.withColumn("profile", profile)
    asked = F.lit(None).cast("string")
    if "explicit_profile" in points.columns:
        rows = rows.join(points.groupBy("track_id").agg(F.max(F.when(F.trim("explicit_profile") != "", F.col("explicit_profile"))).alias("_asked")).filter("_asked is not null"), "track_id", "full")
        asked = F.col("_asked")
    known = F.when(asked.isin(*CEILINGS), asked).when(asked.isNotNull(), "unknown")
    inferred = F.col("profile") != "unknown"
    return rows.withColumns(
        {
            "profile_source": F.when(known.isNotNull(), "explicit").when(inferred, "inferred").otherwise("default"),
            "confidence": F.when(F.coalesce(known, "profile") != "unknown", "high").otherwise("low"),
            "profile": F.coalesce(known, "profile"),
        }
    ).withColumn("ceiling_mps", F.create_map(*(F.lit(x) for kv in CEILINGS.items() for x in kv))[F.col("profile")]).drop("_asked")


def time_order(points: DataFrame) -> DataFrame:
    """The points without those whose time isn't later than every earlier time of their segment."""
    earlier = F.max("ts_ms").over(Window.partitionBy("track_id", "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return points.withColumn("_earlier", earlier).filter("_earlier is null or ts_ms is null or ts_ms > _earlier").drop("_earlier")


def without_duplicates(points: DataFrame) -> DataFrame:
    """The points without those that have place and time of the point before, segments aside; two missing times are equal."""
    same = F.lit(True)
    for c in ("lat", "lon", "ts_ms"):
        same = same & F.col(c).eqNullSafe(F.lag(c).over(in_order()))
    return points.withColumn("_same", same & F.lag("seq").over(in_order()).isNotNull()).filter("not _same").drop("_same")


def turn_angles(points: DataFrame) -> DataFrame:
    """Rows track_id, seq, turn_deg: the change of bearing at each point between two others."""
    b = bearing(F.lag("lat").over(in_order()), F.lag("lon").over(in_order()), F.col("lat"), F.col("lon"))
    return (
        points.withColumn("_in", b)
        .withColumn("_out", F.lead("_in").over(in_order()))
        .filter("_in is not null and _out is not null")
        .select("track_id", "seq", turn(F.col("_in"), F.col("_out")).alias("turn_deg"))
    )


def heading_flips(points: DataFrame) -> DataFrame:
    """The points with is_flip: there and back within 5 s a leg, 5 to 10 m each, 5 m apart at most, by 120 degrees or more."""
    lat, lon, ts, seg = (F.col(c) for c in ("lat", "lon", "ts_ms", "segment"))
    a = {c: F.lag(c).over(in_order()) for c in ("lat", "lon", "ts_ms", "segment")}
    b = {c: F.lead(c).over(in_order()) for c in ("lat", "lon", "ts_ms", "segment")}
    leg = lambda dt, m: (dt > 0) & (dt <= 5000) & m.between(5, 10)
    flip = (
        (a["segment"] == seg) & (b["segment"] == seg)
        & leg(ts - a["ts_ms"], distance(a["lat"], a["lon"], lat, lon)) & leg(b["ts_ms"] - ts, distance(lat, lon, b["lat"], b["lon"]))
        & (distance(a["lat"], a["lon"], b["lat"], b["lon"]) <= 5)
        & (turn(bearing(a["lat"], a["lon"], lat, lon), bearing(lat, lon, b["lat"], b["lon"])) >= 120)
    )
    return points.withColumn("is_flip", F.coalesce(flip, F.lit(False)))


def clean(points: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """The points with reason: null for those kept, else the first rule that drops them, in this order: coordinates out of
    range, a rejected fix, a lone point at 0, 0 over 100 km off, a repeat, a time not after the last, a flip of heading, a
    speed above the track's ceiling. Previous means the last point kept, next the next row. Tracks on which no rule can
    fire against the row before pass by without the fold, which holds one track's rows in memory; both kinds go through one
    pass. profiles: motion_profile's rows, where they are known."""
    ship(points.sparkSession)
    quality = with_fix_quality(points)
    profile = (motion_profile(points) if profiles is None else profiles).select("track_id", "ceiling_mps", (F.col("profile_source") == "inferred").alias("inferred"))
    rows = heading_flips(with_pairs(quality)).join(profile, "track_id", "left").withColumn("ceiling_mps", F.coalesce("ceiling_mps", F.lit(50.0)))
    suspicious = (
        ~valid(F.col("lat"), F.col("lon")) | F.col("rejected") | F.col("is_flip") | ((F.abs("lat") <= 1e-6) & (F.abs("lon") <= 1e-6))
        | ((F.col("metres") == 0) & F.col("ts_ms").eqNullSafe(F.lag("ts_ms").over(in_order()))) | (F.col("same_segment") & (F.col("dt") <= 0)) | (F.try_divide(F.col("metres"), F.when(F.col("dt") > 0, F.col("dt"))) > F.col("ceiling_mps"))
    )
    rows = rows.withColumn("_check", F.max(F.coalesce(suspicious, F.lit(False))).over(Window.partitionBy("track_id")))
    rows = rows.withColumn("_begins", F.lag("seq").over(in_order()).isNull())
    keep = points.columns
    schema = StructType([*points.schema.fields, StructField("reason", StringType())])
    # the windows have brought each track together and in order
    ordered = rows.select(*keep, "rejected", "ceiling_mps", "inferred", "_check", "_begins").sortWithinPartitions("track_id", "seq")
    return ordered.mapInArrow(lambda batches: judged(batches, keep), schema)


def judged(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """A task's sorted rows with their reasons, as many batches at a time as the track at the end of one reaches over."""
    held: list[pa.RecordBatch] = []  # rows of the track that goes on
    for batch in batches:
        starts = np.flatnonzero(batch.column("_begins").to_numpy(zero_copy_only=False))
        if len(starts):
            yield from _with_reasons([*held, batch.slice(0, int(starts[-1]))], keep)
            held, batch = [], batch.slice(int(starts[-1]))
        held.append(batch)
    yield from _with_reasons(held, keep)


def _with_reasons(batches: list[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole tracks, in order, with their reasons."""
    table = pa.Table.from_batches(batches).combine_chunks() if batches else None
    if table is None or not table.num_rows:
        return
    found: list[str | None] = [None] * table.num_rows
    bounds = [*np.flatnonzero(table.column("_begins").to_numpy()).tolist(), table.num_rows]
    check = table.column("_check").to_numpy()
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        if check[lo]:
            columns = (table.column(c).slice(lo, hi - lo).to_pylist() for c in Judged._fields)
            track = (Judged(*x) for x in zip(*columns, strict=True))
            found[lo:hi] = reasons([p if p.segment is not None else p._replace(segment=math.nan) for p in track])
    yield from table.select(keep).append_column("reason", pa.array(found, pa.string())).combine_chunks().to_batches()


def cleaning_summary(cleaned: DataFrame) -> DataFrame:
    """Rows track_id, points_in, points_out, reasons (counts by reason as a sorted array)."""
    by_reason = cleaned.groupBy("track_id", "reason").agg(F.count("*").alias("n"))
    return by_reason.groupBy("track_id").agg(
        F.sum("n").alias("points_in"),
        F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).alias("points_out"),
        F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))).alias("reasons"),
    )
