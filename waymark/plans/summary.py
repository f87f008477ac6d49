"""The whole analysis of many tracks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import checkpointed
from waymark.operators import cleaning, continuity, diagnostics, elevation, moving, series


def track_summary(points: DataFrame) -> DataFrame:
    """Rows track_id, n_points, total_distance_m, total_s, average_kmh, max_kmh (of reliable samples), nominal_s, mode."""
    distance = series.distance_series(points).groupBy("track_id").agg(F.count("*").alias("n_points"), F.sum("route_m").alias("total_distance_m"))
    fastest = series.reliable_speed(series.raw_speed(points)).groupBy("track_id").agg(F.max("kmh").alias("max_kmh"))
    return (
        distance.join(continuity.elapsed(points).select("track_id", "total_s"), "track_id")
        .join(continuity.sampling(points).select("track_id", "nominal_s", "mode"), "track_id")
        .join(fastest, "track_id", "left")
        .withColumn("average_kmh", F.when(F.col("total_s") > 0, F.col("total_distance_m") / F.col("total_s") * 3.6))
    )


def with_thresholds(points: DataFrame, raw: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Cleaned points with their pairs and gaps, their track's cleaning_profile (of the raw points, or profiles), the speeds at which it
    moves and stops, and is_slow_progress for the walking profiles."""
    table = moving.THRESHOLDS
    kind = F.when((F.col("cleaning_profile") == "slow") & (F.col("profile_source") == "inferred"), "inferred_slow").otherwise(F.col("cleaning_profile"))
    pick = lambda j: F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v[j])))[kind]
    profiles = (cleaning.motion_profile(raw) if profiles is None else profiles).select("track_id", F.col("profile").alias("cleaning_profile"), "profile_source")
    rows = continuity.with_gaps(points).join(profiles, "track_id", "left").withColumn("cleaning_profile", F.coalesce("cleaning_profile", F.lit("unknown")))
    rows = rows.withColumns({"on_kmh": pick(0), "off_kmh": pick(1), "to_ms": F.col("ts_ms")}).drop("profile_source")
    walking = rows.filter("on_kmh <= 1.5 and off_kmh <= 0.8").select(*points.columns)
    creeps = diagnostics.slow_progress(walking).select("track_id", "seq", F.lit(True).alias("is_slow_progress"))
    return rows.join(creeps, ["track_id", "seq"], "left").withColumn("is_slow_progress", F.coalesce("is_slow_progress", F.lit(False)))


def motion(speeds: DataFrame, points: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Rows track_id, moving_s, moving_m, moving_source: by the timer where events (track_id, ts_ms, action) have a start or
    a stop, also if it ran for no time; else by the speeds."""
    by_speed = moving.moving_time(speeds).withColumn("moving_source", F.lit("hysteresis"))
    if events is None:
        return by_speed
    usable = events.filter("action in ('start', 'stop') and ts_ms is not null").join(points.filter("ts_ms is not null").select("track_id").distinct(), "track_id", "left_semi")
    spans = continuity.with_continuous_segment(points).filter("ts_ms is not null").groupBy("track_id", "cont_segment").agg(F.min("ts_ms").alias("lo_ms"), F.max("ts_ms").alias("hi_ms"))
    running = moving.clip_intervals(moving.timer_intervals(points, usable), spans)
    seconds = running.groupBy("track_id").agg((F.sum(F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("timer_s"))
    samples = speeds.select("track_id", (F.col("to_ms") - F.round(F.col("dt") * 1000)).cast("long").alias("from_ms"), "to_ms", "metres")
    metres = moving.distance_in_intervals(samples, running).select("track_id", F.col("metres").alias("timer_m"))
    timed = usable.select("track_id").distinct().join(seconds, "track_id", "left").join(metres, "track_id", "left")
    timed = timed.select("track_id", F.coalesce("timer_s", F.lit(0.0)).alias("timer_s"), F.coalesce("timer_m", F.lit(0.0)).alias("timer_m"))
    both = by_speed.join(timed, "track_id", "full")
    has = F.col("timer_s").isNotNull()
    return both.select(
        "track_id", F.when(has, F.col("timer_s")).otherwise(F.col("moving_s")).alias("moving_s"), F.when(has, F.col("timer_m")).otherwise(F.col("moving_m")).alias("moving_m"),
        F.when(has, "timer_events").otherwise("hysteresis").alias("moving_source"),
    )


def analyse(points: DataFrame, events: DataFrame | None = None) -> dict[str, DataFrame]:
    """Cleaned points, speeds, slopes, splits, elevation samples and a summary with motion and elevation, by name, besides all
    points with the reason that drops them (cleaned) and the repaired elevation runs (raw_runs); events are those of the tracks' timers (track_id, ts_ms, action), if any.

    Points may have explicit_profile (for cleaning and thresholds of motion) and explicit_reliability (for the ceiling of
    speeds), the profiles that a caller asks for, and explicit_kind, a stated activity. Points have their gaps, slow progress and jitter; jitter counts for no distance. What several results read (points,
    speeds, profiles, runs, trust in sources, samples) is checkpointed, partitioned by track: nothing stays in memory. A track's windows run
    in one task, so the longest track sets the least time.
    """
    profiles = checkpointed(cleaning.motion_profile(points))
    marked = checkpointed(cleaning.clean(points, profiles))
    cleaned = marked.filter("reason is null").drop("reason")
    base = checkpointed(continuity.with_route_jitter(continuity.with_jitter(checkpointed(with_thresholds(cleaned, points, profiles)))).repartition("track_id"))
    judged = checkpointed(series.with_reliability(series.raw_speed(base)))
    above = F.col("ceiling_kmh").isNotNull() & (F.col("kmh") > F.col("ceiling_kmh"))
    speeds = series.smoothed(judged.filter(~above).drop("n", "p10", "p25", "p50", "rejected_share", "slow_speeds", "profile", "profile_source", "ceiling_kmh"))
    raw_runs = checkpointed(elevation.runs(base))
    settings = checkpointed(elevation.defaults(base, checkpointed(elevation.source_trust(base, raw_runs))))
    fixed = checkpointed(elevation.repaired(base, raw_runs))
    samples = checkpointed(elevation.profile(base, settings, fixed))
    turns = elevation.confirmed_turns(samples, F.col("base_m"), F.col("alpha"), F.col("sustain_m"))
    extrema = elevation.limited_extrema(samples, raw_runs, elevation.supported_turns(turns, raw_runs, settings.select("track_id", "sustain_m")))
    used = judged.groupBy("track_id").agg(
        F.max(F.when(~above, F.col("kmh"))).alias("max_kmh"), F.sum(F.when(~above, F.col("metres"))).alias("reliable_m"),
        F.count(F.when(above, 1)).alias("n_outliers"), F.first("profile").alias("reliability_profile"),
    )
    rows = (
        series.distance_series(base).groupBy("track_id").agg(F.count("*").alias("n_points"), F.sum("route_m").alias("total_distance_m"), F.sum(F.col("is_route_jitter").cast("int")).alias("n_route_jitter"))
        .join(continuity.elapsed(base).select("track_id", "total_s"), "track_id")
        .join(continuity.sampling(base).select("track_id", "nominal_s", "mode"), "track_id")
        .join(used, "track_id", "left").join(motion(speeds, base, events), "track_id", "left")
        .join(elevation.climbs(samples), "track_id", "left").join(extrema, "track_id", "left")
        .withColumn("n_outliers", F.coalesce("n_outliers", F.lit(0)))
    )
    filtered = F.col("n_outliers") > 0
    way = F.when(filtered, F.when(F.col("reliable_m") > 0, F.col("reliable_m"))).otherwise(F.col("total_distance_m"))
    moved = F.when((F.col("moving_source") == "timer_events") | filtered, F.coalesce("moving_m", way)).otherwise(way)
    total = rows.withColumns(
        {
            "average_kmh": F.when(F.col("total_s") > 0, way / F.col("total_s") * 3.6),
            "moving_kmh": F.when((F.col("moving_s") > 0) & (moved > 0), moved / F.col("moving_s") * 3.6),
            "stopped_s": F.greatest(F.lit(0.0), F.col("total_s") - F.coalesce("moving_s", F.lit(0.0))),
        }
    ).drop("reliable_m")
    return {"points": base, "speeds": speeds, "slopes": series.slopes(base), "splits": series.splits(base, samples=speeds), "elevation": samples, "summary": total, "cleaned": marked, "raw_runs": fixed}
