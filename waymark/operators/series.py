"""Distance, speed and slope along a track, and its splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.stats import half_up
from waymark.operators.continuity import in_order, with_bridges, with_gaps

#: Speeds in m/s above which a sample isn't reliable.
RELIABLE = {"slow": 6.0, "moderate": 10.0, "fast": 25.0}
#: The profiles that a caller may ask for.
PROFILES = ("slow", "moderate", "fast", "unrestricted", "unknown")
#: Columns of points that their speed samples keep: a track's profiles and thresholds, slow progress, and the pair's end.
CARRIED = ("cleaning_profile", "explicit_reliability", "on_kmh", "off_kmh", "is_slow_progress", "to_ms")


def _route(points: DataFrame) -> DataFrame:
    """with_gaps, and route_m: the pair's metres, 0 across segments and in route jitter where that is known."""
    rows = points if "is_gap" in points.columns else with_gaps(points)
    counts = F.coalesce("same_segment", F.lit(False))
    if "is_route_jitter" in rows.columns:
        counts = counts & ~F.col("is_route_jitter")
    return rows.withColumn("route_m", F.when(counts, F.col("metres")).otherwise(0.0))


def distance_series(points: DataFrame) -> DataFrame:
    """Every point with distance_m from the start and span (one more after each change of segment). Gaps count."""
    rows = _route(points)
    return rows.withColumns(
        {
            "distance_m": F.sum("route_m").over(in_order().rowsBetween(Window.unboundedPreceding, 0)),
            "span": F.sum(F.when(~F.coalesce("same_segment", F.lit(True)), 1).otherwise(0)).over(in_order().rowsBetween(Window.unboundedPreceding, 0)).cast("int"),
        }
    )


def distance_3d(points: DataFrame) -> DataFrame:
    """Rows track_id, distance_2d_m, distance_3d_m: null where a pair within a segment lacks an elevation or none is there."""
    rise = F.col("ele") - F.lag("ele").over(in_order())
    rows = _route(points).withColumn("rise", rise)
    pair = F.col("same_segment")
    return rows.groupBy("track_id").agg(
        F.sum("route_m").alias("distance_2d_m"),
        F.when(F.coalesce(F.bool_or(pair & F.col("rise").isNull()), F.lit(False)), None).otherwise(F.sum(F.when(pair, F.sqrt(F.pow("route_m", 2) + F.pow("rise", 2))))).alias("distance_3d_m"),
    )


def raw_speed(points: DataFrame) -> DataFrame:
    """Rows track_id, seq, distance_m, metres, dt, kmh of pairs in a segment with time between them, gaps left out unless
    they are bridges; and those of CARRIED that the points have."""
    rows = with_bridges(distance_series(points))
    carried = [c for c in CARRIED if c in points.columns]
    return rows.filter("same_segment and dt > 0 and (not is_gap or is_bridge)").select("track_id", "seq", "distance_m", F.col("route_m").alias("metres"), "dt", (F.try_divide("route_m", "dt") * 3.6).alias("kmh"), *carried)


def with_reliability(speeds: DataFrame) -> DataFrame:
    """The samples with their track's n, p10, p25 (lower rank), p50 (median; km/h, of two digits before they are compared),
    rejected_share, slow_speeds, profile, profile_source and ceiling_kmh (null: none). A known profile in the column
    explicit_reliability wins. Else the distribution's counts where it is stricter than the cleaning profile, which is the
    column cleaning_profile where the samples have one; unknown and unrestricted have no ceiling. Ranks come from one order of the speeds, so that a sample
    costs the same however long its track is."""
    whole = Window.partitionBy("track_id")
    by_speed = Window.partitionBy("track_id").orderBy("kmh", "seq")
    rows = speeds.withColumn("_rank", F.row_number().over(by_speed)).withColumn("n", F.count("*").over(whole))
    at = lambda p: F.max(F.when(F.col("_rank") == F.floor((F.col("n") - 1) * p) + 1, F.col("kmh"))).over(whole)
    upper = F.max(F.when(F.col("_rank") == F.floor(F.col("n") / 2) + 1, F.col("kmh"))).over(whole)
    middle = F.when(F.col("n") % 2 == 1, upper).otherwise((at(0.5) + upper) / 2)
    rows = rows.withColumns({"p10": half_up(at(0.1), 2), "p25": half_up(at(0.25), 2), "p50": half_up(middle, 2), "rejected_share": F.avg((F.col("kmh") > RELIABLE["slow"] * 3.6).cast("int")).over(whole)})
    rows = rows.withColumn("slow_speeds", (F.col("n") >= 8) & (F.col("p10") <= 5) & (F.col("p25") <= 8) & (F.col("p50") <= 24))
    slow, moderate = F.col("slow_speeds") & (F.col("rejected_share") <= 0.5), (F.col("n") >= 8) & (F.col("p25") <= 15) & (F.col("p50") <= 30)
    ranks = F.create_map(*(F.lit(x) for kv in {"slow": 0, "moderate": 1, "fast": 2}.items() for x in kv))
    cleaning = F.coalesce("cleaning_profile", F.lit("unknown")) if "cleaning_profile" in speeds.columns else F.lit("unknown")
    rank = F.coalesce(F.try_element_at(ranks, cleaning), F.lit(3))
    stated = F.when(F.col("explicit_reliability").isin(*PROFILES), F.col("explicit_reliability")) if "explicit_reliability" in speeds.columns else F.lit(None).cast("string")
    found = F.when(slow & (rank > 0), "slow").when(moderate & ~slow & (rank > 1), "moderate")
    profile = F.coalesce(stated, found, cleaning)
    source = F.when(stated.isNotNull(), "explicit").when(found.isNotNull(), "speed_distribution").otherwise("cleaning_profile" if "cleaning_profile" in speeds.columns else "default")
    kmh = F.create_map(*(x for k, v in RELIABLE.items() for x in (F.lit(k), F.lit(v * 3.6))))
    return rows.withColumns({"profile": profile, "profile_source": source}).withColumn("ceiling_kmh", F.try_element_at(kmh, "profile")).drop("_rank")


def reliability(speeds: DataFrame) -> DataFrame:
    """Rows track_id, n, p10, p25, p50, rejected_share, profile, profile_source, ceiling_kmh, n_outliers (samples above the ceiling),
    warning (slow_rejected_share_too_high: slow but for too many fast samples)."""
    first = ("n", "p10", "p25", "p50", "rejected_share", "profile", "profile_source", "ceiling_kmh")
    rows = with_reliability(speeds).groupBy("track_id").agg(*(F.first(c).alias(c) for c in first), F.count(F.when(F.col("kmh") > F.col("ceiling_kmh"), 1)).alias("n_outliers"), F.first("slow_speeds").alias("slow"))
    warning = F.when(F.col("slow") & (F.col("rejected_share") > 0.5), "slow_rejected_share_too_high")
    return rows.withColumn("warning", warning).drop("slow")


def outlier_details(judged: DataFrame, most: int = 50) -> DataFrame:
    """Rows track_id, k, seq, kmh, dt, metres, start_m, distance_m, n_outliers: of with_reliability's samples above the
    ceiling, each track's first ``most`` in order, and how many there are. The limit on the row number is applied in every
    partition before the exchange and again after it, and counts are made apart, so no track's outliers meet."""
    above = judged.filter("ceiling_kmh is not null and kmh > ceiling_kmh")
    counts = above.groupBy("track_id").agg(F.count("*").alias("n_outliers"))
    first = above.withColumn("k", F.row_number().over(in_order())).filter(F.col("k") <= most)
    return first.select("track_id", "k", "seq", "kmh", "dt", "metres", (F.col("distance_m") - F.col("metres")).alias("start_m"), "distance_m").join(counts, "track_id")


def reliable_speed(speeds: DataFrame) -> DataFrame:
    """The samples at or below their track's ceiling, with smooth_kmh: the mean of five samples around each, by order."""
    return smoothed(with_reliability(speeds).filter("ceiling_kmh is null or kmh <= ceiling_kmh").select(*speeds.columns))


def smoothed(kept: DataFrame) -> DataFrame:
    return kept.withColumn("smooth_kmh", F.avg("kmh").over(in_order().rowsBetween(-2, 2)))


def slopes(points: DataFrame) -> DataFrame:
    """Rows track_id, seq, slope_pct of every point but a track's first: the rise from the last point of the span at least
    100 m behind, or the span's first, in percent of the way; 0 if there is no way; null if an elevation is missing."""
    rows = distance_series(points)
    point = F.struct("seq", "ele", "distance_m")
    # the latest row within range, ties included: the greatest seq at 100 m or more behind
    behind = F.expr("max(struct(seq, ele, distance_m)) OVER (PARTITION BY track_id, span ORDER BY distance_m RANGE BETWEEN UNBOUNDED PRECEDING AND 100 PRECEDING)")
    first = F.min(point).over(Window.partitionBy("track_id", "span"))
    rows = rows.withColumn("back", F.coalesce(behind, first)).withColumn("start", F.min("seq").over(Window.partitionBy("track_id")))
    way = F.col("distance_m") - F.col("back.distance_m")
    slope = F.when(F.col("ele").isNull() | F.col("back.ele").isNull(), None).when(way <= 0, 0.0).otherwise(F.try_divide(F.col("ele") - F.col("back.ele"), way) * 100)
    return rows.filter("seq > start").select("track_id", "seq", slope.alias("slope_pct"))


def splits(points: DataFrame, length_m: float = 5000.0, samples: DataFrame | None = None) -> DataFrame:
    """Rows track_id, split, metres, seconds, kmh of stretches of ``length_m``: samples (raw_speed's, or those given) that
    cross a border are shared out by length. Each sample is exploded into the splits it touches: no range join."""
    samples = (raw_speed(points) if samples is None else samples).filter("metres > 0").withColumn("from_m", F.col("distance_m") - F.col("metres"))
    touched = F.sequence(F.floor(F.col("from_m") / length_m), F.greatest(F.floor(F.col("from_m") / length_m), F.ceil(F.col("distance_m") / length_m) - 1))
    part = samples.withColumn("split", F.explode(touched))
    share = (F.least(F.col("distance_m"), (F.col("split") + 1) * length_m) - F.greatest(F.col("from_m"), F.col("split") * length_m)) / F.col("metres")
    return (
        part.withColumn("share", share)
        .filter("share > 0")
        .groupBy("track_id", "split")
        .agg(F.sum(F.col("metres") * F.col("share")).alias("metres"), F.sum(F.col("dt") * F.col("share")).alias("seconds"))
        .withColumn("kmh", F.try_divide("metres", "seconds") * 3.6)
    )


def nearest_sample(series: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query (track_id, at_m) the sample of series (track_id, seq, distance_m) nearest in distance; of two as near
    the one before. A backward and a forward as-of look-up over one ordered union."""
    marks = series.select("track_id", F.col("distance_m").alias("d"), "seq", F.lit(0).alias("is_query")).union(queries.select("track_id", F.col("at_m").cast("double"), F.lit(None).cast("int"), F.lit(1)))
    order = Window.partitionBy("track_id").orderBy("d", "is_query", "seq")
    sample = F.when(F.col("is_query") == 0, F.struct("d", "seq"))
    marks = marks.withColumns(
        {
            "before": F.last(sample, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "after": F.first(sample, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).filter("is_query = 1")
    use_after = F.col("before").isNull() | (F.col("after.d") - F.col("d") < F.col("d") - F.col("before.d"))
    return marks.select("track_id", F.col("d").alias("at_m"), F.when(F.coalesce(use_after, F.lit(False)), F.col("after")).otherwise(F.col("before")).alias("s")).select("track_id", "at_m", "s.seq", F.col("s.d").alias("distance_m"))
