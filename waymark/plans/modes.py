"""All analysis modes of many tracks in one plan, what an analysis says about itself, and its audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import checkpointed
from waymark.functions import values
from waymark.operators import cleaning, continuity, elevation
from waymark.operators.continuity import in_order
from waymark.operators.diagnostics import MODES
from waymark.plans.summary import analyse
from waymark.sources.files import STATED, apply_terrain, stated_summary

# Names of modes, flags, filters and audit items.
FILTERED, RAW, TERRAIN, IMPORTED = MODES
#: The name under which older callers ask for the filtered mode.
OLD_FILTERED = "recomputed_basecamp"
MOVING_FILTERS, MOVING_FLAGS = ("moving_time_hysteresis", "moving_time_timer_events"), ("moving_time_heuristic", "moving_time_timer_events")
#: Columns of the facts that an audit takes.
FACTS = {
    "points_in": "long", "points_out": "long", "n_time_gaps": "long", "n_jitter": "long", "elevation_source": "string", "threshold_m": "double", "p95_m": "double", "on_kmh": "double",
    "recording_mode": "string", "nominal_s": "double", "time_zone": "string",
}


def normal_mode(mode: Column) -> Column:
    return F.when(mode == OLD_FILTERED, FILTERED).otherwise(mode)


def next_mode(tracks: DataFrame) -> DataFrame:
    """Rows track_id, next_mode from tracks with modes, default_mode (diagnostics.modes), last_mode and last_default_mode: the
    mode used last is kept where it was chosen, not the default, and the track has it; else the track's default."""
    last, was = normal_mode(F.coalesce("last_mode", F.lit(FILTERED))), F.coalesce("last_default_mode", F.lit(FILTERED))
    keeps = (F.coalesce("last_mode", F.lit(FILTERED)) != was) & F.array_contains("modes", last)
    return tracks.select("track_id", F.when(F.coalesce(keeps, F.lit(False)), F.coalesce("last_mode", F.lit(FILTERED))).otherwise(F.col("default_mode")).alias("next_mode"))


def with_unique(values_: Column, test: Column, name: str) -> Column:
    """An array with a name appended where a test holds and it isn't there yet."""
    return F.when(F.coalesce(test, F.lit(False)) & ~F.array_contains(values_, name), F.array_append(values_, name)).otherwise(values_)


def self_description(parts: DataFrame) -> DataFrame:
    """parts with flags and filters: the arrays of cleaning, speed, elevation, moving, temporal and sampling in this order,
    repeats kept, then what segments, gaps and jitter add once. Arrays that parts lacks count as empty."""
    none = F.array().cast("array<string>")
    lists = lambda kind, names: F.flatten(F.array(*(F.coalesce(f"{n}_{kind}", none) if f"{n}_{kind}" in parts.columns else none for n in names)))
    gaps, jitter = F.col("n_time_gaps") > 0, F.col("n_jitter") > 0
    flags = lists("flags", ("cleaning", "speed", "elevation", "moving", "temporal", "sampling"))
    flags = with_unique(with_unique(with_unique(flags, F.col("n_segments") > 1, "segment_breaks_preserved"), gaps, "time_gap_segments_preserved"), jitter, "xy_jitter_suppressed")
    filters = lists("filters", ("cleaning", "speed", "elevation", "moving"))
    return parts.withColumns({"flags": flags, "filters": with_unique(with_unique(filters, gaps, "time_gap_segmentation"), jitter, "xy_jitter_distance_threshold")})


def item(name: str, label: str, kind: str, raw: Column, text: Column) -> Column:
    return F.struct(F.lit(name).alias("id"), F.lit(label).alias("label"), F.lit(kind).alias("value_type"), raw.cast("string").alias("raw_value"), text.alias("value"))


def summary_items(distance: Column, gain: Column, flags: Column, last: Column) -> Column:
    return F.array(item("distance", "Distance", "meters", distance, values.rounded_metres(distance)), item("elevationGain", "Elevation gain", "meters", gain, values.rounded_metres(gain)), *last_two(flags, last))


def last_two(flags: Column, last: Column) -> tuple[Column, Column]:
    count = item("flags", "Flags", "count", F.size(flags), values.rounded_count(F.size(flags).cast("double")))
    return (count, last) if last is not None else (count,)


def audit_stages(facts: DataFrame) -> DataFrame:
    """Rows track_id, mode, audit: seven stages (id, label, status, items of id, label, value_type, raw_value, value) from rows
    track_id, mode, flags, FACTS, total_distance_m, moving_s, gain_m. Items that lack a value say so in their text."""
    count = lambda c: values.rounded_count(F.col(c).cast("double"))
    text = lambda c, other: F.coalesce(F.col(c), F.lit(other))
    changed = lambda test: F.when(F.coalesce(test, F.lit(False)), "changed").otherwise("ok")
    removed = F.col("points_in") - F.col("points_out")
    sweep = F.when(F.col("threshold_m").isNull(), "n/a").otherwise(F.concat(F.lit("median: "), values.rounded_metres(F.col("threshold_m")), F.lit(" / p95: "), values.rounded_metres(F.col("p95_m"))))
    zone = item("timeZone", "Time zone", "timeZoneConfidence", text("time_zone", "unknown"), text("time_zone", "unknown"))
    speed = F.when(F.col("on_kmh").isNull(), "n/a").when(F.col("on_kmh") == F.floor("on_kmh"), F.floor("on_kmh").cast("string")).otherwise(F.col("on_kmh").cast("string"))
    stages = [
        ("input", "Input", F.lit("ok"), F.array(item("inputPoints", "Points", "count", F.col("points_in"), count("points_in")), item("mode", "Mode", "analysisMode", F.col("mode"), F.col("mode")))),
        ("cleaning", "Cleaning", changed(removed > 0), F.array(item("keptPoints", "Points", "keptCount", F.col("points_out"), F.concat(count("points_out"), F.lit(" kept"))), item("removedPoints", "Removed", "count", removed, values.rounded_count(removed.cast("double"))))),
        ("continuity", "Continuity", changed((F.col("n_time_gaps") > 0) | (F.col("n_jitter") > 0)), F.array(item("timeGaps", "Time gaps", "count", F.col("n_time_gaps"), count("n_time_gaps")), item("xyJitter", "XY jitter", "count", F.col("n_jitter"), count("n_jitter")))),
        ("elevation", "Elevation", changed(F.col("threshold_m").isNotNull()), F.array(
            item("elevationSource", "Source", "elevationSource", text("elevation_source", "none"), text("elevation_source", "none")), item("threshold", "Threshold", "meters", F.col("threshold_m"), values.rounded_metres(F.col("threshold_m"))),
            item("thresholdSweep", "Sweep", "thresholdSweep", F.when(F.col("threshold_m").isNotNull(), F.concat_ws("/", F.lit("median"), F.lit("p95"))), sweep))),
        ("movement", "Movement", F.lit("changed"), F.array(item("movingTime", "Moving time", "seconds", F.col("moving_s"), values.rounded_seconds(F.col("moving_s"))), item("startSpeed", "Start speed", "kmh", F.col("on_kmh"), F.concat(speed, F.lit(" km/h"))))),
        ("sampling", "Sampling", F.when(F.col("recording_mode").isin("smart", "sparse"), "warning").otherwise("ok"), F.array(item("recording", "Recording", "recordingMode", text("recording_mode", "unknown"), text("recording_mode", "unknown")), item("interval", "Interval", "seconds", F.col("nominal_s"), values.rounded_seconds(F.col("nominal_s"))))),
        ("summary", "Summary", F.when(F.size("flags") > 0, "warning").otherwise("ok"), summary_items(F.col("total_distance_m"), F.col("gain_m"), F.col("flags"), zone)),
    ]
    return facts.select("track_id", "mode", F.array(*(F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), status.alias("status"), items.alias("items")) for i, label, status, items in stages)).alias("audit"))


def imported_audit(rows: DataFrame) -> DataFrame:
    """The rows (audit, flags of the imported mode, stated_distance_m, stated_gain_m, source_tag) with the audit rewritten for
    a summary that the file states: the input's mode, and the summary's items; other stages stay as they are."""
    mode = item("mode", "Mode", "analysisMode", F.lit(IMPORTED), F.lit(IMPORTED))
    tag = F.coalesce("source_tag", F.lit("unknown"))
    flags = F.col("flags")
    d, g = F.col("stated_distance_m"), F.col("stated_gain_m")
    items = F.array(item("distance", "Distance", "meters", d, values.rounded_metres(d)), item("elevationGain", "Elevation gain", "meters", g, values.rounded_metres(g)), item("source", "Source", "sourceTag", tag, tag), *last_two(flags, None))

    def patched(stage: Column) -> Column:
        other = F.struct(stage["id"].alias("id"), stage["label"].alias("label"), stage["status"].alias("status"), F.transform(stage["items"], lambda x: F.when(x["id"] == "mode", mode).otherwise(x)).alias("items"))
        return F.when(stage["id"] == "summary", F.struct(stage["id"].alias("id"), stage["label"].alias("label"), F.lit("warning").alias("status"), items.alias("items"))).otherwise(other)

    return rows.withColumn("audit", F.transform("audit", patched))


def facts_of(points: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Rows track_id, the summary's columns, n_segments, FACTS but time_zone, and the arrays that self_description joins, of
    analyse's results for points."""
    base, samples, summary = parts["points"], parts["elevation"], parts["summary"]
    taken = points.groupBy("track_id").agg(F.count("*").alias("points_in"), F.countDistinct("segment").alias("n_segments"))
    first = parts["cleaned"].filter("reason is not null").groupBy("track_id", "reason").agg(F.min("seq").alias("k"))
    dropped = first.groupBy("track_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "reason"))), lambda x: x["reason"]).alias("cleaning_filters"))
    named_source = lambda name: F.coalesce(F.bool_or(F.col("ele_source") == name), F.lit(False)) if "ele_source" in base.columns else F.lit(False)
    source = F.when(named_source("barometric"), "barometric").when(named_source("terrain"), "terrain").when(named_source("gpx") | (F.count("ele") > 0), "gpx").otherwise("none")
    starts = F.col("is_jitter") & ~F.coalesce(F.lag("is_jitter").over(in_order()), F.lit(False))
    shape = base.withColumn("_starts", starts).groupBy("track_id").agg(F.sum(F.col("is_gap").cast("long")).alias("n_time_gaps"), F.sum(F.col("_starts").cast("long")).alias("n_jitter"), F.first("on_kmh").alias("on_kmh"), source.alias("elevation_source"))
    thresholds = elevation.selected_thresholds(samples, F.col("base_m"), F.col("alpha")).select("track_id", F.col("median_m").alias("threshold_m"), "p95_m")
    cleaned = samples.groupBy("track_id").agg(F.bool_or((F.col("clean") != F.col("ele")) & ~F.col("is_endpoint_spike")).alias("hampel"), F.bool_or("is_endpoint_spike").alias("late_ends"))
    before = parts["raw_runs"].groupBy("track_id").agg(F.bool_or(F.col("raw_outlier").isin("first", "last")).alias("early_ends"), F.bool_or(F.col("raw_outlier") == "interior").alias("inside"), F.bool_or("is_sparse_tail").alias("tails"))
    sampling = continuity.sampling(base).select("track_id", F.col("flag").alias("_sampling"))
    rows = summary.withColumnRenamed("mode", "recording_mode")
    for more in (taken, dropped, shape, thresholds, cleaned, before, sampling):
        rows = rows.join(more, "track_id", "left")
    named = lambda *pairs: F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for t, n in pairs)))
    timer, has = F.coalesce(F.col("moving_source") == "timer_events", F.lit(False)), F.col("moving_s").isNotNull()
    fusion = named((F.col("threshold_m").isNotNull(), "filtered_extrema_used"), (F.col("hampel"), "hampel_outliers_replaced"), (F.col("late_ends") | F.col("early_ends"), "endpoint_spikes_replaced"), (F.col("inside"), "pre_resample_interior_outliers_replaced"), (F.col("tails"), "pre_resample_sparse_tail_replaced"))
    used = named((F.col("threshold_m").isNotNull(), "distance_domain_fusion"), (F.col("threshold_m").isNotNull(), "confirmed_elevation_turns"))
    return rows.withColumns(
        {
            "points_out": F.col("n_points"), "cleaning_filters": F.coalesce("cleaning_filters", F.array().cast("array<string>")), "speed_filters": named((F.col("n_outliers") > 0, "speed_outlier")),
            "elevation_flags": fusion, "elevation_filters": F.concat(used, fusion), "moving_flags": named((has & ~timer, MOVING_FLAGS[0]), (timer, MOVING_FLAGS[1])),
            "moving_filters": named((~timer, MOVING_FILTERS[0]), (timer, MOVING_FILTERS[1])), "sampling_flags": F.array_compact(F.array("_sampling")), "time_zone": F.lit(None).cast("string"),
        }
    ).drop("_sampling", "hampel", "late_ends", "early_ends", "inside", "tails")


def analyse_modes(points: DataFrame, tracks: DataFrame, terrain: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Rows track_id, mode, is_default, the summary's columns, flags, filters, imported (fields that the file states), audit:
    one for each mode that a track offers.

    tracks: track_id, summary (map of what the file states, or null), and requested, if any: then is_default says which mode
    is used, the requested one where the track offers it. terrain: track_id, seq, terrain_ele. Elevations of the recording and
    of the terrain are two variants under one key, so one analysis, one exchange and the same checkpoints serve all modes; the
    filtered and the raw mode share a variant, and an imported summary is laid over the filtered one.
    """
    kind = points.schema["track_id"].dataType
    keyed = lambda df, v: df.withColumn("track_id", F.concat(F.col("track_id").cast("string"), F.lit(f"|{v}")))
    variants = keyed(points, "source")
    lists = [keyed(events, "source")] if events is not None else []
    if terrain is not None:
        plain = points if "ele_source" in points.columns else points.withColumn("ele_source", F.lit("unknown"))
        over = apply_terrain(plain, terrain).filter("ele_source = 'terrain'").select(*plain.columns)
        variants = keyed(plain, "source").unionByName(keyed(over, "terrain"))
        lists += [keyed(events, "terrain")] if events is not None else []
    variants = checkpointed(variants)
    parts = analyse(variants, lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1]) if lists else None)
    found = self_description(facts_of(variants, parts)).withColumn("variant", F.substring_index("track_id", "|", -1))
    found = checkpointed(found.withColumn("track_id", F.expr("substring(track_id, 1, length(track_id) - length(variant) - 1)").cast(kind)))
    stated = stated_summary(tracks)
    asked = F.col("requested") if "requested" in tracks.columns else F.lit(None).cast("string")
    has = found.groupBy("track_id").agg(F.bool_or((F.col("variant") == "terrain")).alias("has_terrain"))
    offers = tracks.select("track_id", normal_mode(asked).alias("requested"), F.coalesce(F.size("summary") > 0, F.lit(False)).alias("has_summary"), F.coalesce(F.map_keys("summary"), F.array().cast("array<string>")).alias("fields"))
    rows = found.join(has, "track_id").join(offers, "track_id", "left")
    own = F.when(F.col("variant") == "terrain", F.array(F.lit(TERRAIN))).otherwise(F.array_compact(F.array(F.lit(FILTERED), F.lit(RAW), F.when(F.col("has_summary"), F.lit(IMPORTED)))))
    rows = rows.withColumn("mode", F.explode(own))
    default = F.when(F.col("has_terrain"), F.lit(TERRAIN)).otherwise(F.lit(FILTERED))
    offered = F.col("requested").isin(FILTERED, RAW) | ((F.col("requested") == TERRAIN) & F.col("has_terrain")) | ((F.col("requested") == IMPORTED) & F.col("has_summary"))
    imported = F.col("mode") == IMPORTED
    over = {c: t for c, t in rows.dtypes if t == "double" and c in STATED}
    rows = rows.join(stated.select("track_id", *(F.col(c).alias(f"_{c}") for c in {*over, "total_distance_m", "gain_m"})), "track_id", "left")
    rows = rows.withColumns({c: F.when(imported, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in over})
    flags = F.array_append(F.filter("flags", lambda x: ~x.isin(*MOVING_FLAGS)), "summary_imported")
    filters = F.array_append(F.filter("filters", lambda x: ~x.isin(*MOVING_FILTERS)), "imported_summary")
    rows = rows.withColumns(
        {
            "is_default": F.col("mode") == F.when(F.coalesce(offered, F.lit(False)), F.col("requested")).otherwise(default), "imported": F.when(imported, F.col("fields")).otherwise(F.array().cast("array<string>")),
            "flags": F.when(imported, flags).otherwise(F.col("flags")), "filters": F.when(imported, filters).otherwise(F.col("filters")),
        }
    )
    audits = audit_stages(rows).withColumnRenamed("audit", "plain")
    rows = rows.join(audits, ["track_id", "mode"]).withColumns({"audit": F.col("plain"), "stated_distance_m": F.col("_total_distance_m"), "stated_gain_m": F.col("_gain_m"), "source_tag": F.lit(None).cast("string")})
    rewritten = imported_audit(rows).withColumn("audit", F.when(imported, F.col("audit")).otherwise(F.col("plain")))
    facts = [c for c in parts["summary"].columns if c not in ("track_id", "mode")]
    return rewritten.select("track_id", "mode", "is_default", *facts, "recording_mode", "flags", "filters", "imported", "audit")
