"""Registered track queries, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import checkpointed
from waymark.functions import stats, values

from waymark.operators import cleaning, continuity, diagnostics, elevation, gradient, moving, present, series, tails
from waymark.plans import modes, oracles
from waymark.plans.summary import analyse, track_summary
from waymark.sources.files import stated_summary
from waymark.sources.spark import register
from waymark.sources.tables import dense_points, pacing_points, sparse_points, supplier_points, tailed_points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles to six decimals, so that the last bits of sums and sines don't count."""
    return df.select(*(F.round(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


@query
def pair_distance(spark, sf_dir):
    p = continuity.with_pairs(sparse_points(spark, sf_dir))
    return p.select("track_id", "seq", "same_segment", "dt", "metres")


@query
def track_bounds(spark, sf_dir):
    return continuity.span_metres(sparse_points(spark, sf_dir))


@query
def time_gaps(spark, sf_dir):
    return continuity.time_gaps(sparse_points(spark, sf_dir))


@query
def time_gap_breaks(spark, sf_dir):
    return continuity.with_bridges(continuity.with_gaps(sparse_points(spark, sf_dir))).filter("is_gap").select("track_id", "seq", "dt", "threshold_s", "is_bridge")


@query
def continuous_segments(spark, sf_dir):
    return continuity.continuous_segments(sparse_points(spark, sf_dir))


@query
def elapsed_duration(spark, sf_dir):
    return continuity.elapsed(sparse_points(spark, sf_dir))


@query
def recording_mode(spark, sf_dir):
    return continuity.sampling(dense_points(spark, sf_dir))


@query
def distance_series(spark, sf_dir):
    return series.distance_series(sparse_points(spark, sf_dir)).select("track_id", "seq", "span", "distance_m")


@query
def distance_3d(spark, sf_dir):
    return series.distance_3d(sparse_points(spark, sf_dir))


@query
def percentile_flavours(spark, sf_dir):
    p = sparse_points(spark, sf_dir)
    flavours = {"nearest": stats.nearest_rank, "interpolated": stats.interpolated, "lower": stats.lower_rank, "upper": stats.upper_rank}
    return p.groupBy("track_id").agg(*(f("ele", q).alias(f"{n}_{int(q * 100)}") for n, f in flavours.items() for q in (0.1, 0.5, 0.95)), F.median("ele").alias("median"))


@query
def fix_quality(spark, sf_dir):
    fix = F.when(F.col("seq") % 13 == 0, " None").when(F.col("seq") % 13 == 5, "unknown").otherwise("3d")
    dops = {n: (F.col("seq") * k % m).cast("double") for n, k, m in (("hdop", 1, 10), ("vdop", 3, 11), ("pdop", 5, 8))}
    p = dense_points(spark, sf_dir).withColumns({"fix": fix} | dops)
    return cleaning.with_fix_quality(p).select("track_id", "seq", "satellites", "fix", "hdop", "vdop", "pdop", "rejected", "warned")


@query
def time_order(spark, sf_dir):
    return cleaning.time_order(dense_points(spark, sf_dir)).select("track_id", "seq", "ts_ms")


@query
def duplicate_points(spark, sf_dir):
    p = dense_points(spark, sf_dir).withColumn("lat", F.floor(F.col("seq") / 3).cast("double")).withColumn("lon", F.lit(1.0)).withColumn("ts_ms", F.floor(F.col("ts_ms") / 6000))
    return cleaning.without_duplicates(p).select("track_id", "seq", "ts_ms", "lat")


@query
def motion_profile(spark, sf_dir):
    return cleaning.motion_profile(dense_points(spark, sf_dir))


@query
def turn_angles(spark, sf_dir):
    return cleaning.turn_angles(sparse_points(spark, sf_dir))


@query
def cleaned_points(spark, sf_dir):
    return cleaning.clean(dense_points(spark, sf_dir).drop("ele_source")).select("track_id", "seq", "reason")


@query
def cleaning_summary(spark, sf_dir):
    c = cleaning.cleaning_summary(cleaning.clean(dense_points(spark, sf_dir)))
    return c.select("track_id", "points_in", "points_out", F.array_join(F.transform("reasons", lambda r: F.concat(r["reason"], F.lit("="), r["n"].cast("string"))), ",").alias("reasons"))


@query
def raw_speed(spark, sf_dir):
    return series.raw_speed(dense_points(spark, sf_dir))


@query
def speed_reliability(spark, sf_dir):
    return series.reliability(series.raw_speed(dense_points(spark, sf_dir)))


@query
def speed_smoothing(spark, sf_dir):
    return series.reliable_speed(series.raw_speed(dense_points(spark, sf_dir))).select("track_id", "seq", "kmh", "smooth_kmh")


@query
def max_speed(spark, sf_dir):
    return series.reliable_speed(series.raw_speed(dense_points(spark, sf_dir))).groupBy("track_id").agg(F.max("kmh").alias("max_kmh"), F.count("*").alias("n"))


@query
def slope_asof(spark, sf_dir):
    return series.slopes(sparse_points(spark, sf_dir))


@query
def splits_5km(spark, sf_dir):
    return series.splits(supplier_points(spark, sf_dir), 5000.0)


@query
def nearest_sample(spark, sf_dir):
    s = series.distance_series(dense_points(spark, sf_dir)).select("track_id", "seq", "distance_m")
    q = s.select("track_id").distinct().withColumn("at_m", F.explode(F.array(*(F.lit(float(x)) for x in (0, 25, 51.5, 90, 10_000)))))
    return series.nearest_sample(s, q).select("track_id", "at_m", "distance_m")


def _timer(spark, sf_dir):
    p = sparse_points(spark, sf_dir)
    action = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "stop")
    return p, p.select("track_id", F.col("seq").alias("event_id"), "ts_ms", action.alias("action")).filter("action is not null")


@query
def timer_intervals(spark, sf_dir):
    return moving.timer_intervals(*_timer(spark, sf_dir))


@query
def interval_clip(spark, sf_dir):
    p, e = _timer(spark, sf_dir)
    seg = p.groupBy("track_id", "segment").agg(F.min("ts_ms").alias("lo_ms"), F.max("ts_ms").alias("hi_ms"))
    return moving.clip_intervals(moving.timer_intervals(p, e), seg)


@query
def distance_in_intervals(spark, sf_dir):
    p, e = _timer(spark, sf_dir)
    pairs = continuity.with_pairs(p).filter("same_segment and dt > 0").select("track_id", (F.col("ts_ms") - F.col("dt") * 1000).cast("long").alias("from_ms"), F.col("ts_ms").alias("to_ms"), "metres")
    return moving.distance_in_intervals(pairs, moving.timer_intervals(p, e))


@query
def moving_hysteresis(spark, sf_dir):
    return moving.moving_time(series.raw_speed(dense_points(spark, sf_dir)), "fast")


@query
def xy_jitter(spark, sf_dir):
    p = dense_points(spark, sf_dir).withColumn("lat", 43 + F.floor(F.col("seq") / 7) * 3e-5 + F.col("seq") % 2 * 1e-6)
    return continuity.with_jitter(continuity.with_gaps(p)).filter("is_jitter").select("track_id", "seq", "metres")


@query
def route_jitter(spark, sf_dir):
    p = dense_points(spark, sf_dir).withColumn("lat", 43 + F.floor(F.col("seq") / 7) * 3e-5 + F.col("seq") % 2 * 1e-6)
    return continuity.with_route_jitter(continuity.with_jitter(continuity.with_gaps(p))).groupBy("track_id").agg(F.sum(F.col("is_jitter").cast("int")).alias("n_jitter"), F.sum(F.col("is_route_jitter").cast("int")).alias("n_route_jitter"))


@query
def elevation_runs(spark, sf_dir):
    return elevation.runs(dense_points(spark, sf_dir)).select("track_id", "seq", "run", "i", "ele_source")


@query
def raw_extrema(spark, sf_dir):
    return elevation.raw_extrema(dense_points(spark, sf_dir))


@query
def source_trust(spark, sf_dir):
    return elevation.source_trust(dense_points(spark, sf_dir))


@query
def primary_source(spark, sf_dir):
    return elevation.primary_source(elevation.source_trust(dense_points(spark, sf_dir)))


@query
def activity_features(spark, sf_dir):
    return elevation.activity(dense_points(spark, sf_dir))


@query
def resample_grid(spark, sf_dir):
    return elevation.resample(elevation.runs(dense_points(spark, sf_dir)), 10.0)


@query
def raw_outliers(spark, sf_dir):
    p = dense_points(spark, sf_dir).drop("ele_source").withColumn("ele", F.col("ele") - F.when((F.col("track_id") % 2 == 0) & (F.col("seq") % 40 == 1), 90.0).otherwise(0.0))
    return elevation.without_raw_outliers(elevation.runs(p)).filter("raw_outlier is not null").select("track_id", "seq", "run", "i", "ele", "raw_outlier")


@query
def sparse_tails(spark, sf_dir):
    rows = tails.without_sparse_tails(elevation.without_raw_outliers(elevation.runs(tailed_points(spark, sf_dir))))
    return rows.filter("is_sparse_tail").select("track_id", "seq", "run", "i", "ele")


@query
def tail_marks(spark, sf_dir):
    rows = tails.without_sparse_tails(elevation.without_raw_outliers(elevation.runs(tailed_points(spark, sf_dir))))
    return rows.groupBy("track_id", "run").agg(F.count("*").alias("n"), F.count_if("low_tail").alias("n_low"), F.count_if("high_tail").alias("n_high"), F.sum(F.when(F.col("low_tail") | F.col("high_tail"), F.col("i"))).alias("places"))


@query
def hampel_outliers(spark, sf_dir):
    return elevation.hampel(elevation.runs(sparse_points(spark, sf_dir)).select("track_id", "run", "i", "ele")).select("track_id", "run", "i", "ele", "clean")


@query
def smooth_runs(spark, sf_dir):
    return elevation.smooth(elevation.runs(sparse_points(spark, sf_dir)).select("track_id", "run", "i", "ele"), 2, "ele")


@query
def local_sigma(spark, sf_dir):
    return elevation.local_sigma(elevation.runs(sparse_points(spark, sf_dir)).select("track_id", "run", "i", "ele"), "ele")


def _plain_samples(spark, sf_dir):
    rows = elevation.runs(dense_points(spark, sf_dir).drop("ele_source"))
    return rows.select("track_id", "run", "i", (F.col("i") * 15.0).alias("d"), "ele", F.lit(1.0).alias("sigma"))


@query
def gain_loss(spark, sf_dir):
    return elevation.gain_loss(_plain_samples(spark, sf_dir), 3.0, 2.0, 20.0, "ele")


@query
def selected_thresholds(spark, sf_dir):
    return elevation.selected_thresholds(elevation.local_sigma(elevation.runs(sparse_points(spark, sf_dir)).select("track_id", "run", "i", "ele"), "ele"))


@query
def robust_envelope(spark, sf_dir):
    return elevation.robust_envelope(elevation.runs(dense_points(spark, sf_dir)))


@query
def net_change(spark, sf_dir):
    return elevation.net_change(_plain_samples(spark, sf_dir))


@query
def elevation_confidence(spark, sf_dir):
    c = diagnostics.confidence(dense_points(spark, sf_dir))
    return c.withColumns({n: F.array_join(n, ",") for n in ("penalties", "flags")})


def _zoned(spark, sf_dir):
    statuses = F.array(*(F.lit(x) for x in ("explicit", "missing", "invalid", "none", None)))
    return sparse_points(spark, sf_dir).withColumn("zone", F.when(F.col("track_id") % 3 == 0, "explicit").otherwise(F.get(statuses, (F.col("seq") % (F.col("track_id") % 5 + 1)).cast("int"))))


@query
def time_zones(spark, sf_dir):
    return diagnostics.time_zones(_zoned(spark, sf_dir)).withColumn("flags", F.array_join("flags", ","))


@query
def activity_candidates(spark, sf_dir):
    """Of tracks that sink evenly, that sink in leaps, and that are flat."""
    down, k = 900 - F.col("seq") * 2.0, F.col("track_id") % 3
    p = dense_points(spark, sf_dir).withColumn("ele", F.when(F.col("ele").isNotNull(), F.when(k == 0, down).when(k == 1, down + F.col("seq") % 2 * 20).otherwise(100.0)))
    return diagnostics.activity_candidates(p.drop("ele_source"))


@query
def base_threshold(spark, sf_dir):
    return diagnostics.base_threshold(dense_points(spark, sf_dir))


@query
def endpoint_spikes(spark, sf_dir):
    return diagnostics.endpoint_spikes(elevation.runs(dense_points(spark, sf_dir).drop("ele_source")).select("track_id", "run", "i", (F.col("ele") / 8).alias("ele")).withColumn("ele", F.when((F.col("i") == 1) & (F.col("track_id") % 2 == 0), F.col("ele") + 70).otherwise(F.col("ele"))))


@query
def noise_summary(spark, sf_dir):
    return diagnostics.noise_summary(elevation.local_sigma(elevation.runs(sparse_points(spark, sf_dir)).select("track_id", "run", "i", "ele"), "ele"))


@query
def threshold_sweep(spark, sf_dir):
    samples = _plain_samples(spark, sf_dir)
    return diagnostics.threshold_sweep(samples, elevation.climbs(samples, 3.0, 2.0, 20.0, "ele"))


@query
def confirmed_turns(spark, sf_dir):
    return elevation.confirmed_turns(_plain_samples(spark, sf_dir), 3.0, 2.0, 20.0, "ele")


def _supported(spark, sf_dir):
    samples = elevation.smooth(_plain_samples(spark, sf_dir), 1, "ele")
    raw = elevation.runs(dense_points(spark, sf_dir).drop("ele_source"))
    return samples, raw, elevation.supported_turns(elevation.confirmed_turns(samples, 3.0, 2.0, 20.0), raw, 30.0)


@query
def supported_turns(spark, sf_dir):
    return _supported(spark, sf_dir)[2]


@query
def confirmed_extrema(spark, sf_dir):
    return elevation.limited_extrema(*_supported(spark, sf_dir))


@query
def elevation_series(spark, sf_dir):
    return diagnostics.elevation_series(_plain_samples(spark, sf_dir), elevation.robust_envelope(elevation.runs(dense_points(spark, sf_dir).drop("ele_source"))))


@query
def slow_scopes(spark, sf_dir):
    return diagnostics.slow_pairs(pacing_points(spark, sf_dir))


@query
def slow_progress(spark, sf_dir):
    p = dense_points(spark, sf_dir).withColumn("lat", 43 + F.col("seq") * 4e-6).withColumn("segment", F.lit(0))
    return diagnostics.slow_progress(p)


@query
def gradient_stops(spark, sf_dir):
    return diagnostics.gradient_stops(series.raw_speed(dense_points(spark, sf_dir)))


@query
def audit_trail(spark, sf_dir):
    return diagnostics.audit(track_summary(sparse_points(spark, sf_dir)).select("track_id", "n_points", "total_s", "mode"))


@query
def colour_scale(spark, sf_dir):
    return present.colour_scale(series.reliable_speed(series.raw_speed(dense_points(spark, sf_dir))), "kmh")


@query
def route_colours(spark, sf_dir):
    p = dense_points(spark, sf_dir)
    s = series.raw_speed(p).withColumn("kmh", F.round("kmh", 3))
    return present.filled_pairs(p, present.coloured(s, "kmh"))


@query
def chart_rows(spark, sf_dir):
    return present.chart_rows(_plain_samples(spark, sf_dir))


@query
def slope_scale(spark, sf_dir):
    return present.slope_scale(series.slopes(sparse_points(spark, sf_dir)))


@query
def viewport(spark, sf_dir):
    return present.viewport(sparse_points(spark, sf_dir))


@query
def representative_point(spark, sf_dir):
    return present.representative_point(sparse_points(spark, sf_dir)).drop("place_key")


@query
def speed_axis(spark, sf_dir):
    return present.speed_axis(series.raw_speed(dense_points(spark, sf_dir)))


def _line_speeds(spark, sf_dir):
    """Speeds of supplier_points; of five suppliers one lacks some samples and one has a few twice."""
    s = series.raw_speed(supplier_points(spark, sf_dir)).withColumn("kmh", F.round("kmh", 3))
    s = s.filter((F.col("track_id") % 5 != 1) | (F.col("seq") % 97 != 5))
    times = F.when((F.col("track_id") % 5 == 2) & (F.col("seq") == 100), 2).otherwise(1)
    return s.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_copy")


@query
def stops_by_way(spark, sf_dir):
    totals = series.distance_series(supplier_points(spark, sf_dir)).groupBy("track_id").agg((F.max("distance_m") + F.when(F.col("track_id") % 5 == 3, 1.5).otherwise(0.5)).alias("total_m"))
    return gradient.stops_by_way(_line_speeds(spark, sf_dir), totals, "kmh")


@query
def stops_by_point(spark, sf_dir):
    p = dense_points(spark, sf_dir)
    return gradient.stops_by_point(p, series.raw_speed(p).withColumn("kmh", F.round("kmh", 3)), "kmh")


@query
def outlier_details(spark, sf_dir):
    s = series.raw_speed(dense_points(spark, sf_dir)).withColumn("kmh", F.col("kmh") + F.when(F.col("seq") % 9 == 0, 40.0).otherwise(0.0))
    return series.outlier_details(series.with_reliability(s), 5)


@query
def midpoint_values(spark, sf_dir):
    p = series.distance_series(dense_points(spark, sf_dir))
    return present.midpoint_values(p, diagnostics.gradient_stops(series.raw_speed(dense_points(spark, sf_dir))))


@query
def geojson_lines(spark, sf_dir):
    line = F.from_json("geojson", "type string, coordinates array<array<double>>")
    g = present.geojson(sparse_points(spark, sf_dir)).select("track_id", line["type"].alias("type"), F.posexplode(line["coordinates"]).alias("k", "c"))
    return g.select("track_id", "type", "k", F.col("c")[0].alias("lon"), F.col("c")[1].alias("lat"))


@query
def number_parsing(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.lit(" "), F.col("o_totalprice").cast("string"), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise("")).alias("t"))
    return p.select("o_orderkey", values.number(F.col("t")).alias("value"))


@query
def formatters(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.floor("o_totalprice").cast("double")).alias("v"))
    return p.select("o_orderkey", *(f(F.col("v")).alias(f.__name__) for f in (values.clock, values.kilometres, values.speed_text, values.metres_text, values.rounded_metres, values.rounded_seconds, values.rounded_count)))


@query
def time_parsing(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("o_orderkey") % 7
    text = F.when(kind == 0, F.concat(day, F.lit("Z"))).when(kind == 1, day).when(kind == 2, F.concat(day, F.lit(".250+02:00"))).when(kind == 3, F.concat(F.lit(" "), day, F.lit("-0130 "))).when(kind == 4, "soon").when(kind == 5, "")
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.alias("t"))
    return p.select("o_orderkey", values.timestamp_ms(F.col("t")).alias("ts_ms"), values.zone_status(F.col("t")).alias("zone"))


@query
def period_label(spark, sf_dir):
    p = sparse_points(spark, sf_dir)
    kind = F.col("track_id") % 4
    p = p.filter((kind == 0) | ((kind == 1) & (F.col("seq") <= 3)) | ((kind == 2) & (F.col("seq") <= 1)) | (kind == 3)).withColumn("ts_ms", F.when((kind != 3) | (F.col("track_id") % 8 == 7), F.col("ts_ms")))
    return present.period_label(p).join(present.period_label(p, "es").withColumnRenamed("label", "label_es"), "track_id")


@query
def formatter_languages(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.floor(F.col("o_totalprice") * (1 + F.col("o_orderkey") % 40)) / 10).alias("v"))
    return p.select("o_orderkey", *(values.metres_text(F.col("v"), language).alias(language) for language in values.SEPARATORS))


@query
def analysis_modes(spark, sf_dir):
    t = sparse_points(spark, sf_dir).select("track_id").distinct()
    stated = F.when(F.col("track_id") % 2 == 0, F.create_map(F.lit("gain_m"), F.lit(1.0)))
    m = diagnostics.modes(t.withColumns({"elevation_source": F.when(F.col("track_id") % 3 == 0, "terrain").when(F.col("track_id") % 3 == 1, "gpx"), "summary": stated}))
    return m.withColumn("modes", F.array_join("modes", ","))


@query
def stated_summaries(spark, sf_dir):
    s = track_summary(sparse_points(spark, sf_dir)).join(elevation.raw_extrema(sparse_points(spark, sf_dir)), "track_id")
    k = F.col("track_id")
    fields = {"total_distance_m": k % 2 == 0, "total_s": k % 3 != 0, "min_ele": k % 5 != 0, "max_ele": k % 7 != 0, "max_kmh": k % 4 == 1}
    pairs = F.array_compact(F.array(*(F.when(test & F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.col(c).alias("value"))) for c, test in fields.items()), F.when(k % 3 == 1, F.struct(F.lit("moving_s").alias("key"), (F.col("total_s") / 2).alias("value")))))
    return stated_summary(s.select("track_id", F.map_from_entries(pairs).alias("summary")))


@query
def metric_tiles(spark, sf_dir):
    s = track_summary(sparse_points(spark, sf_dir)).join(elevation.raw_extrema(sparse_points(spark, sf_dir)), "track_id")
    return present.metric_tiles(s)


@query
def track_summary_query(spark, sf_dir):
    return track_summary(sparse_points(spark, sf_dir))


QUERIES["track_summary"] = QUERIES.pop("track_summary_query")


@query
def supplier_track_summary(spark, sf_dir):
    return track_summary(supplier_points(spark, sf_dir))


@query
def full_analysis(spark, sf_dir):
    return analyse(dense_points(spark, sf_dir))["summary"]


def _rows_of(audits):
    one = audits.select("track_id", "mode", F.posexplode("audit").alias("n", "s")).select("track_id", "mode", "n", F.col("s.id").alias("stage"), F.col("s.status").alias("status"), F.posexplode("s.items").alias("k", "x"))
    return one.select("track_id", "mode", "n", "k", "stage", "status", F.col("x.id").alias("item"), "x.label", "x.value_type", "x.raw_value", "x.value")


@query
def audit_stages(spark, sf_dir):
    p = sparse_points(spark, sf_dir)
    gaps = continuity.with_gaps(p).groupBy("track_id").agg(F.sum(F.col("is_gap").cast("long")).alias("n_time_gaps"), F.countDistinct("segment").alias("n_segments"))
    s = track_summary(p).withColumnRenamed("mode", "recording_mode").join(gaps, "track_id")
    k, v = F.col("track_id"), lambda c: F.round(F.col(c))
    facts = s.select(
        "track_id", F.when(k % 2 == 0, modes.IMPORTED).otherwise(modes.FILTERED).alias("mode"), "n_segments", "n_time_gaps", (k % 3).alias("n_jitter"), "recording_mode", F.round("nominal_s").alias("nominal_s"),
        (F.col("n_points") + k % 4).alias("points_in"), F.col("n_points").alias("points_out"), F.when(k % 5 == 0, None).otherwise("gpx").alias("elevation_source"), F.when(k % 5 != 0, (k % 7).cast("double")).alias("threshold_m"),
        (k % 11).cast("double").alias("p95_m"), F.lit(1.5).alias("on_kmh"), F.lit(None).cast("string").alias("time_zone"), v("total_distance_m").alias("total_distance_m"), F.when(k % 6 != 1, v("total_s")).alias("moving_s"), (k % 13).cast("double").alias("gain_m"),
        F.array_compact(F.array(F.when(F.col("recording_mode") == "sparse", "sampling_sparse"), F.when(F.col("recording_mode") == "smart", "sampling_smart_recording"))).alias("sampling_flags"),
    )
    facts = checkpointed(modes.self_description(facts))
    audits = facts.join(modes.audit_stages(facts).select("track_id", "audit"), "track_id")
    stated = audits.withColumns({"stated_distance_m": (k * 10).cast("double"), "stated_gain_m": F.lit(None).cast("double"), "source_tag": F.lit("gpx")})
    return _rows_of(audits.filter("mode <> 'imported_summary'").select("track_id", "mode", "audit").union(modes.imported_audit(stated.filter("mode = 'imported_summary'")).select("track_id", "mode", "audit")))


@query
def next_modes(spark, sf_dir):
    k = F.col("track_id")
    t = sparse_points(spark, sf_dir).select("track_id").distinct().withColumns({"elevation_source": F.when(k % 3 == 0, "terrain"), "summary": F.when(k % 2 == 0, F.create_map(F.lit("gain_m"), F.lit(1.0)))})
    last = F.array(F.lit(None), *(F.lit(m) for m in (modes.FILTERED, modes.RAW, modes.TERRAIN, modes.IMPORTED, modes.OLD_FILTERED)))
    offered = diagnostics.modes(t).withColumns({"last_mode": F.get(last, (k % 6).cast("int")), "last_default_mode": F.when(k % 4 == 1, modes.TERRAIN)})
    return modes.next_mode(offered)


@query
def all_modes(spark, sf_dir):
    p = dense_points(spark, sf_dir)
    terrain = p.filter("track_id % 3 = 0").select("track_id", "seq", F.coalesce(F.round(F.col("ele") / 2), F.lit(40.0)).alias("terrain_ele"))
    tracks = p.select("track_id").distinct().withColumn("summary", F.when(F.col("track_id") % 4 == 0, F.create_map(F.lit("gain_m"), F.lit(1.0), F.lit("total_distance_m"), F.lit(77.0))))
    rows = modes.analyse_modes(p, tracks, terrain)
    return rows.withColumns({"flags": F.array_join("flags", ","), "filters": F.array_join("filters", ","), "imported": F.array_join("imported", ",")}).drop("audit")


@query
def gpx_documents(spark, sf_dir):
    """Points written as GPX documents of up to 4,000 points and read again by the table function. Prefixed points aren't
    found, route points follow the track's, heights of an ellipsoid come down by the geoid's."""
    seq, number = F.col("seq"), lambda c: F.col(c).cast("string")
    geoid = F.when(seq % 7 == 0, "<geoidheight>30</geoidheight><extensions><x:datum><elevationDatum>ellipsoid</elevationDatum></x:datum><n>&lt;</n></extensions>").otherwise("")
    name = F.when(seq % 31 == 0, "rtept").when(seq % 29 == 0, "g:trkpt").otherwise("trkpt")
    ele = F.when(F.col("ele").isNotNull(), F.concat(F.lit("<ele>"), number("ele"), F.lit("</ele>"))).otherwise("")
    text = F.concat(F.lit("<"), name, F.lit(' lat="'), number("lat"), F.lit('" lon="'), number("lon"), F.lit('">'), ele, geoid, F.lit("</"), name, F.lit(">"))
    points = dense_points(spark, sf_dir).select("track_id", F.floor((seq - 1) / 4000).alias("part"), F.when(seq % 31 != 0, F.col("segment")).alias("segment"), "seq", text.alias("text"))
    in_order = lambda *c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c, "text"))), lambda x: x["text"]), "")
    held = points.groupBy("track_id", "part", "segment").agg(in_order("seq").alias("text"))
    kind = F.when(F.col("segment").isNull(), "rte").otherwise("trkseg")
    held = held.withColumn("text", F.concat(F.lit("<"), kind, F.lit(">"), "text", F.lit("</"), kind, F.lit(">")))
    files = held.groupBy("track_id", "part").agg(F.concat(F.lit('<gpx xmlns:g="urn:g" xmlns:x="urn:x">'), in_order("segment"), F.lit("</gpx>")).cast("binary").alias("content"))
    register(spark)
    read = spark.sql("SELECT d.track_id, d.part, p.* FROM {files} d, LATERAL track_points('a.gpx', d.content) p", files=files)
    return read.select("track_id", "part", "seq", "lat", "lon", "ele", "segment", "phys", "ele_source", "datum", "geoid_m", F.array_join("extensions", " ").alias("fragments"))


@query
def explicit_profiles(spark, sf_dir):
    """The profiles that callers ask for, by track, in cleaning and in the ceiling of speeds."""
    k = F.col("track_id")
    asked = lambda names, n: F.get(F.array(*(F.lit(x) for x in names)), (k % n).cast("int"))
    p = dense_points(spark, sf_dir).withColumns({"explicit_profile": asked(("slow", "fast", " ", "unrestricted", "sprint", None), 6), "explicit_reliability": asked(("moderate", None, "unknown", "nonsense"), 4)})
    profile = cleaning.motion_profile(p).select("track_id", "profile", "profile_source", "confidence", "ceiling_mps")
    speeds = series.raw_speed(p.join(profile.select("track_id", F.col("profile").alias("cleaning_profile")), "track_id"))
    judged = series.reliability(speeds).select("track_id", F.col("profile").alias("reliability_profile"), "ceiling_kmh", "n_outliers")
    return profile.join(judged, "track_id")


@query
def sql_functions(spark, sf_dir):
    register(spark)
    pairs = continuity.with_pairs(dense_points(spark, sf_dir)).withColumn("ahead", F.lead(F.struct("lat", "lon")).over(series.in_order())).withColumn("back", F.lag(F.struct("lat", "lon")).over(series.in_order()))
    return spark.sql(
        """SELECT track_id, seq, way_m(back.lat, back.lon, lat, lon) AS metres, bearing_deg(back.lat, back.lon, lat, lon) AS bearing,
        turn_deg(bearing_deg(back.lat, back.lon, lat, lon), bearing_deg(lat, lon, ahead.lat, ahead.lon)) AS turned FROM {pairs}""",
        pairs=pairs,
    )


ORACLE_SQL = oracles.ORACLE_SQL
__all__ = ["ORACLE_SQL", "QUERIES"]
