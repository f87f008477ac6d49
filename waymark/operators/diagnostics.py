"""What an analysis says about itself: time zones, activity candidates, noise, confidence, modes, an audit table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import ship
from waymark.functions.geo import ECC2, METRES_PER_DEGREE, RADIUS
from waymark.functions.stats import fixed, half_up, interpolated
from waymark.operators import elevation
from waymark.operators.continuity import in_order, with_continuous_segment, with_gaps

#: The analysis modes, in the order in which they are offered.
MODES = ("recomputed_filtered", "recomputed_raw", "recomputed_terrain", "imported_summary")

#: The length of the wider direction window, its least efficiency and the most way back in net ways.
QUALITY_MS, BROAD = 900_000, (0.03, 20.0)


def time_zones(points: DataFrame) -> DataFrame:
    """Rows track_id, n_explicit, n_missing, n_invalid, n_unknown, confidence, flags from points with ts_ms and zone:
    unknown counts known times without a status; confidence is low with a missing or invalid zone, high with explicit ones
    only, unknown with times of unknown zone, none without times."""
    n = lambda test: F.count(F.when(test, 1))
    rows = points.groupBy("track_id").agg(
        n(F.col("zone") == "explicit").alias("n_explicit"), n(F.col("zone") == "missing").alias("n_missing"), n(F.col("zone") == "invalid").alias("n_invalid"),
        n(~F.coalesce(F.col("zone").isin("explicit", "missing", "invalid"), F.lit(False)) & F.col("ts_ms").isNotNull()).alias("n_unknown"),
    )
    level = F.when((F.col("n_missing") > 0) | (F.col("n_invalid") > 0), "low").when(F.col("n_unknown") > 0, "unknown").when(F.col("n_explicit") > 0, "high").otherwise("none")
    return rows.withColumns({"confidence": level, "flags": F.when(F.col("n_missing") > 0, F.array(F.lit("tz_inferred"))).otherwise(F.array().cast("array<string>"))})


def activity_candidates(points: DataFrame) -> DataFrame:
    """Rows track_id, rank, activity, score, reason: the activity chosen (elevation.activity) and what else it might have been,
    best first; of equal scores in the order chosen, foot, bike, water. Descents of more than 80 m count for water, and slow
    flat tracks. A stated activity stands alone."""
    rows = elevation.activity(points)
    median, p95 = F.coalesce("median_kmh", F.lit(0.0)), F.coalesce("p95_kmh", "median_kmh", F.lit(0.0))
    c, open_ = F.col("activity"), F.col("reason") != "explicit_activity"
    flat = (F.col("n_timed") >= 6) & (median > 0) & (median <= 8) & (p95 <= 18) & (F.abs("net_ele") <= 20) & ((F.col("raw_ele") <= 40) | (F.col("directional") <= 0.5))

    def entry(order: int, name: Column, value: Column, reason: Column, test: Column) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.struct((-value).alias("minus"), F.lit(order).alias("order"), name.alias("activity"), reason.alias("reason")))

    options = F.array_compact(
        F.array(
            entry(0, c, F.col("confidence"), F.col("reason"), F.lit(True)),
            entry(1, F.lit("foot"), F.when(c == "bike", 0.48).otherwise(0.35), F.lit("fallback_slow_motion"), open_ & (c != "foot") & (median > 0)),
            entry(2, F.lit("bike"), F.when(c == "foot", 0.48).otherwise(0.4), F.lit("near_bike_speed"), open_ & (c != "bike") & ((median >= 6) | (p95 >= 16))),
            entry(3, F.lit("water"), F.lit(0.42), F.lit("sustained_descent"), open_ & (c != "water") & (F.col("net_ele") < -80)),
            entry(4, F.lit("water"), F.when(c == "foot", 0.42).otherwise(0.35), F.lit("flat_low_speed"), open_ & (c != "water") & flat),
        )
    )
    ranked = rows.select("track_id", F.posexplode(F.sort_array(options)).alias("k", "x"))
    return ranked.select("track_id", (F.col("k") + 1).alias("rank"), "x.activity", (-F.col("x.minus")).alias("score"), "x.reason")


def base_threshold(points: DataFrame) -> DataFrame:
    """Rows track_id, activity, ele_source, base_m: the least turn that counts, of tracks with a trusted source."""
    primary = elevation.primary_source(elevation.source_trust(points)).select("track_id", "ele_source")
    rows = elevation.activity(points).select("track_id", "activity").join(primary, "track_id")
    return rows.join(elevation.defaults(points).select("track_id", "base_m"), "track_id").select("track_id", "activity", "ele_source", "base_m")


def endpoint_spikes(samples: DataFrame, column: str = "ele") -> DataFrame:
    """Rows track_id, run, i, ele, clean of elevation.replace_endpoints' spikes."""
    rows = elevation.replace_endpoints(samples.withColumn("clean", F.col(column)), "clean")
    return rows.filter("is_endpoint_spike").select("track_id", "run", "i", F.col(column).alias("ele"), "clean")


def confidence(points: DataFrame) -> DataFrame:
    """Rows track_id, gain_loss, extrema, overall, level, penalties (codes), flags.

    The chosen activity's score and the primary source's trust are averaged, relative trust for gain and loss, absolute for
    extrema. Penalties, half of them for extrema: four changes of source or more; four runs or more, half of them of two
    samples at most; a share of samples replaced (1 %, 5 %); endpoints replaced (1, 3); a second activity within 0.15.
    """
    samples = elevation.replace_endpoints(elevation.hampel(elevation.resample(elevation.runs(points))))
    per_run = samples.groupBy("track_id", "run").agg(F.count("*").alias("n"), F.sum((F.col("clean") != F.col("ele")).cast("int")).alias("off"), F.sum(F.col("is_endpoint_spike").cast("int")).alias("ends"))
    shape = per_run.groupBy("track_id").agg(F.count("*").alias("runs"), F.sum((F.col("n") <= 2).cast("int")).alias("short"), (100 * F.sum("off") / F.sum("n")).alias("replaced"), F.sum("ends").alias("ends"))
    sources = elevation.runs(points)
    order = Window.partitionBy("track_id").orderBy("seq")
    switches = sources.withColumn("s", F.coalesce(F.lag("ele_source").over(order) != F.col("ele_source"), F.lit(False)).cast("int")).groupBy("track_id").agg(F.sum("s").alias("switches"))
    trust = elevation.source_trust(points)
    primary = elevation.primary_source(trust).select("track_id", F.col("ele_source").alias("rel_source"), F.col("trust").alias("rel")).join(elevation.primary_source(trust, "abs_trust").select("track_id", F.col("ele_source").alias("abs_source"), F.col("trust").alias("abs")), "track_id")
    ranks = activity_candidates(points).groupBy("track_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    rows = shape.join(switches, "track_id").join(ranks, "track_id").join(primary, "track_id", "left")
    p = lambda test, code, value: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(value).alias("value")))
    penalties = F.array_compact(  # fixed values: codes and weights
        F.array(
            p(F.col("switches") >= 4, "source_switch_fragmentation", 0.10),
            p((F.col("runs") >= 4) & (F.col("short") >= 0.5 * F.col("runs")), "many_short_elevation_runs", 0.10),
            p(F.col("replaced") >= 5, "outliers_removed_high", 0.15),
            p((F.col("replaced") >= 1) & (F.col("replaced") < 5), "outliers_removed", 0.05),
            p(F.col("ends") >= 3, "many_endpoint_spikes_replaced", 0.12),
            p(F.col("ends").between(1, 2), "endpoint_spike_replaced", 0.05),
            p(F.col("top") - F.col("second") < 0.15, "activity_ambiguous", 0.08),
        )
    )
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    rows = rows.withColumn("p", penalties).withColumn("off", F.aggregate("p", F.lit(0.0), lambda a, x: a + x["value"]))
    rows = rows.withColumns({"gain_loss": clamp(clamp((F.col("top") + F.coalesce("rel", F.lit(0.0))) / 2) - F.col("off")), "extrema": clamp(clamp((F.col("top") + F.coalesce("abs", F.lit(0.0))) / 2) - F.col("off") / 2)})
    rows = rows.withColumn("overall", clamp((2 * F.col("gain_loss") + F.col("extrema")) / 3))
    codes = F.transform("p", lambda x: x["code"])
    more = F.array_compact(F.array(F.when(F.col("top") < 0.5, F.lit("activity_inference_low_confidence")), F.when(F.col("rel_source") == "terrain", F.lit("terrain_relative_elevation_low_confidence")), F.when(F.col("abs_source") == "terrain", F.lit("elevation_dem_corrected"))))
    level = F.when(F.col("overall") >= 0.75, "high").when(F.col("overall") >= 0.5, "medium").otherwise("low")
    return rows.select("track_id", "gain_loss", "extrema", "overall", level.alias("level"), codes.alias("penalties"), F.array_distinct(F.concat(codes, more)).alias("flags"))


def noise_summary(sigmas: DataFrame) -> DataFrame:
    """Rows track_id, median_sigma, p95_sigma (interpolated)."""
    return sigmas.groupBy("track_id").agg(interpolated("sigma", 0.5).alias("median_sigma"), interpolated("sigma", 0.95).alias("p95_sigma"))


def threshold_sweep(samples: DataFrame, climbs: DataFrame) -> DataFrame:
    """Rows track_id, kind, threshold_m, gain_m, loss_m: the selected thresholds beside the one gain and loss of climbs, which
    are rounded to two decimals by their exact values; climbs adds in order, so no tie falls either way."""
    t = elevation.selected_thresholds(samples).join(climbs, "track_id")
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("threshold_m")) for k, c in (("selected_median_local_threshold", "median_m"), ("selected_p95_local_threshold", "p95_m"))))
    return t.select("track_id", F.inline(rows), fixed(F.col("gain_m")).alias("gain_m"), fixed(F.col("loss_m")).alias("loss_m")).filter("threshold_m is not null")


def elevation_series(samples: DataFrame, envelope: DataFrame, column: str = "ele") -> DataFrame:
    """Rows track_id, run, i, d, ele: samples clamped to their track's extrema (track_id, min_ele, max_ele)."""
    return samples.join(envelope, "track_id").select("track_id", "run", "i", "d", F.greatest("min_ele", F.least("max_ele", column)).alias("ele"))


def modes(tracks: DataFrame) -> DataFrame:
    """Rows track_id, modes, default_mode from tracks with elevation_source and summary (a map, null or empty: none stated)."""
    terrain, stated = F.coalesce(F.col("elevation_source") == "terrain", F.lit(False)), F.coalesce(F.size("summary") > 0, F.lit(False))
    offered = F.array_compact(F.array(F.lit(MODES[0]), F.lit(MODES[1]), F.when(terrain, F.lit(MODES[2])), F.when(stated, F.lit(MODES[3]))))
    return tracks.select("track_id", offered.alias("modes"), F.when(terrain, F.lit(MODES[2])).otherwise(F.lit(MODES[0])).alias("default_mode"))


def audit(summary: DataFrame) -> DataFrame:
    """Rows track_id, stage, item, value of a summary, in order: how the result came about."""
    stages = {"input": ["n_points"], "distance": ["total_distance_m"], "time": ["total_s", "nominal_s", "mode"], "speed": ["average_kmh", "max_kmh"], "motion": ["moving_s", "stopped_s"], "elevation": ["gain_m", "loss_m", "min_ele", "max_ele"]}
    rows = [F.struct(F.lit(s).alias("stage"), F.lit(c).alias("item"), (half_up(F.col(c), 2) if dict(summary.dtypes)[c] == "double" else F.col(c)).cast("string").alias("value")) for s, items in stages.items() for c in items if c in summary.columns]
    return summary.select("track_id", F.inline(F.array(*rows)))


def slow_progress(points: DataFrame, on_kmh: float = 1.5) -> DataFrame:
    """Rows track_id, seq of pairs within slow but steady progress: slow_pairs that are poor in no scope."""
    return slow_pairs(points, on_kmh).filter("not (poor_window or poor_broad or poor_segment)").select("track_id", "seq")


def slow_pairs(points: DataFrame, on_kmh: float = 1.5) -> DataFrame:
    """Rows track_id, seq, poor_window, poor_broad, poor_segment of pairs that may be slow progress: in the 150 s on either
    side of the pair's middle, inside its continuous segment, four pairs or more over 120 s or more, a net speed up to
    ``on_kmh`` and of 0.5 km/h, or 0.15 and 12 m net.

    The flags say where the direction is poor: in that window; in the 15 minutes around the middle, moved into the segment where
    they stick out, so that they stay 15 minutes (efficiency below 0.03 and 20 times the net way back); in a whole segment of
    up to 120 points. A task reads its tracks one after another in batches and holds one segment; its windows are places
    between sorted times, and are looked at many at a time: work grows with the windows, not with the segment's square.
    """
    ship(points.sparkSession)
    every = with_continuous_segment(with_gaps(points))
    new = F.coalesce(F.lag("cont_segment").over(in_order()) != F.col("cont_segment"), F.lit(True))
    # the windows have brought each track together and in order
    rows = every.select("track_id", "seq", F.col("ts_ms").cast("long").alias("ts_ms"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), new.alias("new"))
    kinds = {c: t for c, t in points.dtypes if c in ("track_id", "seq")}
    schema = f"track_id {kinds['track_id']}, seq {kinds['seq']}, {', '.join(f'{c} boolean' for c in POOR)}"
    return rows.sortWithinPartitions("track_id", "seq").mapInArrow(lambda batches: slow_rows(batches, on_kmh), schema)


#: Where the direction of a slow pair may be poor.
POOR = ("poor_window", "poor_broad", "poor_segment")


def slow_rows(batches: Iterator[pa.RecordBatch], on_kmh: float) -> Iterator[pa.RecordBatch]:
    """slow_pairs of a task's sorted rows, whole segments of a batch and of those before it at a time."""
    held: list[pa.RecordBatch] = []  # rows of the segment that goes on
    for batch in batches:
        starts = np.flatnonzero(batch.column("new").to_numpy(zero_copy_only=False))
        if not len(starts):
            held.append(batch)
            continue
        yield from slow_in_segments([*held, batch.slice(0, int(starts[-1]))], on_kmh)
        held = [batch.slice(int(starts[-1]))]
    yield from slow_in_segments(held, on_kmh)


def slow_in_segments(batches: list[pa.RecordBatch], on_kmh: float) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches).combine_chunks() if batches else None
    if rows is None or not rows.num_rows:
        return
    known = rows.column("ts_ms").is_valid().to_numpy()
    ts = rows.column("ts_ms").fill_null(0).to_numpy()
    lat, lon = (rows.column(c).fill_null(math.nan).to_numpy() for c in ("lat", "lon"))
    bounds = [*np.flatnonzero(rows.column("new").to_numpy()).tolist(), rows.num_rows]
    found: list[tuple[np.ndarray, ...]] = []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        places = np.flatnonzero(known[lo:hi]) + lo
        if len(places) < 5:
            continue
        places = places[np.argsort(ts[places], kind="stable")]
        # the segment's ends by order; one without a time bounds nothing
        ends = (int(ts[lo]) if known[lo] else -(2**62), int(ts[hi - 1]) if known[hi - 1] else 2**62)
        pairs, *poor = slow_in(ts[places], lat[places], lon[places], hi - lo, ends, on_kmh)
        if len(pairs):
            found.append((places[pairs], *poor))
    if found:
        at, *poor = (np.concatenate(c) for c in zip(*found, strict=True))
        out = rows.select(["track_id", "seq"]).take(pa.array(at)).combine_chunks()
        yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in out.columns), *(pa.array(x) for x in poor)], ["track_id", "seq", *POOR])


def slow_in(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, n_points: int, ends: tuple[int, int], on_kmh: float) -> tuple[np.ndarray, ...]:
    """Places of the slow pairs' second points among a segment's points in order of time, and the three flags of each."""
    centre = (t[1:] + t[:-1]) // 2
    first, last = np.searchsorted(t, centre - 150_000), np.searchsorted(t, centre + 150_000, side="right")
    seconds, net = (t[last - 1] - t[first]) / 1000, way(lat[first], lon[first], lat[last - 1], lon[last - 1])
    kmh = np.divide(net, seconds, out=np.full(len(net), math.nan), where=seconds != 0) * 3.6
    slow = np.flatnonzero((last - first >= 5) & (seconds >= 120) & (kmh <= on_kmh) & ((kmh >= 0.5) | ((kmh >= 0.15) & (net >= 12))))
    if not len(slow):
        return (slow, *(np.zeros(0, bool) for _ in POOR))
    window = goes_to_and_fro(lat, lon, first[slow], last[slow])
    # the 15 minutes, moved into the segment
    (start, end), c, half = ends, centre[slow], QUALITY_MS // 2
    late = c - half < start
    begin, stop = np.where(late, start, c - half), np.where(late, min(end, start + QUALITY_MS), c + half)
    begin, stop = np.where(stop > end, max(start, end - QUALITY_MS), begin), np.minimum(stop, end)
    holds = np.flatnonzero((t[slow] >= begin) & (t[slow + 1] <= stop))
    broad = np.zeros(len(slow), bool)
    broad[holds] = goes_to_and_fro(lat, lon, np.searchsorted(t, begin[holds]), np.searchsorted(t, stop[holds], side="right"), *BROAD)
    whole = n_points <= 120 and bool(goes_to_and_fro(lat, lon)[0])
    return slow + 1, window, broad, np.full(len(slow), whole)


def way(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """functions.geo.distance of arrays."""
    mean = np.radians((lat1 + lat2) / 2)
    base = np.sqrt(1 - ECC2 * np.sin(mean) ** 2)
    north, east = RADIUS * (1 - ECC2) / base**3 * np.radians(lat2 - lat1), RADIUS / base * np.cos(mean) * np.radians(lon2 - lon1)
    return np.sqrt(north * north + east * east)


#: Points of windows that are looked at together, at most, where one window hasn't more.
CELLS = 1 << 14


def goes_to_and_fro(lat: np.ndarray, lon: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None, least_efficiency: float = 0.45, most_back: float = 1.0) -> np.ndarray:
    """Which stretches of points in order, from places ``first`` to before ``last`` (without these, the one of all points),
    go to and fro: along the axis, east or north, on which they reach farther, steps of 1 m or more change sign three times or
    more, the net way is less than ``least_efficiency`` of the whole, and the way back is ``most_back`` of the net way or more.
    Fewer than three points, or no such step, don't.

    Degrees of latitude have one length, so steps north are running sums. Those of longitude have that of the stretch's first
    point, which settles which steps have 1 m: stretches along them are laid out beside each other."""
    if first is None or last is None:
        first, last = np.array([0]), np.array([len(lat)])
    out = np.zeros(len(first), bool)
    todo = np.flatnonzero(last - first >= 3)
    if not len(todo):
        return out
    a, b = first[todo], last[todo]
    lowest, highest = reach(lat, lon, a, b)
    scale = METRES_PER_DEGREE * np.cos(np.radians(lat[a]))
    east = (highest[1] - lon[a]) * scale - (lowest[1] - lon[a]) * scale
    is_east = east >= (highest[0] - lat[a]) * METRES_PER_DEGREE - (lowest[0] - lat[a]) * METRES_PER_DEGREE
    judge = lambda *facts: verdict(*facts, least_efficiency, most_back)
    out[todo[~is_east]] = judge(*ways_north(lat, a[~is_east], b[~is_east]))
    todo = todo[is_east]
    many = max(1, CELLS // int((b - a).max()))
    for k in range(0, len(todo), many):
        part = todo[k : k + many]
        out[part] = judge(*ways_east(lat, lon, first[part], last[part]))
    return out


def reach(lat: np.ndarray, lon: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest latitude and longitude of stretches: of the two powers of two that cover each."""
    low = high = np.stack([lat, lon])
    lowest, highest = np.empty((2, len(a))), np.empty((2, len(a)))
    level = np.frexp(b - a)[1] - 1  # 2 ** level is the greatest power up to the length
    for k in range(int(level.max()) + 1):
        at, width = np.flatnonzero(level == k), 1 << k
        lowest[:, at], highest[:, at] = np.minimum(low[:, a[at]], low[:, b[at] - width]), np.maximum(high[:, a[at]], high[:, b[at] - width])
        low, high = np.minimum(low[:, :-width], low[:, width:]), np.maximum(high[:, :-width], high[:, width:])
    return lowest, highest


def ways_north(lat: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The net way, the whole way, the way back and the turns of stretches along the meridian."""
    steps = np.diff(lat) * METRES_PER_DEGREE
    kept = np.flatnonzero(np.abs(steps) >= 1)
    steps = steps[kept]
    changes = np.cumsum(np.concatenate([[0], steps[1:] * steps[:-1] < 0]))
    north, south = (np.concatenate([[0.0], np.cumsum(np.maximum(x, 0.0))]) for x in (steps, -steps))
    lo, hi = np.searchsorted(kept, a), np.searchsorted(kept, b - 1)
    net = (lat[b - 1] - lat[a]) * METRES_PER_DEGREE
    up, down = north[hi] - north[lo], south[hi] - south[lo]
    turns = np.where(hi > lo, changes[np.maximum(hi - 1, 0)] - changes[np.minimum(lo, len(changes) - 1)], 0)
    return net, np.where(hi > lo, up + down, 0.0), np.where(net > 0, down, up), turns


def ways_east(lat: np.ndarray, lon: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same of stretches along the parallel of their first point."""
    # shorter stretches stay at their last point: steps of 0 m, which don't count
    at = np.minimum(a[:, None] + np.arange(int((b - a).max())), b[:, None] - 1)
    along = (lon[at] - lon[a][:, None]) * (METRES_PER_DEGREE * np.cos(np.radians(lat[a])))[:, None]
    net, steps = along[:, -1] - along[:, 0], np.diff(along, axis=1)
    row, column = np.nonzero(np.abs(steps) >= 1)
    steps = steps[row, column]
    size, sign = np.abs(steps), np.sign(steps)
    back = np.bincount(row, np.where(sign != np.sign(net)[row], size, 0.0), len(a))
    return net, np.bincount(row, size, len(a)), back, np.bincount(row[1:][(sign[1:] != sign[:-1]) & (row[1:] == row[:-1])], None, len(a))


def verdict(net: np.ndarray, path: np.ndarray, back: np.ndarray, turns: np.ndarray, least_efficiency: float, most_back: float) -> np.ndarray:
    far = np.abs(net)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (path > 0) & (turns >= 3) & (far / path < least_efficiency) & (~(far > 0) | (back / far >= most_back))


def gradient_stops(speeds: DataFrame, column: str = "kmh") -> DataFrame:
    """Rows track_id, progress, kmh: each sample's middle as a share of its track's way, the last of equal ones."""
    whole = Window.partitionBy("track_id")
    rows = speeds.withColumn("total", F.max("distance_m").over(whole)).filter("total > 0")
    at = rows.withColumn("progress", half_up((F.col("distance_m") - F.col("metres") / 2) / F.col("total"), 6))
    return at.groupBy("track_id", "progress").agg(F.max_by(column, "seq").alias("kmh"))
