"""Rows for maps, charts and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import values
from waymark.functions.geo import valid
from waymark.functions.stats import interpolated, lower_rank
from waymark.operators.continuity import in_order

#: The colours of slow and fast.
SLOW_RGB, FAST_RGB = (37, 99, 235), (220, 38, 38)
#: Samples and km/h between the ends that a scale of colours has at least.
LEAST_SAMPLES, LEAST_KMH = 2, 0.1


def geojson(points: DataFrame) -> DataFrame:
    """Rows track_id, geojson: the track as a LineString of [lon, lat] with six decimals; fewer than two points give none."""
    pair = F.array(F.round("lon", 6), F.round("lat", 6))
    line = F.transform(F.sort_array(F.collect_list(F.struct("seq", pair.alias("p")))), lambda x: x["p"])
    rows = points.filter(valid(F.col("lat"), F.col("lon"))).groupBy("track_id").agg(line.alias("coordinates"))
    return rows.filter(F.size("coordinates") >= 2).select("track_id", F.to_json(F.struct(F.lit("LineString").alias("type"), "coordinates")).alias("geojson"))


def colour_scale(speeds: DataFrame, column: str = "smooth_kmh") -> DataFrame:
    """Rows track_id, low_kmh, high_kmh: the tenth and ninetieth percentiles, where two samples and 0.1 km/h lie between."""
    rows = speeds.groupBy("track_id").agg(interpolated(column, 0.1).alias("low_kmh"), interpolated(column, 0.9).alias("high_kmh"), F.count(column).alias("n"))
    return rows.filter(f"n >= {LEAST_SAMPLES} and high_kmh - low_kmh >= {LEAST_KMH}").drop("n")


def with_colour(speeds: DataFrame, column: str = "smooth_kmh") -> DataFrame:
    """The samples of tracks that have a colour_scale, with colour: between the two colours by their place on it. The scale is
    a window aggregate, so that the samples are made once and joined with nothing."""
    whole = Window.partitionBy("track_id")
    scale = {"_low": interpolated(column, 0.1).over(whole), "_high": interpolated(column, 0.9).over(whole), "_known": F.count(column).over(whole)}
    rows = speeds.withColumns(scale).filter(f"_known >= {LEAST_SAMPLES} and _high - _low >= {LEAST_KMH}")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low"))))
    return rows.withColumn("colour", values.hex_colour(*(a + (b - a) * t for a, b in zip(SLOW_RGB, FAST_RGB, strict=True)))).drop(*scale)


def coloured(speeds: DataFrame, column: str = "smooth_kmh") -> DataFrame:
    """Rows track_id, seq, colour: each sample between the two colours by its place on the track's scale."""
    return with_colour(speeds, column).select("track_id", "seq", "colour")


def filled_pairs(points: DataFrame, coloured_samples: DataFrame) -> DataFrame:
    """Rows track_id, seq, colour of every point: its sample's colour, else the one before, else the one after."""
    rows = points.select("track_id", "seq").join(coloured_samples, ["track_id", "seq"], "left")
    before = F.last("colour", ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("colour", ignorenulls=True).over(in_order().rowsBetween(0, Window.unboundedFollowing))
    return rows.select("track_id", "seq", F.coalesce(before, after).alias("colour"))


def chart_rows(samples: DataFrame) -> DataFrame:
    """Rows track_id, run, i, km, ele of an elevation chart, with a row of nulls before each run but the first."""
    order = Window.partitionBy("track_id").orderBy("run", "i")
    row = F.struct((F.col("d") / 1000).alias("km"), F.col("ele").alias("ele"))
    gap = F.struct(F.lit(None).cast("double").alias("km"), F.lit(None).cast("double").alias("ele"))
    parts = F.when(F.col("_was") != F.col("run"), F.array(gap, row)).otherwise(F.array(row))
    return samples.withColumn("_was", F.lag("run").over(order)).select("track_id", "run", "i", F.explode(parts).alias("x")).select("track_id", "run", "i", "x.km", "x.ele")


def slope_scale(slopes: DataFrame) -> DataFrame:
    """Rows track_id, scale_pct: 1.2 times the lower-rank 92nd percentile of steepness, 6 at least."""
    steep = slopes.filter("slope_pct is not null").withColumn("steep", F.abs("slope_pct"))
    return steep.groupBy("track_id").agg(F.greatest(F.lit(6.0), 1.2 * lower_rank("steep", 0.92)).alias("scale_pct"))


def viewport(points: DataFrame, width: int = 720, height: int = 430, padding: int = 40) -> DataFrame:
    """Rows track_id, seq, x, y: the track scaled into a drawing of width by height."""
    whole = Window.partitionBy("track_id")
    lo, hi = {c: F.min(c).over(whole) for c in ("lat", "lon")}, {c: F.max(c).over(whole) for c in ("lat", "lon")}
    place = lambda c, size: F.when(hi[c] > lo[c], (F.col(c) - lo[c]) / (hi[c] - lo[c])).otherwise(0.5) * (size - 2 * padding)
    return points.select("track_id", "seq", (padding + place("lon", width)).alias("x"), (height - padding - place("lat", height)).alias("y"))


#: The tiles in order: name, unit, the first of these columns that a summary has, and how it is written.
TILES = [
    ("distance", "m", ("total_distance_m",), values.kilometres), ("moving-time", "s", ("moving_s",), values.clock), ("stopped-time", "s", ("stopped_s",), values.clock),
    ("total-time", "s", ("total_s",), values.clock), ("average-speed", "km/h", ("average_kmh",), values.speed_text), ("moving-speed", "km/h", ("moving_kmh", "average_kmh"), values.speed_text),
    ("max-speed", "km/h", ("max_kmh",), values.speed_text), ("elevation-gain", "m", ("gain_m",), values.metres_text), ("elevation-loss", "m", ("loss_m",), values.metres_text),
    ("min-elevation", "m", ("min_ele",), values.metres_text), ("max-elevation", "m", ("max_ele",), values.metres_text), ("elevation-range", "m", ("range_m",), values.metres_text),
]


def metric_tiles(summary: DataFrame) -> DataFrame:
    """Rows track_id, metric, unit, value, text: a summary row as twelve tiles. Each takes the first column that isn't null; what
    a summary lacks is null, a dash. The range is that of the extrema where the summary has none."""
    if "range_m" not in summary.columns and {"min_ele", "max_ele"} <= set(summary.columns):
        summary = summary.withColumn("range_m", F.col("max_ele") - F.col("min_ele"))
    has = set(summary.columns)

    def value(columns: tuple[str, ...]) -> Column:
        return F.coalesce(*(F.col(c).cast("double") for c in columns if c in has), F.lit(None).cast("double"))

    one = [F.struct(F.lit(m).alias("metric"), F.lit(u).alias("unit"), value(c).alias("value"), f(value(c)).alias("text")) for m, u, c, f in TILES]
    return summary.select("track_id", F.explode(F.array(*one)).alias("t")).select("track_id", "t.*")


def period_label(points: DataFrame, language: str = "en") -> DataFrame:
    """Rows track_id, label: the track's first to last day (UTC) in words, in the language's order, shortened where year, month
    or day agree; empty without times."""
    rows = points.groupBy("track_id").agg(F.timestamp_millis(F.min("ts_ms")).alias("a"), F.timestamp_millis(F.max("ts_ms")).alias("b"))
    parts = lambda c: (F.dayofmonth(c), F.month(c), F.year(c))
    (d1, m1, y1), (d2, m2, y2) = parts("a"), parts("b")
    text, year, month = values.date_text, y1 == y2, (y1 == y2) & (m1 == m2)
    label = (
        F.when(F.col("a").isNull(), "")
        .when(month & (d1 == d2), text(d1, m1, y1, language))
        .when(month, text(F.concat_ws("-", d1, d2), m2, y2, language))
        .when(year, F.concat(text(d1, m1, None, language), F.lit(" - "), text(d2, m2, y2, language)))
        .otherwise(F.concat(text(d1, m1, y1, language), F.lit(" - "), text(d2, m2, y2, language)))
    )
    return rows.select("track_id", label.alias("label"))


def representative_point(points: DataFrame) -> DataFrame:
    """Rows track_id, seq, lat, lon, place_key of each track's middle valid point; the key rounds to four decimals."""
    whole = Window.partitionBy("track_id")
    rows = points.filter(valid(F.col("lat"), F.col("lon"))).withColumns({"k": F.row_number().over(in_order()) - 1, "n": F.count("*").over(whole)})
    return rows.filter("k = floor(n / 2)").select("track_id", "seq", "lat", "lon", F.format_string("%.4f,%.4f", "lat", "lon").alias("place_key"))


def speed_axis(speeds: DataFrame, column: str = "kmh") -> DataFrame:
    """Rows track_id, top_kmh of a speed chart: a quarter or 1 km/h above the fastest, 4 at least."""
    return speeds.groupBy("track_id").agg(F.max(column).alias("m")).select("track_id", F.greatest(1.25 * F.col("m"), F.col("m") + 1, F.lit(4.0)).alias("top_kmh"))


def midpoint_values(points: DataFrame, stops: DataFrame) -> DataFrame:
    """Rows track_id, seq, kmh of every pair of points: the value of the first stop (track_id, progress, kmh) at or beyond the
    middle of the pair, else the last stop. points has distance_m; a forward as-of look-up over one ordered union."""
    whole = Window.partitionBy("track_id")
    before = F.lag("distance_m").over(in_order())
    pairs = points.withColumns({"total": F.max("distance_m").over(whole), "_before": before}).filter("_before is not null and total > 0")
    marks = pairs.select("track_id", "seq", ((F.col("_before") + F.col("distance_m")) / 2 / F.col("total")).alias("at"), F.lit(None).cast("double").alias("kmh"), F.lit(0).alias("is_stop"))
    both = marks.union(stops.select("track_id", F.lit(None).cast("int"), "progress", "kmh", F.lit(1)))
    order = Window.partitionBy("track_id").orderBy("at", "is_stop")
    stop = F.when(F.col("is_stop") == 1, F.col("kmh"))
    ahead = F.first(stop, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    behind = F.last(stop, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("v", F.coalesce(ahead, behind)).filter("is_stop = 0").select("track_id", "seq", F.col("v").alias("kmh"))
