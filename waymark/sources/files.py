"""Track files as DataFrames: GPX and like XML, TCX and FIT."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark import ship
from waymark.functions.geo import distance
from waymark.functions.values import timestamp_ms, zone_status
from waymark.sources.parse import parse

POINT = "seq: int, lat: double, lon: double, ele: double, time_text: string, ts_ms: bigint, segment: int, ele_source: string, fix: string, satellites: int, hdop: double, vdop: double, pdop: double, phys: int, speed_mps: double, cadence: double, watts: double, datum: string, geoid_m: double, extensions: array<string>"
FILE = f"track_id string, bytes long, format string, error string, name string, activity string, activity_kind string, activity_source string, summary map<string,double>, timer array<struct<ts_ms: bigint, action: string>>, extensions struct<gpx: array<string>, metadata: array<string>, tracks: array<string>>, points array<struct<{POINT}>>"
#: What a point doesn't state, and what of a parsed file becomes columns as it is.
UNSTATED = {"ts_ms": None, "fix": None, "satellites": None, "hdop": None, "vdop": None, "pdop": None, "speed_mps": None, "cadence": None, "watts": None, "datum": None, "geoid_m": None, "extensions": None}
KEPT = ("format", "error", "name", "activity", "activity_kind", "activity_source", "timer", "extensions")
#: Bytes from which a file draws a warning.
LARGE = 50 * 1024 * 1024


def file_row(where: str, size: int, content: bytes) -> dict:
    """A file as a row of FILE."""
    r = parse(where, content)
    return {"track_id": where, "bytes": size, "summary": list(r["summary"].items()), "points": [UNSTATED | {"seq": k} | p for k, p in enumerate(r["points"], 1)]} | {k: r[k] for k in KEPT}


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row for each file below path, parsed in tasks; a file that can't be read has an error and no points."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(FILE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, size, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                yield pa.RecordBatch.from_pylist([file_row(where, size, content)], schema=arrow)

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content").mapInArrow(run, FILE)


def points_of(files: DataFrame) -> DataFrame:
    """The points of read_files, with times read and placeholders removed: zero-filled elevations of a file, times that don't
    advance in a segment, and those made up at an even pace."""
    return without_synthetic_times(without_flat_times(without_zero_elevations(stated_points(files))))


def stated_points(files: DataFrame) -> DataFrame:
    """The points of read_files with times read, as the files state them."""
    rows = files.select("track_id", F.inline("points")).drop("extensions")
    return rows.withColumns({"zone": zone_status(F.col("time_text")), "ts_ms": F.coalesce("ts_ms", timestamp_ms(F.col("time_text")))})


def raw_extensions(files: DataFrame) -> DataFrame:
    """Rows track_id, level (gpx, metadata, tracks, point), seq (of a point, else null), k, fragment: the elements in each
    level's own extensions, each as a document of its own that declares its namespaces."""
    of_file = [files.select("track_id", F.lit(c).alias("level"), F.lit(None).cast("int").alias("seq"), F.posexplode(f"extensions.{c}").alias("k", "fragment")) for c in ("gpx", "metadata", "tracks")]
    of_points = files.select("track_id", F.lit("point").alias("level"), F.explode("points").alias("p")).select("track_id", "level", "p.seq", F.posexplode("p.extensions").alias("k", "fragment"))
    return of_file[0].union(of_file[1]).union(of_file[2]).union(of_points)


def sensor_coverage(files: DataFrame) -> DataFrame:
    """Rows track_id, n_points, n_speed, n_cadence, n_watts, n_any: how many points state what a sensor measured."""
    has = {c: F.col(f"p.{c}").isNotNull() for c in ("speed_mps", "cadence", "watts")}
    counts = [F.count(F.when(t, 1)).alias(f"n_{c.removesuffix('_mps')}") for c, t in has.items()]
    either = F.count(F.when(has["speed_mps"] | has["cadence"] | has["watts"], 1)).alias("n_any")
    return files.select("track_id", F.explode("points").alias("p")).groupBy("track_id").agg(F.count("*").alias("n_points"), *counts, either)


def normalisations(files: DataFrame) -> DataFrame:
    """Rows track_id, kind, n_points: what points_of took out of the files' statements, and heights that the parser lowered
    from the ellipsoid to the sea."""
    rows = with_synthetic_times(with_flat_times(with_zero_elevations(stated_points(files))))
    kinds = {"zero_filled_elevation_placeholder": "_filled", "flat_timestamp_placeholder": "_flat", "synthetic_timestamp_placeholder": "_synthetic"}
    kinds["ellipsoid_to_msl"] = F.col("geoid_m").isNotNull()
    counts = rows.groupBy("track_id").agg(*(F.count(F.when(F.col(c) if isinstance(c, str) else c, 1)).alias(k) for k, c in kinds.items()))
    return counts.unpivot("track_id", list(kinds), "kind", "n_points").filter("n_points > 0")


def _segments(points: DataFrame) -> str:
    return "phys" if "phys" in points.columns else "segment"


def with_synthetic_times(points: DataFrame) -> DataFrame:
    """_synthetic: the times of the point's physical segment are made up. It has six pairs or more with a positive interval,
    four fifths of them within a tenth (or 1 s) of their upper median, which is 15 s at most, and speeds above 100 m/s in
    six pairs, or in three fifths: without lone points out and back, whose neighbours and direct way are slower."""
    part = _segments(points)
    order = Window.partitionBy("track_id", part).orderBy("seq")
    before = {c: F.lag(c).over(order) for c in ("seq", "ts_ms", "lat", "lon")}
    pairs = points.select(
        "track_id", part, "seq", "lat", "lon", *(before[c].alias(f"p_{c}") for c in ("seq", "lat", "lon")),
        ((F.col("ts_ms") - before["ts_ms"]) / 1000.0).alias("s"), distance(before["lat"], before["lon"], F.col("lat"), F.col("lon")).alias("m"),
    ).filter("s > 0").withColumn("v", F.try_divide("m", "s"))
    ahead = {c: F.lead(c).over(order) for c in ("p_seq", "v", "s", "lat", "lon")}
    direct = F.try_divide(distance(F.col("p_lat"), F.col("p_lon"), ahead["lat"], ahead["lon"]), F.col("s") + ahead["s"])
    calm = lambda c: F.coalesce(c <= 100, F.lit(True))
    out = (ahead["p_seq"] == F.col("seq")) & (F.col("v") > 100) & (ahead["v"] > 100) & (direct <= 100) & calm(F.lag("v").over(order)) & calm(F.lead("v", 2).over(order))
    pairs = pairs.withColumn("out", F.coalesce(out, F.lit(False))).withColumn("spike", F.col("out") | F.coalesce(F.lag("out").over(order), F.lit(False)))
    rows = pairs.groupBy("track_id", part).agg(F.sort_array(F.collect_list("s")).alias("all"), F.count(F.when(~F.col("spike"), 1)).alias("left"), F.count(F.when(~F.col("spike") & (F.col("v") > 100), 1)).alias("fast"))
    rows = rows.withColumn("mid", F.get("all", F.floor(F.size("all") / 2).cast("int")))
    even = F.size(F.filter("all", lambda x: F.abs(x - F.col("mid")) <= F.greatest(F.lit(1.0), 0.1 * F.col("mid")))) >= 0.8 * F.size("all")
    flagged = rows.filter((F.size("all") >= 6) & (F.col("mid") <= 15) & even & (F.col("left") > 0) & ((F.col("fast") >= 6) | (F.col("fast") >= 0.6 * F.col("left"))))
    return points.join(flagged.select("track_id", part, F.lit(True).alias("_synthetic")), ["track_id", part], "left").withColumn("_synthetic", F.coalesce("_synthetic", F.lit(False)))


def without_synthetic_times(points: DataFrame) -> DataFrame:
    """The points, with made-up times (with_synthetic_times) null and their zone none."""
    rows = with_synthetic_times(points).withColumn("ts_ms", F.when(~F.col("_synthetic"), F.col("ts_ms")))
    if "zone" in points.columns:
        rows = rows.withColumn("zone", F.when(F.col("_synthetic"), "none").otherwise(F.col("zone")))
    return rows.select(*points.columns)


def with_zero_elevations(points: DataFrame) -> DataFrame:
    """_filled: the point's elevation stands for none. Its track has 20 or more, 95 % of them within 0.01 m of 0, up to 3 %
    aren't, and one of these is 20 m off or more."""
    whole = Window.partitionBy("track_id")
    off = F.abs("ele") > 0.01
    n, zero, odd = F.count("ele").over(whole), F.count(F.when(~off, 1)).over(whole), F.count(F.when(off, 1)).over(whole)
    filled = (n >= 20) & (zero >= 0.95 * n) & (odd > 0) & (odd <= 0.03 * n) & (F.max(F.abs("ele")).over(whole) >= 20)
    return points.withColumn("_filled", F.coalesce(filled & F.col("ele").isNotNull(), F.lit(False)))


def without_zero_elevations(points: DataFrame) -> DataFrame:
    """The points, with elevations that stand for none (with_zero_elevations) null."""
    return with_zero_elevations(points).withColumn("ele", F.when(~F.col("_filled"), F.col("ele"))).drop("_filled")


def with_flat_times(points: DataFrame) -> DataFrame:
    """_flat: the point's physical segment has two times or more, and all are equal."""
    whole = Window.partitionBy("track_id", _segments(points))
    flat = (F.count("ts_ms").over(whole) >= 2) & (F.min("ts_ms").over(whole) == F.max("ts_ms").over(whole))
    return points.withColumn("_flat", F.coalesce(flat & F.col("ts_ms").isNotNull(), F.lit(False)))


def without_flat_times(points: DataFrame) -> DataFrame:
    """The points, with times that don't advance (with_flat_times) null and their zone none."""
    rows = with_flat_times(points).withColumn("ts_ms", F.when(~F.col("_flat"), F.col("ts_ms")))
    if "zone" in points.columns:
        rows = rows.withColumn("zone", F.when(F.col("_flat"), "none").otherwise(F.col("zone")))
    return rows.drop("_flat")


def tracks_of(files: DataFrame, points: DataFrame) -> DataFrame:
    """Rows track_id, format, error, name, activity, counts, elevation_source, errors, warnings of each file."""
    order = F.create_map(*(F.lit(x) for kv in {"barometric": 4, "terrain": 3, "gpx": 2, "none": 1}.items() for x in kv))
    per = points.groupBy("track_id").agg(
        F.count("*").alias("n_points"), F.countDistinct("segment").alias("n_segments"), F.count("ele").alias("n_ele"), F.count("ts_ms").alias("n_timed"), F.max_by("ele_source", order[F.col("ele_source")]).alias("elevation_source")
    )
    n = F.coalesce("n_points", F.lit(0))
    flag = lambda test, name: F.when(test, F.lit(name))
    errors: Column = F.array_compact(F.array(F.col("error"), flag(n == 0, "no_points"), flag(n == 1, "one_point")))
    warnings: Column = F.array_compact(
        F.array(flag((n > 0) & (F.coalesce("n_ele", F.lit(0)) == 0), "missing_elevation"), flag((n > 0) & (F.coalesce("n_timed", F.lit(0)) == 0), "missing_time"), flag(F.col("elevation_source") == "terrain", "terrain_elevation"), flag(F.col("bytes") >= LARGE, "large_file"))
    )
    return files.drop("points").join(per, "track_id", "left").withColumns({"errors": errors, "warnings": warnings, "n_points": n, "n_segments": F.greatest(F.lit(1), F.coalesce("n_segments", F.lit(1)))})


def apply_terrain(points: DataFrame, terrain: DataFrame) -> DataFrame:
    """Points with every elevation replaced by terrain (track_id, seq, terrain_ele), for tracks that it covers whole."""
    whole = Window.partitionBy("track_id")
    rows = points.join(terrain, ["track_id", "seq"], "left").withColumn("_all", F.count("terrain_ele").over(whole) == F.count("*").over(whole))
    return rows.withColumns({"ele": F.when(F.col("_all"), F.col("terrain_ele")).otherwise(F.col("ele")), "ele_source": F.when(F.col("_all"), "terrain").otherwise(F.col("ele_source"))}).drop("_all", "terrain_ele")


#: The numbers that a stated summary may have.
STATED = ("total_distance_m", "total_distance_3d_m", "total_s", "moving_s", "stopped_s", "average_kmh", "moving_kmh", "max_kmh", "gain_m", "loss_m", "min_ele", "max_ele", "range_m")


def stated_summary(files: DataFrame) -> DataFrame:
    """Rows track_id and the columns of STATED, from files with summary (a map): what a file states, and what follows from
    that. Stopped is total less moving time, averages are distance by time, the range lies between the extrema."""
    rows = files.select("track_id", *(F.try_element_at("summary", F.lit(c)).alias(c) for c in STATED))
    rows = rows.select("track_id", *(F.when(F.abs(c) < float("inf"), F.col(c)).alias(c) for c in STATED))
    kmh = lambda s: F.when((F.col("total_distance_m") > 0) & (F.col(s) > 0), F.try_divide("total_distance_m", s) * 3.6)
    least0 = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), c))
    return rows.withColumns(
        {
            "stopped_s": F.coalesce(least0(F.col("stopped_s")), least0(F.col("total_s") - F.col("moving_s"))), "average_kmh": F.coalesce("average_kmh", kmh("total_s")), "moving_kmh": F.coalesce("moving_kmh", kmh("moving_s")),
            "range_m": F.coalesce(least0(F.col("range_m")), least0(F.col("max_ele") - F.col("min_ele"))),
        }
    )


def with_imported(summary: DataFrame, files: DataFrame) -> DataFrame:
    """The computed summary with what a file states, or what follows from it, put over it, and imported: the names of the
    fields that the file has."""
    named = files.select("track_id", F.coalesce(F.map_keys("summary"), F.array().cast("array<string>")).alias("imported"))
    fields = [c for c, t in summary.dtypes if t == "double" and c in STATED]
    stated = stated_summary(files).select("track_id", *(F.col(c).alias(f"_{c}") for c in fields))
    rows = summary.join(stated, "track_id", "left").join(named, "track_id", "left")
    return rows.withColumns({c: F.coalesce(f"_{c}", c) for c in fields} | {"imported": F.coalesce("imported", F.array().cast("array<string>"))}).drop(*(f"_{c}" for c in fields))
