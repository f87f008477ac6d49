"""Colour stops along a track's line, by way or by point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import distance
from waymark.functions.stats import half_up
from waymark.operators.continuity import in_order
from waymark.operators.present import coloured, with_colour

#: Metres by which neighbouring samples may miss each other, samples and stops that a gradient has at least.
MISS_M, LEAST = 1.0, 2


def stops(rows: DataFrame, least: int = 0) -> DataFrame:
    """Rows track_id, progress, colour from rows in the order k: from the first colour at 0 to the last at 1; of rows with
    equal progress, rounded to a millionth, the last counts. Tracks with fewer than ``least`` stops have none."""
    whole = Window.partitionBy("track_id")
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("progress"))), 6)))
    rows = rows.withColumns({"at": at, "last": F.max("k").over(whole), "first": F.min("k").over(whole)})
    # the first row also stands at 0 and the last at 1, where no row of their own does
    ends = F.array_compact(F.array(F.when(F.col("k") == F.col("first"), F.struct(F.lit(0.0).alias("progress"), F.lit(0).alias("own"))), F.struct(F.col("at").alias("progress"), F.lit(1).alias("own")), F.when((F.col("k") == F.col("last")) & (F.col("at") < 1), F.struct(F.lit(1.0).alias("progress"), F.lit(2).alias("own")))))
    spread = rows.select("track_id", "k", "colour", F.inline(ends))
    out = spread.groupBy("track_id", "progress").agg(F.max_by("colour", F.struct("k", "own")).alias("colour"))
    return out.withColumn("_n", F.count("*").over(whole)).filter(F.col("_n") >= least).drop("_n")


def usable(speeds: DataFrame, column: str) -> Column:
    return (F.abs(column) < float("inf")) & (F.col(column) >= 0) & (F.col("seq") > 1)


def stops_by_way(speeds: DataFrame, totals: DataFrame | None = None, column: str = "smooth_kmh") -> DataFrame:
    """Rows track_id, progress, colour: each sample's colour at its end's share of the way.

    Only tracks whose samples cover the whole line: they begin at 0, each begins where the one before ended, and the last ends
    at the total (rows track_id, total_m; else the last sample's end), all within a metre. One pair misfitting, such as a
    gap or an overlap, and the track has no stops; nor has one with fewer than two samples or one speed only."""
    rows = speeds.filter(usable(speeds, column) & (F.col("metres") > 0)).withColumn("start_m", F.col("distance_m") - F.col("metres")).filter("start_m >= 0 and distance_m > start_m")
    order = Window.partitionBy("track_id").orderBy("distance_m", "seq")
    rows = rows.withColumns({"k": F.row_number().over(order), "before_m": F.coalesce(F.lag("distance_m").over(order), F.lit(0.0))})
    if totals is not None:
        rows = rows.join(totals.select("track_id", "total_m"), "track_id", "left")
    whole = Window.partitionBy("track_id")
    end = F.max("distance_m").over(whole)
    total = F.when(F.col("total_m") > 0, F.col("total_m")) if totals is not None else F.lit(None).cast("double")
    rows = rows.withColumns({"end_m": end, "total_m": F.coalesce(total, end), "fits": F.abs(F.col("start_m") - F.col("before_m")) <= MISS_M})
    rows = rows.withColumns({"whole": F.bool_and("fits").over(whole), "n": F.count("*").over(whole)}).filter((F.col("n") >= LEAST) & F.col("whole") & (F.abs(F.col("end_m") - F.col("total_m")) <= MISS_M) & (F.col("total_m") > 0))
    rows = rows.select("track_id", "seq", "k", column, (F.col("distance_m") / F.col("total_m")).alias("progress"))
    return stops(with_colour(rows, column))


def stops_by_point(points: DataFrame, speeds: DataFrame, column: str = "smooth_kmh") -> DataFrame:
    """Rows track_id, progress, colour: each sample's colour at its point's share of the line as drawn, which runs across gaps
    and segments; a line without length counts points instead. Tracks of one point, of one speed or with one stop have none."""
    whole = Window.partitionBy("track_id")
    step = distance(F.lag("lat").over(in_order()), F.lag("lon").over(in_order()), F.col("lat"), F.col("lon"))
    line = points.withColumns({"_k": F.row_number().over(in_order()) - 1, "_n": F.count("*").over(whole), "_step": F.coalesce(step, F.lit(0.0))}).filter("_n >= 2")
    line = line.withColumn("_d", F.sum("_step").over(in_order().rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.max("_d").over(whole))
    progress = F.when(F.col("_total") > 0, F.try_divide("_d", "_total")).otherwise(F.col("_k") / (F.col("_n") - 1))
    samples = speeds.filter(usable(speeds, column)).select("track_id", "seq", column)
    rows = line.select("track_id", "seq", progress.alias("progress")).join(samples, ["track_id", "seq"])
    return stops(rows.withColumn("k", F.col("seq")).join(coloured(samples, column), ["track_id", "seq"]), LEAST)
