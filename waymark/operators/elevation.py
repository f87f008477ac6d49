"""Elevation: runs, trust in sources, even resampling, outliers, smoothing, confirmed gain and loss, extrema, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.stats import lower_of, nearest_rank, upper_rank
from waymark.operators.continuity import in_order, run_order, whole_run, with_gaps
from waymark.operators.tails import without_sparse_tails

#: Metres between samples, least turn in metres and metres it must last, by activity.
ACTIVITIES = {"foot": (5, 3, 20), "bike": (10, 4, 30), "water": (10, 15, 300), "motor": (20, 6, 80), "route_plan": (10, 6, 40), "unknown": (10, 5, 40)}
#: Sigmas that a turn must exceed, by source.
ALPHA = {"barometric": 2.0, "terrain": 4.0, "gpx": 3.0, "unknown": 3.0}
#: Fixed value: the scale from a median absolute deviation to a standard deviation.
MAD = 1.4826
#: The rise in metres across a declared gap that breaks a run.
GAP_RISE = 60.0


def runs(points: DataFrame) -> DataFrame:
    """The points with an elevation, with run: one more after a missing elevation, a change of segment or of ele_source,
    and a rise of 60 m or more across a gap; and i, the place in the run from 1."""
    rows = points if "is_gap" in points.columns else with_gaps(points)
    source = F.coalesce("ele_source", F.lit("unknown")) if "ele_source" in points.columns else F.lit("unknown")
    rows = rows.withColumn("ele_source", source)
    before = F.lag("ele").over(in_order())
    cut = before.isNull() | ~F.col("same_segment") | (F.lag("ele_source").over(in_order()) != F.col("ele_source")) | (F.col("is_gap") & (F.abs(F.col("ele") - before) >= GAP_RISE))
    flagged = rows.withColumn("_cut", F.when(F.coalesce(cut, F.lit(True)), 1).otherwise(0)).filter("ele is not null")
    return flagged.withColumn("run", F.sum("_cut").over(in_order()).cast("int")).drop("_cut").withColumn("i", F.row_number().over(Window.partitionBy("track_id", "run").orderBy("seq")))


def raw_extrema(points: DataFrame) -> DataFrame:
    finite = F.when(F.abs("ele") < float("inf"), F.col("ele"))
    return points.groupBy("track_id").agg(F.min(finite).alias("min_ele"), F.max(finite).alias("max_ele"), F.count(finite).alias("n_ele"))


def source_trust(points: DataFrame, run_points: DataFrame | None = None) -> DataFrame:
    """Rows track_id, ele_source, n_pairs, p75_delta, p95_delta, median_m, p95_grade, p95_vertical_mps (nearest rank, over pairs
    within runs that are no gaps), change_ratio (sum of changes over the sum of the runs' ranges; null without range),
    noisy, drifts, spikes, abs_trust, rel_trust.

    A source is noisy if a pair rises 8 m or more at a grade of 0.35 or at 1.2 m/s; if dense pairs (80 m at the median)
    chatter; or, unless it is barometric, if its changes are twelve times its range. A barometric run drifts if it climbs
    or falls slowly and steadily, and spikes if its steps are large. run_points: the points' runs, where they are known.
    """
    rows = runs(points) if run_points is None else run_points
    rows = rows.withColumn("delta", F.when(~F.col("is_gap"), F.abs(F.col("ele") - F.lag("ele").over(run_order()))))
    rows = rows.withColumn("apart", F.when(F.col("delta").isNotNull() & (F.col("metres") > 0), F.col("metres")))
    rows = rows.withColumns({"grade": F.try_divide("delta", "apart"), "vertical": F.when(F.col("dt") > 0, F.try_divide("delta", "dt"))})
    by_run = rows.groupBy("track_id", "ele_source", "run").agg(
        F.count("*").alias("n"), (F.max("ele") - F.min("ele")).alias("range"), F.abs(F.max_by("ele", "i") - F.min_by("ele", "i")).alias("net"),
        F.sum("delta").alias("raw"), nearest_rank("delta", 0.75).alias("p75"), nearest_rank("delta", 0.95).alias("p95"),
    )
    trend = (F.col("n") >= 4) & (F.col("range") >= 8) & (F.col("p95") < 2) & (F.col("net") >= 0.85 * F.col("raw")) & (F.col("raw") > 0)
    shape = by_run.groupBy("track_id", "ele_source").agg(
        F.sum("range").alias("range"), F.coalesce(F.bool_or(trend), F.lit(False)).alias("drifts"), F.coalesce(F.bool_or((F.col("p75") >= 2) | (F.col("p95") >= 8)), F.lit(False)).alias("spikes")
    )
    wild = (F.col("delta") >= 8) & (F.coalesce(F.col("grade") >= 0.35, F.lit(False)) | F.coalesce(F.col("vertical") >= 1.2, F.lit(False)))
    pairs = rows.groupBy("track_id", "ele_source").agg(
        F.count("delta").alias("n_pairs"), nearest_rank("delta", 0.75).alias("p75_delta"), nearest_rank("delta", 0.95).alias("p95_delta"), nearest_rank("apart", 0.5).alias("median_m"),
        nearest_rank("grade", 0.95).alias("p95_grade"), nearest_rank("vertical", 0.95).alias("p95_vertical_mps"), F.coalesce(F.sum("delta"), F.lit(0.0)).alias("raw"), F.coalesce(F.bool_or(wild), F.lit(False)).alias("wild"),
    )
    out = pairs.join(shape, ["track_id", "ele_source"]).withColumn("change_ratio", F.when(F.col("range") > 0, F.try_divide("raw", "range")))
    source = F.col("ele_source")
    dense = F.coalesce(F.col("median_m"), F.lit(0.0)) <= 80
    steep = F.coalesce(F.col("p95_grade") >= 0.18, F.lit(False))
    chatter = dense & F.coalesce((F.col("p75_delta") >= 2) | (F.col("p95_delta") >= 8), F.lit(False)) & (steep | F.coalesce(F.col("p95_vertical_mps") >= 0.5, F.lit(False)))
    churns = (source != "barometric") & F.when(F.col("range") > 0, F.col("change_ratio") >= 12).otherwise(F.col("raw") > 0) & (dense | steep)
    out = out.withColumn("noisy", F.col("wild") | chatter | churns)
    noisy = F.col("noisy")
    shaky = noisy | F.col("drifts") | F.coalesce((F.col("range") > 0) & (F.col("range") <= 1) & (F.col("change_ratio") >= 8), F.lit(False))
    none = F.col("n_pairs") < 1
    absolute = F.when(none, 0.0).when(source == "barometric", F.when(shaky, 0.35).otherwise(0.55)).when(source == "terrain", 0.78).when(source == "gpx", F.when(noisy, 0.35).otherwise(0.55)).otherwise(F.when(noisy, 0.25).otherwise(0.45))
    relative = F.when(none, 0.0).when(source == "barometric", F.when(F.col("spikes"), 0.55).otherwise(0.9)).when(source == "terrain", F.when(noisy, 0.25).otherwise(0.45)).when(source == "gpx", F.when(noisy, 0.25).otherwise(0.6)).otherwise(F.when(noisy, 0.2).otherwise(0.5))
    return out.withColumns({"abs_trust": absolute, "rel_trust": relative}).drop("raw", "range", "wild")


def primary_source(trust: DataFrame, key: str = "rel_trust") -> DataFrame:
    """Rows track_id, ele_source, trust: the most trusted source, of equals the first of barometric, terrain, gpx, unknown;
    no row where none is trusted at all."""
    rank = F.array_position(F.array(*map(F.lit, ("barometric", "terrain", "gpx", "unknown"))), F.col("ele_source"))
    best = trust.filter(F.col(key) > 0).groupBy("track_id").agg(F.min_by(F.struct("ele_source", key), F.struct(-F.col(key), rank)).alias("b"))
    return best.select("track_id", "b.ele_source", F.col(f"b.{key}").alias("trust"))


def activity(points: DataFrame) -> DataFrame:
    """Rows track_id, n_timed, median_kmh, p95_kmh (nearest rank, of pairs with a way; without jitter, where that is known),
    net_ele, raw_ele (sums of signed and absolute changes between neighbours, but across rises of 60 m in a gap),
    directional (their ratio), descent_m (falls of pairs with a speed), activity, confidence, reason.

    The column explicit_kind of the points counts first, where there is one and it names one of foot, bike, water and motor.
    A track without times is a plan. A slow descent of more than 80 m is on water if it goes mostly down, or if its changes
    are four times what it descends, as noise on a river's are. All else goes by speed."""
    rows = points if "is_gap" in points.columns else with_gaps(points)
    counts = F.col("same_segment") & (F.col("dt") > 0) & ~F.col("is_gap") & (F.col("metres") > 0)
    if "is_jitter" in rows.columns:
        counts = counts & ~F.col("is_jitter")
    kmh = F.when(counts, F.col("metres") / F.col("dt") * 3.6)
    step = F.col("ele") - F.lag("ele").over(in_order())
    step = F.when(F.col("same_segment") & ~(F.col("is_gap") & (F.abs(step) >= GAP_RISE)), step)
    stated = F.max(F.when(F.col("explicit_kind").isin("foot", "bike", "water", "motor"), F.col("explicit_kind"))) if "explicit_kind" in rows.columns else F.lit(None).cast("string")
    total = lambda c: F.round(F.sum(c), 6)
    falls = F.when(F.col("step").isNotNull(), F.when((F.col("step") < 0) & F.col("kmh").isNotNull(), -F.col("step")).otherwise(0.0))
    out = rows.withColumns({"kmh": kmh, "step": step}).groupBy("track_id").agg(
        F.count("ts_ms").alias("n_timed"), nearest_rank("kmh", 0.5).alias("median_kmh"), nearest_rank("kmh", 0.95).alias("p95_kmh"), total("step").alias("net_ele"), total(F.abs("step")).alias("raw_ele"),
        total(falls).alias("descent_m"), stated.alias("_stated"),
    )
    out = out.withColumn("directional", F.try_divide(F.abs("net_ele"), "raw_ele"))
    sinks = (F.col("net_ele") < -80) & (F.col("descent_m") > 80) & (F.col("median_kmh") <= 8) & (F.col("p95_kmh") <= 18)
    noisy = (F.col("directional") < 0.75) & (F.col("raw_ele") >= 4 * F.abs("net_ele"))
    verdict = lambda kind, confidence, reason: F.struct(F.lit(kind).alias("activity"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))
    found = (
        F.when(F.col("_stated").isNotNull(), F.struct(F.col("_stated").alias("activity"), F.lit(0.95).alias("confidence"), F.lit("explicit_activity").alias("reason")))
        .when(F.col("n_timed") < 2, verdict("route_plan", 0.75, "no_timestamps"))
        .when(sinks & (F.col("directional") >= 0.75), verdict("water", 0.7, "sustained_directional_descent"))
        .when(sinks & noisy, verdict("water", 0.62, "noisy_sustained_descent"))
        .when((F.col("median_kmh") >= 35) | (F.col("p95_kmh") >= 70), verdict("motor", 0.72, "motor_speed"))
        .when((F.col("median_kmh") >= 8) | (F.col("p95_kmh") >= 18), verdict("bike", 0.68, "bike_speed"))
        .when(F.col("median_kmh") > 0, verdict("foot", 0.66, "foot_speed"))
        .otherwise(verdict("unknown", 0.35, "insufficient_motion_signal"))
    )
    return out.withColumn("_found", found).select("*", "_found.*").drop("_found", "_stated")


def without_raw_outliers(run_points: DataFrame) -> DataFrame:
    """The runs with raw_outlier (first, last, interior or null), and ele replaced there, before anything is resampled.

    An end goes to the lower median of its three neighbours (two at least) that lie within half the floor, if it is off by
    more than max(4 floor, 50 m), and the way to it is too steep (0.35, or 1.2 m/s) or has neither length nor time. A point
    inside goes to that of the two on either side, if these lie within max(1 m, the step across it) and it is off them and
    both neighbours by more than max(60 m, 4 floor), and by four times that step. The floor is hampel's."""
    w = run_order()
    n = F.max("i").over(whole_run())
    floor = F.least(F.lit(12.0), F.greatest(F.lit(4.0), 0.15 * (F.max("ele").over(whole_run()) - F.min("ele").over(whole_run()))))
    names = {f"_{side}{k}": f("ele", k).over(w) for side, f in (("back", F.lag), ("ahead", F.lead)) for k in (1, 2, 3)}
    rows = run_points.withColumns(names | {"_n": n, "_floor": floor, "_next_m": F.lead("metres").over(w), "_next_s": F.lead("dt").over(w)})
    is_first, ele = F.col("i") == 1, F.col("ele")
    near = F.sort_array(F.array_compact(F.when(is_first, F.array(*(f"_ahead{k}" for k in (1, 2, 3)))).otherwise(F.array(*(f"_back{k}" for k in (1, 2, 3))))))
    rows = rows.withColumns({"_near": near, "_way": F.when(is_first, F.col("_next_m")).otherwise(F.col("metres")), "_time": F.abs(F.when(is_first, F.col("_next_s")).otherwise(F.col("dt")))})
    rows = rows.withColumn("_end", lower_of(F.col("_near"), 0.5)).withColumn("_off", F.abs(ele - F.col("_end")))
    step = F.greatest(F.abs(ele - F.when(is_first, F.col("_ahead1")).otherwise(F.col("_back1"))), F.col("_off"))
    grade, climb = F.when(F.col("_way") > 0, F.try_divide(step, "_way")), F.when(F.col("_time") > 0, F.try_divide(step, "_time"))
    steep = F.coalesce(grade >= 0.35, F.lit(False)) | F.coalesce(climb >= 1.2, F.lit(False)) | (grade.isNull() & climb.isNull())
    calm = (F.size("_near") >= 2) & (F.element_at("_near", -1) - F.get("_near", F.lit(0)) <= F.col("_floor") / 2)
    end = (F.col("_n") >= 3) & (is_first | (F.col("i") == F.col("_n"))) & calm & steep & (F.col("_off") > F.greatest(4 * F.col("_floor"), F.lit(50.0)))
    four = F.sort_array(F.array("_back2", "_back1", "_ahead1", "_ahead2"))
    across, least = F.abs(F.col("_back1") - F.col("_ahead1")), F.greatest(F.lit(60.0), 4 * F.col("_floor"))
    alone = (F.abs(ele - four[1]) > least) & (F.abs(ele - F.col("_back1")) > least) & (F.abs(ele - F.col("_ahead1")) > least) & (F.abs(ele - four[1]) > 4 * across)
    inside = (F.col("i") >= 3) & (F.col("i") <= F.col("_n") - 2) & (four[3] - four[0] <= F.greatest(F.lit(1.0), across)) & alone
    kind = F.when(F.coalesce(end, F.lit(False)), F.when(is_first, "first").otherwise("last")).when(F.coalesce(inside, F.lit(False)), "interior")
    rows = rows.withColumn("raw_outlier", kind)
    new = F.when(F.col("raw_outlier") == "interior", four[1]).when(F.col("raw_outlier").isNotNull(), F.col("_end")).otherwise(ele)
    return rows.withColumn("ele", new).select(*run_points.columns, "raw_outlier")


def resample(run_points: DataFrame, step_m: float | Column = 10.0) -> DataFrame:
    """Rows track_id, run, i, d, ele: each run at d = 0, step, 2 step, ... and its full length, elevations interpolated by
    distance. A run without length gives its last point. Each interval between points is exploded into the marks that it
    holds, so no range join is needed."""
    pair = F.when(F.col("i") > 1, F.col("metres")).otherwise(0.0)
    run_points = run_points.withColumn("_step", F.lit(step_m).cast("double"))
    rows = run_points.withColumn("d", F.sum(pair).over(run_order().rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"d0": F.lag("d").over(run_order()), "e0": F.lag("ele").over(run_order()), "total": F.max("d").over(whole_run()), "n": F.max("i").over(whole_run())})
    first = F.ceil(F.col("d0") / F.col("_step"))
    last = F.ceil(F.col("d") / F.col("_step")) - 1
    marks = F.when(last >= first, F.transform(F.sequence(first, last), lambda k: k * F.col("_step")))
    inner = rows.filter("d > d0").select("track_id", "run", "d0", "d", "e0", "ele", F.explode(marks).alias("at"))
    inner = inner.filter("at < d").select("track_id", "run", F.col("at").alias("d"), (F.col("e0") + (F.col("ele") - F.col("e0")) * (F.col("at") - F.col("d0")) / (F.col("d") - F.col("d0"))).alias("ele"))
    ends = rows.filter("i = n").select("track_id", "run", F.col("total").alias("d"), "ele")
    grid = inner.filter("d >= 0").union(ends)
    return grid.withColumn("i", F.row_number().over(Window.partitionBy("track_id", "run").orderBy("d"))).select("track_id", "run", "i", "d", "ele")


def hampel(samples: DataFrame) -> DataFrame:
    """The samples with clean: inside a run, a sample farther from the median of seven than max(floor, 3 sigma) becomes the
    mean of its neighbours; where sigma is 0 it must also differ from both of them by more than the floor. The floor is
    0.15 of the run's range, from 4 to 12 m."""
    near = F.collect_list("ele").over(run_order().rowsBetween(-3, 3))
    rows = samples.withColumns({"near": near, "n": F.max("i").over(whole_run()), "floor": F.least(F.lit(12.0), F.greatest(F.lit(4.0), 0.15 * (F.max("ele").over(whole_run()) - F.min("ele").over(whole_run())))), "left": F.lag("ele").over(run_order()), "right": F.lead("ele").over(run_order())})
    rows = rows.withColumn("mid", lower_of(F.col("near"), 0.5))
    rows = rows.withColumn("sigma", MAD * lower_of(F.transform("near", lambda x: F.abs(x - F.col("mid"))), 0.5))
    off = F.abs(F.col("ele") - F.col("mid"))
    alone = (F.abs(F.col("ele") - F.col("left")) > F.col("floor")) & (F.abs(F.col("ele") - F.col("right")) > F.col("floor"))
    outlier = (F.col("i") > 1) & (F.col("i") < F.col("n")) & F.when(F.col("sigma") > 0, off > F.greatest("floor", 3 * F.col("sigma"))).otherwise((off > F.col("floor")) & alone)
    return rows.withColumn("clean", F.when(outlier, (F.col("left") + F.col("right")) / 2).otherwise(F.col("ele"))).select(*samples.columns, "clean")


def smooth(samples: DataFrame, radius: int = 1, column: str = "clean") -> DataFrame:
    """The samples with smooth: the mean of ``radius`` samples on either side (2 where the column is_terrain is true), ends
    as they are."""
    rows = samples.withColumn("n", F.max("i").over(whole_run()))
    mean = F.avg(column).over(run_order().rowsBetween(-radius, radius))
    if "is_terrain" in samples.columns:
        mean = F.when(F.col("is_terrain"), F.avg(column).over(run_order().rowsBetween(-2, 2))).otherwise(mean)
    return rows.withColumn("smooth", F.when((F.col("i") == 1) | (F.col("i") == F.col("n")), F.col(column)).otherwise(mean)).drop("n")


def local_sigma(samples: DataFrame, column: str = "smooth") -> DataFrame:
    """The samples with sigma: 1.4826 times the lower median of the absolute deviations of steps within five samples."""
    rows = samples.withColumn("step", F.abs(F.col(column) - F.lag(column).over(run_order())))
    rows = rows.withColumn("steps", F.collect_list("step").over(run_order().rowsBetween(-5, 5)))
    mid = lower_of(F.col("steps"), 0.5)
    rows = rows.withColumn("mid", mid)
    return rows.withColumn("sigma", F.coalesce(MAD * lower_of(F.transform("steps", lambda x: F.abs(x - F.col("mid"))), 0.5), F.lit(0.0))).drop("step", "steps", "mid")


def turns_of_runs(samples: DataFrame, base_m: float | Column, alpha: float | Column, sustain_m: float | Column, column: str) -> DataFrame:
    """Rows track_id, run, turns: (i, d, ele) of a run's first sample and of each confirmed extreme. A direction holds once the
    way from the anchor, and a turn once the way back from the extreme, reaches max(base, alpha sigma) in height and
    ``sustain_m`` in length. A fold over one run's samples, kept in the JVM."""
    rows = F.sort_array(F.collect_list(F.struct("i", "d", F.col(column).alias("e"), F.greatest(F.lit(base_m).cast("double"), F.col("sigma") * alpha).alias("thr"), F.lit(sustain_m).cast("double").alias("far"))))
    place = lambda x: F.struct(x["i"].alias("i"), x["d"].alias("d"), x["e"].alias("ele"))

    def step(a, s):
        rise = s["e"] - a["e"]
        far = F.abs(s["d"] - a["d"]) >= s["far"]
        begins = (a["dir"] == 0) & (F.abs(rise) >= s["thr"]) & far
        grows = (a["dir"] != 0) & (rise * a["dir"] >= 0)
        turns = (a["dir"] != 0) & ~grows & (F.abs(rise) >= s["thr"]) & far
        moves = begins | grows | turns
        return F.struct(
            F.when(begins, F.signum(rise).cast("int")).when(turns, -a["dir"]).otherwise(a["dir"]).alias("dir"),
            *(F.when(moves, s[x]).otherwise(a[x]).alias(x) for x in ("i", "d", "e")),
            F.when(turns, F.array_append(a["turns"], place(a))).otherwise(a["turns"]).alias("turns"),
        )

    done = samples.groupBy("track_id", "run").agg(rows.alias("rows"))
    first = F.col("rows")[0]
    start = F.struct(F.lit(0).alias("dir"), first["i"].alias("i"), first["d"].alias("d"), first["e"].alias("e"), F.array(place(first)).alias("turns"))
    finish = lambda a: F.when(a["dir"] != 0, F.array_append(a["turns"], place(a))).otherwise(a["turns"])
    return done.select("track_id", "run", F.aggregate("rows", start, step, finish).alias("turns"))


def confirmed_turns(samples: DataFrame, base_m: float | Column = 5.0, alpha: float | Column = 3.0, sustain_m: float | Column = 40.0, column: str = "smooth") -> DataFrame:
    """Rows track_id, run, k, i, d, ele: turns_of_runs as rows, k from 1."""
    rows = turns_of_runs(samples, base_m, alpha, sustain_m, column)
    return rows.select("track_id", "run", F.posexplode("turns").alias("k", "t")).select("track_id", "run", (F.col("k") + 1).alias("k"), "t.i", "t.d", "t.ele")


def legs(turns: Column) -> Column:
    """The rises and falls between an array of turns."""
    return F.transform(F.slice(turns, 2, F.greatest(F.size(turns) - 1, F.lit(0))), lambda t, k: t["ele"] - F.get(turns, k)["ele"])


def risen(steps: Column, sign: int) -> Column:
    """The sum of what goes up (down for -1) among steps, added in their order, so that it is the same on every run."""
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + F.greatest(sign * x, F.lit(0.0)))


def gain_loss(samples: DataFrame, base_m: float | Column = 5.0, alpha: float | Column = 3.0, sustain_m: float | Column = 40.0, column: str = "smooth") -> DataFrame:
    """Rows track_id, run, gain_m, loss_m: sums over the legs between confirmed turns."""
    steps = legs(F.col("turns"))
    return turns_of_runs(samples, base_m, alpha, sustain_m, column).select("track_id", "run", risen(steps, 1).alias("gain_m"), risen(steps, -1).alias("loss_m"))


def selected_thresholds(samples: DataFrame, base_m: float = 5.0, alpha: float = 3.0) -> DataFrame:
    """Rows track_id, median_m, p95_m (upper rank) of the local thresholds over all samples."""
    return samples.withColumn("thr", F.greatest(F.lit(base_m), F.col("sigma") * alpha)).groupBy("track_id").agg(upper_rank("thr", 0.5).alias("median_m"), upper_rank("thr", 0.95).alias("p95_m"))


def robust_envelope(run_points: DataFrame) -> DataFrame:
    """Rows track_id, min_ele, max_ele over raw elevations, in which a lone point is replaced by its neighbours' mean: one
    off both by more than max(12, 3 times their difference)."""
    left, right = F.lag("ele").over(run_order()), F.lead("ele").over(run_order())
    mean = (left + right) / 2
    lone = F.abs(F.col("ele") - mean) > F.greatest(F.lit(12.0), 3 * F.abs(right - left))
    return run_points.withColumn("sane", F.when(F.coalesce(lone, F.lit(False)), mean).otherwise(F.col("ele"))).groupBy("track_id").agg(F.min("sane").alias("min_ele"), F.max("sane").alias("max_ele"))


def net_change(samples: DataFrame, column: str = "ele") -> DataFrame:
    """Rows track_id, net_m: the sum over runs of last minus first."""
    per_run = samples.groupBy("track_id", "run").agg((F.max_by(column, "i") - F.min_by(column, "i")).alias("net"))
    return per_run.groupBy("track_id").agg(F.sum("net").alias("net_m"))


def replace_endpoints(samples: DataFrame, column: str = "clean") -> DataFrame:
    """The samples with is_endpoint_spike, and column replaced there: the first or last of four samples or more that is off
    its three neighbours' median by more than max(4 floor, 50 m), while these lie within half the floor."""
    w = run_order()
    ahead, back = F.array(*(F.lead(column, k).over(w) for k in (1, 2, 3))), F.array(*(F.lag(column, k).over(w) for k in (1, 2, 3)))
    spread = F.max(column).over(whole_run()) - F.min(column).over(whole_run())
    rows = samples.withColumns({"_n": F.max("i").over(whole_run()), "_floor": F.least(F.lit(12.0), F.greatest(F.lit(4.0), 0.15 * spread)), "_near": F.sort_array(F.when(F.col("i") == 1, ahead).otherwise(back))})
    low, mid, high = (F.element_at("_near", k) for k in (1, 2, 3))
    end = (F.col("_n") >= 4) & ((F.col("i") == 1) | (F.col("i") == F.col("_n")))
    spike = end & (high - low <= F.col("_floor") / 2) & (F.abs(F.col(column) - mid) > F.greatest(4 * F.col("_floor"), F.lit(50.0)))
    return rows.withColumn("is_endpoint_spike", F.coalesce(spike, F.lit(False))).withColumn(column, F.when(F.col("is_endpoint_spike"), mid).otherwise(F.col(column))).drop("_n", "_floor", "_near")


def defaults(points: DataFrame, trust: DataFrame | None = None) -> DataFrame:
    """Rows track_id, step_m, base_m, sustain_m of the track's activity, alpha of its primary source, is_terrain (terrain is
    the source most trusted for height or for change). The least turn of a noisy gpx track that isn't on water grows with
    the ratio of change to range, from 3 m at 12 to 18 m at most."""
    trust = source_trust(points) if trust is None else trust
    rel = primary_source(trust).select("track_id", F.col("ele_source").alias("primary"))
    absolute = primary_source(trust, "abs_trust").select("track_id", F.col("ele_source").alias("absolute"))
    noisy = trust.select("track_id", F.col("ele_source").alias("primary"), "noisy", "change_ratio")
    rows = activity(points).select("track_id", "activity").join(rel, "track_id", "left").join(absolute, "track_id", "left").join(noisy, ["track_id", "primary"], "left")
    pick = lambda table, key: F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col(key)]
    step, base, sustain = (pick({k: float(v[j]) for k, v in ACTIVITIES.items()}, "activity") for j in range(3))
    grown = F.least(F.lit(18.0), 3 + 0.33 * F.greatest(F.lit(0.0), F.col("change_ratio") - 12))
    raised = F.coalesce((F.col("activity") != "water") & (F.col("primary") == "gpx") & F.col("noisy") & F.col("change_ratio").isNotNull(), F.lit(False))
    terrain = F.coalesce(F.col("primary") == "terrain", F.lit(False)) | F.coalesce(F.col("absolute") == "terrain", F.lit(False))
    return rows.select(
        "track_id", step.alias("step_m"), F.when(raised, F.greatest(base, grown)).otherwise(base).alias("base_m"), sustain.alias("sustain_m"),
        F.coalesce(pick(ALPHA, "primary"), F.lit(3.0)).alias("alpha"), terrain.alias("is_terrain"),
    )


def repaired(points: DataFrame, run_points: DataFrame | None = None) -> DataFrame:
    """The elevation runs (run_points, where they are known) with lone outliers, wild ends and sparse tails replaced, before
    anything is resampled."""
    return without_sparse_tails(without_raw_outliers(runs(points) if run_points is None else run_points))


def profile(points: DataFrame, settings: DataFrame | None = None, fixed: DataFrame | None = None) -> DataFrame:
    """Samples with run, i, d, ele, clean, smooth, sigma and their track's settings (of defaults), spaced by its activity:
    the chain up to gain and loss. fixed: repaired's rows, where they are known."""
    settings = defaults(points) if settings is None else settings
    fixed = repaired(points) if fixed is None else fixed
    samples = resample(fixed.join(settings.select("track_id", "step_m"), "track_id"), F.col("step_m"))
    return local_sigma(smooth(replace_endpoints(hampel(samples.join(settings, "track_id")))))


def climbs(samples: DataFrame, base_m: float | str = "base_m", alpha: float | str = "alpha", sustain_m: float | str = "sustain_m", column: str = "smooth") -> DataFrame:
    """Rows track_id, gain_m, loss_m over all legs of a track, added from its first run to its last; by default with the
    settings in profile's samples."""
    base, by, far = (F.col(x) if isinstance(x, str) else x for x in (base_m, alpha, sustain_m))
    runs_legs = turns_of_runs(samples, base, by, far, column).select("track_id", "run", legs(F.col("turns")).alias("legs"))
    steps = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("run", "legs"))), lambda x: x["legs"]))
    return runs_legs.groupBy("track_id").agg(steps.alias("steps")).select("track_id", risen(F.col("steps"), 1).alias("gain_m"), risen(F.col("steps"), -1).alias("loss_m"))


def raw_envelopes(run_points: DataFrame) -> DataFrame:
    """Rows track_id, run, lo, hi, low_support, high_support of raw elevations: the range in which lone points are replaced
    (robust_envelope), and the least and the greatest point that isn't severely alone: the run's ends, and those off their
    neighbours' mean by max(GAP_RISE, 3 times their difference) at most."""
    left, right, ele = F.lag("ele").over(run_order()), F.lead("ele").over(run_order()), F.col("ele")
    rows = run_points.withColumns({"_off": F.abs(ele - (left + right) / 2), "_step": F.abs(right - left), "_mean": (left + right) / 2})
    sane = F.when(F.coalesce(F.col("_off") > F.greatest(F.lit(12.0), 3 * F.col("_step")), F.lit(False)), F.col("_mean")).otherwise(ele)
    held = F.when(~F.coalesce(F.col("_off") > F.greatest(F.lit(GAP_RISE), 3 * F.col("_step")), F.lit(False)), ele)
    return rows.groupBy("track_id", "run").agg(F.min(sane).alias("lo"), F.max(sane).alias("hi"), F.min(held).alias("low_support"), F.max(held).alias("high_support"))


def supported_turns(turns: DataFrame, run_points: DataFrame, sustain: DataFrame | float) -> DataFrame:
    """The confirmed turns that may widen a track's extrema: a run's first or last, or with legs of ``sustain`` metres (a
    number, or rows track_id, sustain_m) on both sides; and inside their own run's raw envelope, or backed by a raw point as
    low (as high) that isn't severely alone."""
    w = Window.partitionBy("track_id", "run").orderBy("k")
    rows = turns.withColumn("sustain_m", F.lit(float(sustain))) if isinstance(sustain, (int, float)) else turns.join(sustain, "track_id")
    back, ahead = F.col("d") - F.lag("d").over(w), F.lead("d").over(w) - F.col("d")
    edge = back.isNull() | ahead.isNull() | ((back >= F.col("sustain_m")) & (ahead >= F.col("sustain_m")))
    rows = rows.withColumn("_long", edge).filter("_long").join(raw_envelopes(run_points), ["track_id", "run"])
    low, high = (F.col("ele") >= F.col("lo")) | (F.col("low_support") <= F.col("ele")), (F.col("ele") <= F.col("hi")) | (F.col("high_support") >= F.col("ele"))
    return rows.filter(F.coalesce(low & high, F.lit(False))).select("track_id", "run", "k", "i", "d", "ele")


def limited_extrema(samples: DataFrame, run_points: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """Rows track_id, min_ele, max_ele of the smooth samples, not beyond the robust envelope of the raw elevations, but for
    what supported turns reach, where these are given."""
    own = samples.groupBy("track_id").agg(F.min("smooth").alias("lo"), F.max("smooth").alias("hi"))
    rows = own.join(robust_envelope(run_points), "track_id")
    low, high = F.greatest("lo", "min_ele"), F.least("hi", "max_ele")
    if turns is not None:
        rows = rows.join(turns.groupBy("track_id").agg(F.min("ele").alias("low_turn"), F.max("ele").alias("high_turn")), "track_id", "left")
        low, high = F.least(low, "low_turn"), F.greatest(high, "high_turn")
    return rows.select("track_id", low.alias("min_ele"), high.alias("max_ele"))
