"""Time in motion: timer events where there are any, else a state machine over speeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: km/h from which a stopped track moves, and at which a moving one stops.
THRESHOLDS = {"slow": (1.2, 0.5), "inferred_slow": (1.5, 0.8), "moderate": (1.5, 0.8), "unknown": (1.5, 0.8), "fast": (3.0, 1.5), "unrestricted": (3.0, 1.5)}
#: Seconds of motion before a stopped track moves, and of rest before a moving one stops.
START_S, STOP_S = 5.0, 10.0


def moving_time(speeds: DataFrame, profile: str = "unknown") -> DataFrame:
    """Rows track_id, moving_s, moving_m from samples (seq, kmh, dt, metres): motion counts from its start once it has
    lasted 5 s; a rest counts for nothing once it has lasted 10 s, and else as motion when the track moves on. Null where
    the track never moves. Samples may have their own thresholds, on_kmh and off_kmh, and is_slow_progress, which counts as
    motion at any speed. A fold over one track's samples, kept in the JVM."""
    has = set(speeds.columns)
    on, off = (F.col(c) if c in has else F.lit(v) for c, v in zip(("on_kmh", "off_kmh"), THRESHOLDS[profile], strict=True))
    creeps = F.coalesce("is_slow_progress", F.lit(False)) if "is_slow_progress" in has else F.lit(False)
    sample = F.struct("seq", "dt", "metres", ((F.col("kmh") <= off) & ~creeps).alias("resting"), ((F.col("kmh") >= on) | creeps).alias("going"))
    rows = F.sort_array(F.collect_list(sample))
    names = ("mv", "mvm", "rest", "restm", "go", "gom")
    start = F.struct(F.lit(False).alias("on"), *(F.lit(0.0).alias(n) for n in names))

    def step(a, s):
        resting, going = s["resting"], s["going"]
        rest, restm, go, gom = a["rest"] + s["dt"], a["restm"] + s["metres"], a["go"] + s["dt"], a["gom"] + s["metres"]
        stops, starts = a["on"] & resting & (rest >= STOP_S), ~a["on"] & going & (go >= START_S)
        zero = F.lit(0.0)
        return F.struct(
            F.when(stops, F.lit(False)).when(starts, F.lit(True)).otherwise(a["on"]).alias("on"),
            F.when(a["on"] & ~resting, a["mv"] + rest).when(starts, a["mv"] + go).otherwise(a["mv"]).alias("mv"),
            F.when(a["on"] & ~resting, a["mvm"] + restm).when(starts, a["mvm"] + gom).otherwise(a["mvm"]).alias("mvm"),
            F.when(a["on"] & resting & ~stops, rest).otherwise(zero).alias("rest"),
            F.when(a["on"] & resting & ~stops, restm).otherwise(zero).alias("restm"),
            F.when(~a["on"] & going & ~starts, go).otherwise(zero).alias("go"),
            F.when(~a["on"] & going & ~starts, gom).otherwise(zero).alias("gom"),
        )

    done = speeds.groupBy("track_id").agg(F.aggregate(rows, start, step).alias("a"))
    moved = F.col("a.mv") > 0
    return done.select("track_id", F.when(moved, F.col("a.mv")).alias("moving_s"), F.when(moved, F.col("a.mvm")).alias("moving_m"))


def timer_intervals(points: DataFrame, events: DataFrame) -> DataFrame:
    """Rows track_id, start_ms, end_ms in which the timer of events (track_id, ts_ms, action start or stop) ran. Times are
    clamped to the track's; a stop before any start closes an interval from the track's start, an open start runs to its
    end; repeated actions count once; empty intervals go."""
    bounds = points.filter("ts_ms is not null").groupBy("track_id").agg(F.min_by("ts_ms", "seq").alias("lo"), F.max_by("ts_ms", "seq").alias("hi"))
    order = Window.partitionBy("track_id").orderBy("t", "n")
    known = events.filter("action in ('start', 'stop') and ts_ms is not null").join(bounds, "track_id")
    numbered = known.withColumn("n", F.row_number().over(Window.partitionBy("track_id").orderBy("ts_ms", *(c for c in ("event_id",) if c in events.columns))))
    marks = numbered.withColumn("t", F.greatest("lo", F.least("hi", "ts_ms"))).withColumn("was", F.lag("action").over(order)).filter("was is null or was <> action")
    marks = marks.withColumn("next", F.lead("t").over(order))
    running = marks.filter("action = 'start'").select("track_id", F.col("t").alias("start_ms"), F.coalesce("next", "hi").alias("end_ms"))
    opening = marks.filter("action = 'stop' and was is null").select("track_id", F.col("lo").alias("start_ms"), F.col("t").alias("end_ms"))
    return running.union(opening).filter("end_ms > start_ms")


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows track_id, a, b, lo, hi: where intervals of left and right (track_id, lo, hi, and x, a struct that tells them
    apart) overlap for a positive time. Within either table a track's intervals don't overlap each other. One sweep over the
    ordered ends: rows grow with the intervals, not with their pairs."""
    ends = None
    for side, table in (("a", left), ("b", right)):
        for opens, at in ((1, "lo"), (0, "hi")):
            value = {s: (F.col("x") if s == side else F.lit(None)) for s in "ab"}
            mine = table.filter("lo < hi").select("track_id", F.col(at).alias("t"), F.lit(opens).alias("opens"), F.lit(side).alias("side"), "x")
            kinds = {s: dict((left if s == "a" else right).dtypes)["x"] for s in "ab"}
            mine = mine.select("track_id", "t", "opens", "side", *(value[s].cast(kinds[s]).alias(s) for s in "ab"))
            ends = mine if ends is None else ends.union(mine)
    order = Window.partitionBy("track_id").orderBy("t", "opens", "side")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = ends.withColumn("next", F.lead("t").over(order))
    for s in "ab":
        step = F.when(F.col("side") == s, F.when(F.col("opens") == 1, 1).otherwise(-1)).otherwise(0)
        rows = rows.withColumn(f"open_{s}", F.sum(step).over(upto) > 0).withColumn(s, F.last(F.when((F.col("side") == s) & (F.col("opens") == 1), F.col(s)), ignorenulls=True).over(upto))
    both = rows.filter("open_a and open_b and next > t")
    return both.groupBy("track_id", "a", "b").agg(F.min("t").alias("lo"), F.max("next").alias("hi"))


def clip_intervals(intervals: DataFrame, ranges: DataFrame) -> DataFrame:
    """The parts of intervals (track_id, start_ms, end_ms) within ranges (track_id, lo_ms, hi_ms), of positive length; both
    disjoint in themselves."""
    left = intervals.select("track_id", F.col("start_ms").alias("lo"), F.col("end_ms").alias("hi"), F.struct("start_ms").alias("x"))
    right = ranges.select("track_id", F.col("lo_ms").alias("lo"), F.col("hi_ms").alias("hi"), F.struct("lo_ms").alias("x"))
    return overlaps(left, right).select("track_id", F.col("lo").alias("start_ms"), F.col("hi").alias("end_ms"))


def distance_in_intervals(samples: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows track_id, metres, seconds of samples (track_id, from_ms, to_ms, metres) inside intervals, by share of time; both
    disjoint in themselves."""
    left = samples.select("track_id", F.col("from_ms").alias("lo"), F.col("to_ms").alias("hi"), F.struct("from_ms", "to_ms", "metres").alias("x"))
    right = intervals.select("track_id", F.col("start_ms").alias("lo"), F.col("end_ms").alias("hi"), F.struct("start_ms").alias("x"))
    ms = F.col("hi") - F.col("lo")
    meet = overlaps(left, right)
    return meet.groupBy("track_id").agg(F.sum(F.col("a.metres") * ms / (F.col("a.to_ms") - F.col("a.from_ms"))).alias("metres"), (F.sum(ms) / 1000.0).alias("seconds"))
