"""Recordings as they come in: each track's recording is summed point by point over micro-batches and closed by a timer."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waymark import ship
from waymark.functions.geo import distance
from waymark.functions.rules import metres
from waymark.operators.continuity import Place
from waymark.operators.moving import START_S, STOP_S, THRESHOLDS, moving_time

ROW = "track_id string, start_ms long, end_ms long, n_points long, distance_m double, moving_s double, max_kmh double"
WAITING = "ts_ms long, seq long, lat double, lon double"
OPEN = "start_ms long, end_ms long, n_points long, lat double, lon double, distance_m double, max_kmh double, moves boolean, moving_s double, rest_s double, go_s double"
Point = namedtuple("Point", ("ts_ms", "seq", "lat", "lon"))
Open = namedtuple("Open", [c.split()[0] for c in OPEN.split(", ")])
#: Where the state of a stream lives; the processor needs column families and timers, which the default store lacks.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def begun(p: Point) -> Open:
    return Open(p.ts_ms, p.ts_ms, 1, p.lat, p.lon, 0.0, float("nan"), False, 0.0, 0.0, 0.0)


def carried_on(a: Open, p: Point, on_kmh: float, off_kmh: float) -> Open:
    """The recording with one point more: the step of moving_time's state machine, and the sums."""
    way, dt = metres(Place(a.lat, a.lon), Place(p.lat, p.lon)), (p.ts_ms - a.end_ms) / 1000
    moves, moving, rest, go, top = a.moves, a.moving_s, 0.0, 0.0, a.max_kmh
    if dt > 0:
        kmh = way / dt * 3.6
        top = kmh if not top >= kmh else top
        if moves and kmh > off_kmh:
            moving += a.rest_s + dt
        elif moves:
            rest = a.rest_s + dt
            moves, rest = (False, 0.0) if rest >= STOP_S else (True, rest)
        elif kmh >= on_kmh:
            go = a.go_s + dt
            if go >= START_S:
                moves, moving, go = True, moving + go, 0.0
    else:
        rest, go = a.rest_s, a.go_s
    return Open(a.start_ms, p.ts_ms, a.n_points + 1, p.lat, p.lon, a.distance_m + way, top, moves, moving, rest, go)


class Recorder(StatefulProcessor):
    """Holds what waits for the watermark and the open recording of one track.

    Points wait until the watermark has passed them, so they are taken in order however they came; then they are folded into
    the open recording, which a point after the gap, or the timer of the gap, closes. What waits is bounded by the watermark's
    delay, the rest is a few numbers a track."""

    def __init__(self, gap_ms: int, on_kmh: float, off_kmh: float):
        self.gap_ms, self.on_kmh, self.off_kmh = gap_ms, on_kmh, off_kmh

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        new = [Point(*p) for df in rows for p in df[["ts_ms", "seq", "lat", "lon"]].itertuples(index=False) if p.ts_ms >= now]
        if new:
            self.waiting.appendList([tuple(p) for p in new])
        yield from self.advanced(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advanced(key, timerValues.getCurrentWatermarkInMs())

    def advanced(self, key, now: int) -> Iterator[pd.DataFrame]:
        """Folds in what the watermark has passed, closes what is over, sets the one timer at which more may be done."""
        waiting = sorted(Point(*p) for p in self.waiting.get())
        ready = [p for p in waiting if p.ts_ms < now]
        current = Open(*self.open.get()) if self.open.exists() else None
        done, current = self.folded(ready, current)
        if current and current.end_ms + self.gap_ms < now:
            done, current = [*done, current], None
        if ready:
            self.waiting.put([tuple(p) for p in waiting[len(ready) :]]) if len(ready) < len(waiting) else self.waiting.clear()
        self.open.update(tuple(current)) if current else self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        times = [p.ts_ms for p in waiting[len(ready) :][:1]] + ([current.end_ms + self.gap_ms] if current else [])
        if times:
            self.handle.registerTimer(min(times) + 1)
        if done:
            yield pd.DataFrame([(key[0], a.start_ms, a.end_ms, a.n_points, a.distance_m, a.moving_s, a.max_kmh) for a in done], columns=[c.split()[0] for c in ROW.split(", ")])

    def folded(self, points: Iterable[Point], current: Open | None) -> tuple[list[Open], Open | None]:
        done = []
        for p in points:
            if current and p.ts_ms - current.end_ms > self.gap_ms:
                done, current = [*done, current], None
            current = carried_on(current, p, self.on_kmh, self.off_kmh) if current else begun(p)
        return done, current

    def close(self) -> None:
        pass


def recordings(stream: DataFrame, gap_s: int = 120, late: str = "10 minutes", profile: str = "unknown") -> DataFrame:
    """Rows track_id, start_ms, end_ms, n_points, distance_m, moving_s, max_kmh of each recording in a stream of points
    (track_id string, ts timestamp, seq, lat, lon): points of a track without a pause longer than ``gap_s``.

    A row comes once, when the watermark is past a recording's end by the pause. Points that come more than ``late`` behind
    the newest are dropped. The state is in the session's state store, which is set to RocksDB; a restarted query goes on from
    its checkpoint. Points of a null track or time are left out; of equal times the lower seq comes first.
    """
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set(*STORE)
    rows = stream.filter("track_id is not null and ts is not null").withWatermark("ts", late)
    rows = rows.select("track_id", "ts", F.unix_millis("ts").alias("ts_ms"), F.col("seq").cast("long").alias("seq"), "lat", "lon")
    return rows.groupBy("track_id").transformWithStateInPandas(Recorder(gap_s * 1000, *THRESHOLDS[profile]), ROW, "Append", "EventTime")


def recordings_of(points: DataFrame, gap_s: int = 120, profile: str = "unknown") -> DataFrame:
    """What recordings() gives of the same points once all have come and are over, from a table with track_id, ts_ms, seq, lat,
    lon: pairs by windows, recordings by running sums, motion by moving_time's fold."""
    w = Window.partitionBy("track_id").orderBy("ts_ms", "seq")
    rows = points.filter("track_id is not null and ts_ms is not null").select("track_id", "ts_ms", F.col("seq").cast("long").alias("seq"), "lat", "lon")
    rows = rows.withColumns({"dt": (F.col("ts_ms") - F.lag("ts_ms").over(w)) / 1000.0, "metres": distance(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), "at": F.row_number().over(w)})
    first = F.coalesce(F.col("dt") > gap_s, F.lit(True))
    rows = rows.withColumn("recording", F.sum(first.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumns({"dt": F.when(~first, F.col("dt")), "metres": F.when(~first, F.col("metres"))})
    key = F.struct("track_id", "recording").alias("track_id")
    kmh = F.when(F.col("dt") > 0, F.try_divide("metres", "dt") * 3.6)
    sums = rows.groupBy(key).agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("n_points"), F.coalesce(F.sum("metres"), F.lit(0.0)).alias("distance_m"), F.max(kmh).alias("max_kmh"))
    moved = moving_time(rows.filter("dt > 0").select(key, F.col("at").alias("seq"), kmh.alias("kmh"), "dt", "metres"), profile)
    out = sums.join(moved, "track_id", "left")
    return out.select(F.col("track_id.track_id").alias("track_id"), "start_ms", "end_ms", "n_points", "distance_m", F.coalesce("moving_s", F.lit(0.0)).alias("moving_s"), "max_kmh")
