"""Operators on small tracks with known answers."""

import numpy as np
import pytest
from waymark.functions import rules, values
from waymark.operators import cleaning, continuity, diagnostics, elevation, moving, present, series
from waymark.plans.summary import analyse
from pyspark.sql import functions as F

SCHEMA = "track_id string, seq int, ts_ms long, lat double, lon double, ele double, segment int"
T0 = 1716624000000
#: Five points, 28 minutes, 1132.89 m, 125 m up and 10 m down.
RIDGE = [(43.1, 42.1, 620, 0), (43.101, 42.102, 640, 300), (43.103, 42.105, 700, 720), (43.105, 42.108, 690, 1200), (43.107, 42.11, 735, 1680)]
DEGREE = 111319.49079327357


def track(spark, rows, name="t"):
    return spark.createDataFrame([(name, k, None if t is None else T0 + int(t * 1000), float(lat), float(lon), None if e is None else float(e), s) for k, (lat, lon, e, t, s) in enumerate(rows, 1)], SCHEMA)


def test_ridge(spark):
    out = analyse(track(spark, [(*p, 0) for p in RIDGE]))
    s = out["summary"].first()
    assert s.total_distance_m == pytest.approx(1132.89, abs=0.01)
    assert s.total_s == s.moving_s == 1680 and s.mode == "sparse" and s.nominal_s == 450
    assert s.average_kmh == pytest.approx(2.43, abs=0.01) and s.max_kmh == pytest.approx(2.83, abs=0.01)
    assert s.gain_m == pytest.approx(125, abs=0.5) and s.loss_m == pytest.approx(10, abs=0.5)
    assert (s.min_ele, s.max_ele, s.n_points) == (620, 735, 5)
    assert out["splits"].count() == 1 and out["slopes"].count() == 4


def test_cleaning_reasons(spark):
    m = 1 / DEGREE
    rows = [(0, 0, 1, 0, 0), (2 * m, 0, 1, 1, 0), (2 * m, 0, 1, 1, 0), (4 * m, 0, 1, 1, 0), (5000 * m, 0, 1, 2, 0), (6 * m, 0, 1, 3, 0), (91, 0, 1, 4, 0), (8 * m, 0, 1, 4, 0), (5, 0, 1, 5, 1), (10 * m, 0, 1, 6, 1)]
    got = {r.seq: r.reason for r in cleaning.clean(track(spark, [(lat, lon + 1, *r) for lat, lon, *r in rows])).collect()}
    assert got == {1: None, 2: None, 3: "duplicate_points", 4: "time_order", 5: "gps_jump", 6: None, 7: "invalid_coordinates", 8: None, 9: None, 10: "gps_jump"}


def test_cleaning_of_many_and_long_tracks(spark):
    import time

    # 40,000 tracks of five points and one of 4,001, each with a repeat of its second point at the end
    short = spark.range(200_000).selectExpr("concat('s', id div 5) AS track_id", "int(id % 5 + 1) AS seq", "id % 5 * 10000 AS ts_ms", "1 + id % 5 * 1e-5 AS lat", "1D AS lon", "1D AS ele", "0 AS segment")
    long = spark.range(4001).selectExpr("'l'", "int(id + 1)", "id * 10000", "1 + id * 1e-5", "1D", "1D", "0")
    back = F.when((F.col("seq") == 5) & F.col("track_id").startswith("s") | (F.col("seq") == 4001), 10000)
    began = time.perf_counter()
    got = cleaning.clean(short.union(long).withColumn("ts_ms", F.coalesce(back, "ts_ms"))).groupBy("reason", F.substring("track_id", 1, 1).alias("kind")).count().collect()
    assert {(r.kind, r.reason): r["count"] for r in got} == {("s", None): 160_000, ("s", "time_order"): 40_000, ("l", None): 4000, ("l", "time_order"): 1}
    assert time.perf_counter() - began < 45


def test_flip_and_null_island(spark):
    m = 1 / DEGREE
    flip = [(0, 1, 1, 0, 0), (0, 1 + 5 * m, 1, 5, 0), (0, 1 + 12 * m, 1, 8, 0), (0, 1 + 6 * m, 1, 11, 0), (0, 1 + 16 * m, 1, 16, 0)]
    got = {r.seq: r.reason for r in cleaning.clean(track(spark, flip)).collect()}
    assert got[3] == "heading_flip_jitter" and sum(x is None for x in got.values()) == 4
    island = [(43, 42, 1, 0, 0), (0, 0, 1, 4000, 0), (43, 42.001, 1, 8000, 0)]
    assert [r.reason for r in cleaning.clean(track(spark, island)).orderBy("seq").collect()] == [None, "null_island", None]


def test_a_steady_fast_stretch_of_a_slow_track_stays(spark):
    m, lon = 1 / DEGREE, 1.0
    rows = [(0, lon + k * 6 * m, 1, 5 * k, 0) for k in range(40)]
    at = rows[-1]
    rows += [(0, at[1] + k * 36 * m, 1, at[3] + 5 * k, 0) for k in range(1, 6)]
    straight = [r.reason for r in cleaning.clean(track(spark, rows)).collect()]
    assert straight == [None] * 45
    lone = [*rows[:40], (0, at[1] + 80 * m, 1, at[3] + 5, 0)]
    assert [r.reason for r in cleaning.clean(track(spark, lone)).orderBy("seq").collect()][-1] == "gps_jump"


def test_gaps_segments_and_elapsed(spark):
    rows = [(43 + k * 1e-4, 42, 1, t, s) for k, (t, s) in enumerate([(0, 0), (5, 0), (10, 0), (100, 0), (105, 0), (500, 1), (505, 1)])]
    t = track(spark, rows)
    segments = continuity.continuous_segments(t).orderBy("cont_segment").collect()
    assert [(r.first_seq, r.last_seq, r.duration_s) for r in segments] == [(1, 3, 10), (4, 5, 5), (6, 7, 5)]
    e = continuity.elapsed(t).first()
    assert (e.total_s, e.has_breaks) == (110, True)
    untimed = continuity.sampling(track(spark, [(1, 1, 1, None, 0), (2, 2, 1, None, 0)])).first()
    assert (untimed.mode, untimed.n_timed, untimed.nominal_s) == ("untimed", 0, None)


def test_moving_needs_five_seconds_and_stops_after_ten(spark):
    rows = [(1, 3.0, 5.0), (2, 3.0, 5.0), (3, 0.0, 6.0), (4, 3.0, 1.0), (5, 0.0, 6.0), (6, 0.0, 6.0), (7, 3.0, 4.0), (8, 0.0, 1.0)]
    speeds = spark.createDataFrame([("t", k, v, dt, v / 3.6 * dt) for k, v, dt in rows], "track_id string, seq int, kmh double, dt double, metres double")
    assert moving.moving_time(speeds).first().moving_s == 17
    assert moving.moving_time(speeds.filter("kmh = 0")).first().moving_s is None


def test_timer(spark):
    points = track(spark, [(1, 1, 1, 0, 0), (1, 1, 1, 100, 0)])
    events = spark.createDataFrame([("t", T0 + t * 1000, a) for t, a in [(10, "stop"), (20, "start"), (30, "start"), (40, "stop"), (90, "start")]], "track_id string, ts_ms long, action string")
    got = sorted(((r.start_ms - T0) // 1000, (r.end_ms - T0) // 1000) for r in moving.timer_intervals(points, events).collect())
    assert got == [(0, 10), (20, 40), (90, 100)]


def samples(spark, eles, step=50.0):
    return spark.createDataFrame([("t", 1, k, (k - 1) * step, float(e), 0.0) for k, e in enumerate(eles, 1)], "track_id string, run int, i int, d double, ele double, sigma double")


@pytest.mark.parametrize(("eles", "gain", "loss"), [([100, 120, 140, 135], 40, 0), ([200, 180, 160, 165, 150], 0, 50), ([100, 150, 100], 50, 50), ([100, 101, 100, 101], 0, 0), ([100, 110, 104, 120], 26, 6)])
def test_gain_and_loss(spark, eles, gain, loss):
    r = elevation.gain_loss(samples(spark, eles), 5.5, 3.0, 20.0, "ele").first()
    assert (r.gain_m, r.loss_m) == (gain, loss)


def test_hampel_replaces_a_spike(spark):
    got = [r.clean for r in elevation.hampel(samples(spark, [100, 101, 102, 1000, 103, 104, 105])).orderBy("i").collect()]
    assert got == [100, 101, 102, 102.5, 103, 104, 105]


def test_runs_break_where_elevation_does(spark):
    rows = [(43 + k * 1e-4, 42, e, t, 0) for k, (e, t) in enumerate([(300, 0), (299, 1), (298, 2), (None, 3), (120, 4), (119, 5), (118, 6)])]
    r = elevation.runs(track(spark, rows))
    assert [x.run for x in r.orderBy("seq").collect()] == [1, 1, 1, 2, 2, 2]
    assert elevation.net_change(r).first().net_m == -4


def test_nearest_sample_takes_the_left_of_two(spark):
    s = spark.createDataFrame([("t", 1, 0.0), ("t", 2, 10.0), ("t", 3, 30.0)], "track_id string, seq int, distance_m double")
    q = spark.createDataFrame([("t", -5.0), ("t", 5.0), ("t", 20.1), ("t", 99.0), ("u", 1.0)], "track_id string, at_m double")
    got = {(r.track_id, r.at_m): r.seq for r in series.nearest_sample(s, q).collect()}
    assert got == {("t", -5.0): 1, ("t", 5.0): 1, ("t", 20.1): 3, ("t", 99.0): 3, ("u", 1.0): None}


def test_values(spark):
    df = spark.createDataFrame([(t,) for t in [" 12.5 ", "1e3", "0x10", "", "abc", "Infinity", None]], "t string")
    assert [r[0] for r in df.select(values.number(F.col("t"))).collect()] == [12.5, 1000, 16, 0, None, None, None]
    df = spark.createDataFrame([(t,) for t in ["2024-05-25T08:00:00Z", "2024-05-25T08:00:00", "2024-05-25T10:00:00+02:00", "2024-05-25T10:00:00.250+0200", "soon", "", None]], "t string")
    got = [tuple(r) for r in df.select(values.timestamp_ms(F.col("t")), values.zone_status(F.col("t"))).collect()]
    assert got == [(T0, "explicit"), (T0, "missing"), (T0, "explicit"), (T0 + 250, "explicit"), (None, "invalid"), (None, "none"), (None, "none")]
    assert spark.range(1).select(values.clock(F.lit(3661.5)), values.clock(F.lit(None).cast("double")), values.kilometres(F.lit(1250.0))).first()[:] == ("1:01:02", "—", "1.3 km")


def test_colours(spark):
    s = spark.createDataFrame([("t", k, float(k)) for k in range(11)], "track_id string, seq int, smooth_kmh double")
    got = {r.seq: r.colour for r in present.coloured(s).collect()}
    assert got[0] == "#2563eb" and got[10] == "#dc2626" and len(set(got.values())) > 5


def test_slow_progress_needs_a_direction(spark):
    m = 1 / DEGREE
    onward = [(0, 1 + k * 4 * m, 1, 20 * k, 0) for k in range(20)]
    swaying = [(0, 1 + (k % 2 * 6 + k * 0.2) * m, 1, 20 * k, 0) for k in range(20)]
    assert diagnostics.slow_progress(track(spark, onward)).count() >= 15
    assert diagnostics.slow_progress(track(spark, swaying)).count() == 0


def test_slow_progress_names_pairs_by_their_second_points(spark):
    # the first two points have one time, where an order by time alone may list the first: it ends no pair
    m = 1 / DEGREE
    rows = track(spark, [(0, 1 + k * 4 * m, 1, 20 * max(k, 1), 0) for k in range(20)])
    for laid in (rows, rows.repartition(7, "seq"), rows.orderBy(F.desc("seq")).coalesce(1)):
        assert sorted(r.seq for r in diagnostics.slow_progress(laid).collect()) == list(range(2, 21))


@pytest.mark.parametrize(("places", "poor"), [([0, 5, 10, 15], False), ([0, 5, 0, 5, 0, 5], True), ([0, 0.5, 0, 0.5], False), ([0, 9], False), ([0, 6, 3, 9, 6, 12, 9, 15], False)])
def test_poor_direction(places, poor):
    lat = np.array([1 + p / DEGREE for p in places])
    assert bool(diagnostics.goes_to_and_fro(lat, np.zeros(len(lat)))) is poor
    assert bool(diagnostics.goes_to_and_fro(np.zeros(len(lat)), lat - 1)) is poor


def test_motion_profile_takes_lower_ranks_and_shares(spark):
    m, rows, lon, t = 1 / DEGREE, [(0, 1.0, 1, 0, 0)], 1.0, 0
    for v in [3] * 4 + [7] * 4 + [11] * 4:
        lon, t = lon + 10 * v * m, t + 10
        rows.append((0, lon, 1, t, 0))
    r = cleaning.motion_profile(track(spark, rows)).first()
    assert (r.n, r.median_mps, r.p75_mps, r.p90_mps, r.slow_share, r.moderate_share) == (12, 7.0, 11.0, 11.0, 0.67, 0.33) and r.profile == "fast"
    rows = rows[:6] + [(0, rows[5][1] + k * 20 * m, 1, rows[5][3] + 10 * k, 0) for k in range(1, 7)]
    assert cleaning.motion_profile(track(spark, rows)).first().profile == "slow"


def test_fix_quality_limits(spark):
    df = spark.createDataFrame([(7.0, 1.0, 1.0, "3d"), (8.5, 1.0, 1.0, "3d"), (1.0, 6.5, 1.0, "2d"), (1.0, 1.0, 8.0, "3d"), (1.0, 1.0, 8.5, None), (None, None, None, " Unknown ")], "vdop double, pdop double, hdop double, fix string")
    assert [(r.rejected, r.warned) for r in cleaning.with_fix_quality(df).collect()] == [(False, False), (True, False), (True, False), (False, True), (True, True), (True, False)]


def test_a_flip_is_tested_against_the_point_kept_last(spark):
    m = 1 / DEGREE
    rows = [(0, 1, 1, 0, 0), (91, 1, 1, 1, 0), (0, 1 + 7 * m, 1, 3, 0), (0, 1 + 1 * m, 1, 6, 0), (0, 1 + 6 * m, 1, 20, 0)]
    got = [r.reason for r in cleaning.clean(track(spark, rows)).orderBy("seq").collect()]
    assert got == [None, "invalid_coordinates", "heading_flip_jitter", None, None]


def brute_jitter(rows):
    """Pairs of (lat, lon, second) rows at the equator that shake around a moving anchor."""
    flags, anchor = [False], rows[0]
    for a, b in zip(rows, rows[1:]):
        far = lambda p, q: ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5 * DEGREE
        shakes = 0 < far(a, b) and far(a, b) / (b[2] - a[2]) * 3.6 <= 0.9 and far(anchor, b) <= 5
        flags.append(shakes)
        anchor = anchor if shakes else b
    return flags


def test_jitter_equals_a_plain_loop_and_a_long_track_passes(spark):
    import random
    import time

    rng = random.Random(4)
    lon, rows = 1.0, []
    for k in range(600):
        lon += rng.choice([0.1, -0.1, 0.2, 0, 6]) / DEGREE * (rng.random() < 0.9)
        rows.append((0.0, lon, 2 * k))
    got = continuity.with_jitter(continuity.with_gaps(track(spark, [(a, b, 1, t, 0) for a, b, t in rows]))).orderBy("seq").collect()
    assert [r.is_jitter for r in got] == brute_jitter(rows) and 50 < sum(r.is_jitter for r in got) < 550
    long = spark.range(300_000).selectExpr("'t' AS track_id", "int(id + 1) AS seq", "id * 1000 AS ts_ms", "0D AS lat", "1 + id % 2 * 1e-6 AS lon", "1D AS ele", "0 AS segment")
    began = time.perf_counter()
    assert continuity.with_jitter(continuity.with_gaps(long)).filter("is_jitter").count() == 299_999
    assert series.reliable_speed(series.raw_speed(long)).count() == 299_999
    assert time.perf_counter() - began < 90
    # many short stretches cost no more than one long one: track k has 200 points in stretches of seven
    many = "concat('t', id div 200) AS track_id", "int(id % 200 + 1) AS seq", "id % 200 * 2000 AS ts_ms", "43 + id % 200 div 7 * 3e-5 + id % 2 * 1e-6 AS lat", "42D AS lon", "1D AS ele", "0 AS segment"
    began = time.perf_counter()
    marked = continuity.with_jitter(continuity.with_gaps(spark.range(800_000).selectExpr(*many)))
    assert {r["count"] for r in marked.filter("is_jitter").groupBy("track_id").count().collect()} == {171}
    assert time.perf_counter() - began < 60


def test_analysis_leaves_jitter_out_and_takes_the_timer(spark):
    m = 1 / DEGREE
    rows = [(0, 1 + k * 3 * m, 1, 2 * k, 0) for k in range(30)]
    rows += [(0, rows[29][1] + (k % 2) * 0.3 * m, 1, 58 + 2 * k, 0) for k in range(1, 61)]
    events = spark.createDataFrame([("t", T0, "start"), ("t", T0 + 40_000, "stop")], "track_id string, ts_ms long, action string")
    plain, timed = (analyse(track(spark, rows), e)["summary"].first() for e in (None, events))
    assert plain.n_route_jitter >= 50  # the first pairs lie in windows of slow progress
    assert 87 <= plain.total_distance_m < 91 and plain.moving_s < 80 and plain.moving_source == "hysteresis"
    assert (timed.moving_source, timed.moving_s) == ("timer_events", 40.0) and timed.moving_m == pytest.approx(60, abs=0.5)
    assert timed.moving_kmh == pytest.approx(timed.moving_m / 40 * 3.6)


def test_the_fastest_speed_is_a_reliable_one(spark):
    m = 1 / DEGREE
    rows = [(0, 1 + k * 6 * m, 1, 6 * k, 0) for k in range(20)]
    rows.append((0, rows[-1][1] + 66 * m, 1, rows[-1][3] + 6, 0))
    from waymark.plans.summary import track_summary

    s = track_summary(track(spark, rows)).first()
    assert s.max_kmh == pytest.approx(3.6, abs=0.01) == series.reliable_speed(series.raw_speed(track(spark, rows))).agg({"kmh": "max"}).first()[0]


def test_overlaps_equal_all_pairs(spark):
    import random

    rng = random.Random(5)

    def cut(n):
        t = sorted(rng.sample(range(1000), 2 * n))
        return [(t[2 * k], t[2 * k + 1]) for k in range(n)] + [(t[-1], t[-1] + 7)]

    a, b = cut(30), cut(40)
    left = spark.createDataFrame([("t", *x) for x in a], "track_id string, start_ms long, end_ms long")
    right = spark.createDataFrame([("t", *x) for x in b] + [("u", 1, 2)], "track_id string, lo_ms long, hi_ms long")
    want = sorted((max(p, r), min(q, s)) for p, q in a for r, s in b if max(p, r) < min(q, s))
    assert sorted((r.start_ms, r.end_ms) for r in moving.clip_intervals(left, right).collect()) == want


def test_explicit_profiles(spark):
    from waymark.operators.cleaning import clean, motion_profile
    from waymark.operators.series import reliability
    from waymark.plans.summary import with_thresholds

    # one metre and a bit a second, with a leap of 7 m/s at the end: a walk
    def walk(name, asked):
        return [(name, k, k * 1000, 43 + (k + (6 if k == 29 else 0)) * 1e-5, 42.0, 10.0, 0, asked) for k in range(30)]

    asked = {"none": None, "blank": "  ", "slow": "slow", "fast": "fast", "odd": "sprint", "still": "slow"}
    rows = [r for n, a in asked.items() if n != "still" for r in walk(n, a)] + [("still", k, k * 1000, 43.0, 42.0, 10.0, 0, "slow") for k in range(3)]
    p = spark.createDataFrame(rows, "track_id string, seq int, ts_ms long, lat double, lon double, ele double, segment int, explicit_profile string")
    got = {r.track_id: (r.profile, r.profile_source, r.confidence, r.ceiling_mps, r.n) for r in motion_profile(p).collect()}
    assert got == {
        "none": ("slow", "inferred", "high", 6, 29), "blank": ("slow", "inferred", "high", 6, 29), "slow": ("slow", "explicit", "high", 6, 29), "fast": ("fast", "explicit", "high", 25, 29),
        "odd": ("unknown", "explicit", "low", 50, 29), "still": ("slow", "explicit", "high", 6, None),
    }
    dropped = {(r.track_id, r.seq) for r in clean(p).filter("reason is not null and track_id <> 'still'").collect()}
    assert ("slow", 29) in dropped and not {t for t, _ in dropped} & {"fast", "odd"}
    on = {r.track_id: (r.on_kmh, r.off_kmh) for r in with_thresholds(p, p).select("track_id", "on_kmh", "off_kmh").distinct().collect()}
    assert on == {"none": (1.5, 0.8), "blank": (1.5, 0.8), "slow": (1.2, 0.5), "still": (1.2, 0.5), "fast": (3.0, 1.5), "odd": (1.5, 0.8)}

    # medians lie between two ranks, and signals have two digits when they are compared: 5.004 is 5
    v = [5.004, 5.004, 6.0, 6.0, 24.0, 24.004, 25.0, 26.0]
    s = spark.createDataFrame([(t, k, x, r) for t, r in (("a", None), ("b", "fast"), ("c", "none")) for k, x in enumerate(v)], "track_id string, seq int, kmh double, explicit_reliability string")
    got = {r.track_id: r for r in reliability(s).collect()}
    assert (got["a"].p10, got["a"].p25, got["a"].p50) == (5, 5, 15) and (got["a"].profile, got["a"].profile_source, got["a"].n_outliers) == ("slow", "speed_distribution", 4)
    assert (got["b"].profile, got["b"].profile_source, got["b"].ceiling_kmh) == ("fast", "explicit", 90) and got["c"].profile == "slow"


def test_clean_reads_its_points_once(spark):
    rows = [(43 + k * 3e-5, 42, 100, 2 * k if k != 5 else 8, 0) for k in range(20)]
    out = cleaning.clean(track(spark, rows))
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.reason for r in out.orderBy("seq").collect()] == [None] * 5 + ["time_order"] + [None] * 14


def test_corridors_ask_the_rules_of_fast_pairs_only(monkeypatch):
    place = lambda k, metres: cleaning.Judged("a", 43 + metres / 111_000, 42.0, k * 1000, 0, False, rules.SLOW_CEILING, True)
    asked = []
    reason = rules.reason
    monkeypatch.setattr(rules, "reason", lambda *x: asked.append(x) or reason(*x))
    assert rules.corridors([place(k, k * 1.5) for k in range(500)], rules.SLOW_CEILING) == set() and not asked
    fast = rules.corridors([place(k, k * 8.0) for k in range(10)], rules.SLOW_CEILING)
    assert fast == set(range(1, 10)) and len(asked) == 10
