"""Sparse tails, confirmed extrema, slow progress, gradient stops, outliers and modes on small tracks with known answers."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from waymark.functions import stats, values
from waymark.operators import diagnostics, elevation, gradient, series, tails
from waymark.plans.modes import FILTERED, IMPORTED, RAW, TERRAIN, analyse_modes
from waymark.plans.summary import analyse
from pyspark.sql import functions as F

from tests.test_operators import DEGREE, RIDGE, T0, track

RUN_SCHEMA = "track_id string, run int, i int, seq int, ts_ms long, lat double, lon double, metres double, ele double"


def run_of(spark, heights, step_m=10.0, seconds=None, name="t"):
    """One run, a sample every step_m metres to the north; seconds of each sample, or ten apart."""
    seconds = seconds or [10 * k for k in range(len(heights))]
    rows = [(name, 1, k + 1, k + 1, T0 + int(s * 1000), k * step_m / DEGREE, 0.0, step_m if k else 0.0, float(e)) for k, (e, s) in enumerate(zip(heights, seconds, strict=True))]
    return spark.createDataFrame(rows, RUN_SCHEMA)


def repaired(spark, *args, **kwargs):
    return {r.seq: (r.ele, r.is_sparse_tail) for r in tails.without_sparse_tails(run_of(spark, *args, **kwargs)).collect()}


def test_low_tail_is_filled_by_way(spark):
    heights = [10 + k % 3 for k in range(200)]
    heights[100:104] = [-30] * 4
    got = repaired(spark, heights)
    assert [got[k][1] for k in range(100, 106)] == [False, True, True, True, True, False]
    left, right = heights[99], heights[104]
    assert [got[101 + k][0] for k in range(4)] == pytest.approx([left + (right - left) * (k + 1) / 5 for k in range(4)])


def test_tails_that_stay(spark):
    base = [10 + k % 3 for k in range(200)]
    long = base[:100] + [-30] * 11 + base[111:]  # more than one sample in twenty
    short = base[:79]
    short[40] = -30
    high = base[:100] + [90] * 4 + base[104:]  # high groups go at the ends only
    shallow = base[:100] + [0.5] * 4 + base[104:]  # seeds lie below the sea
    gentle = [-30 + 4 * k for k in range(8)] + base[8:]  # a beginning that the way explains
    for name, heights, step in (("long", long, 10), ("short", short, 10), ("high", high, 10), ("shallow", shallow, 10), ("gentle", gentle, 40)):
        assert not any(t for _, t in repaired(spark, heights, float(step), seconds=[60 * k for k in range(len(heights))], name=name).values()), name


def test_high_ends_take_the_sample_beside_them(spark):
    heights = [90] * 4 + [10 + k % 3 for k in range(192)] + [95] * 4
    got = repaired(spark, heights)
    assert [got[k] for k in (1, 4, 5)] == [(heights[4], True), (heights[4], True), (heights[4], False)]
    assert got[200] == (heights[195], True)


@pytest.mark.parametrize(("gap", "before", "moves"), [(2400, [20, 20, 20, 21, 23, 26, 31], True), (1700, [20, 20, 20, 21, 23, 26, 31], False), (2400, [20, 20, 20, 25, 27, 29, 30], False), (2400, [26, 26, 26, 26, 26, 28, 31], False), (2400, [20, 24, 20, 21, 23, 26, 31], False)])
def test_settling_anchors(spark, gap, before, moves):
    """The anchor before a high end gives way where the elevation settles across half an hour; near misses stay: a shorter
    gap, a last step under 2 m, a settling of less than 6 m."""
    heights = [32 if k % 5 == 0 else 12 for k in range(190)] + before + [60] * 4
    seconds = [k for k in range(197)] + [197 + gap + k for k in range(4)]
    got = repaired(spark, heights, 4.0, seconds=seconds)
    settled = got[197][1]
    assert got[201][1] and settled is moves
    assert got[201][0] == got[197][0] == (21 if moves else before[-1])


def test_climbs_add_in_order_and_round_exactly(spark):
    xs = [165.845, 1.005, 2.675, 0.125, -0.125, 1e9 + 0.005, 0.0, 1234.565]
    want = [float(Decimal(x).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)) for x in xs]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double").select("k", stats.fixed(F.col("x")).alias("y")).orderBy("k").collect()
    assert [r.y for r in got] == want


def test_turns_and_supported_extrema(spark):
    heights = [0, 10, 20, 30, 25, 10, 0, 5, 40, 60]
    samples = spark.createDataFrame([("t", 1, k + 1, 25.0 * k, float(e), 0.0) for k, e in enumerate(heights)], "track_id string, run int, i int, d double, smooth double, sigma double")
    turns = elevation.confirmed_turns(samples, 5.0, 3.0, 40.0)
    assert [(r.i, r.ele) for r in turns.orderBy("k").collect()] == [(1, 0), (4, 30), (7, 0), (10, 60)]
    assert elevation.climbs(samples, 5.0, 3.0, 40.0).first()[1:] == (90, 30)
    raw = run_of(spark, [0, 10, 20, 30, 25, 10, 0, 5, 40, 50])
    assert [r.ele for r in elevation.supported_turns(turns, raw, 40.0).orderBy("k").collect()] == [0, 30, 0]  # 60 is above the raw envelope
    backed = run_of(spark, [0, 10, 20, 30, 25, 10, 0, 5, 40, 61])
    assert [r.ele for r in elevation.supported_turns(turns, backed, 40.0).orderBy("k").collect()] == [0, 30, 0, 60]
    assert [r.ele for r in elevation.supported_turns(turns, raw, 80.0).orderBy("k").collect()] == [0]  # the legs inside are 75 m
    assert elevation.limited_extrema(samples, raw, elevation.supported_turns(turns, raw, 40.0)).first()[1:] == (0, 50)


def test_broad_window_is_moved_into_the_segment(spark):
    """Pacing with legs of 225 s: 15 minutes hold whole rounds, so the way nets to nothing, also near the segment's ends."""
    m = 1 / DEGREE
    pacing = [(0, 1 + 0.4 * min(t % 450, 450 - t % 450) * m, 1, t, 0) for t in range(0, 1801, 5)]
    rows = diagnostics.slow_pairs(track(spark, pacing)).collect()
    assert len(rows) > 200
    assert sum(r.poor_broad for r in rows) > 0.5 * len(rows)
    early = [r for r in rows if r.seq <= 60]
    assert early and any(r.poor_broad for r in early)
    onward = [(0, 1 + 0.4 * t * m, 1, t, 0) for t in range(0, 1801, 5)]
    assert not any(r.poor_broad or r.poor_window for r in diagnostics.slow_pairs(track(spark, onward)).collect())


def in_batches(spark, n, make):
    """The sorted rows of make() where Python gets n rows at a time."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
    try:
        return sorted(make().collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_segments_and_runs_reach_over_batches_without_groups(spark):
    m = 1 / DEGREE
    pacing = track(spark, [(0, 1 + 0.4 * min(t % 450, 450 - t % 450) * m, 1, t, t // 900) for t in range(0, 1801, 5)])
    rows = [(f"r{k}", 1, i + 1, i + 1, T0 + i * 10000, i * 10 / DEGREE, 0.0, 10.0 if i else 0.0, -30.0 if k % 2 and 50 <= i < 54 else float(10 + i % 3)) for k in range(4) for i in range(100)]
    runs = spark.createDataFrame(rows, RUN_SCHEMA)
    for make in (lambda: diagnostics.slow_pairs(pacing), lambda: tails.without_sparse_tails(runs)):
        assert in_batches(spark, 7, make) == in_batches(spark, 1000, make) != []
        plan = make()._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Groups" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sum(r.is_sparse_tail for r in tails.without_sparse_tails(runs).collect()) == 8


def test_windows_go_to_and_fro_as_one_by_one():
    """Many windows at once against the rule for one, on lines along both axes, with unknown places and without way."""

    def one(lat, lon, efficiency, most_back):
        east, north = (lon - lon[:1]) * DEGREE * np.cos(np.radians(lat[:1])), (lat - lat[:1]) * DEGREE
        along = east if len(lat) and np.ptp(east) >= np.ptp(north) else north
        steps = np.diff(along)
        steps = steps[np.abs(steps) >= 1]
        if len(lat) < 3 or not len(steps) or np.count_nonzero(np.diff(np.sign(steps))) < 3:
            return False
        net = along[-1] - along[0]
        back = np.abs(steps[np.sign(steps) != np.sign(net)]).sum()
        return bool(abs(net) / np.abs(steps).sum() < efficiency and (not abs(net) > 0 or back / abs(net) >= most_back))

    rng, seen = np.random.default_rng(3), []
    for trial in range(60):
        n = int(rng.integers(1, 60))
        lat, lon = (43 + np.cumsum(rng.normal(0, rng.uniform(0.1, 3), n)) / DEGREE for _ in range(2))
        if trial % 10 == 0:
            lat[n // 2] = np.nan
        if trial % 10 == 1:
            lon[:] = 43
        first = rng.integers(0, n, 30)
        last = np.minimum(n, first + rng.integers(0, 50, 30))
        for limits in ((0.45, 1.0), (0.2, 2.0)):
            got = diagnostics.goes_to_and_fro(lat, lon, first, last, *limits).tolist()
            assert got == [one(lat[a:b], lon[a:b], *limits) for a, b in zip(first, last, strict=True)]
            seen += got
    assert 100 < sum(seen) < len(seen) - 100


def speeds_of(spark, rows):
    return spark.createDataFrame([("t", k, float(d), float(m), float(v)) for k, d, m, v in rows], "track_id string, seq int, distance_m double, metres double, smooth_kmh double")


def test_stops_by_way_ask_for_the_whole_line(spark):
    whole = [(2, 10, 10, 3), (3, 20, 10, 9), (4, 40, 20, 6)]
    got = [(r.progress, r.colour) for r in gradient.stops_by_way(speeds_of(spark, whole)).orderBy("progress").collect()]
    assert [x for x, _ in got] == [0, 0.25, 0.5, 1] and got[0][1] == got[1][1] == "#2563eb" and got[2][1] == "#dc2626"
    for broken in ([(2, 10, 10, 3), (4, 40, 20, 6)], [(2, 12, 10, 3), *whole[1:]], [*whole, (5, 50, 20, 4)]):
        assert gradient.stops_by_way(speeds_of(spark, broken)).count() == 0
    short = spark.createDataFrame([("t", 42.0)], "track_id string, total_m double")
    assert gradient.stops_by_way(speeds_of(spark, whole), short).count() == 0
    tie = [(2, 10, 10, 3), (3, 10.000001, 0.000001, 9), (4, 40, 29.999999, 6)]
    assert gradient.stops_by_way(speeds_of(spark, tie)).count() == 3  # equal progress: the last one's colour


def test_stops_by_point_count_points_without_length(spark):
    p = track(spark, [(0, 0, 1, k, 0) for k in range(5)])
    s = spark.createDataFrame([("t", 2, 3.0), ("t", 4, 9.0)], "track_id string, seq int, smooth_kmh double")
    got = [(r.progress, r.colour) for r in gradient.stops_by_point(p, s).orderBy("progress").collect()]
    assert [x for x, _ in got] == [0, 0.25, 0.75, 1] and got[0][1] == got[1][1] == "#2563eb" and got[2][1] == got[3][1] == "#dc2626"


def test_outlier_details_are_the_first_of_each_track(spark):
    rows = [(t, k, 10.0 * k, 10.0, 1.0, float(k), 5.0) for t in ("a", "b") for k in range(1, 100)]
    judged = spark.createDataFrame(rows, "track_id string, seq int, distance_m double, metres double, dt double, kmh double, ceiling_kmh double")
    got = series.outlier_details(judged)
    assert got.count() == 100 and {r.n_outliers for r in got.collect()} == {94}
    assert [r.seq for r in got.filter("track_id = 'a'").orderBy("k").collect()] == list(range(6, 56))
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_modes_of_the_golden_track(spark):
    """One plan for all modes: the filtered row has the known numbers, flags and filters, and equals a run of its own."""
    points = [(a, b, e, t, 0) for a, b, e, t in RIDGE]
    p = track(spark, points).unionByName(track(spark, points, "u"))
    terrain = spark.createDataFrame([("u", k, 500.0 + 10 * k) for k in range(1, 6)], "track_id string, seq int, terrain_ele double")
    tracks = spark.createDataFrame([("t", {"gain_m": 130.0, "moving_s": 1500.0}, "recomputed_basecamp"), ("u", None, IMPORTED)], "track_id string, summary map<string, double>, requested string")
    rows = {(r.track_id, r.mode): r for r in analyse_modes(p, tracks, terrain).collect()}
    assert set(rows) == {("t", FILTERED), ("t", RAW), ("t", IMPORTED), ("u", FILTERED), ("u", RAW), ("u", TERRAIN)}
    assert {k for k, r in rows.items() if r.is_default} == {("t", FILTERED), ("u", TERRAIN)}
    golden = rows["t", FILTERED]
    assert golden.total_distance_m == pytest.approx(1132.89, abs=0.01) and (golden.total_s, golden.moving_s, golden.recording_mode, golden.nominal_s) == (1680, 1680, "sparse", 450)
    assert (golden.gain_m, golden.loss_m) == pytest.approx((125, 10), abs=0.5) and (golden.min_ele, golden.max_ele) == (620, 735)
    assert {"distance_domain_fusion", "confirmed_elevation_turns", "filtered_extrema_used", "moving_time_hysteresis"} <= set(golden.filters)
    assert {"filtered_extrema_used", "moving_time_heuristic", "sampling_sparse"} <= set(golden.flags)
    single = analyse(track(spark, points))["summary"].withColumnRenamed("mode", "recording_mode").first()
    for c in single.asDict():
        assert c == "track_id" or golden[c] == single[c] or golden[c] == pytest.approx(single[c]), c
    stated = rows["t", IMPORTED]
    assert (stated.gain_m, stated.moving_s, stated.loss_m) == (130, 1500, golden.loss_m)
    assert stated.flags[-1] == "summary_imported" and "moving_time_heuristic" not in stated.flags and "imported_summary" in stated.filters and "moving_time_hysteresis" not in stated.filters
    assert (rows["u", TERRAIN].min_ele, rows["u", TERRAIN].max_ele) == (510, 550) and rows["u", FILTERED].max_ele == 735
    audit = {s.id: s for s in golden.audit}
    assert list(audit) == ["input", "cleaning", "continuity", "elevation", "movement", "sampling", "summary"]
    assert [s.status for s in golden.audit] == ["ok", "ok", "ok", "changed", "changed", "warning", "warning"]
    assert [x.value for x in audit["input"]["items"]] == ["5", FILTERED] and [x.value for x in audit["cleaning"]["items"]] == ["5 kept", "0"]
    assert [x.value for x in audit["summary"]["items"]][:2] == ["1133 m", "125 m"]
    patched = {s.id: s for s in stated.audit}
    assert patched["input"]["items"][1].value == IMPORTED and [x.id for x in patched["summary"]["items"]] == ["distance", "elevationGain", "source", "flags"]
    assert patched["elevation"] == audit["elevation"]


def test_numbers_and_dates_by_language(spark):
    row = spark.range(1).select(*(values.metres_text(F.lit(x), n).alias(f"{n}{k}") for n in values.SEPARATORS for k, x in enumerate((1234.0, 12345.65, -0.5)))).first()
    assert row[:] == ("1,234.0 m", "12,345.7 m", "-0.5 m", "1.234,0 m", "12.345,7 m", "-0,5 m", "1234,0 m", "12.345,7 m", "-0,5 m", "1 234,0 m", "12 345,7 m", "-0,5 m", "1 234,0 m", "12 345,7 m", "-0,5 m")
    noisy = spark.range(1).select(*(values.metres_text(F.lit(x)) for x in (207.54999999999998, -207.54999999999998, 207.54, 1e300))).first()
    assert noisy[:3] == ("207.6 m", "-207.6 m", "207.5 m") and noisy[3].startswith("1,000,") and noisy[3].endswith(".0 m")
    texts = {n: spark.range(1).select(values.date_text(F.lit("25-27"), F.lit(5), F.lit(2024), n)).first()[0] for n in values.DATES}
    assert texts == {"en": "May 25-27, 2024", "de": "25-27. Mai 2024", "es": "25-27 de mayo de 2024", "fr": "25-27 mai 2024", "ru": "25-27 мая 2024"}


def test_a_stated_activity_sets_the_thresholds(spark):
    p = track(spark, [(a, b, e, t, 0) for a, b, e, t in RIDGE])
    named = p.withColumn("explicit_kind", F.lit("water")).unionByName(track(spark, [(a, b, e, t, 0) for a, b, e, t in RIDGE], "odd").withColumn("explicit_kind", F.lit("chess")))
    assert [r.activity for r in elevation.activity(p).collect()] == ["foot"]
    assert {r.track_id: r.activity for r in elevation.activity(named).collect()} == {"t": "water", "odd": "foot"}
    rows = {r.track_id: (r.base_m, r.sustain_m) for r in elevation.defaults(named).collect()}
    assert rows == {"t": (15, 300), "odd": (3, 20)}
    summary = {r.track_id: r.gain_m for r in analyse(named)["summary"].collect()}
    assert summary["odd"] == pytest.approx(125, abs=0.5) and summary["t"] <= 125


def test_islands():
    assert tails.islands(np.array([True, True, False, True])) == [(0, 1), (3, 3)]
    assert tails.islands(np.array([], bool)) == []
    rng = random.Random(1)
    mark = np.array([rng.random() < 0.5 for _ in range(200)])
    assert sum(b - a + 1 for a, b in tails.islands(mark)) == mark.sum()


def test_slow_descents_are_water(spark):
    """A river, a noisy river, and near misses: too fast, too little, leaps that are no noise, falls without a speed."""
    def track(name, eles, lat_step=1e-5, timed=True):
        return [(name, k, k * 1000 if timed else None, 43 + k * lat_step, 42.0, e, 0, "bike" if name == "stated" else None) for k, e in enumerate(eles)]

    even, noisy = [500.0 - k for k in range(100)], [500.0 - k + k % 2 * 5 for k in range(100)]
    rows = track("river", even) + track("stated", even) + track("noisy", noisy) + track("fast", even, 1e-4) + track("short", even[:60]) + track("leaping", [500.0 - k + k % 2 * 2 for k in range(100)]) + track("plan", even, timed=False) + track("still", even, 0.0)
    p = spark.createDataFrame(rows, "track_id string, seq int, ts_ms long, lat double, lon double, ele double, segment int, explicit_kind string")
    got = {r.track_id: (r.activity, r.confidence, r.reason) for r in elevation.activity(p).collect()}
    assert got == {
        "river": ("water", 0.7, "sustained_directional_descent"), "stated": ("bike", 0.95, "explicit_activity"), "noisy": ("water", 0.62, "noisy_sustained_descent"), "fast": ("motor", 0.72, "motor_speed"),
        "short": ("foot", 0.66, "foot_speed"), "leaping": ("foot", 0.66, "foot_speed"), "plan": ("route_plan", 0.75, "no_timestamps"), "still": ("unknown", 0.35, "insufficient_motion_signal"),
    }
    d = {r.track_id: r for r in elevation.activity(p).collect()}
    assert (d["river"].net_ele, d["river"].raw_ele, d["river"].descent_m, d["still"].descent_m) == (-99, 99, 99, 0) and d["leaping"].directional < 0.75
    assert [tuple(r)[1:] for r in diagnostics.activity_candidates(p).filter("track_id = 'stated'").collect()] == [(1, "bike", 0.95, "explicit_activity")]
