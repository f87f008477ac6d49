"""Track files, and streams of points."""

import struct

import pytest
from pyspark.sql import functions as F
from waymark.operators import series
from waymark.plans.queries import QUERIES
from waymark.plans.summary import track_summary
from waymark.sources import tables
from waymark.sources.files import apply_terrain, points_of, read_files, tracks_of, with_imported, without_flat_times, without_synthetic_times, without_zero_elevations
from waymark.sources.parse import activity_kind, is_generic, route, stem
from waymark.sources.tables import supplier_points
from waymark.streaming.live import bounds_by_window, sessions

GPX = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><metadata><name>Meta</name></metadata>
<rte><rtept lat="1" lon="2"/></rte><wpt lat="9" lon="9"/>
<trk><name> Ridge </name><type>hiking</type><extensions><Total_Ascent>125</Total_Ascent><x maxSpeed="9.5"/></extensions>
<trkseg></trkseg><trkseg><trkpt lat="43.1" lon="42.1"><ele>130</ele><time>2024-05-25T08:00:00</time><geoidheight>30</geoidheight><sat>7</sat><hdop>1.5</hdop>
<extensions><elevationDatum>ellipsoid</elevationDatum><elevationSource>barometric</elevationSource></extensions></trkpt>
<trkpt lat="43.2" lon="42.1"><time>2024-05-25T08:00:10Z</time></trkpt></trkseg><trkpt lat="44" lon="42"/></trk></gpx>"""
TCX = """<TrainingCenterDatabase xmlns="http://www.garmin.com/xmlschemas/TrainingCenterDatabase/v2"><Activities><Activity Sport="Running">
<Lap><TotalTimeSeconds>95</TotalTimeSeconds><DistanceMeters>310</DistanceMeters><MaximumSpeed>4</MaximumSpeed><Track>
<Trackpoint><Time>2021-03-07T17:20:05Z</Time><Position><LatitudeDegrees>-8.25</LatitudeDegrees><LongitudeDegrees>115.5</LongitudeDegrees></Position><Extensions>
<TPX xmlns="http://www.garmin.com/xmlschemas/ActivityExtension/v2"><Speed>3.5</Speed><Watts>210</Watts></TPX></Extensions></Trackpoint></Track></Lap>
<Lap><TotalTimeSeconds>45</TotalTimeSeconds><DistanceMeters>190</DistanceMeters><MaximumSpeed>5</MaximumSpeed><Calories>31</Calories><Track>
<Trackpoint><Time>2021-03-07T17:22:25Z</Time><Position><LatitudeDegrees>-8.254</LatitudeDegrees><LongitudeDegrees>115.5</LongitudeDegrees></Position><AltitudeMeters>71</AltitudeMeters></Trackpoint></Track></Lap></Activity></Activities></TrainingCenterDatabase>"""


def fit_file():
    """Four records, the third without a time, a session of a hike, and a timer that stops and starts again."""
    def definition(n, kind, fields):
        return struct.pack("<BBBHB", 0x40 | n, 0, 0, kind, len(fields)) + b"".join(bytes(f) for f in fields)

    t, semi = 900_000_000, lambda d: int(d * 2**31 / 180)
    body = definition(0, 20, [(253, 4, 0x86), (0, 4, 0x85), (1, 4, 0x85), (2, 2, 0x84)])
    for dt, lat, ele in ((0, -33.5, 12), (40, -33.501, 15), (None, -33.502, 19), (130, -33.503, 18)):
        body += struct.pack("<BIiiH", 0, 0xFFFFFFFF if dt is None else t + dt, semi(lat), semi(150.25), (ele + 500) * 5)
    body += definition(1, 18, [(9, 4, 0x86), (7, 4, 0x86), (14, 2, 0x84), (22, 2, 0x84), (5, 1, 0)]) + struct.pack("<BIIHHB", 1, 35_000, 130_000, 2500, 9, 17)
    body += definition(2, 21, [(253, 4, 0x86), (0, 1, 0), (1, 1, 0)])
    for dt, kind in ((0, 0), (50, 4), (90, 0)):
        body += struct.pack("<BIBB", 2, t + dt, 0, kind)
    return struct.pack("<BBHI4sH", 14, 16, 2100, len(body), b".FIT", 0) + body + b"\0\0"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tracks")
    (d / "a.gpx").write_text(GPX)
    (d / "b.tcx").write_text(TCX)
    (d / "c.fit").write_bytes(fit_file())
    (d / "broken.gpx").write_text("<gpx><trk>")
    (d / "out.gpx").write_text('<gpx><trk><trkseg><trkpt lat="99" lon="0"/></trkseg></trk></gpx>')
    (d / "none.gpx").write_text('<gpx><trk><trkseg><trkpt lat="9"/></trkseg></trk></gpx>')
    (d / "notes.txt").write_text("x")
    return read_files(spark, str(d)).cache()


def name(path):
    return path.rpartition("/")[2]


def test_files_and_errors(files):
    rows = {name(r.track_id): r for r in tracks_of(files, points_of(files)).collect()}
    assert {k: r.error for k, r in rows.items() if r.error} == {"broken.gpx": "invalid_xml", "out.gpx": "coordinates_out_of_bounds", "none.gpx": "missing_coordinates", "notes.txt": "unsupported_format"}
    a, b, c = rows["a.gpx"], rows["b.tcx"], rows["c.fit"]
    assert (a.name, a.activity, a.activity_kind, a.activity_source, a.n_points, a.n_segments, a.elevation_source) == ("Ridge", "hiking", "foot", "gpx_track_type", 4, 2, "barometric")
    assert dict(a.summary) == {"gain_m": 125, "max_kmh": 9.5}
    assert (b.activity, b.activity_kind, b.name) == ("Running", "foot", "b") and dict(b.summary) == {"total_distance_m": 500, "total_s": 140, "moving_s": 140, "max_kmh": 18, "calories": 31}
    assert dict(c.summary) == {"total_distance_m": 350, "total_s": 130, "average_kmh": 9, "gain_m": 9} and [e.action for e in c.timer] == ["start", "stop", "start"]
    assert (c.activity, c.activity_kind, c.activity_source) == ("hiking", "foot", "fit_session_sport")
    assert "no_points" in rows["broken.gpx"].errors and a.warnings == []


def test_points(files):
    rows = {(name(r.track_id), r.seq): r for r in points_of(files).collect()}
    first = rows["a.gpx", 1]
    assert (first.lat, first.ele, first.ts_ms, first.zone, first.segment, first.satellites, first.hdop) == (43.1, 100, 1716624000000, "missing", 0, 7, 1.5)
    assert [(rows["a.gpx", k].lat, rows["a.gpx", k].segment, rows["a.gpx", k].phys) for k in (2, 3, 4)] == [(43.2, 0, 0), (44, 0, 1), (1, 1, 2)]
    assert rows["c.fit", 2].lat == pytest.approx(-33.501, abs=1e-6) and rows["c.fit", 2].ele == 15 and rows["c.fit", 2].ts_ms - rows["c.fit", 1].ts_ms == 40_000
    assert [rows["c.fit", k].segment for k in (1, 2, 3, 4)] == [0, 0, 1, 1]
    assert (rows["b.tcx", 1].speed_mps, rows["b.tcx", 1].cadence, rows["b.tcx", 1].watts, rows["b.tcx", 2].watts) == (3.5, None, 210, None)
    s = {name(r.track_id): r for r in with_imported(track_summary(points_of(files)), files).collect()}
    assert s["b.tcx"].total_distance_m == 500 and "total_s" in s["b.tcx"].imported and s["b.tcx"].n_points == 2


def test_placeholders(spark):
    rows = [("t", k, 0.0 if k != 7 else 30.0, 5 if k < 10 else 6 + k, 0 if k < 10 else 1) for k in range(40)]
    p = spark.createDataFrame(rows, "track_id string, seq int, ele double, ts_ms long, segment int")
    assert without_zero_elevations(p).filter("ele is not null").count() == 0
    assert without_zero_elevations(p.filter("seq > 25")).filter("ele is null").count() == 0
    assert without_flat_times(p).filter("ts_ms is null").count() == 10


def test_made_up_times_go(spark):
    def rows(name, lats, step=10):
        return [(name, k, k * step * 1000, lat, 42.0, 0, 0) for k, lat in enumerate(lats)]

    fast, calm = [43 + 0.02 * k for k in range(9)], [43 + 1e-4 * k for k in range(12)]
    spiked = [43.5 if k == 5 else x for k, x in enumerate(calm)]
    data = rows("fast", fast) + rows("slow", calm) + rows("spiked", spiked) + rows("few", fast[:6]) + rows("wide", fast, 60)
    p = spark.createDataFrame(data, "track_id string, seq int, ts_ms long, lat double, lon double, segment int, phys int")
    timed = {r.track_id: r.n for r in without_synthetic_times(p).groupBy("track_id").agg({"ts_ms": "count"}).withColumnRenamed("count(ts_ms)", "n").collect()}
    assert timed == {"fast": 0, "slow": 12, "spiked": 12, "few": 6, "wide": 9}


def test_names_and_formats():
    assert all(map(is_generic, ["Track", " TRACK 12", "Current  track: 2024-01-01", "Activité", "untitled", "Aktivität 3", "Новый трек #4"]))
    assert not any(map(is_generic, ["Track to the hut", "Ridge", "route 66", "trackside 5"]))
    assert [activity_kind(x) for x in (" Road Cycling", "mountain-biking", "Swimming", "chess", None)] == ["bike", "bike", "water", None, None]
    assert (stem("/a/b.c/Lake.walk.gpx"), route("x.bin", "application/gpx+xml"), route("x.GPX", "text/tcx"), route("x", "text/xml"), route("x")) == ("Lake.walk", "gpx", "gpx", "gpx", None)


def test_terrain_is_all_or_nothing(spark):
    p = spark.createDataFrame([("t", 1, 5.0, "gpx"), ("t", 2, 6.0, "gpx"), ("u", 1, 7.0, "gpx")], "track_id string, seq int, ele double, ele_source string")
    terrain = spark.createDataFrame([("t", 1, 50.0), ("u", 1, 70.0)], "track_id string, seq int, terrain_ele double")
    assert {(r.track_id, r.seq): (r.ele, r.ele_source) for r in apply_terrain(p, terrain).collect()} == {("t", 1): (5, "gpx"), ("t", 2): (6, "gpx"), ("u", 1): (70, "terrain")}


@pytest.mark.parametrize(("operator", "rows"), [(sessions, [("t", "08:00", 3), ("t", "08:10", 2)]), (bounds_by_window, [("t", "08:00", 3), ("t", "08:10", 2), ("t", "08:40", 1)])])
def test_streams(spark, tmp_path, operator, rows):
    data = [("t", f"2024-05-25 08:{m:02d}:00", 43.0 + m / 100, 42.0, 100.0 + m) for m in (0, 1, 2, 10, 11, 40)]
    points = spark.createDataFrame(data, "track_id string, ts string, lat double, lon double, ele double")
    points.selectExpr("track_id", "timestamp(ts) AS ts", "lat", "lon", "ele").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("track_id string, ts timestamp, lat double, lon double, ele double").parquet(str(tmp_path / "in"))
    q = operator(stream).writeStream.format("memory").queryName(operator.__name__).outputMode("complete" if operator is bounds_by_window else "append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.table(operator.__name__).select("track_id", F.date_format("start", "HH:mm"), "n_points").orderBy("start").collect()]
    assert got == rows
    if operator is bounds_by_window:
        first = spark.table(operator.__name__).orderBy("start").first()
        assert (first.min_lat, first.max_lat, first.min_ele, first.max_ele) == (43, 43.02, 100, 102)


def test_lines_of_one_number_have_one_order(spark, tmp_path):
    rows = [(7, 5, 1, 100.0), (7, 5, 1, 300.0), (7, 5, 1, 200.0), (7, 4, 2, 900.0)]
    got = []
    for name, some in (("a", rows), ("b", rows[::-1])):
        spark.createDataFrame(some, "l_suppkey long, l_orderkey long, l_linenumber int, l_extendedprice double").coalesce(1).write.parquet(str(tmp_path / name / "lineitem.parquet"))
        got.append([r.ele for r in supplier_points(spark, str(tmp_path / name)).orderBy("seq").collect()])
    assert got[0] == got[1] == [100.45, 100.05, 100.1, 100.15]


def test_partitions_grow_with_the_table(spark, monkeypatch):
    """A task's rows don't grow with the table: it is dealt by track into more partitions, each track whole."""
    small = "/root/testdata/sf0.001"
    plain = sorted(tables.supplier_points(spark, small).collect())
    monkeypatch.setattr(tables, "ROWS_A_TASK", 300)
    dealt = tables.supplier_points(spark, small)
    assert sorted(dealt.collect()) == plain
    assert dealt.rdd.getNumPartitions() == -(-len(plain) // 300) > 8
    placed = dealt.select("track_id", F.spark_partition_id().alias("p")).distinct()
    assert placed.count() == placed.select("track_id").distinct().count()


def test_stops_by_way_read_the_lines_twice(spark):
    """Once for the speeds and once for the whole ways: neither copies of samples nor colours make them again."""
    plan = QUERIES["stops_by_way"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2
