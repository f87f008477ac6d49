"""The pull reader of GPX, and track files as a Spark data source, table function and SQL functions."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from waymark.functions import geo
from waymark.sources.files import normalisations, points_of, raw_extensions, read_files, sensor_coverage
from waymark.sources.gpx import CHUNK, chunks, gpx, numeric, stream
from waymark.sources.parse import BadTrack, parse
from waymark.sources.spark import register

from tests.test_sources import GPX, TCX, fit_file

NAMED = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1" xmlns:g="http://www.topografix.com/GPX/1/1" xmlns:x="urn:x" xmlns:stats="http://www.garmin.com/xmlschemas/TrackStatsExtension/v1">
<metadata><name>Meta</name><extensions><x:device a="1" x:b="&quot;2&quot;">A &amp; B<!-- c --><![CDATA[<raw>]]></x:device></extensions></metadata>
<g:trk><g:name>Prefixed</g:name></g:trk>
<rte><type>swimming</type><rtept lat="5" lon="6"/></rte>
<trk><type>chess</type><type>hiking</type><extensions><stats:MovingSpeed maxspeed="4">2</stats:MovingSpeed></extensions>
<trkseg><g:trkpt lat="1" lon="1"/></trkseg>
<trkseg><trkpt lat="0x10" lon=""><g:ele> 120 </g:ele><ele>7</ele><time>
</time><geoidheight>20</geoidheight><extensions><o xmlns="urn:o"><elevationDatum>ELLIPSOID</elevationDatum></o><x:hr/></extensions><extensions><plain>1</plain></extensions></trkpt></trkseg></trk>
<extensions><distance>12</distance><y:z xmlns:y="urn:y" y:q="3"/></extensions></gpx>"""


def test_names_are_qualified():
    r = gpx(NAMED.encode())
    assert [(p["lat"], p["lon"], p["segment"], p["phys"]) for p in r["points"]] == [(16, 0, 0, 0), (5, 6, 1, 1)]
    first = r["points"][0]
    assert (first["ele"], first["geoid_m"], first["datum"], first["time_text"], first["ele_source"]) == (100, 20, "ellipsoid", None, "gpx")
    assert (r["name"], r["activity"], r["activity_source"]) == ("Meta", "swimming", "gpx_route_type")
    # the element's speed is in m/s, the attribute has no namespace
    assert r["summary"] == {"moving_kmh": 7.2, "max_kmh": 4, "total_distance_m": 12}


def test_fragments_stand_alone():
    r = gpx(NAMED.encode())
    default = ' xmlns="http://www.topografix.com/GPX/1/1"'
    assert r["extensions"] == {
        "gpx": [f"<distance{default}>12</distance>", '<y:z xmlns:y="urn:y" y:q="3"/>'],
        "metadata": ['<x:device xmlns:x="urn:x" a="1" x:b="&quot;2&quot;">A &amp; B<!-- c --><![CDATA[<raw>]]></x:device>'],
        "tracks": ['<stats:MovingSpeed xmlns:stats="http://www.garmin.com/xmlschemas/TrackStatsExtension/v1" maxspeed="4">2</stats:MovingSpeed>'],
    }
    assert r["points"][0]["extensions"] == ['<o xmlns="urn:o"><elevationDatum>ELLIPSOID</elevationDatum></o>', '<x:hr xmlns:x="urn:x"/>', f"<plain{default}>1</plain>"]
    for text in (f for level in r["extensions"].values() for f in level):
        again = gpx(f'<gpx><extensions>{text}</extensions><trkpt lat="1" lon="1"/></gpx>'.encode())
        assert again["extensions"]["gpx"] == [text]


def test_nested_default_namespaces():
    text = '<gpx><extensions><a xmlns="urn:a"><b xmlns=""><c xmlns="urn:a"/></b></a></extensions><trkpt lat="1" lon="1"/></gpx>'
    assert gpx(text.encode())["extensions"]["gpx"] == ['<a xmlns="urn:a"><b xmlns=""><c xmlns="urn:a"/></b></a>']


@pytest.mark.parametrize(("text", "code"), [
    ("lat,lon", "not_xml"), ("<gpx><trk>", "invalid_xml"), ("<gpx><p:trk/></gpx>", "invalid_xml"), ('<gpx><trkpt lat="1"/></gpx>', "missing_coordinates"),
    ('<gpx><rtept lat="1"/><trkpt lat="91" lon="1"/></gpx>', "coordinates_out_of_bounds"), ('<gpx><trkpt lat="1" lon="1_0"/></gpx>', "missing_coordinates"),
])
def test_errors(text, code):
    assert parse("a.gpx", text.encode())["error"] == code
    with pytest.raises(BadTrack, match=code):
        next(stream(lambda: chunks(text.encode())))


def test_empty_files_and_numbers():
    assert parse("a.gpx", b"\xef\xbb\xbf <gpx/>")["points"] == [] and parse("a.gpx", b"")["error"] == "invalid_xml"
    assert [numeric(t) for t in ("", " 1e2 ", "0x1F", "0b11", ".5", "5.", "1_0", "Infinity", "1e999", "٣", None)] == [0, 100, 31, 3, 0.5, 5, None, None, None, None, None]


def large(points: int) -> list[bytes]:
    row = b'<trkpt lat="%d.5" lon="7.25"><ele>%d</ele><time>2024-05-25T08:00:00Z</time><extensions><x hr="1">9</x></extensions></trkpt>'
    body = [b"<trkseg>" + b"".join(row % (k % 80, k % 900) for k in range(s, min(s + 1000, points))) + b"</trkseg>" for s in range(0, points, 1000)]
    return [b"<gpx><trk>", *body, b"</trk><rte>", b'<rtept lat="1" lon="2"/>' * 3, b"</rte></gpx>"]


def test_stream_equals_whole():
    data = b"".join(large(2500))
    whole = gpx(data)["points"]
    assert list(stream(lambda: chunks(data))) == whole and len(whole) == 2503
    assert [p["segment"] for p in whole[::1000]] == [0, 1, 2] and whole[-1]["segment"] == 3
    assert list(stream(lambda: (data[k : k + 7] for k in range(0, len(data), 7)))) == whole


def test_memory_does_not_grow(tmp_path):
    """19 MB of text, streamed by a process that grows by less than half of it."""
    target = tmp_path / "long.gpx"
    with target.open("wb") as f:
        f.writelines(large(150_000))
    assert target.stat().st_size > 17 << 20
    code = f"""
import resource, waymark.sources.gpx as g
def opened():
    with open({str(target)!r}, "rb") as f:
        while part := f.read({CHUNK}): yield part
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(1 for _ in g.stream(opened))
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parent.parent)
    n, grown = map(int, out.stdout.split())
    assert n == 150_003 and grown * 1024 < 8 << 20


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("tracks")
    (d / "deep").mkdir()
    (d / "a.gpx").write_text(GPX)
    (d / "named.gpx").write_text(NAMED)
    (d / "deep" / "b.tcx").write_text(TCX)
    (d / "c.fit").write_bytes(fit_file())
    (d / "broken.gpx").write_text("<gpx><trk>")
    (d / "notes.txt").write_text("x")
    return str(d)


@pytest.fixture(scope="module")
def session(spark):
    register(spark)
    return spark


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_source_gives_the_rows_of_read_files(session, folder):
    want = read_files(session, folder).cache()
    for size in ("1", "100000000"):
        got = session.read.format("waymark").option("groupBytes", size).load(folder)
        assert rows(got) == rows(want)
        assert got.rdd.getNumPartitions() == (6 if size == "1" else 1)
    each = session.read.format("waymark").option("rows", "points").load(folder)
    assert rows(each) == rows(want.select("track_id", F.inline("points")))
    assert rows(session.read.format("waymark").option("pathGlobFilter", "*.tcx").load(folder)) == rows(want.filter("track_id LIKE '%.tcx'"))


def test_filters_choose_files(session, folder):
    df = session.read.format("waymark").option("groupBytes", "1").load(folder)
    for test, n in (("format = 'gpx'", 3), ("format IN ('tcx', 'fit')", 2), ("track_id LIKE '%/a.gpx'", 1), (f"track_id = 'file:{folder}/c.fit'", 1), ("track_id LIKE 'http%'", 0)):
        some = df.filter(test)
        assert some.count() == n and some.rdd.getNumPartitions() == max(1, n)
    assert df.filter("error = 'invalid_xml' AND format = 'gpx'").count() == 1


def test_table_function(session, folder):
    session.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).createOrReplaceTempView("files")
    got = session.sql("SELECT f.path AS track_id, p.* FROM files f, LATERAL track_points(f.path, f.content) p")
    assert rows(got) == rows(read_files(session, folder).select("track_id", F.inline("points")))
    assert session.sql("SELECT * FROM track_points(CAST(NULL AS STRING), CAST(NULL AS BINARY))").count() == 0


def test_sql_functions(session):
    p = session.createDataFrame([(43.0, 42.0, 43.1, 42.3), (1.0, 2.0, 1.0, 2.0), (None, 1.0, 2.0, 3.0), (-10.0, 179.0, 10.0, -179.0)], "a double, b double, c double, d double")
    names = [F.col(c) for c in "abcd"]
    got = p.select(F.expr("way_m(a, b, c, d)").alias("m"), F.expr("bearing_deg(a, b, c, d)").alias("deg"), F.expr("turn_deg(a, d)").alias("t"))
    assert rows(got) == rows(p.select(geo.distance(*names).alias("m"), geo.bearing(*names).alias("deg"), geo.turn(names[0], names[3]).alias("t")))


def test_extension_and_sensor_rows(session, folder):
    files = read_files(session, folder)
    named = raw_extensions(files.filter("track_id LIKE '%named.gpx'"))
    assert {r.level: r.n for r in named.groupBy("level").agg(F.count("*").alias("n")).collect()} == {"gpx": 2, "metadata": 1, "tracks": 1, "point": 3}
    assert [(r.seq, r.k) for r in named.filter("level = 'point'").orderBy("seq", "k").collect()] == [(1, 0), (1, 1), (1, 2)]
    assert [tuple(r)[1:] for r in sensor_coverage(files.filter("format = 'tcx'")).collect()] == [(2, 1, 0, 1, 1)]
    assert {(r.track_id.rpartition("/")[2], r.kind, r.n_points) for r in normalisations(files).collect()} == {("a.gpx", "ellipsoid_to_msl", 1), ("named.gpx", "ellipsoid_to_msl", 1)}
    assert "extensions" not in points_of(files).columns
