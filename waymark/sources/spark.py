"""Track files and functions on points as parts of Spark: a data source, a table function and SQL functions.

    register(spark)
    spark.read.format("waymark").load("tracks/")                          # a row for each file, as read_files gives them
    spark.read.format("waymark").option("rows", "points").load("tracks/")  # a row for each point
    SELECT f.path, p.* FROM files f, LATERAL track_points(f.path, f.content) p
    SELECT way_m(lat1, lon1, lat2, lon2), bearing_deg(lat1, lon1, lat2, lon2), turn_deg(b1, b2)
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.functions import udtf

from waymark import ship
from waymark.functions.geo import ECC2, RADIUS
from waymark.sources.files import FILE, POINT, UNSTATED, file_row
from waymark.sources.gpx import CHUNK, stream
from waymark.sources.parse import BadTrack, parse, route

#: Points in a batch that a task hands over.
BATCH = 4096
#: Bytes of files that a task reads, unless the option groupBytes says otherwise; a larger file has a task of its own.
GROUP_BYTES = 64 << 20


@dataclass
class Group(InputPartition):
    """Files that one task reads: their names as track_id, their paths in the file system, their sizes."""

    files: list[tuple[str, str, int]]


def file_system(path: str) -> tuple[fs.FileSystem, str, Callable[[str], str]]:
    """A path's file system, the path in it, and what makes a track_id of a path in it: the name that Spark's own readers
    give the file."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file" or "/" in scheme:
        local = fs.LocalFileSystem()
        plain = local.normalize_path("/" + rest.lstrip("/") if scheme == "file" and colon else path)
        return local, plain, lambda p: f"file:{p}"
    system, inner = fs.FileSystem.from_uri(path)
    before = path.removesuffix("/").removesuffix(inner.removesuffix("/"))
    return system, inner, lambda p: before + p


class Tracks(DataSource):
    """GPX and like XML, TCX and FIT files below a path. Options: rows (files or points), pathGlobFilter, groupBytes."""

    @classmethod
    def name(cls) -> str:
        return "waymark"

    def schema(self) -> str:
        kind = self.options.get("rows", "files")
        if kind not in ("files", "points"):
            raise ValueError(f"rows is files or points, not {kind}")
        return FILE if kind == "files" else "track_id string, " + POINT.replace(":", "")

    def reader(self, schema) -> TrackReader:
        return TrackReader(dict(self.options), schema)


class TrackReader(DataSourceReader):
    """Lists files on the driver (names and sizes alone) and deals them to tasks by size; every task opens its own files. As
    points, a GPX file streams through in memory that doesn't grow with it; TCX and FIT files are held whole. A file that
    can't be read is a row with an error, or no points."""

    def __init__(self, options: dict[str, str], schema) -> None:
        self.options, self.schema, self.filters = options, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on track_id, and on format, choose files before any is opened."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if isinstance(f, EqualTo | In) and column in (("track_id",), ("format",)) or isinstance(f, StringStartsWith | StringEndsWith) and column == ("track_id",):
                self.filters.append(f)
            else:
                yield f

    def wanted(self, track_id: str) -> bool:
        for f in self.filters:
            own = track_id if f.attribute == ("track_id",) else route(track_id)
            match f:
                case EqualTo():
                    fits = own is not None and own == f.value
                case In():
                    fits = own is not None and own in f.value
                case StringStartsWith():
                    fits = own.startswith(f.value)
                case _:
                    fits = own.endswith(f.value)
            if not fits:
                return False
        return True

    def partitions(self) -> list[Group]:
        system, inner, named = file_system(self.options["path"])
        info = system.get_file_info(inner)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
        glob, most = self.options.get("pathglobfilter", self.options.get("pathGlobFilter", "*")), int(self.options.get("groupbytes", self.options.get("groupBytes", GROUP_BYTES)))
        files = [(named(f.path), f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, glob) and f.base_name[:1] not in "._"]
        groups, room = [], 0
        for f in sorted(f for f in files if self.wanted(f[0])):
            if not groups or f[2] > room:
                groups.append(Group([]))
                room = most
            groups[-1].files.append(f)
            room -= f[2]
        return groups or [Group([])]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        system, _, _ = file_system(self.options["path"])
        for track_id, path, size in partition.files:
            if self.options.get("rows", "files") == "files":
                with system.open_input_stream(path) as f:
                    yield pa.RecordBatch.from_pylist([file_row(track_id, size, f.read())], schema=arrow)
                continue
            rows = ({"track_id": track_id, "seq": k} | p for k, p in enumerate(points(system, track_id, path), 1))
            try:
                for part in batched(rows, BATCH):
                    yield pa.RecordBatch.from_pylist([UNSTATED | p for p in part], schema=arrow)
            except BadTrack:
                continue


def points(system: fs.FileSystem, track_id: str, path: str) -> Iterator[dict]:
    """A file's points; BadTrack before the first one if it can't be read."""

    def opened() -> Iterator[bytes]:
        with system.open_input_stream(path) as f:
            while part := f.read(CHUNK):
                yield part

    if route(track_id) == "gpx":
        return stream(opened)
    return iter(parse(track_id, b"".join(opened()))["points"])


class TrackPoints:
    """eval(path, content): the points of one file's bytes, whose format its path names; none if either is null or the file
    can't be read."""

    columns = [c.split(":")[0].strip() for c in POINT.split(", ")]

    def eval(self, path: str, content: bytes):
        if path is None or content is None:
            return
        for k, p in enumerate(parse(path, bytes(content))["points"], 1):
            row = UNSTATED | p | {"seq": k}
            yield tuple(row[c] for c in self.columns)


#: SQL functions, put into plans as expressions by the optimizer; their results are those of functions.geo.
FUNCTIONS = {
    "way_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)": f"""CASE WHEN lat1 = lat2 AND lon1 = lon2 THEN 0.0D ELSE
        sqrt(pow({RADIUS}D * (1 - {ECC2}D) / pow(sqrt(1 - {ECC2}D * pow(sin(radians((lat1 + lat2) / 2)), 2)), 3) * radians(lat2 - lat1), 2)
        + pow({RADIUS}D / sqrt(1 - {ECC2}D * pow(sin(radians((lat1 + lat2) / 2)), 2)) * cos(radians((lat1 + lat2) / 2)) * radians(lon2 - lon1), 2)) END""",
    "bearing_deg(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)": """pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)),
        cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360, 360.0D)""",
    "turn_deg(first DOUBLE, second DOUBLE)": "CASE WHEN abs(first - second) > 180 THEN 360 - abs(first - second) ELSE abs(first - second) END",
}


def register(spark: SparkSession) -> None:
    """Makes the data source waymark, the table function track_points and the SQL functions known to the session, and lets
    filters reach Python data sources."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tracks)
    spark.udtf.register("track_points", udtf(TrackPoints, returnType=POINT))
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")
