"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import ship

#: ASCII white space as the contracts define it: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a local
    master; on a cluster that would be a different disk on each machine, so it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


class Folders(threading.local):
    """A list for each thread, so that queries in several threads of one driver count and delete their own folders only."""

    def __init__(self):
        self.paths: list[str] = []

    def __len__(self) -> int:
        return len(self.paths)

    def __getitem__(self, places):
        return self.paths[places]

    def __delitem__(self, places) -> None:
        del self.paths[places]

    def append(self, path: str) -> None:
        self.paths.append(path)


#: Folders that staged() has written in this thread and discard() hasn't deleted.
STAGED = Folders()


def staged(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts lineage, survives lost executors. The shuffle
    files of the finished write are of no more use and go at once; the folder stays until discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/waymark-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Deletes what staged() wrote from place ``since`` of STAGED on (to ``until``): for callers that have written all that
    reads it."""
    for path in STAGED[since:until]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del STAGED[since:until]


def numbered(docs: DataFrame, row: str = "_row") -> DataFrame:
    """docs with a column ``row``: a long that no other row has. Written to the shared folder, so that all who read it see
    the same numbers, whatever is computed again."""
    return staged(docs.withColumn(row, F.monotonically_increasing_id()))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, under fixed names; a null text becomes the empty text."""
    ship(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def per_text(
    docs: DataFrame, schema: str, make: Callable[[], Callable[[list, list[str]], Iterable[tuple]]], rows_per_batch: int = 256
) -> DataFrame:
    """Maps Arrow batches of (doc_id, text) to rows of ``schema``.

    make() runs once a task and returns a function from the ids and texts of a slice to its rows, so large texts meet
    in slices of ``rows_per_batch`` rows only.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_batch):
                part = batch.slice(start, rows_per_batch)
                rows = list(work(part.column(0).to_pylist(), part.column(1).to_pylist()))
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(run, schema)


class TwoGenerations(dict):
    """A bounded cache: when the young half is full it becomes the old half, and what is used moves back."""

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
