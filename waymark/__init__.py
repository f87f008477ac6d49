"""Waymark: GPS activity track analytics on Spark DataFrames."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows in a batch that a Python task gets at a time: long texts count, so that tasks stay small.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application, so that tasks can import it wherever they run; and keeps the
    session's Arrow batches at BATCH_ROWS or below."""
    sc = spark.sparkContext
    if int(spark.conf.get(ROWS, "10000")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(ROWS, str(BATCH_ROWS))
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "waymark.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(target))


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir, with its partitioning and without its lineage: what several plans
    read is computed once, and their own plans stay small. Without such a folder a temporary one is taken on a local
    master; on a cluster that is an error, as its machines share no disk."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
