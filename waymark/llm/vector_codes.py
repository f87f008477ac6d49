"""Vector code compression: product codes found by partial-distance search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import ship
from waymark.llm.common import staged


def kept_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, vector, label of the rows whose vector holds numbers and all are finite."""
    finite = (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vector_col].cast("array<double>").alias("vector"), rows[label_col].alias("label")).filter(finite)


def whole_numbers(vectors: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, a row a vector. What would overflow the sums of squares stays at their bound."""
    bound = math.isqrt((1 << 62) // dims) // 2
    values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.clip(np.floor(values * float(scale)), -bound, bound).astype(np.int64)


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest entry of the book and its squared distance, ties to the lower entry.

    Dimensions in which the entries vary most come first. A point's best complete distance is that of the entry that looks
    nearest so far; entries whose sum over the dimensions seen strictly exceeds it are dropped, so none at the least distance
    is, and the entry behind the bound itself stays.
    """
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    points, book = points[:, order], book[:, order]
    sums = np.square(points[:, :1] - book[:, 0])
    best = np.square(points - book[sums.argmin(axis=1)]).sum(axis=1)
    row, entry = np.nonzero(sums <= best[:, None])
    sums = sums[row, entry]
    for j in range(1, len(order)):
        sums += np.square(points[row, j] - book[entry, j])
        stay = sums <= best[row]
        row, entry, sums = row[stay], entry[stay], sums[stay]
        if j + 1 < len(order):
            first = leading(row, sums)
            best = np.minimum(best, np.square(points - book[entry[first]]).sum(axis=1))
    first = leading(row, sums)
    return entry[first], sums[first]


def leading(row: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Where each row's least sum stands first; rows ascend and none is missing."""
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(sums, starts)
    hits = np.flatnonzero(sums == least[row])
    return hits[np.flatnonzero(np.diff(row[hits], prepend=-1))]


def first_vectors(kept: DataFrame, entries: int) -> list[tuple]:
    """The vectors of the ``entries`` smallest ids: each task gives as many at most, and so does the merge of them. Of the
    vectors of a repeated id the least counts, null ids come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple, tuple] = {}
        for batch in batches:
            ids = batch.column(0)
            keys = np.where(ids.is_null().to_numpy(False), np.iinfo(np.int64).max, ids.fill_null(0).to_numpy())
            last = max(k[1] if not k[0] else np.iinfo(np.int64).max for k in least) if len(least) >= entries else np.iinfo(np.int64).max
            able = np.flatnonzero(keys <= last)
            wanted = np.unique(keys[able])[: entries + 1]
            for at in able[np.isin(keys[able], wanted)]:
                i, v = ids[at].as_py(), tuple(batch.column(1)[at].as_py())
                key = (i is None, i or 0)
                if key not in least or v < least[key]:
                    least[key] = v
            least = {k: least[k] for k in sorted(least)[:entries]}
        if least:
            ids = pa.array([None if null else i for null, i in least], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(least.values()), pa.list_(pa.float64()))], names=["vec_id", "vector"])

    one = kept.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector array<double>").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return [tuple(r) for r in one.orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]


def learned(kept: DataFrame, parts: int, dims: int, entries: int, rounds: int, scale: int) -> np.ndarray:
    """The codebooks, (parts, entries, dims of a part): a round's sums are made in the tasks, merged by (part, entry), and
    come to the driver as one row an entry."""
    width = dims // parts
    start = whole_numbers(pa.array([v for _, v in first_vectors(kept, entries)], pa.list_(pa.float64())), dims, scale)
    books = start.reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    names = [f"s{j}" for j in range(width)]
    for _ in range(rounds):
        shipped = kept.sparkSession.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            books = shipped.value
            sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                points = whole_numbers(batch.column(0), dims, scale).reshape(-1, parts, width)
                for p in range(parts):
                    entry, _ = nearest(points[:, p], books[p])
                    counts[p] += np.bincount(entry, minlength=len(counts[p]))
                    np.add.at(sums[p], entry, points[:, p])
            part, entry = np.nonzero(counts)
            columns = [part, entry, counts[part, entry], *sums[part, entry].T]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["part", "entry", "n", *names])

        tasks = kept.select("vector").mapInArrow(run, ", ".join(f"{c} long" for c in ["part", "entry", "n", *names]))
        for part, entry, n, *sums in tasks.groupBy("part", "entry").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *names])).collect():
            books[part, entry] = [int(s) // int(n) for s in sums]
    return books


def compress(
    rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Rows vec_id, code, error, label_error, codebooks_sha256 of every vector of finite numbers.

    Components become floor(scale * x); a vector is cut into ``parts`` equal parts, each coded as the nearest of at most
    ``entries`` (256 or fewer) entries of that part's codebook. Codebooks start from the vectors of the smallest ids and are
    averaged ``rounds`` times; unused entries stay. Only codebooks, whose size the parameters fix, reach the driver or are
    broadcast; the coded rows are staged, as both the labels' sums and the result read them.
    Left out: null and empty vectors, null, NaN or infinite components, vectors that aren't as long as that of the smallest id, and all
    if that length isn't a multiple of ``parts``. Repeated rows each get a row; null ids stay null. Components are held at
    2**30 / sqrt(dims) after scaling. label_error is the sum of error over equal labels (nulls together), null if it is more
    than a long holds. A label of any share of the rows is summed in the tasks first. No vectors give no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    kept = kept_vectors(rows, id_col, vector_col, label_col)
    kind = kept.schema["label"].dataType
    schema = f"vec_id long, label {kind.simpleString()}, code string, error long"
    smallest = kept.agg(F.min(F.struct(F.col("vec_id").isNull().alias("x"), "vec_id", F.size("vector").alias("dims"))).alias("m")).first()[0]
    dims = smallest.dims if smallest else 0
    if not dims or dims % parts:
        return spark.createDataFrame([], schema).select("vec_id", "code", "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    kept = kept.filter(F.size("vector") == dims)
    books = learned(kept, parts, dims, entries, rounds, scale)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    shipped = spark.sparkContext.broadcast(books)
    width = dims // parts
    digits = np.array([f"{k:02x}" for k in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shipped.value
        for batch in batches:
            points = whole_numbers(batch.column(2), dims, scale).reshape(-1, parts, width)
            found = [nearest(points[:, p], books[p]) for p in range(parts)]
            codes = np.stack([digits[entry] for entry, _ in found], axis=1)
            error = np.sum([d for _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map("".join, codes), pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    coded = staged(kept.select("vec_id", "label", "vector").mapInArrow(run, schema))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS bigint)").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
