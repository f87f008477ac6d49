"""Removal of repeated runs of lines, found as content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import id_and_text, staged

#: Marks of chunks: a chunk begins at a line whose rolling hash with the line after it is 0 modulo the divisor, and ends at
#: the next line whose rolling hash with the line before it is. Divisors are nested, the finest is used with three seeds; so
#: the lines of a chunk alone choose it, and it stands wherever they stand.
MARKS = ((2, 1), (2, 2), (2, 3), (4, 1), (8, 1))
MASK, MULTIPLIER = (1 << 64) - 1, 0x9E3779B97F4A7C15
#: Rows of an Arrow batch, and characters in it, from which a task hands it on; rows of one that it unpacks at a time.
ROWS, CHARACTERS, AT_ONCE = 10_000, 1 << 20, 50
NO_ID = 2**63 - 1


def chunks_of(lines: list[str], marks: tuple[tuple[int, int], ...] = MARKS) -> list[tuple[int, int]]:
    """The chunks of a text's lines: first and last line of each, both with more than white space. Blank lines belong to
    what they part. A text's first line begins a chunk and its last line ends one. Chunks of one line aren't any."""
    full = [k for k, line in enumerate(lines) if line and not line.isspace()]
    if len(full) < 2:
        return []
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(lines[k]) for k in full), np.uint64, len(full))
    found: set[tuple[int, int]] = set()
    last = len(full) - 1
    for divisor, seed in marks:
        rolling = (hashes[:-1] * np.uint64(MULTIPLIER * seed & MASK) + hashes[1:]) * np.uint64(MULTIPLIER)
        begins = np.flatnonzero((rolling >> np.uint64(32)) % np.uint64(divisor) == 0).tolist()  # at the first line of a pair
        ends = (np.flatnonzero((rolling >> np.uint64(48)) % np.uint64(divisor) == 0) + 1).tolist()  # at its second line
        at = 0
        for begin in dict.fromkeys([0, *begins]):
            while at < len(ends) and ends[at] <= begin:
                at += 1
            found.add((full[begin], full[ends[at] if at < len(ends) else last]))
    return sorted(found)


def body(lines: list[str], chunk: tuple[int, int]) -> str:
    return "\n".join(lines[chunk[0] : chunk[1] + 1])


def key_of(text: str) -> tuple[int, int]:
    """128 bits of a text as two signed longs."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(text), ">i8").tolist()
    return a, b


def own_of(text: str) -> int:
    return key_of(text)[0]


def shorter(text: str, known: dict[tuple[int, int], bool]) -> tuple[str, int, int]:
    """The text without its repeated chunks, its number of lines and how many went. known: the repeated chunks by key, and
    whether the first of them is in this text."""
    lines = text.split("\n")
    gone, seen = set(), set()
    for chunk in chunks_of(lines):
        key = key_of(body(lines, chunk))
        first = known.get(key)
        if first and key not in seen:
            seen.add(key)
        elif first is not None:
            gone.update(range(chunk[0], chunk[1] + 1))
    for k in sorted(gone):  # blank lines after a line that goes
        while k + 1 < len(lines) and not lines[k + 1].strip():
            k += 1
            gone.add(k)
    return "\n".join(line for k, line in enumerate(lines) if k not in gone), len(lines), len(gone)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of AT_ONCE rows: texts and lists of keys take many times their size as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(start, AT_ONCE)


def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows h1, h2, body of the chunks in batches of text and known whose key is known, handed on by CHARACTERS: texts of which
    much repeats have several times their length in chunks."""
    out: list[tuple[int, int, str]] = []
    size = 0

    def made() -> pa.RecordBatch:
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], ["h1", "h2", "body"])

    for part in unpacked(batches):
        for t, listed in zip(*(part.column(c).to_pylist() for c in ("text", "known")), strict=True):
            wanted, lines = {(x["h1"], x["h2"]): None for x in listed}, t.split("\n")
            for chunk in chunks_of(lines):
                text = body(lines, chunk)
                if (key := key_of(text)) in wanted and wanted[key] != text:  # once, unless two bodies share a key
                    wanted[key] = text
                    out.append((*key, text))
                    size += len(text)
                    if size >= CHARACTERS:
                        yield made()
                        size = 0
    yield made()


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, text, n_lines, n_removed: every text without the lines of multi-line chunks that stand elsewhere too.

    Chunks are cut where rolling hashes over the lines' hashes say so (MARKS), at nested divisors, by what the lines of a chunk
    say and not by where they stand; what surrounds a repeated run of lines hides at most the few lines before its first mark
    and after its last. The longest chunk that repeats covers the shorter ones in it. Of equal chunks the first isn't removed: the one in the
    smallest doc_id (of equal ids, the smallest hash of the text), within it the first; so the first occurrence of every
    line stays. Chunks meet by a 128-bit hash and go only after their bytes are compared: where two different texts share
    a hash, both stay everywhere. Single repeated lines stay. Blank lines after a removed line go with it.

    Null text: comes back as the empty text. Null ids count as larger than all others. Repeated rows with equal id and text
    are treated alike: a chunk that only they share stays in each. Very long texts take memory in proportion to their
    length. An empty table gives no rows; other columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col)
    names = ["doc_id", "own", "h1", "h2"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        numbers: list[tuple[int, int, int]] = []

        def made() -> pa.RecordBatch:
            columns = np.array(numbers, np.int64).reshape(-1, 3)
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(columns[:, k]) for k in range(3))], names)
            ids.clear()
            numbers.clear()
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if "\n" not in t:
                    continue
                lines, own = t.split("\n"), own_of(t)
                for chunk in chunks_of(lines):
                    ids.append(i)
                    numbers.append((own, *key_of(body(lines, chunk))))
                    if len(ids) >= ROWS:
                        yield made()
        if ids:
            yield made()

    chunks = rows.mapInArrow(cut, "doc_id long, own long, h1 long, h2 long")
    place = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "own")
    repeated = staged(chunks.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").select("h1", "h2", "first"))
    # keys are cut anew and joined with what repeats, so that only texts with repeats carry a list of these
    met = chunks.join(repeated, ["h1", "h2"]).withColumn("is_first", place == F.col("first"))
    known = met.groupBy("doc_id", "own").agg(F.collect_set(F.struct("h1", "h2", "is_first")).alias("known"))

    def with_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([own_of(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), own, batch.column(1)], ["doc_id", "own", "text"])

    keyed = rows.mapInArrow(with_own, "doc_id long, own long, text string")
    meets = (F.col("d.own") == F.col("k.own")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    texts = staged(keyed.alias("d").join(known.hint("merge").alias("k"), meets, "left").select("d.doc_id", "d.own", "d.text", "k.known"))

    compared = texts.filter("known is not null").select("text", "known").mapInArrow(bodies, "h1 long, h2 long, body string")
    collided = staged(compared.groupBy("h1", "h2").agg(F.min("body").alias("a"), F.max("body").alias("b")).filter("a <> b").select("h1", "h2"))
    if not collided.isEmpty():
        texts = without(texts, collided)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in unpacked(batches):
            out = []
            for text, listed in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                out.append(shorter(text, {(x["h1"], x["h2"]): x["is_first"] for x in listed}) if listed else (text, text.count("\n") + 1, 0))
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["doc_id", "text", "n_lines", "n_removed"])

    return texts.select("doc_id", "text", "known").mapInArrow(run, "doc_id long, text string, n_lines long, n_removed long")


def without(texts: DataFrame, collided: DataFrame) -> DataFrame:
    """The texts with their lists less the keys that stand for different bodies."""
    listed = texts.filter("known is not null").select("doc_id", "own", F.explode("known").alias("x")).select("doc_id", "own", "x.*").distinct()
    left = listed.join(collided, ["h1", "h2"], "left_anti").groupBy("doc_id", "own").agg(F.collect_set(F.struct("h1", "h2", "is_first")).alias("known"))
    meets = (F.col("d.own") == F.col("k.own")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    return texts.drop("known").alias("d").join(left.alias("k"), meets, "left").select("d.doc_id", "d.own", "d.text", "k.known")
