"""Token ids in packed matrices: best-fit-decreasing with a segment tree over capacities."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.bpe import PRE_TOKENS
from waymark.llm.common import id_and_text

SCHEMA = "pack_id long, doc_ids array<long>, parts array<int>, ids array<int>, cu_seqlens array<int>, position_ids array<int>, n_tokens int"

ENCODINGS: dict = {}


def encoding(ranks: bytes, pattern: str):
    """A Python worker's encoder for the ranks of a tiktoken file."""
    import tiktoken

    key = (len(ranks), hash(ranks), pattern)
    if key not in ENCODINGS:
        ENCODINGS.clear()
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        ENCODINGS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return ENCODINGS[key]


#: White space as the pattern's engine knows it, in runs longer than that engine can take.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{20000,}")


def encode_all(text: str, enc) -> list[int]:
    """The text's ids. The pattern takes a run of white space but its last character, if text follows, as one pre-token;
    very long runs are cut out by this rule and merged apart, as the pattern's engine fails on them."""
    if len(text) < 20_000 or not LONG_BLANK.search(text):
        return enc.encode_ordinary(text)
    out, done = [], 0
    for m in LONG_BLANK.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[done : m.start()])
        out += enc._encode_single_piece(text[m.start() : end].encode())
        done = end
    return out + enc.encode_ordinary(text[done:])


class Capacities:
    """A segment tree with a leaf for each free capacity 0..size; a node tells whether any row below it has that much."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        k = capacity + self.leaves
        while k:
            self.count[k] += n
            k >>= 1

    def least(self, need: int) -> int:
        """The least capacity >= need that a row has, or -1."""
        count, k = self.count, need + self.leaves
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):  # up, until the right neighbour below the same parent has a row
                k >>= 1
            if k <= 1:
                return -1
            k += 1
        while k < self.leaves:
            k = 2 * k if count[2 * k] else 2 * k + 1
        return k - self.leaves


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of indexes into lengths (each 1..size): longest first, each into the row with the least room that holds it."""
    tree, rows, free = Capacities(size), [], [[] for _ in range(size + 1)]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least(lengths[i])
        if room < 0:
            row, room = len(rows), size
            rows.append([])
        else:
            row = free[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        if room > lengths[i]:
            free[room - lengths[i]].append(row)
            tree.add(room - lengths[i], 1)
    return rows


def pack_tokens(
    docs: DataFrame, ranks: bytes, pattern: str = PRE_TOKENS, size: int = 2048, pad: int = 0, block_tokens: int = 4_000_000, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Packs the token ids of every whole text into rows of ``size`` ids.

    ranks: the bytes of a tiktoken file; special strings in a text are ordinary text, and ``pad`` may be a free id.
    Rows: pack_id (unique; partition and row), doc_ids and parts (the document and the part of it in each segment), ids
    (padded with ``pad``), cu_seqlens (0 and each segment's end), position_ids (0, 1, ... anew in each segment; 0 in the
    padding), n_tokens (ids before the padding). A text of more than ``size`` tokens is split without loss: its parts
    0, 1, ... in order give its ids again. Null and empty texts have no tokens and no segment. Repeated rows are packed
    each; a null id stays null; other columns are ignored.

    Packing is best-fit-decreasing over blocks of ``block_tokens`` tokens of a partition: no shuffle, and memory is bounded
    by the block whatever the input's size. A text is never cut at a block's end. Which texts share a row then depends on
    how the input lies in partitions; with ``blocks`` the texts are first dealt to so many partitions by their hash and
    ordered by id and hash, so that the packs depend on the rows alone. Texts of any length and any run of white space are
    taken; an empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((ranks, pattern))  # as large as the vocabulary
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def lists(values: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))

    def packed(block: list[tuple[int | None, int, np.ndarray]], first: int) -> Iterator[pa.RecordBatch]:
        rows = best_fit_decreasing([len(x[2]) for x in block], size)
        for at in range(0, len(rows), 512):
            some = rows[at : at + 512]
            ids, places = np.full((len(some), size), pad, np.int32), np.zeros((len(some), size), np.int32)
            who, parts, cuts, ends, cut_ends, full = [], [], [], [0], [0], []
            for r, row in enumerate(some):
                end = 0
                cuts.append(0)
                for i in row:
                    doc, part, tokens = block[i]
                    ids[r, end : end + len(tokens)] = tokens
                    places[r, end : end + len(tokens)] = np.arange(len(tokens))
                    end += len(tokens)
                    who.append(doc)
                    parts.append(part)
                    cuts.append(end)
                ends.append(len(who))
                cut_ends.append(len(cuts))
                full.append(end)
            steps = np.arange(len(some) + 1) * size
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(first + at, first + at + len(some)), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(who, pa.int64())),
                    lists(np.array(parts, np.int32), np.array(ends), pa.int32()),
                    lists(ids.ravel(), steps, pa.int32()),
                    lists(np.array(cuts, np.int32), np.array(cut_ends), pa.int32()),
                    lists(places.ravel(), steps, pa.int32()),
                    pa.array(full, pa.int32()),
                ],
                schema=arrow,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(*shipped.value)
        block, held, first = [], 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = np.array(encode_all(text, enc), np.int32)
                block += [(doc, k, tokens[s : s + size]) for k, s in enumerate(range(0, len(tokens), size))]
                held += len(tokens)
                if held >= block_tokens:
                    for out in packed(block, first):
                        first += out.num_rows
                        yield out
                    block, held = [], 0
        if block:
            yield from packed(block, first)

    rows = id_and_text(docs, id_col, text_col)
    if blocks:
        own = F.xxhash64("text", "doc_id")
        rows = rows.repartition(blocks, own).sortWithinPartitions("doc_id", own)
    return rows.mapInArrow(run, SCHEMA)


def write_packed(packs: DataFrame, path: str) -> None:
    """Writes packs as Parquet with the ids and positions as little-endian int32 bytes, one matrix row each, beside the
    lists of documents, parts and segment ends."""

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            for name in ("ids", "position_ids"):
                columns[name] = pa.array([np.asarray(x.values, "<i4").tobytes() for x in columns[name]], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    packs.mapInArrow(raw, SCHEMA.replace(" ids array<int>", " ids binary").replace("position_ids array<int>", "position_ids binary")).write.parquet(path)
