"""Importance resampling toward a target distribution, by bucket-partitioned inverted postings."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import id_and_text, staged

#: Bytes as the contract reads them: A-Z become a-z; digits, a-z and all from 0x80 on stay; the rest cuts words.
LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
#: Fixed value: the reversed polynomial of crc32.
POLYNOMIAL = 0xEDB88320
#: Shards of the buckets; words that a block takes before it is sent; bits of a document's place in its block.
SHARDS, BLOCK_WORDS, PLACE = 128, 250_000, 16
#: Bytes of a text that are cut into words at a time, and words a task knows the crc of.
PIECE, KNOWN = 1 << 20, 400_000
#: What a row of the shuffle holds: counts of the corpus, counts of the target, postings; an earlier kind is read first.
CORPUS, TARGET, POSTINGS = 0, 1, 2
SENT = "shard int, salt int, kind int, block long, data binary"


def pack(values: np.ndarray) -> bytes:
    """Integers in the least width that holds them, all lowest bytes first, so that what is zero lies together."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return bytes([width]) + values.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T).view(f"<i{width}").ravel().astype(np.int64)


def joined(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def parted(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def after_zeros() -> tuple[np.ndarray, np.ndarray]:
    """Tables that carry a crc over zero bytes, for each byte of the crc: over 0 to 63 of them, and over 64 << j."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
    steps = [np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]]
    for _ in range(64):
        steps.append((steps[-1] >> 8) ^ one[steps[-1] & 255])
    powers = [steps.pop()]
    for _ in range(30):
        powers.append(carried(powers[-1], powers[-1]))
    return np.stack(steps), np.stack(powers)


def carried(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


class Features:
    """The buckets of all runs of 1 to ``most`` words. A run's crc comes from that of the run without its last word: crc is
    linear, so carrying it over as many zero bytes and adding the crc of a space and the word gives the crc of the whole."""

    def __init__(self, most: int, buckets: int):
        self.most, self.buckets = most, buckets
        self.steps, self.powers = after_zeros()
        self.flat = self.steps.ravel()
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.alone, self.spaced, self.length = (np.empty(1024, t) for t in (np.uint32, np.uint32, np.int64))

    def number(self, words: list[bytes]) -> np.ndarray:
        """A number for each word; what a task knows of words is forgotten when it grows too large."""
        if len(self.numbers) > KNOWN:
            self.forget()
        numbers = self.numbers
        first = len(numbers)
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        if new := list(numbers)[first:] if len(numbers) > first else []:
            if len(numbers) > len(self.alone):
                more = 2 * len(numbers)
                self.alone, self.spaced, self.length = (np.concatenate([x, np.empty(more - len(x), x.dtype)]) for x in (self.alone, self.spaced, self.length))
            at = slice(first, len(numbers))
            self.alone[at] = list(map(zlib.crc32, new))
            self.spaced[at] = [zlib.crc32(b" " + w) for w in new]
            self.length[at] = [len(w) + 1 for w in new]
        return ids

    def longer(self, crc: np.ndarray, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        at = (n & 63) << 10
        out = self.flat[at + (crc & 255)] ^ self.flat[at + 256 + ((crc >> 8) & 255)] ^ self.flat[at + 512 + ((crc >> 16) & 255)] ^ self.flat[at + 768 + (crc >> 24)]
        high = n >> 6
        for j in range(int(high.max(initial=0)).bit_length()):
            rows = np.nonzero((high >> j) & 1)[0]
            out[rows] = carried(self.powers[j], out[rows])
        return out ^ self.spaced[ids]

    def keys(self, words: list[bytes], owner: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """(bucket, owner) as one number for every run of words of one owner that ends in a word not ``seen`` before."""
        ids = self.number(words)
        crc, out = self.alone[ids], []
        for k in range(1, self.most + 1):
            if k > 1:
                crc = self.longer(crc[:-1], ids[k - 1 :])
            ends = np.arange(k - 1, len(ids))
            good = (owner[: len(owner) - k + 1] == owner[k - 1 :]) & ~seen[ends]
            out.append((crc[good] % np.uint32(self.buckets)).astype(np.int64) << PLACE | owner[k - 1 :][good])
        return np.concatenate(out)


def runs_of_words(text: bytes) -> Iterator[list[bytes]]:
    """The text's words in lists, so that a text of any length is cut in bounded memory."""
    text, at = text.translate(LETTERS), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        if words := text[at:end].split():
            yield words
        at = end


def blocks(rows: Iterable[tuple[int | None, str]], features: Features) -> Iterator[tuple]:
    """(ids, words of each, keys, counts) for blocks of documents; the keys are distinct and ascend."""
    most = features.most
    ids, n_words, found = [], [], []
    words, owner, seen = [], [], []

    def turned() -> None:
        if words:
            found.append(np.unique(features.keys(words, np.array(owner), np.array(seen)), return_counts=True))
            del words[:], owner[:], seen[:]

    def block() -> tuple:
        turned()
        if len(found) == 1:
            keys, counts = found[0]
        else:
            every = np.concatenate([np.empty(0, np.int64), *(k for k, _ in found)])
            keys, place = np.unique(every, return_inverse=True)
            counts = np.bincount(place, np.concatenate([np.empty(0), *(c for _, c in found)]), len(keys)).astype(np.int64)
        out = (list(ids), list(n_words), keys, counts)
        del ids[:], n_words[:], found[:]
        return out

    held = 0
    for i, text in rows:
        n = 0
        for part in runs_of_words(text.encode()):
            words += part
            owner += [len(ids)] * len(part)
            seen += [False] * len(part)
            n += len(part)
            held += len(part)
            if len(words) >= BLOCK_WORDS:
                last = words[-min(most - 1, n) :] if most > 1 else []  # runs go on across the cut
                turned()
                words += last
                owner += [len(ids)] * len(last)
                seen += [True] * len(last)
        ids.append(i)
        n_words.append(n)
        if held >= BLOCK_WORDS or len(ids) == 1 << PLACE:
            yield block()
            held = 0
    if ids:
        yield block()


def postings(texts: DataFrame, words: int, buckets: int, salts: int, target: bool) -> DataFrame:
    """What is shuffled: for each block and shard of buckets the postings (bucket, document, count), once a task the counts
    of a shard's buckets, and each block's documents. A target's texts send counts only."""
    width = -(-buckets // SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(words, buckets)
        task = TaskContext.get().partitionId()
        sums = np.zeros(SHARDS * width, np.int64)
        rows = ((i, t) for b in batches for k in range(0, b.num_rows, 64) for i, t in zip(*(c.to_pylist() for c in b.slice(k, 64).columns), strict=True))
        for n, (ids, n_words, keys, counts) in enumerate(blocks(rows, features)):
            np.add.at(sums, keys >> PLACE, counts)
            if target:
                continue
            block = task << 32 | n
            of_doc = np.bincount(keys & ((1 << PLACE) - 1), counts, len(ids)).astype(np.int64)
            nulls = np.array([i is None for i in ids], np.int64)
            out = [(-1, block % 4096, POSTINGS, block, joined(pack(np.array([i or 0 for i in ids], np.int64)), pack(nulls), pack(np.array(n_words, np.int64)), pack(of_doc)))]
            ends = np.searchsorted(keys, np.arange(SHARDS + 1) * width << PLACE)
            for shard in range(SHARDS):
                a, b = ends[shard], ends[shard + 1]
                if a < b:
                    gaps = np.diff(keys[a:b], prepend=shard * width << PLACE)
                    out.append((shard, (block * 0x9E3779B1 >> 7) % salts, POSTINGS, block, joined(pack(gaps), pack(counts[a:b]))))
            yield as_batch(out)
        if total := int(sums.sum()):
            kind = TARGET if target else CORPUS
            for shard in range(SHARDS):
                data = joined(pack(sums[shard * width : (shard + 1) * width]), pack(np.array([total])))
                yield as_batch([(shard, salt, kind, task, data) for salt in range(salts)])

    return texts.mapInArrow(run, SENT)


def as_batch(rows: list[tuple], names: tuple = ("shard", "salt", "kind", "block", "data")) -> pa.RecordBatch:
    types = {"shard": pa.int32(), "salt": pa.int32(), "kind": pa.int32(), "block": pa.int64(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=list(names))


def gain_of(s: int, t: int, s_all: int, t_all: int, buckets: int) -> int:
    """Thousandths of the log ratio of a bucket's share in the target to its share in the corpus, each bucket's count one up."""
    return math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))


def contributions(sent: DataFrame, buckets: int) -> DataFrame:
    """Reads a shard's counts of both corpora, then its postings, in one pass; a block's postings become the sum of the gains
    of each of its documents in this shard."""
    width = -(-buckets // SHARDS)  # a shard's keys begin at 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gains, counts, totals = None, None, None, None
        for batch in batches:
            out = []
            for shard, salt, kind, block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard < 0:
                    out.append((block, 0, data))
                    continue
                if at != (shard, salt):
                    at, gains, counts, totals = (shard, salt), None, np.zeros((2, width), np.int64), [0, 0]
                first, second = map(unpack, parted(data))
                if kind != POSTINGS:
                    counts[kind] += first
                    totals[kind] += int(second[0])
                    continue
                if gains is None:
                    gains = np.array([gain_of(int(s), int(t), totals[0], totals[1], buckets) for s, t in counts.T], np.int64)
                keys = np.cumsum(first)
                out.append((block, 1, pack(np.bincount(keys & ((1 << PLACE) - 1), gains[keys >> PLACE] * second).astype(np.int64))))
            if out:
                yield as_batch(out, ("block", "kind", "data"))

    return sent.mapInArrow(run, "block long, kind int, data binary")


def by_document(parts: DataFrame) -> DataFrame:
    """Sums a block's contributions document by document; a weight is the floored mean over the document's features."""

    def rows(data: list[bytes], sums: np.ndarray) -> pa.RecordBatch:
        ids, nulls, n_words, n_features = map(unpack, data)
        weight = np.where(n_features > 0, sums // np.maximum(n_features, 1), 0)
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls > 0), pa.array(n_words), pa.array(n_features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sums = None, None
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == 0:
                    if docs:
                        yield rows(docs, sums)
                    docs = parted(data)
                    sums = np.zeros(len(unpack(docs[0])), np.int64)
                else:
                    part = unpack(data)
                    sums[: len(part)] += part
        if docs:
            yield rows(docs, sums)

    return parts.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def weights(docs: DataFrame, target: DataFrame, words: int = 2, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Rows doc_id, n_words, n_features, weight: how much likelier a document's features are in the target's texts.

    Features are runs of 1 to ``words`` words of a whole text, hashed to ``buckets``. Postings are dealt by shard of
    buckets; there a bucket's gain is computed from the counts of both corpora, which are sorted before the postings, and
    what each document gains goes back to its block. Nothing is collected or broadcast. A document has one posting a
    bucket, however often a word stands in it; where there are more shuffle partitions than shards, a shard's postings are
    dealt over several salts, and each gets the counts, so a common word's bucket is no bottleneck. Rows must come in the
    same order when a task is repeated, as they do from files; stage what comes from a shuffle first.
    Null and empty texts: no features, weight 0. A row for each row; null ids stay null. No documents: no rows. No
    target: as if it had no features. Very long texts are cut into words by the megabyte.
    """
    spark = docs.sparkSession
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARDS))
    wanted = target.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(target[target_col], F.lit("")).alias("text"))
    sent = postings(id_and_text(docs, id_col, text_col), words, buckets, salts, False).union(postings(wanted, words, buckets, salts, True))
    dealt = sent.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return by_document(contributions(dealt, buckets).repartition("block").sortWithinPartitions("block", "kind"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, least_words: int = 20, words: int = 2, buckets: int = 10_000,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Rows doc_id, n_features, weight, score, rank of every document; rank is null where it isn't drawn.

    A score is the weight plus Gumbel noise from seed and id, so the highest scores are a draw without replacement by
    importance. Of the documents with at least ``least_words`` words, ``percent`` in a hundred are drawn, rounded down; ties go
    to the smaller id, null ids last. Ranks are counted in ranges of the sorted scores, each range's offset is the number of
    rows before it (a row a partition is all that meets). Other cases as in weights(); repeated ids are drawn one by one.
    """
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0))))
    scored = weights(docs, target, words, buckets, id_col, text_col, target_col).select(
        "doc_id", "n_features", "weight", (F.col("weight") + gumbel).alias("score"), (F.col("n_words") >= least_words).alias("may")
    )
    order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features")]
    sorted_rows = staged(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part, all_parts = F.shiftright("place", 33), Window.partitionBy(F.lit(0))
    counts = sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("may").alias("able"))
    # a row for each partition of the sort, however many documents there are
    offsets = counts.select("part", (F.sum("n").over(all_parts.orderBy("part")) - F.col("n")).alias("before"), F.floor(F.sum("able").over(all_parts) * percent / 100).alias("drawn"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    placed = sorted_rows.join(F.broadcast(offsets), part == F.col("part"))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("may") & (rank <= F.col("drawn")), rank).alias("rank"))
