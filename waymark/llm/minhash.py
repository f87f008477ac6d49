"""Near-duplicate documents: universal hash minima in bands, signature and full-set checks, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import id_and_text, per_text, staged
from waymark.llm.components import components
from waymark.llm.texts import shingles, text_key, texts_of, words_of

ROWS = 4
#: Chance that a pair of exactly the threshold's similarity shares no band.
MISS = 1e-6


def bands_for(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS))


def least_agreeing(n: int, similarity: float) -> int:
    """The number of equal minima of n that a pair of this similarity falls short of with a chance below MISS."""
    total = 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if total > MISS:
            return k
    return n


class Minima:
    """n universal hash functions h -> (a h + b) mod 2^64, of which the upper 32 bits count; a is odd."""

    def __init__(self, n: int):
        rng = np.random.default_rng(20)
        self.a = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.uint64(2**64 - 1))
        for s in range(0, len(hashes), 1024):
            np.minimum(least, (hashes[s : s + 1024, None] * self.a + self.b).min(axis=0), out=least)
        return (least >> np.uint64(32)).astype("<u4")


def signatures(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Rows doc_id, key, n_shingles, bands, minima of each text (bands and minima null where it has no word)."""
    n_bands = bands_for(similarity)

    def make():
        minima = Minima(n_bands * ROWS)

        def work(ids, texts):
            for i, t in zip(ids, texts, strict=True):
                w = words_of(t)
                if not w:
                    yield i, text_key(w), 0, None, None
                    continue
                unique = np.unique(shingles(w, words))
                sig = minima.of(unique).tobytes()
                bands = np.array([xxhash.xxh3_64_intdigest(sig[k * 4 * ROWS : (k + 1) * 4 * ROWS], seed=k) for k in range(n_bands)], np.uint64)
                yield i, text_key(w), len(unique), bands.astype(np.int64).tolist(), sig

        return work

    return per_text(docs, "doc_id long, key binary, n_shingles long, bands array<long>, minima binary", make)


def agreeing(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in ``least`` minima at least."""
    sig = nodes.select("key", "minima")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(batch.num_rows, -1) for k in (2, 3))
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    with_both = (
        pairs.join(sig.select(F.col("key").alias("a"), F.col("minima").alias("x")), "a")
        .join(sig.select(F.col("key").alias("b"), F.col("minima").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    return with_both.mapInArrow(run, "a binary, b binary")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.empty(0))
        for batch in batches:
            keep = []
            for a, _, x, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if a != last[0]:
                    last = (a, np.unique(shingles(words_of(x), words)))
                other = np.unique(shingles(words_of(y), words))
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                keep.append(100 * both >= percent * (len(last[1]) + len(other) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], ["a", "b"])

    with_texts = (
        pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("x")), "a")
        .join(texts.select(F.col("key").alias("b"), F.col("text").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    return with_texts.mapInArrow(run, "a binary, b binary")


def open_buckets(members: DataFrame, held: DataFrame) -> DataFrame:
    """Rows band, key, root of the buckets that hold several components."""
    rooted = members.select("band", "key").join(held.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    several = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    return staged(rooted.join(several, "band").select("band", "key", "root"))


def reachable(rows: DataFrame, bodies: DataFrame, words: int, percent: int, most_rounds: int = 3) -> DataFrame:
    """Rows band, key, root, n, reach of texts that may still be linked with a text of another component of their bucket.

    n is the text's number of shingles. Only shingles that two texts of rows have can be shared; a link needs
    percent (n + m) / (100 + percent) of them, so the partner's number m is ``reach`` at most. Texts beyond the reach of
    all others go, and the count is taken anew while that helps.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [np.unique(shingles(words_of(t), words)).astype(np.int64) for t in part.column(1).to_pylist()]
                times = [len(s) for s in sets]
                keys = part.column(0).take(pa.array(np.repeat(np.arange(len(sets)), times)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.repeat(times, times), pa.int64()), pa.array(np.concatenate(sets))], ["key", "n", "gram"])

    before = -1
    for _ in range(most_rounds):
        there = rows.select("key").distinct()
        count = there.count()
        each = bodies.join(there, "key").select("key", "text").mapInArrow(grams, "key binary, n long, gram long")
        shared = each.join(each.groupBy("gram").agg(F.count("*").alias("times")).filter("times > 1"), "gram").groupBy("key", "n").agg(F.count("*").alias("shared"))
        reach = staged(shared.select("key", "n", (F.floor(F.col("shared") * (100 + percent) / percent) - F.col("n")).alias("reach")))
        live = rows.select("band", "key", "root").join(reach, "key")
        least = live.groupBy("band", "root").agg(F.min("n").alias("m"))
        smallest = least.groupBy("band").agg(F.min(F.struct("m", "root")).alias("x")).select("band", F.col("x.root").alias("least_root"), "x.m")
        after = least.join(smallest.select("band", "least_root"), "band").filter("root <> least_root").groupBy("band").agg(F.min("m").alias("after"))
        least = smallest.join(after, "band")
        live = live.join(least, "band").filter("reach >= CASE WHEN root = least_root THEN after ELSE m END")
        several = live.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
        rows = staged(live.join(several, "band").select("band", "key", "root", "n", "reach"))
        if count in (0, before):
            break
        before = count
    return rows


def across(left: DataFrame, bodies: DataFrame, words: int, percent: int, block: int, part: int = 4096) -> DataFrame:
    """The links (a, b) between components of each cluster of touching buckets, found on full sets.

    The texts outside a cluster's largest component are its queries. A task holds the shingles of one block of queries as
    an index, and streams one part of the cluster's texts past it: one look-up of a text's shingles counts what it shares
    with all of the block. No pair is made unless it is a link. Blocks (``block`` texts or two million shingles) and parts
    (``part`` texts) are dealt by hash, so that no task sorts or holds a whole cluster; sets are sent, not texts.
    """
    touching = left.join(left.groupBy("band").agg(F.min("key").alias("v")), "band").select(F.col("key").alias("u"), "v")
    cluster = components(touching).select(F.col("node").alias("key"), F.col("root").alias("cluster"))
    each = staged(left.select("key", "root", "n").distinct().join(cluster, "key"))
    by_root = each.groupBy("cluster", "root").agg(F.count("*").alias("texts"), F.sum("n").alias("grams"))
    main = by_root.groupBy("cluster").agg(F.max(F.struct("texts", "root", "grams")).alias("m"), F.sum("texts").alias("texts"), F.sum("grams").alias("grams"))
    blocks = F.greatest(F.ceil((F.col("texts") - F.col("m.texts")) / block), F.ceil((F.col("grams") - F.col("m.grams")) / 2_000_000))
    dealing = staged(main.filter("texts > m.texts").select("cluster", F.col("m.root").alias("main"), blocks.cast("int").alias("blocks"), F.ceil(F.col("texts") / part).cast("int").alias("parts")))
    known = each.join(dealing, "cluster").withColumn("hash", F.xxhash64("key"))
    number = lambda n: F.pmod("hash", n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = known.filter("root <> main").select("cluster", number(F.col("blocks")).alias("block"), every("parts").alias("part"), F.lit(0).alias("is_target"), "key", "root")
    targets = known.select("cluster", every("blocks").alias("block"), number(F.col("parts")).alias("part"), F.lit(1).alias("is_target"), "key", "root")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(shingles(words_of(t), words)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["key", "grams"])

    held = staged(bodies.join(known.select("key").distinct(), "key").select("key", "text").mapInArrow(sets, "key binary, grams binary"))
    dealt = queries.union(targets).join(held, "key").select("cluster", "block", "part", "is_target", "key", "root", "grams")
    dealt = dealt.repartition("cluster", "block", "part").sortWithinPartitions("cluster", "block", "part", "is_target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, index = None, None
        keys: list[bytes] = []
        roots: list[bytes] = []
        sets: list[np.ndarray] = []
        for batch in batches:
            a, b = [], []
            for cluster, number, part, is_target, key, root, grams in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if group != (cluster, number, part):
                    group, index, keys, roots, sets = (cluster, number, part), None, [], [], []
                own = np.frombuffer(grams, np.uint64)
                if not is_target:
                    keys.append(key)
                    roots.append(root)
                    sets.append(own)
                    continue
                if not sets:
                    continue
                if index is None:
                    index = Postings(sets)
                shared = index.shared(own)
                for k in np.flatnonzero(100 * shared >= percent * (index.sizes + len(own) - shared)):
                    if roots[k] != root:
                        a.append(min(key, keys[k]))
                        b.append(max(key, keys[k]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


class Postings:
    """Which of some sets hold a shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        grams = np.concatenate(sets)
        order = np.argsort(grams, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.grams, self.starts, self.counts = np.unique(grams[order], return_index=True, return_counts=True)

    def shared(self, own: np.ndarray) -> np.ndarray:
        """How many elements of own each set has."""
        at = np.searchsorted(self.grams, own)
        at = at[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == own)]
        n = self.counts[at]
        places = np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.owners[places], minlength=len(self.sizes))


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, block: int = 256, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows doc_id, n_shingles, component_id (smallest id reachable by links, itself included), kept (doc_id = component_id).

    Two documents are linked if 100 * intersection >= percent * union of their sets of distinct shingles of ``words``
    words; a text with fewer words has its whole sequence as one shingle; a text without words is linked with nothing.
    Copies (equal sequences of words) meet as one text with many ids. Null text: as the empty text. A null id takes part
    by its text, names no component and is kept only where its component has no id at all. Repeated rows get equal rows.
    An empty table gives no rows; other columns are ignored.

    A band's texts are compared with one of them (a star: no pairs within a bucket): the one that shares most bands with
    others, which among edited copies is the least edited. A bucket that then still holds several components is pruned by
    what is exact: shingles that no other text in such buckets has can't be shared, which bounds the size of a partner.
    What is left in buckets that touch forms a cluster, and every text outside the cluster's main component is compared with
    all the cluster's texts, ``block`` of them at a time, so that no link between different texts is lost.
    """
    rows = staged(signatures(id_and_text(docs, id_col, text_col), words, percent / 100))
    nodes = staged(
        rows.filter("n_shingles > 0")
        .groupBy("key")
        .agg(F.min("doc_id").alias("rep_id"), F.first("bands").alias("bands"), F.first("minima").alias("minima"))
    )
    members = nodes.select(F.explode("bands").alias("band"), "key")
    members = staged(members.join(members.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "band"))
    weight = members.groupBy("key").agg(F.sum("size").alias("weight"))
    centres = members.join(weight, "key").groupBy("band").agg(F.max(F.struct("weight", "key")).alias("c")).select("band", F.col("c.key").alias("centre"))
    star = members.join(centres, "band").filter("key <> centre").select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct()
    agree = least_agreeing(bands_for(percent / 100) * ROWS, percent / 100)
    tested = staged(agreeing(star, nodes, agree))
    bodies = staged(texts_of(docs, weight.join(nodes, "key").select("key", "rep_id"), id_col, text_col))
    links = staged(confirmed(tested, bodies, words, percent))
    held = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    left = reachable(open_buckets(members, held), bodies, words, percent)
    more = staged(across(left, bodies, words, percent, block))
    if not more.isEmpty():
        links = links.union(more)
        held = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = held.join(nodes.select(F.col("key").alias("node"), "rep_id"), "node")
    ids = named.groupBy("root").agg(F.min("rep_id").alias("component_id"))
    by_key = nodes.select("key", "rep_id").join(
        named.join(ids, "root").select(F.col("node").alias("key"), "component_id"), "key", "left"
    ).select("key", F.coalesce("component_id", "rep_id").alias("component_id"))
    return (
        rows.select("doc_id", "n_shingles", "key")
        .join(by_key, "key", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )
