"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import id_and_text, per_text

WORDS = re.compile(r"\w+")
MATCH, MISMATCH, GAP = 2, -1, -1


def normal_words(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores: punctuation and case don't count."""
    return WORDS.findall(text.lower())


def last_rows(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment's score, and how many words of item and window it ends after; of equal scores the first end
    in the window. Two rows of the table are held, so that memory grows with the window only."""
    n = len(window)
    row = np.zeros(n + 1, np.int32)
    slope = -GAP * np.arange(1, n + 1, dtype=np.int32)
    best = (0, 0, 0)
    for i, word in enumerate(item.tolist(), 1):
        step = row[:-1] + np.where(window == word, MATCH, MISMATCH)
        new = np.maximum(np.maximum(step, row[1:] + GAP), 0)
        row[1:] = np.maximum.accumulate(new + slope) - slope
        j = int(row.argmax())
        if (int(row[j]), -j) > (best[0], -best[2]):
            best = (int(row[j]), i, j)
    return best


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment's score and the window's places [start, end) that it covers: forward for the end, then
    backward from there for the nearest start that gives the score."""
    if not len(item) or not len(window):
        return 0, 0, 0
    score, i, j = last_rows(item, window)
    if not score:
        return 0, 0, 0
    _, _, back = last_rows(item[:i][::-1], window[:j][::-1])
    return score, j - back, j


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    seed_words: int = 4,
    least: float = 0.5,
    common: int = 50,
    most_seeds: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Rows doc_id, item_id, score, start_word, end_word, n_seeds: passages of documents that align with test items.

    Seeds are an item's runs of ``seed_words`` words (all its words if it has fewer); rare ones are those that at most
    ``common`` items have (where an item has none, all its seeds count as rare). Documents that hold a rare seed, however
    often, or two others, give the stretch of words around it. Its best local alignment with the item scores 2 for a word
    in common, -1 for a changed, missing or added word; ``score`` is that over twice the item's words, and counts from
    ``least`` on. Stretches with too few words in common for that, in any order, aren't aligned. One row for each document
    and item: the best passage, the first of equals. Word places are those of lower-cased ``\\w+`` runs.

    Long stretches are aligned in pieces that overlap by the longest passage that can score ``least``, so that memory is
    bounded by the item's length, however often a document repeats it; a passage is never cut.

    Only the benchmark's seeds are broadcast. Their number is bounded before they are made, by half the items' characters:
    above ``most_seeds`` the items are taken in blocks, each with its own scan of the documents; one item is never split.
    Null and empty texts and items match nothing; a null item id is kept as null; rows with a null doc_id or repeated ids
    count as one document for each id; other columns are ignored; an empty table gives no rows.
    """
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text_col].alias("item_text")).filter("item_text is not null").distinct()
    n_seeds = items.agg(F.sum(F.ceil(F.length("item_text") / 2))).first()[0] or 0
    blocks = -(-n_seeds // most_seeds) or 1
    found = None
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == b)
        rows = _leaks_of(docs, part, seed_words, least, common, id_col, text_col)
        found = rows if found is None else found.union(rows)
    return found


def pieces(lo: int, hi: int, size: int, least: float) -> Iterator[tuple[int, int]]:
    """Pieces of the stretch [lo, hi) for an item of ``size`` words: any passage that can score ``least`` lies in one."""
    reach = size + int(MATCH * size * (1 - least)) + 1
    step = max(4 * reach, 4096)
    while True:
        yield lo, min(lo + step + reach, hi)
        if lo + step + reach >= hi:
            return
        lo += step


def _leaks_of(docs: DataFrame, items: DataFrame, n: int, least: float, common: int, id_col: str, text_col: str) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    known = [(r.item_id, normal_words(r.item_text)) for r in items.collect()]  # bounded by most_seeds
    seeds: dict[tuple, list[tuple[int, int]]] = {}
    for k, (_, words) in enumerate(known):
        for at in range(max(1, len(words) - n + 1) if words else 0):
            seeds.setdefault(tuple(words[at : at + n]), []).append((k, at))
    holders = {g: len({k for k, _ in where}) for g, where in seeds.items()}
    lowest: dict[int, int] = {}
    for g, where in seeds.items():
        for k, _ in where:
            lowest[k] = min(lowest.get(k, holders[g]), holders[g])
    #: by seed: item, place in it, whether the seed is rare for the item
    dealt = {g: [(k, at, holders[g] <= max(common, lowest[k])) for k, at in where] for g, where in seeds.items()}
    shorter = sorted({len(s) for s in seeds if len(s) < n})
    shipped = sc.broadcast((known, [Counter(words) for _, words in known], dealt))

    def make():
        known, bags, seeds = shipped.value
        has = seeds.keys()

        def aligned(words: list[str], k: int, lo: int, hi: int) -> tuple[float, int, int] | None:
            """The best passage of the stretch [lo, hi) of words for item k, if it scores enough."""
            item, bag = known[k][1], bags[k]
            size, best = len(item), None
            for a, b in pieces(lo, hi, size, least):
                window = words[a:b]
                common_words = sum(min(c, bag[w]) for w, c in Counter(window).items() if w in bag)
                if common_words / size < least:  # a word in common adds 2 to the score, nothing else adds to it
                    continue
                codes: dict[str, int] = {}
                x, y = (np.array([codes.setdefault(w, len(codes)) for w in ws], np.int64) for ws in (item, window))
                score, first, end = align(x, y)
                share = score / (MATCH * size)
                if share >= least and (best is None or (share, -first - a) > (best[0], -best[1])):
                    best = (share, a + first, a + end)
            return best

        def work(ids, texts):
            for i, text in zip(ids, texts, strict=True):
                words = normal_words(text)
                hits = [(at, g) for at, g in enumerate(zip(*(words[k:] for k in range(n)))) if g in has]
                for m in shorter:
                    hits += [(at, g) for at, g in enumerate(zip(*(words[k:] for k in range(m)))) if g in has]
                starts: dict[int, list[tuple[int, bool]]] = {}
                for at, g in hits:
                    for k, place, rare in seeds[g]:
                        starts.setdefault(k, []).append((at - place, rare))
                for k, places in starts.items():
                    size = len(known[k][1])
                    slack = size // 2 + 2
                    places.sort()
                    first = last = None
                    count, rare = 0, False
                    for start, is_rare in [*places, (1 << 62, False)]:
                        if last is not None and start - last > slack:
                            if (rare or count > 1) and (best := aligned(words, k, max(0, first - slack), min(len(words), last + size + slack))):
                                yield i, known[k][0], *best, count
                            first, count, rare = None, 0, False
                        first = start if first is None else first
                        last = start
                        count, rare = count + 1, rare or is_rare

        return work

    found = per_text(id_and_text(docs, id_col, text_col), "doc_id long, item_id long, score double, start_word int, end_word int, n_seeds int", make)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("start_word")).alias("s"), "end_word", "n_seeds")).alias("x"))
    return best.select("doc_id", "item_id", "x.score", (-F.col("x.s")).alias("start_word"), "x.end_word", "x.n_seeds")
