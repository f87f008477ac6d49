"""Small tables and brute-force versions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Texts that every operator must take: null, empty, blank, long, odd.
ODD = [None, "", " \n\t ", "one", "a b", "x " * 30_000, "\n" * 50, "日本語 テキスト 😀", "<|endoftext|> a", "NUL\x00byte", "é" * 2000]


def frame(spark, texts, first=0):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def odd_frame(spark):
    """The odd texts, each row twice, a null id, and columns whose names an operator might use itself."""
    rows = [(i, t, "en", "s", 1, "k", 2) for i, t in enumerate(ODD) for _ in range(2)] + [(None, "no id here", None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS + ", key string, node int")


def empty_frame(spark):
    return spark.createDataFrame([], DOCS)


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingle_set(text, n):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(texts, n, percent):
    """Component ids by comparing every pair."""
    sets = {i: shingle_set(t, n) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}
