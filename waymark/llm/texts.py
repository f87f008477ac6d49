"""Words, shingles and identities of texts."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import id_and_text, per_text

MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """The text's words in UTF-8, A-Z lower-cased, cut at ASCII white space."""
    return text.encode().lower().split()


def text_key(words: list[bytes]) -> bytes:
    """128 bits for the sequence of words: texts with equal keys are copies."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """A 64-bit hash for the n-word shingle at each place; with fewer words the whole sequence is one; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = len(words) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + m]) * MIX
        out ^= out >> np.uint64(29)
    return out


def texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows key, text of the texts in wanted (key, rep_id: an id that has the text), one for each key."""

    def make():
        return lambda ids, texts: ((i, text_key(words_of(t)), t) for i, t in zip(ids, texts, strict=True))

    found = per_text(id_and_text(docs, id_col, text_col), "doc_id long, key binary, text string", make)
    return (
        found.alias("t")
        .join(wanted.alias("w"), (F.col("t.key") == F.col("w.key")) & F.col("t.doc_id").eqNullSafe(F.col("w.rep_id")))
        .select("t.key", "t.text")
        .dropDuplicates(["key"])
    )
