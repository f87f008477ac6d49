"""Token counts with a byte-level vocabulary, by whole-token shortcut."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.bpe import ByteLevel
from waymark.llm.common import TwoGenerations, id_and_text, per_text


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text.

    vocabulary: the text of a tokenizers .json file. The driver proves once which of its strings encode alone as one
    token; a pre-token among them counts one without merging, and only the rest is merged. Special strings inside a text
    count one, as is the library's default. Null text: as the empty text, 0 tokens. Repeated rows give repeated rows;
    other columns are ignored. What is broadcast is as large as the vocabulary, whatever the data's size.
    """
    sc = docs.sparkSession.sparkContext
    shipped = sc.broadcast((vocabulary, {t: 1 for t in ByteLevel(vocabulary).whole()}))

    def make():
        text, ones = shipped.value
        bpe = ByteLevel(text)
        counts = TwoGenerations(lambda t: ones.get(t) or len(bpe.tokens(t)))
        get, find = counts.__getitem__, bpe.splitter()
        special = re.compile("|".join(map(re.escape, sorted(bpe.special, key=len, reverse=True)))) if bpe.special else None

        def work(ids, texts):
            for i, t in zip(ids, texts, strict=True):
                parts = special.split(t) if special and special.search(t) else [t]
                n = sum(sum(map(get, find(p))) for p in parts) + len(parts) - 1
                yield i, len(t.encode()), n

        return work

    return per_text(id_and_text(docs, id_col, text_col), "doc_id long, n_bytes long, n_tokens long", make).withColumn("over_limit", F.col("n_tokens") > limit)
