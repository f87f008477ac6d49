import hashlib
import random
from collections import defaultdict
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from waymark.llm.packing import best_fit_decreasing, pack_tokens, write_packed
from waymark.llm.sentencepieces import PieceEncoder, encode_pieces, piece_digests
from waymark.llm.token_counts import count_tokens

from tests.llm.helpers import DOCS, ODD, empty_frame, frame, odd_frame

TEXTS = [
    *ODD, "a  b\n\nc ﬁ ２ \u3000x\r\ty", "x▁y", "▁", " ▁ ", "<s> </s><unk> <0x0A>", "a" * 3000, "ab " * 500, "x\u00a0y\u2003z\ufeff",
    "'s 't don't I'll  12345 ²³ Ⅷ", "<|endoftext|>a<|endoftext|> <|endoftext|><|endoftext", " \n \n\t x", "🇩🇪" * 20, "!!!???...   ", "\u0558\U00020000 \U000323b0x \ua7ce",
]
MODEL = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
RANKS = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
VOCABULARY = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()


def corpus(spark):
    return [*TEXTS, *(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect())]


def test_pieces_equal_the_library(spark):
    texts = corpus(spark)
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    rows = {r.doc_id: r for r in piece_digests(frame(spark, texts), MODEL).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert rows[i].n_tokens == len(ids) and rows[i].n_disagreed == 0
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((library.decode(ids) if ids else "").encode()).hexdigest()
    full = encode_pieces(frame(spark, texts[:30]), MODEL).collect()
    assert all(r.ids == library.encode(texts[r.doc_id] or "") for r in full)


def test_agenda_alone_equals_the_library():
    encoder, rng = PieceEncoder(MODEL), random.Random(4)
    for _ in range(500):
        word = "▁" + "".join(rng.choice("aabcdeéßñ日x1 ") for _ in range(rng.randrange(1, 14))).replace(" ", "")
        assert [list(encoder.by_agenda(word))] == encoder.by_library([word])


def test_counts_equal_the_library(spark):
    texts, library = corpus(spark), Tokenizer.from_str(VOCABULARY)
    rows = {r.doc_id: r for r in count_tokens(frame(spark, texts), VOCABULARY).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((t or "").encode()), n > 512)


def test_packs_hold_every_token_once(spark, tmp_path):
    texts, library = [t for t in corpus(spark) if "\u0558" not in (t or "")], Tokenizer.from_str(VOCABULARY)
    library.encode_special_tokens = True
    packs = pack_tokens(frame(spark, texts), RANKS, size=128, pad=7, block_tokens=20_000)
    parts = defaultdict(dict)
    rows = packs.collect()
    assert len({r.pack_id for r in rows}) == len(rows)
    for r in rows:
        assert len(r.ids) == len(r.position_ids) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert all(x == 7 for x in r.ids[r.n_tokens :])
        for doc, part, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            parts[doc][part] = r.ids[a:b]
            assert r.position_ids[a:b] == list(range(b - a))
    for i, t in enumerate(texts):
        ids = [x for _, p in sorted(parts[i].items()) for x in p]
        assert ids == library.encode(t or "", add_special_tokens=False).ids
    used = sum(r.n_tokens for r in rows)
    assert used / (128 * len(rows)) > 0.97
    write_packed(packs, str(tmp_path / "packs"))
    back = spark.read.parquet(str(tmp_path / "packs"))
    assert back.count() == len(rows) and len(back.first().ids) == 512


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_is_best_fit(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 2, 7, 8, 31, 64])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 80))]
    rows = best_fit_decreasing(lengths, size)
    free = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            free[free.index(min(fits))] -= lengths[i]
        else:
            free.append(size - lengths[i])
    assert sorted(size - sum(lengths[i] for i in r) for r in rows) == sorted(free)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))


def test_token_operators_take_odd_and_empty_tables(spark):
    for f in (lambda d: piece_digests(d, MODEL), lambda d: count_tokens(d, VOCABULARY)):
        assert f(odd_frame(spark)).count() == 23
        assert f(empty_frame(spark)).count() == 0
    assert pack_tokens(spark.createDataFrame([(None, "a"), (1, None)], "doc_id long, text string"), RANKS, size=8).count() == 1
    assert pack_tokens(spark.createDataFrame([], DOCS), RANKS, size=8).count() == 0


def test_very_long_white_space_is_packed(spark):
    library = Tokenizer.from_str(VOCABULARY)
    blank = " " * 30_000
    texts = [blank, f"a{blank}b", f"a{blank}\n", f"{blank}\nx\u00a0{blank}'s {blank}1", f"\x1c{blank}\x1c y" + "\n " * 20_000]
    ids = {}
    for r in pack_tokens(frame(spark, texts), RANKS).collect():
        for k, (doc, part) in enumerate(zip(r.doc_ids, r.parts, strict=True)):
            ids[doc, part] = r.ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]]
    for i, t in enumerate(texts):
        got = [x for part in range(len([k for k in ids if k[0] == i])) for x in ids[i, part]]
        assert got == library.encode(t, add_special_tokens=False).ids
    wide = spark.range(1).selectExpr("id AS doc_id", "concat(repeat(' ', 10000000), 'x') AS text")
    assert sum(r.n_tokens for r in pack_tokens(wide, RANKS).select("n_tokens").collect()) == 10_000_000


def test_packs_of_dealt_blocks_depend_on_the_rows_alone(spark):
    texts = corpus(spark)
    packs = [sorted(map(str, pack_tokens(frame(spark, texts).repartition(n), RANKS, blocks=2).collect())) for n in (1, 5)]
    assert packs[0] == packs[1]
