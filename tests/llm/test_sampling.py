"""Importance resampling, chat formatting and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from waymark.llm import resampling
from waymark.llm.chat import Chat, Template, conversation_digests, encoder, format_conversations, mask
from waymark.llm.queries import tokenizer
from waymark.llm.vector_codes import compress, nearest

from .helpers import ODD, empty_frame, frame, lower, odd_frame, prose

FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VOCABULARY = open(tokenizer("byte_bpe_50k.json")).read()


def features(text):
    w = FEATURE_WORD.findall(lower(text))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def brute_resample(docs, target, buckets=10_000, percent=25):
    s, t, each = Counter(), Counter(), []
    for i, text in docs:
        w, f = features(text)
        each.append((i, len(w), [zlib.crc32(x.encode()) % buckets for x in f]))
        s.update(each[-1][2])
    for text in target:
        t.update(zlib.crc32(x.encode()) % buckets for x in features(text)[1])
    s_all, t_all = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)}
    out = []
    for i, n, found in each:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0], -x[3], x[2]))
    drawn = Counter()
    rows = []
    for k, x in enumerate(able):
        rows.append((x[0], x[2], x[3], x[4], k + 1 if k < percent * len(able) // 100 else None))
        drawn[x[0]] += 1
    return sorted(map(str, rows + [(x[0], x[2], x[3], x[4], None) for x in out if x[1] < 20]))


def sample_docs(rng):
    target = [" ".join(prose(rng, 60, 50)) for _ in range(5)] + [None, ""]
    texts = [" ".join(prose(rng, rng.randrange(5, 200), rng.choice([50, 3000]))) for _ in range(120)]
    texts += [texts[0], texts[0], "Ünï " * 30, ("y" * 200 + " z") * 25, "w" * 5000 + " a " + "v" * 70_000, "A-b_c9" * 40]
    return texts, target


def test_resample_equals_brute_force(spark):
    texts, target = sample_docs(random.Random(3))
    docs = frame(spark, texts).union(odd_frame(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    wanted = brute_resample(rows, target)
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, doc_id int")
    assert sorted(str(tuple(r)) for r in resampling.resample(docs, bench).collect()) == wanted
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")  # shards are dealt over salts, each with all counts
    try:
        salted = resampling.weights(frame(spark, texts[:20]), bench).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = {eval(x)[0]: eval(x)[2] for x in brute_resample(list(enumerate(texts[:20])), target)}
    assert {r.doc_id: r.weight for r in salted} == want


def test_resample_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(empty_frame(spark), bench).count() == 0
    texts = [" ".join(prose(random.Random(1), 40)) for _ in range(8)]
    assert sorted(str(tuple(r)) for r in resampling.resample(frame(spark, texts), bench).collect()) == brute_resample(list(enumerate(texts)), [])


@pytest.mark.parametrize("most", [1, 2, 3])
def test_blocks_cut_anywhere(monkeypatch, most):
    """Pieces and blocks of any size give the same counts."""
    monkeypatch.setattr(resampling, "PIECE", 40)
    monkeypatch.setattr(resampling, "KNOWN", 30)
    rng = random.Random(most)
    texts = [" ".join(prose(rng, n, 60)) for n in (0, 1, 2, 3, 50, 400, 7)] + ["é" * 100 + " " + "q" * 300 + " q"]
    for words in (5, 60, 10_000):
        monkeypatch.setattr(resampling, "BLOCK_WORDS", words)
        got = Counter()
        for ids, n_words, keys, counts in resampling.blocks(enumerate(texts), resampling.Features(most, 977)):
            assert (np.diff(keys) > 0).all()
            for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
                got[ids[key & 65535], key >> 16] += n
            assert n_words == [len(FEATURE_WORD.findall(lower(texts[i]))) for i in ids]
        want = Counter()
        for i, t in enumerate(texts):
            w = FEATURE_WORD.findall(lower(t))
            want.update((i, zlib.crc32(" ".join(w[a : a + k]).encode()) % 977) for k in range(1, most + 1) for a in range(len(w) - k + 1))
        assert got == want


@given(st.lists(st.integers(-(2**62), 2**62)))
def test_pack_round_trip(values):
    assert resampling.unpack(resampling.pack(np.array(values, np.int64))).tolist() == values


CONTROL_TEXT = st.lists(st.sampled_from(["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "/TURN]", "|endoftext|>", "ROLE]", "a", " ", "é", "😀", "\n"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool", "<s>", "[/ROLE]"]), CONTROL_TEXT), max_size=6))
def test_any_turns_come_back(turns):
    chat = Chat(Template(), ("<|endoftext|>",))
    text, starts, ends = chat.render(turns)
    assert list(chat.turns(text)) == turns
    assert [chat.unescape(text[a:b]) for a, b in zip(starts, ends, strict=True)] == [t for r, t in turns if r == "assistant"]


def test_marks_that_cannot_be_told_apart():
    for marks in ({"user": ("[A]", "[A]x")}, {"user": ("[[A]", "[B]")}, {"user": ("[A\\]", "[B]")}, {"user": ("[", "[B]")}):
        with pytest.raises(ValueError, match="told apart"):
            Template(marks=marks).controls()


def test_mask_of_sorted_spans():
    starts, ends = np.array([0, 3, 5, 5, 9]), np.array([3, 5, 6, 6, 12])
    assert mask(starts, ends, np.array([3, 10]), np.array([5, 12])).tolist() == [False, True, False, False, True]
    assert not mask(starts, ends, np.array([], int), np.array([], int)).any()
    assert mask(starts, ends, np.array([4, 5]), np.array([4, 6])).tolist() == [False, False, True, True, False]


def conversation_rows():
    rng = random.Random(5)
    rows = [(c, k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(ODD) if rng.random() < 0.3 else " ".join(prose(rng, rng.randrange(30)))) for c in range(30) for k in range(rng.randrange(1, 6))]
    rows += [(77, k, "user" if k % 2 else "assistant", "[/INST]</s>\\" * (k % 3) + " ".join(prose(rng, 300))) for k in range(400)]  # half of all rows, over several parts and tasks
    return rows + [(None, None, None, None), (None, 1, "assistant", "x"), (5, 0, "user", "again"), (5, 0, "user", "again"), (6, None, "assistant", ""), (-1, 0, "assistant", "</s>[INST] ok [/INST]")]


def test_chat_digests_equal_brute_force(spark):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, mark string").repartition(5)
    formatted = format_conversations(df, VOCABULARY)
    got = {r.conv_id: r for r in conversation_digests(formatted, VOCABULARY).collect()}
    key = lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")
    seen = {r[0] for r in rows}
    assert set(got) == seen
    for conv in seen:
        mine = [r for r in rows if r[0] == conv]
        if conv is not None and any(a[1:3] == b[1:3] and (a[3] or "") != (b[3] or "") for a in mine for b in mine if a is not b):
            continue  # ties of turn and role go by a hash of the text
        turns = [(r or "", t or "") for _, _, r, t in sorted(mine, key=lambda r: key(r)[:1] + (r[1] or 0,) + key(r)[2:])]
        learned = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(learned))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    tok, chat = encoder(VOCABULARY, Template())
    parts = sorted((r for r in formatted.filter("conv_id = 77").collect()), key=lambda r: r.part)
    assert len(parts) > 5 and not any(r.whole for r in parts)
    text = "".join(r.text for r in parts)
    assert [i for r in parts for i in r.ids] == tok.encode(text, add_special_tokens=False).ids  # cuts between turns change no token
    assert tok.decode([i for r in parts for i in r.ids], skip_special_tokens=False) == text
    assert sum(map(len, (r.text for r in parts))) == got[77].formatted_chars


def test_chat_of_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_digests(format_conversations(empty, VOCABULARY), VOCABULARY).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6), st.integers(1, 9), st.integers(1, 30), st.integers(0, 2**31), st.sampled_from([2, 50, 2**27]))
def test_nearest_equals_all_distances(dims, entries, n, seed, size):
    rng = np.random.default_rng(seed)
    points, book = rng.integers(-size, size, (n, dims)), rng.integers(-size, size, (entries, dims))
    every = np.square(points[:, None] - book[None]).sum(axis=2)
    entry, distance = nearest(points, book)
    assert entry.tolist() == every.argmin(axis=1).tolist()
    assert distance.tolist() == every.min(axis=1).tolist()


def brute_codes(rows, parts, entries, rounds):
    """rows: (vec_id, vector, label) that are kept."""
    q = [[math.floor(256 * x) for x in v] for _, v, _ in rows]
    w = len(q[0]) // parts
    cut = [[tuple(v[p * w : p * w + w]) for p in range(parts)] for v in q]
    firsts = {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1])):
        firsts.setdefault(rows[k][0], k)
    books = [[cut[k][p] for k in list(firsts.values())[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (distance(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                if mine := [c[p] for c, f in zip(cut, found, strict=True) if f[p] == e]:
                    books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    found = assign()
    errors = [sum(distance(c[p], books[p][f[p]]) for p in range(parts)) for c, f in zip(cut, found, strict=True)]
    sums = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        sums[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(str((i, "".join(f"{e:02x}" for e in f), e, sums[label], digest)) for (i, _, label), f, e in zip(rows, found, errors, strict=True))


def test_codes_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(60) if rng.random() < 0.5 else 1000 + k, [rng.choice([rng.gauss(0, 0.2), 0.5, -0.25]) for _ in range(8)], rng.choice([1, 2, None])) for k in range(300)]
    rows += [(None, [0.1] * 8, 1), (None, [0.3] * 8, None), rows[0], rows[0]]
    bad = [(-5, None, 1), (-4, [], 1), (-3, [float("nan")] * 8, 1), (-2, [float("inf")] * 8, 1), (-1, [None] * 8, 1), (90_000, [0.5] * 4, 1)]
    df = spark.createDataFrame([(*r, 3) for r in rows + bad], "vec_id long, embedding array<double>, label int, code int").repartition(4)
    got = sorted(str(tuple(r)) for r in compress(df, parts=4, entries=16).collect())
    rows = [(i, v, label) for i, v, label in rows]
    assert got == brute_codes(rows, 4, 16, 2)
    few = spark.createDataFrame([(3, [1e30] * 4, 1), (1, [0.0] * 4, 1)], "vec_id long, embedding array<double>, label int")
    assert {(r.vec_id, r.code, r.error) for r in compress(few, parts=2).collect()} == {(1, "0000", 0), (3, "0101", 0)}


def test_codes_of_empty_and_odd_tables(spark):
    kinds = "vec_id long, embedding array<float>, label int"
    assert compress(spark.createDataFrame([], kinds)).count() == 0
    odd = compress(spark.createDataFrame([(1, [0.5] * 5, 1)], kinds))
    assert odd.count() == 0 and odd.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="hexadecimal"):
        compress(spark.createDataFrame([], kinds), entries=300)
