import random
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest
import xxhash
from waymark.llm.compact_windows import repeated_passages, tree_windows
from waymark.llm.common import STAGED, discard
from waymark.llm.components import components
from waymark.llm.line_chunks import CHARACTERS, MARKS, MULTIPLIER, bodies, body, chunks_of, drop_repeated_chunks, key_of, without
from waymark.llm.minhash import near_duplicates

from tests.llm.helpers import brute_components, empty_frame, frame, odd_frame, prose


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, n, percent):
    rng = random.Random(n)
    texts = {}
    for _ in range(12):
        base = prose(rng, rng.randrange(20, 200))
        for _ in range(rng.randrange(1, 8)):
            texts[len(texts)] = " ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.04])))
    chain = prose(rng, 300)  # a chain whose ends are far apart
    for k in range(12):
        chain = [*chain[6:], *prose(rng, 6)]
        texts[len(texts)] = " ".join(chain).upper() if k % 2 else " ".join(chain)
    texts |= {len(texts): "", len(texts) + 1: None, len(texts) + 2: "a b", len(texts) + 3: "A  b"}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, texts.values()), n, percent, block=2).collect()}
    assert got == brute_components(texts, n, percent)


def test_near_duplicates_of_odd_tables(spark):
    rows = near_duplicates(odd_frame(spark)).collect()
    assert len(rows) == 23
    assert all(r.component_id == r.doc_id and r.kept for r in rows if r.doc_id is not None and r.doc_id not in (3, 4))
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert near_duplicates(empty_frame(spark)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e if n is not None}
    for _ in range(400):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    touched = {n for a, b in edges if a is not None and a != b for n in (a, b)}
    assert got == {n: root[n] for n in touched}


def test_tree_windows_cover_every_stretch_once():
    import numpy as np

    h = np.random.default_rng(1).permutation(60)
    got = tree_windows(h, 7)
    for i in range(60):
        for j in range(i + 6, 60):
            fits = [c for c, lo, hi in got if lo <= i <= c <= j <= hi]
            assert fits == [i + int(h[i : j + 1].argmin())]


def test_windows_of_repetitive_texts():
    import time

    import numpy as np
    from waymark.llm.compact_windows import windows_of
    from waymark.llm.texts import shingles

    began = time.perf_counter()
    for text in (["x"] * 1_000_000, ["x", "y", "z"] * 300_000, [f"w{k % 977}" for k in range(500_000)]):
        keys, _ = windows_of(shingles([w.encode() for w in text], 5), 46)
        assert len(np.unique(keys)) == len(keys) <= 5 * 977
    assert time.perf_counter() - began < 20


def test_windows_are_the_nodes_of_the_trees_in_less_time():
    import time

    import numpy as np
    from waymark.llm.compact_windows import FUNCTIONS, keys_of, windows_of

    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 45, 46, 47, *rng.integers(50, 900, 300))] + [rng.integers(0, 9, 400).astype(np.uint64)]
    began = time.perf_counter()
    got = [set(windows_of(g, 46)[0].view(np.uint64).tolist()) for g in texts]
    own = time.perf_counter() - began
    trees, began = [], time.perf_counter()
    for g in texts:
        keys = [keys_of(g, f) for f in range(FUNCTIONS)]
        trees.append({int(k[c]) for k in keys for c, _, _ in tree_windows(k, 46)})
    assert got == trees and not got[1] and len(got[2]) == FUNCTIONS
    assert own < 0.7 * (time.perf_counter() - began)


def exact_links(texts, n):
    """Pairs of texts that share n words in a row, by all pairs."""
    runs = [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in map(str.split, texts)]
    return [(i, j) for i in range(len(texts)) for j in range(i) if runs[i] & runs[j]]


def test_repeated_passages_keep_the_links_of_all_pairs(spark):
    rng = random.Random(25)
    passages = [prose(rng, rng.randrange(50, 90), 10**6) for _ in range(40)]
    phrases = [prose(rng, 20, 10**6) for _ in range(3)]
    texts = []
    for k in range(300):
        words = prose(rng, rng.randrange(30, 150), 10**6)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        at = rng.randrange(len(words) + 1)
        words[at:at] = rng.choice(phrases)
        texts.append(" ".join(words))
    want = exact_links(texts, 50)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in want:
        root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.doc_id: r.class_id for r in repeated_passages(frame(spark, texts)).collect()}
    linked = {i for pair in want for i in pair}
    assert len(want) > 300 and len(set(got) - linked) <= 3
    kept = sum(i in got and got[i] == got.get(j) for i, j in want)
    print("documents", len(linked & set(got)), len(linked), "links", kept, len(want))
    assert len(linked & set(got)) >= 0.98 * len(linked) and kept >= 0.98 * len(want)


def test_repeated_passages_finds_planted_and_leaves_clean(spark):
    rng = random.Random(5)
    texts, planted = [], set()
    exact, near = prose(rng, 60, 10**6), prose(rng, 120, 10**6)
    short = prose(rng, 30, 10**6)
    for k in range(40):
        words = prose(rng, rng.randrange(60, 200), 10**6)
        at = rng.randrange(len(words))
        if k % 4 == 0:
            words[at:at] = exact
            planted.add(k)
        elif k % 4 == 1 and k < 20:
            words[at:at] = [*near[:50], f"x{k}", *near[51:]]
            planted.add(k)
        else:
            words[at:at] = short
        texts.append(" ".join(words))
    texts += [texts[2], texts[2]]
    planted |= {2, 40, 41}
    got = {r.doc_id: r for r in repeated_passages(frame(spark, texts)).collect()}
    assert set(got) == planted
    assert {got[k].class_id for k in range(0, 40, 4)} == {0}
    assert {got[k].class_id for k in (1, 5, 9, 13, 17)} == {1}
    assert got[2].class_id == got[40].class_id == 2
    for k in range(0, 40, 4):
        words = texts[k].split()
        at = next(i for i in range(len(words)) if words[i : i + 60] == exact)
        assert any(s.start <= at + 5 and s.end >= at + 55 and s.end - s.start <= 75 for s in got[k].spans)


def test_repeated_passages_with_a_part_that_stands_earlier_too(spark):
    rng = random.Random(15)
    texts, passages = [], []
    for k in range(6):
        passage = prose(rng, 60, 10**6)
        opening = [*passage[25:34], *prose(rng, 80, 10**6), *passage[5:14]]
        texts.append(" ".join([*prose(rng, 40, 10**6), *passage, *prose(rng, 40, 10**6)]))
        texts.append(" ".join([*(opening if k < 4 else passage[:40]), *prose(rng, 90, 10**6), *passage, *prose(rng, 40, 10**6)]))
        passages.append(passage)
    texts += [t + " again" for t in texts[:2]]
    got = {r.doc_id: r for r in repeated_passages(frame(spark, texts)).collect()}
    for k in range(12):
        words = texts[k].split()
        at = next(i for i in range(len(words)) if words[i : i + 60] == passages[k // 2])
        assert got[k].class_id == k // 2 * 2
        assert any(s.start <= at + 5 and s.end >= at + 55 for s in got[k].spans)


def test_repeated_passages_of_odd_tables(spark):
    got = repeated_passages(odd_frame(spark)).collect()
    assert {r.doc_id for r in got} == {5}  # the long text stands twice
    assert repeated_passages(empty_frame(spark)).count() == 0


def test_texts_held_only_under_null_ids_are_compared(spark):
    rng = random.Random(8)
    shared = prose(rng, 400)
    texts = [" ".join(shared + prose(rng, 20)), " ".join(prose(rng, 20) + shared)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert [tuple(r)[:2] for r in repeated_passages(docs).collect()] == [(None, None)] * 2
    named = spark.createDataFrame([(None, texts[0]), (3, texts[1])], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(named).collect()} == {(None, 3), (3, 3)}


def brute_chunks(lines):
    """Every stretch from a first mark to the next last mark, mark by mark and line by line."""
    full = [k for k, x in enumerate(lines) if x.strip()]
    h = [xxhash.xxh3_64_intdigest(lines[k]) for k in full]
    out = set()
    for divisor, seed in MARKS:
        roll = [((a * (MULTIPLIER * seed) + b) * MULTIPLIER) % 2**64 for a, b in zip(h, h[1:])]
        for j in range(len(full) - 1):
            if j == 0 or (roll[j] // 2**32) % divisor == 0:
                end = next((k for k in range(j + 1, len(full) - 1) if (roll[k - 1] // 2**48) % divisor == 0), len(full) - 1)
                out.add((full[j], full[end]))
    return out


def brute_lines(texts):
    """By a list of where each chunk stands, in order of row and place."""
    places = {}
    cut = [(t or "").split("\n") for t in texts]
    for i, lines in enumerate(cut):
        for a, b in sorted(brute_chunks(lines)):
            places.setdefault("\n".join(lines[a : b + 1]), []).append((i, a, b))
    gone = {(i, k) for where in places.values() for i, a, b in where[1:] for k in range(a, b + 1)}
    out = []
    for i, lines in enumerate(cut):
        kept, after = [], False
        for k, line in enumerate(lines):
            after = (i, k) in gone or after and not line.strip()
            if not after:
                kept.append(line)
        out.append("\n".join(kept))
    return out


def test_line_chunks_equal_brute_force(spark):
    rng = random.Random(9)
    block = [" ".join(prose(rng, 6)) for _ in range(30)]
    texts = []
    for k in range(60):
        own = [rng.choice([" ".join(prose(rng, 6)), "", " "]) for _ in range(rng.randrange(1, 12))]
        at, start = rng.randrange(len(own) + 1), rng.randrange(20)
        own[at:at] = block[start : start + rng.randrange(1, 10)] if k % 3 else ["x", "x", "", "x", "y", "x", "y"]
        texts.append("\n".join(own))
    texts += ["\n".join(block), "", None, "\n", "a\n", "\n\n\n", "one\n\ntwo", "zero\none\n\ntwo\n\n\nthree"]
    got = {r.doc_id: r for r in drop_repeated_chunks(frame(spark, texts)).collect()}
    want = brute_lines(texts)
    assert [got[k].text for k in range(len(texts))] == want
    lines = {x for t in texts if t for x in t.split("\n") if x.strip()}
    assert lines == {x for t in want for x in t.split("\n") if x.strip()}
    assert sum(r.n_removed for r in got.values()) > 100


def test_recall_of_repeated_runs_by_length(spark):
    """Nine in ten lines of repeats of six lines or more go; shorter ones have fewer marks inside."""
    rng = random.Random(19)
    line = lambda: " ".join(prose(rng, 5, 10**6))
    texts, lengths = [], (2, 4, 6, 8, 20, 40)
    for n in lengths:
        for _ in range(40):
            block = [line() for _ in range(n)]
            texts += ["\n".join([*(line() for _ in range(6)), *block, *(line() for _ in range(6))]) for _ in range(2)]
    got = {r.doc_id: r.n_removed for r in drop_repeated_chunks(frame(spark, texts)).collect()}
    recall = [sum(got[k] for k in range(80 * j, 80 * j + 80)) / (40 * n) for j, n in enumerate(lengths)]
    assert all(r >= least for r, least in zip(recall, (0.4, 0.75, 0.85, 0.88, 0.94, 0.96), strict=True)), recall


def test_marks_choose_the_chunks():
    rng = random.Random(2)
    lines = [" ".join(prose(rng, 5)) for _ in range(200)]
    whole = set(chunks_of(lines))
    assert whole == brute_chunks(lines)
    assert set(chunks_of(lines, ((16, 1),))) != set(chunks_of(lines, ((8, 1),)))
    inner = {(a + 3, b + 3) for a, b in whole if a > 0 and b < 199}
    assert inner <= set(chunks_of(["x", "y", "z", *lines, "w"]))  # what stands around them moves no chunk


def test_rows_with_one_id_and_different_texts_share_one_copy(spark):
    texts = ["a b\nc d\ne f", "x\na b\nc d", "a b\nc d\ny"]
    docs = spark.createDataFrame([(i, t) for i in (None, 7) for t in texts] + [(7, texts[0])], "doc_id long, text string")
    got = sorted(r.text for r in drop_repeated_chunks(docs).collect())
    assert sum("a b\nc d" in t for t in got) in (1, 2) and len(got) == 7  # equal rows are treated alike


def test_chunks_whose_hashes_collide_stay(spark):
    rows = [(k, k, f"t{k}", [(1, 2, k == 0), (3, 4, False)]) for k in range(3)] + [(9, 9, "u", None)]
    texts = spark.createDataFrame(rows, "doc_id long, own long, text string, known array<struct<h1: long, h2: long, is_first: boolean>>")
    left = {r.doc_id: r.known for r in without(texts, spark.createDataFrame([(1, 2)], "h1 long, h2 long")).collect()}
    assert left[9] is None and all([tuple(x) for x in left[k]] == [(3, 4, False)] for k in range(3))


def test_bodies_are_handed_on_before_they_pile_up():
    texts = ["\n".join(f"{k} {line} " + "w" * 300 for line in range(200)) for k in range(200)]
    found = [{body(t.split("\n"), c) for c in chunks_of(t.split("\n"))} for t in texts]
    known = [[{"h1": a, "h2": b} for a, b in map(key_of, one)] for one in found]
    out = list(bodies(iter([pa.RecordBatch.from_pydict({"text": texts, "known": known})])))
    made = [b.column("body").to_pylist() for b in out]
    assert sum(map(len, found[0])) > 3 * len(texts[0])
    assert max(sum(map(len, one)) for one in made) < CHARACTERS + len(texts[0])
    assert sorted(x for one in made for x in one) == sorted(x for one in found for x in one)


def test_line_chunks_of_odd_tables(spark):
    rows = drop_repeated_chunks(odd_frame(spark)).collect()
    assert len(rows) == 23 and all(r.n_removed == 0 for r in rows)
    assert drop_repeated_chunks(empty_frame(spark)).count() == 0


def test_threads_delete_their_own_folders_only(spark):
    texts = [" ".join(prose(random.Random(k // 2), 60)) for k in range(40)]
    want = {k: k // 2 * 2 for k in range(40)}

    def run(_):
        began = len(STAGED)
        got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, texts)).collect()}
        assert len(STAGED) >= began
        discard(spark, began)
        return got

    with ThreadPoolExecutor(2) as pool:
        assert all(got == want for got in pool.map(run, range(4)))
    assert len(STAGED) == len(STAGED[:])
