import hashlib
import random

import corpus_pipeline
import pytest
import sentencepiece
from waymark.llm.queries import ORACLE_SQL, QUERIES, tokenizer

from tests.llm.helpers import DOCS, brute_components, prose
from tests.llm.test_dedup import brute_lines
from tests.llm.test_rules import brute_statistics

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order_and_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out = corpus_pipeline.staged(out)
        assert out.count() <= before
        if k < 4:
            assert out.columns == columns
        before, docs = out.count(), out
    assert before > 0 and sorted(corpus_pipeline.run(spark, SMALL).collect()) == sorted(docs.collect())


def rows_of(rng, items):
    """Rows with null ids, ids of several texts, equal rows, repeated lines, near copies and passages of items."""
    base = [" ".join(prose(rng, 60)) for _ in range(8)]
    block = "\n".join(" ".join(prose(rng, 12)) for _ in range(4))
    rows = [(None, base[0]), (None, base[1]), (7, base[2]), (7, base[3]), (7, base[2]), (None, base[0]), (3, "too short"), (None, "short too"), (9, None), (9, "")]
    rows += [(7, base[4] + "\n" + block), (None, block + "\n" + base[5]), (None, base[6] + "\n" + block), (5, base[7] + "\n" + block)]
    near = base[1].split()
    near[30] = "changed"
    rows += [(4, " ".join(near)), (None, base[7] + " " + items[0]), (7, base[6] + " more " + items[1]), (12, "again and again " * 40)]
    return [(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def own_tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("own")
    rng = random.Random(12)
    items = [" ".join(prose(rng, 30)) for _ in range(3)]
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rows = rows_of(rng, items)
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{d}/documents.parquet")
    return str(d), items, rows


def test_every_stage_equals_brute_force_for_null_and_repeated_ids(spark, own_tables):
    sf_dir, items, rows = own_tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]

    def after(k, want):
        nonlocal docs
        docs = corpus_pipeline.staged(stages[k](spark, docs, sf_dir).coalesce(1))
        got = [tuple(r) for r in docs.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        return got  # in the order in which the next stage reads them

    def passes(t):
        n, _, _, _, repeated = brute_statistics(t)
        return n >= 20 and 100 * repeated <= 30 * n

    rows = after(0, [r for r in rows if passes(r[1])])
    assert sum(r[0] is None for r in rows) >= 5 and sum(r[0] == 7 for r in rows) >= 4
    changed = brute_lines([r[1] for r in rows])
    assert sum(t != r[1] for t, r in zip(changed, rows, strict=True)) >= 3
    rows = after(1, [(r[0], t, *r[2:4], len(t)) for r, t in zip(rows, changed, strict=True) if t.strip()])
    groups = {}
    for k, (_, root) in brute_components({k: r[1] for k, r in enumerate(rows)}, 5, 80).items():
        groups.setdefault(root, []).append(k)
    stay = {min(g, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)) for g in groups.values()}
    assert len(stay) < len(rows)
    rows = after(2, [r for k, r in enumerate(rows) if k in stay])
    clean = [r for r in rows if not any(item in r[1] for item in items)]
    assert len(clean) == len(rows) - 2
    rows = after(3, clean)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    tokens = stages[4](spark, docs, sf_dir).collect()
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in tokens) == sorted((str(r[0]), len(ids), digest(ids)) for r in rows for ids in [library.encode(r[1])])


def test_stages_take_odd_and_empty_tables(spark, own_tables):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (2, "", None, None, 0), (None, "w " * 40, "en", "s", 80), (3, "a b c " * 9000, "en", "s", 5)], DOCS)
    kept = [sorted((str(r.doc_id) for r in stage(spark, docs, own_tables[0]).collect())) for _, stage in corpus_pipeline.STAGES]
    assert kept == [[], *[["1", "2", "3", "None"]] * 4]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), own_tables[0]).count() == 0


def test_every_query_is_there():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
