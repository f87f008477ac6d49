import random
import re

import pytest
from waymark.llm.decision_list import FEATURES, judge, learn, statistics, verdict
from waymark.llm.decontamination import leaks
from waymark.llm.html_wrapper import Outline, extract, main_text, parse, tree_match
from waymark.llm.url_filter import judge_urls

from tests.llm.helpers import WORD, empty_frame, frame, odd_frame, prose


def brute_statistics(t):
    t = t or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)),
        sum(x in lines[:k] for k, x in enumerate(lines)), len(covered),
    )


def test_statistics_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "a\u00a0b c\x1cd", "x " * 9, "# | <>\n\nl1\nl1\n l1\nl1\n"]
    for _ in range(40):
        w = prose(rng, rng.randrange(1, 120), 60)
        at = rng.randrange(len(w))
        w += w[at : at + rng.randrange(30)]
        texts.append("".join(x + rng.choice([" ", " ", "\n", "  ", "\t"]) for x in w))
    got = {r.doc_id: r for r in statistics(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(t)


def test_rules_separate_held_out_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = judge(rows, labels.filter("doc_id % 2 = 0"), sample=1500).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r for r in held if r.quality == 1 and not r.base_failed]
    bad = [r for r in held if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)


def test_learning_without_rows_keeps_all(spark):
    import numpy as np

    assert learn(np.empty((0, len(FEATURES))), np.empty(0, bool)) == []
    assert spark.range(1).select(verdict([])).first()[0] is True
    rows = judge(odd_frame(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == 23 and all(r.base_failed != r.kept for r in rows)
    assert judge(empty_frame(spark), spark.createDataFrame([(1, 0), (1, 1), (None, 0), (2, None)], "doc_id long, quality int")).count() == 0


def items(spark, rng, n=20):
    return [" ".join(prose(rng, rng.randrange(15, 50))) for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(8)
    bench = items(spark, rng)
    texts, want = [], set()
    for k in range(60):
        words = prose(rng, rng.randrange(0, 150))
        at = rng.randrange(len(words) + 1)
        if k % 3 == 0:
            item = bench[k % 20].split()
            if k % 2:  # an edited copy: a changed, a missing and an added word
                item[4] = "changed"
                del item[8]
                item.insert(11, "added")
            words[at:at] = [w.upper() + "," for w in item]
            want.add((k, k % 20))
        texts.append(" ".join(words))
    table = spark.createDataFrame([*enumerate(bench), (None, None), (99, "")], "item_id long, text string")
    got = leaks(frame(spark, texts), table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.end_word - r.start_word >= 13 for r in got)
    blocks = leaks(frame(spark, texts), table, most_seeds=100).collect()
    assert sorted(blocks) == sorted(got)
    assert leaks(odd_frame(spark), table).count() == 0
    assert leaks(empty_frame(spark), table).count() == 0
    assert leaks(frame(spark, texts), table.limit(0)).count() == 0


def test_leaks_of_one_edited_passage_in_many_documents(spark):
    rng = random.Random(18)
    item = prose(rng, 40)
    copied = [f"c{k}" if k % 7 == 5 else w for k, w in enumerate(item)]  # fewer than half of the seeds are left
    texts = [" ".join([*prose(rng, 30), *copied, *prose(rng, 30)]) for _ in range(40)]
    texts += [" ".join([*prose(rng, 30), *item[:4], *prose(rng, 30)]) for _ in range(40)]  # a seed alone is no leak
    got = leaks(frame(spark, texts), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(40))
    assert all((r.start_word, r.end_word) == (30, 70) and r.score > 0.75 for r in got)


def brute_score(item, words):
    """The best local alignment's score by the whole table."""
    table = [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(words, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
    return max(map(max, table))


def test_leaks_equal_brute_force(spark):
    rng = random.Random(28)
    bench = [prose(rng, rng.randrange(8, 30), 300) for _ in range(8)]
    bench += [["what", "is", "the", "name", "of", *prose(rng, 8, 300)] for _ in range(4)]
    texts = []
    for k in range(300):
        words = prose(rng, rng.randrange(0, 40), 300)
        item = [w if rng.random() > 0.12 else "changed" for w in bench[k % 12] if rng.random() > 0.04]
        at = rng.randrange(len(words) + 1)
        words[at:at] = item * rng.choice([0, 1, 1, 2]) if k % 3 else item[: len(item) // 2]
        texts.append(words)
    want = {}
    for i, words in enumerate(texts):
        for k, item in enumerate(bench):
            seeds = {tuple(item[a : a + 4]) for a in range(len(item) - 3)}
            score = brute_score(item, words) / (2 * len(item))
            if score >= 0.5 and any(tuple(words[a : a + 4]) in seeds for a in range(len(words) - 3)):
                want[i, k] = score
    table = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(bench)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks(frame(spark, [" ".join(t) for t in texts]), table).collect()}
    assert len(want) > 80 and set(got) == set(want)
    for (i, k), r in got.items():
        assert r.score == pytest.approx(want[i, k])
        assert brute_score(bench[k], texts[i][r.start_word : r.end_word]) / (2 * len(bench[k])) == pytest.approx(r.score)


def test_leaks_of_a_document_that_holds_an_item_very_often(spark):
    from waymark.llm.decontamination import pieces

    rng = random.Random(38)
    item = prose(rng, 8)
    text = " ".join([*prose(rng, 30), *(item * 100_000)])
    got = leaks(frame(spark, [text]), spark.createDataFrame([(1, ", ".join(item))], "item_id long, text string")).collect()
    assert [(r.score, r.start_word, r.end_word) for r in got] == [(1.0, 30, 38)]
    cut = list(pieces(5, 900_000, 100, 0.5))
    assert cut[0][0] == 5 and cut[-1][1] == 900_000 and max(b - a for a, b in cut) < 5000
    assert all(y[0] <= x[1] - 201 for x, y in zip(cut, cut[1:]))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/x">X</a><li>Y</ul></nav><div class="ad">Buy</div><!-- c > -->
<article><h1>H&amp;{n}</h1><p>One <b>two
  three</b>&nbsp;x<p>Four<br>five<div class="share">S</div><aside>side</aside><ul><li>a<li>b &lt;c&gt;</ul></article>
<section id="comments"><p>I say</p></section><form><p>Name</p></form><footer>&copy; me</footer>"""
BARE = '<html><body><div class="top">Welcome to our site</div><div class="body"><p>Text {n}</p><p>More {n}</p></div><div class="low">Call us</div></body></html>'


def text_of(page):
    return main_text(parse(page))


def test_main_text_of_a_page_alone():
    assert text_of(PAGE.format(n=1)) == "H&1\nOne two three x\nFour five\na\nb <c>"
    assert text_of("") == text_of("<p></p><br>") == ""
    assert text_of("<div>a</div></p></div>b<") == "a\nb<"
    words = "some words of the article that is longer than all else on this page "
    for page in ('<div class="page with-sidebar"><article class="post has-comments"><p>{w}</p></article></div>', '<form><div id="content"><p>{w}</p></div></form>', '<div id="search-results"><p>{w}</p></div>'):
        assert text_of(page.format(w=words * 5)) == (words * 5).strip()
    a, b = (Outline(parse(BARE.format(n=n))) for n in (1, 2))
    assert tree_match(a, b) == {k: k for k in range(len(a.tags))} and len(a.tags) == 4


def test_deep_and_wide_pages():
    assert text_of("<div class=a>" * 100_000 + "x") == "x"
    assert text_of("<div><p>a" * 100_000).count("a") == 100_000
    wide = "<section>" + "".join(f'<h2>{k} x</h2><div class="c{k % 2}">t {k}</div>' for k in range(50_000)) + "<p>end</section>"
    assert text_of(wide).count("\n") == 100_000
    page = Outline(parse(wide))
    assert tree_match(page, page) == {k: k for k in range(len(page.tags))}


def brute_match(x, y, a=0, b=0):
    """Simple tree matching by its recursive definition: the most slots, equal names counting one more."""
    if x.tags[a] != y.tags[b]:
        return 0
    xs, ys = x.children()[a], y.children()[b]
    table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, p in enumerate(xs, 1):
        for j, q in enumerate(ys, 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + brute_match(x, y, p, q))
    return 1 + (x.names[a] == y.names[b]) + table[-1][-1]


def test_tree_match_is_the_best():
    rng = random.Random(6)

    def tree(depth):
        return "".join(f'<{t} class="{rng.choice("xyz")}">{tree(depth - 1)}</{t}>' for t in rng.choices(["div", "section", "nav"], k=rng.randrange(4))) if depth else "t"

    for _ in range(60):
        x, y = Outline(parse(tree(3))), Outline(parse(tree(3)))
        got = tree_match(x, y)
        assert sum(1 + (x.names[a] == y.names[b]) for b, a in got.items()) == brute_match(x, y)
        for b, a in got.items():
            assert x.tags[a] == y.tags[b] and (b == 0 or got[y.parents[b]] == x.parents[a])


def test_template_of_a_host_goes(spark):
    rows = [(i, f"http://h.example/{i}", BARE.format(n=i)) for i in range(8)] + [(20, "http://other/", BARE.format(n=20)), (None, None, None), (21, "", "")]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == f"Text {i}\nMore {i}" and got[i].n_chars == len(got[i].text) and got[i].template == "host" for i in range(8))
    assert got[20].text == "Welcome to our site\nText 20\nMore 20\nCall us" and got[20].template == "none"
    assert got[None].text == got[21].text == "" and len(got) == 11
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_inside_the_article_goes_and_names_of_columns_may_clash(spark):
    rng = random.Random(3)

    def page(k):
        text = "".join(f"<p>{' '.join(prose(rng, 30))}</p>" for _ in range(rng.randrange(2, 6)))
        return f'<nav><a href="/">home {k}</a></nav><article><p>Read our other articles too</p>{text}<div class="k{k % 3}">Written by us</div></article><div class="q">Buy {k}</div>', text

    pages = [page(k) for k in range(9)]
    rows = [(k, f"http://{k % 3}.shop.example/{k}", p, "x", "y", 1, 2, "z") for k, (p, _) in enumerate(pages)] * 2
    table = spark.createDataFrame(rows, "page_id string, url string, html string, host string, group string, n int, slot int, reference string")
    got = extract(table).collect()
    assert len(got) == 18
    for r in got:
        assert r.template == "domain" and r.text == "\n".join(re.findall(r"<p>(.*?)</p>", pages[int(r.page_id)][1]))
    assert len(judge_urls(table, spark.createDataFrame([], "rule string, verdict string")).collect()) == 18


@pytest.mark.parametrize("change", [(), (("</?article>", ""),), (("</?article>", ""), ('class="ad"', 'class="k1"'))])
def test_extraction_equals_the_articles(spark, change):
    import html

    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    altered = pages
    for old, new in change:
        altered = altered.withColumn("html", F.regexp_replace("html", old, new))
    got = {r.page_id: r for r in extract(altered).collect()}
    assert all(r.template != "none" for r in got.values())
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<p>|</p>|</h1>", article)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)


def brute_url(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(raw) :], re.S)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
    fit = [(r, v) for r, v in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2] if "/" in r else "")]
    rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


@pytest.mark.parametrize("rules", [[], [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), ("bad.com", "block")]])
def test_urls_equal_brute_force(spark, rules):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q#f", "http://xcom/en/", "http://com/en/1", "://net/de/", "http://a.b.example.net/de/88", "http://example.net/de/9", "https://org?x://y", "http://é.org/es/", "http://bad.com", "http://www.bad.com/a://b", "http://org/es"]
    urls += [r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("url").collect()]
    pages = spark.createDataFrame([*enumerate(urls), (None, "http://com/en/"), (1, "")], "page_id long, url string")
    got = judge_urls(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        url = "http://com/en/" if r.page_id is None else urls[r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == brute_url(url, rules)
