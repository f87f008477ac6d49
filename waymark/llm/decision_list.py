"""Quality rules: a decision list learned from labelled statistics by sequential covering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import id_and_text, per_text, staged
from waymark.llm.texts import shingles

WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 8, 20, 30
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct long"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of COUNTS for every whole text: words are cut at ASCII white space; n_dup_lines are lines with a word that
    equal an earlier line; n_repeat_words are words in 8-word windows that stand twice or more; n_lines are lines with a
    word; n_distinct are different words."""

    def make():
        def work(ids, texts):
            for i, t in zip(ids, texts, strict=True):
                words = t.encode().split()
                lines = [x for x in t.split("\n") if x.strip(BLANKS)]
                repeated = 0
                if len(words) > WINDOW:
                    windows = shingles(words, WINDOW)
                    _, inverse, times = np.unique(windows, return_inverse=True, return_counts=True)
                    starts = np.flatnonzero(times[inverse] > 1)
                    if len(starts):
                        edge = np.zeros(len(words) + 1, np.int64)
                        edge[starts] += 1
                        edge[starts + WINDOW] -= 1
                        repeated = int((np.cumsum(edge) > 0).sum())
                chars = len(t) - sum(map(t.count, BLANKS))
                yield i, len(words), chars, sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), len(set(words))

        return work

    return per_text(id_and_text(docs, id_col, text_col), COUNTS, make)


#: What the rules look at: names and the Spark expressions that give them.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "distinct_growth": "ln(greatest(n_distinct, 2)) / ln(greatest(n_words, 2))",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "words": "double(n_words)",
}


@dataclass(frozen=True)
class Test:
    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.threshold if self.above else x[:, self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.expr(list(FEATURES.values())[self.feature])
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{list(FEATURES)[self.feature]} {'>' if self.above else '<='} {self.threshold:.6g}"


def covers(rule: list[Test], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        out &= t.holds(x)
    return out


def grow(x: np.ndarray, y: np.ndarray, most: int, cuts: int) -> list[Test]:
    """Adds the test of most FOIL gain until no row to keep is covered, or ``most`` tests stand."""
    rule: list[Test] = []
    here = np.ones(len(y), bool)
    while len(rule) < most and (here & ~y).any():
        p0, n0 = (here & y).sum(), (here & ~y).sum()
        base = np.log2(p0 / (p0 + n0)) if p0 else 0
        best, gain = None, 1e-9
        for f in range(x.shape[1]):
            values = np.unique(x[here, f])
            if len(values) > cuts:
                values = np.unique(np.quantile(values, np.linspace(0, 1, cuts)))
            for threshold in (values[1:] + values[:-1]) / 2:
                for above in (True, False):
                    t = Test(f, above, float(threshold))
                    c = here & t.holds(x)
                    p, n = (c & y).sum(), (c & ~y).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - base)) > gain:
                        best, gain = t, g
        if best is None:
            break
        rule.append(best)
        here &= best.holds(x)
    return rule


def learn(x: np.ndarray, reject: np.ndarray, most_rules: int = 12, most_tests: int = 3, least_precision: float = 0.97, cuts: int = 64) -> list[list[Test]]:
    """Ordered rules that reject. Each is grown on two thirds of the rows left, pruned from its end on the other third by
    (p - n) / (p + n), and kept if it is right at least ``least_precision`` of the time on all rows left; then what it
    covers goes. No rows, or none to reject: no rules."""
    rules: list[list[Test]] = []
    left = np.arange(len(reject))
    while len(rules) < most_rules and reject[left].any():
        part = left % 3 == 0
        a, b = left[~part], left[part]
        if not reject[a].any():
            break
        rule = grow(x[a], reject[a], most_tests, cuts)

        def worth(r: list[Test], b=b) -> float:
            c = covers(r, x[b])
            p, n = (c & reject[b]).sum(), (c & ~reject[b]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = covers(rule, x[left])
        p, n = reject[left][c].sum(), (~reject[left][c]).sum()
        if not rule or p < 3 or p < least_precision * (p + n):
            break
        rules.append(rule)
        left = left[~c]
    return rules


def verdict(rules: list[list[Test]]) -> Column:
    """The rules as one ordered conditional expression: false where a rule rejects, else true."""
    if not rules:
        return F.lit(True)
    out = None
    for rule in rules:
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, sample: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Rows of COUNTS, base_failed and kept for every document.

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated 8-word windows. kept: false if
    base_failed, else the learned list's verdict. The list is fitted on at most ``sample`` labelled documents, those of
    the smallest hash of the id (the only thing bounded; statistics and verdicts cover all rows). Labels that are null or
    contradict each other for an id are left out, as are documents whose id stands for several texts; without labels the
    list is empty and keeps all. Null text: no words, base_failed. Repeated rows get equal rows; other columns are ignored.
    """
    rows = staged(statistics(docs, id_col, text_col))
    known = (
        labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
        .filter("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .filter("label = most")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
        .select("doc_id", "label")
    )
    fit = rows.join(known, "doc_id").select("doc_id", "label", *(F.expr(e).alias(n) for n, e in FEATURES.items()))
    one = fit.groupBy("doc_id").agg(F.first("label").alias("label"), F.count("*").alias("times"), *(F.first(n).alias(n) for n in FEATURES))
    table = np.array([[float(v) for v in r] for r in one.filter("times = 1").orderBy(F.xxhash64("doc_id"), "doc_id").drop("doc_id", "times").collect()]).reshape(-1, 1 + len(FEATURES))
    rules = learn(table[:, 1:], table[:, 0] == 0)
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))
