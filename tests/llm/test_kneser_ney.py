"""The language model against a brute-force count, and its held-out use."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as E
from convolens.llm import kneser_ney

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_tokens string, score int"


def tokens(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def discounts(values):
    n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    if all(n[:3]):
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        if all(0 < x < k for x, k in zip(d, (1, 2, 3))):
            return [0, *d]
    return [0, 0.5, 1.0, 1.5]


class Brute:
    def __init__(self, texts):
        seqs = [tokens(t) for t in texts]
        self.c = Counter(t for s in seqs for t in s)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.pairs = Counter((a, b) for s in seqs for a, b in zip(["<s>", *s], s))
        self.followed, self.by_context, self.contexts = Counter(), defaultdict(list), Counter()
        for (a, b), k in self.pairs.items():
            self.followed[a] += k
            self.by_context[a].append(k)
            self.contexts[b] += 1
        self.d, self.d1 = discounts(self.pairs.values()), discounts(self.contexts.values())

    def p1(self, w):
        if not self.n:
            return 1.0
        total = len(self.pairs)
        rest = sum(self.d1[min(k, 3)] for k in self.contexts.values()) / total
        k = self.contexts[w]
        return max(k - self.d1[min(k, 3)], 0) / total + rest / (self.v + 1)

    def p(self, w, v):
        lower = self.p1(w)
        if not self.followed[v]:
            return lower
        rest = sum(self.d[min(k, 3)] for k in self.by_context[v])
        k = self.pairs[v, w]
        return (max(k - self.d[min(k, 3)], 0) + rest * lower) / self.followed[v]

    def row(self, text):
        s = tokens(text)
        base = sum(math.log10((self.c[t] + 0.5) / (self.n + 0.5 * (self.v + 1))) for t in s)
        score = sum(math.log10(self.p(w, v)) for v, w in zip(["<s>", *s], s))
        return len(s), sum(self.c[t] > 0 for t in s), self.n, base, score


def check(df, texts, train):
    brute = Brute(train)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=repr)
    want = sorted(((d, *brute.row(t)) for d, t in texts), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("share", [2_000_000, 3])
def test_small(spark, share):
    train = ["a b c a b", "A B\ta b", "the a the b the c the d the e", "", None, "x", "a b c", "the the the the", "é ÉÀ z"]
    rows = [(1, "a b c"), (2, "new words a"), (3, None), (4, ""), (5, "the " * 500), (5, "the " * 500), (None, "É é"), (6, "c b a the e d x")]
    df = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(train)], SCHEMA).repartition(3)
    texts = spark.createDataFrame([(d, t, "", 0) for d, t in rows], SCHEMA)
    check(kneser_ney.score(texts, kneser_ney.train(df, share=share)), rows, train)


class BruteOrder(Brute):
    """Any order, by recursion over tuples of words."""

    def __init__(self, texts, order):
        super().__init__(texts)
        seqs = [("<s>", *tokens(t)) for t in texts]
        grams = {n: Counter(s[i : i + n] for s in seqs for i in range(len(s) - n + 1)) for n in range(2, order + 1)}
        self.levels = {order: grams[order]}
        for n in range(order - 1, 1, -1):
            left = Counter(g[1:] for g in grams[n + 1])
            self.levels[n] = {g: k if g[0] == "<s>" else left[g] for g, k in grams[n].items()}
        self.ds = {n: discounts(c.values()) for n, c in self.levels.items()}
        self.after = defaultdict(list)
        for counts in self.levels.values():
            for g, k in counts.items():
                self.after[g[:-1]].append(k)
        self.order = order

    def pn(self, w, context):
        if not context:
            return self.p1(w)
        lower, after = self.pn(w, context[1:]), self.after.get(context)
        if not after:
            return lower
        d = self.ds[len(context) + 1]
        k = self.levels[len(context) + 1].get((*context, w), 0)
        return (max(k - d[min(k, 3)], 0) + sum(d[min(x, 3)] for x in after) * lower) / sum(after)

    def row(self, text):
        s = ("<s>", *tokens(text))
        score = sum(math.log10(self.pn(s[i], s[max(i - self.order + 1, 0) : i])) for i in range(1, len(s)))
        return (*super().row(text)[:4], score)


@pytest.mark.parametrize("order, share", [(3, 2_000_000), (3, 3), (4, 5)])
def test_higher_orders(spark, order, share):
    train = ["a b c a b", "A B\ta b", "the a the b the c the d the e", "", None, "x", "a b c", "the the the the", "é ÉÀ z", "a b d", "c a b c"]
    rows = [(1, "a b c"), (2, "new words a b c"), (3, None), (4, ""), (5, "the " * 500), (None, "É é"), (6, "c b a the e d x"), (7, "c a b c a b d x")]
    brute = BruteOrder(train, order)
    for context in [("<s>",), ("<s>", "a"), ("a", "b"), ("the", "the", "the")]:
        assert sum(brute.pn(w, context) for w in [*brute.c, "unknown"]) == pytest.approx(1)
    df = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(train)], SCHEMA).repartition(3)
    texts = spark.createDataFrame([(d, t, "", 0) for d, t in rows], SCHEMA)
    got = kneser_ney.score(texts, kneser_ney.train(df, share=share, order=order)).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=repr)
    want = sorted(((d, *brute.row(t)) for d, t in rows), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9, atol=1e-9)
    assert all(r.score == 0 for r in kneser_ney.score(texts, kneser_ney.train(df.filter("doc_id < 0"), order=order)).collect())


def test_texts_shorter_than_the_order(spark):
    df = spark.createDataFrame([(1, "", "", 0), (2, None, "", 0)], SCHEMA)
    check(kneser_ney.score(df, kneser_ney.train(df, order=4)), [(1, ""), (2, None)], ["", None])


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    rows = [(1, "a b"), (2, None)]
    texts = spark.createDataFrame([(d, t, "", 0) for d, t in rows], SCHEMA)
    model = kneser_ney.train(none)
    check(kneser_ney.score(texts, model), rows, [])
    assert kneser_ney.score(none, model).count() == 0


def test_probabilities_sum_to_one():
    brute = Brute(["a b c a b", "the a the b the c", "x"])
    for v in ["<s>", "a", "the", "nothing"]:
        assert sum(brute.p(w, v) for w in [*brute.c, "unknown"]) == pytest.approx(1)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    df = E.queries()["op4_kneser_ney"](spark, SF)
    check(df, rows, [t for d, t in rows if not out(d)])
    got = df.collect()
    assert all(r.held_out == out(r.doc_id) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
