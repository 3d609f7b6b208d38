"""Katz backoff against plain dictionaries."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from offerloom.llm import katz as k


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x20\x09-\x0d]+", text or "")] + [None]


class Plain:
    """The same model, one probability at a time."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [Counter() for _ in range(order + 1)]
        for text in texts:
            padded = ["<start>"] * (order - 1) + tokens(text)
            for at in range(order - 1, len(padded)):
                for n in range(1, order + 1):
                    self.counts[n][tuple(padded[at - n + 1 : at + 1])] += 1
        self.d = [None] + [k.discounts([list(c.values()).count(r) for r in range(1, k.DISCOUNTED + 2)]) for c in self.counts[1:]]
        self.n, self.types = sum(self.counts[1].values()), len(self.counts[1])
        self.after = [None] + [{} for _ in range(order)]
        for n in range(1, order + 1):
            for gram, c in self.counts[n].items():
                self.after[n].setdefault(gram[:-1], {})[gram[-1]] = c

    def left(self, n, context):
        found = self.after[n].get(context, {})
        total = sum(found.values())
        left = sum((1 - self.discount(n, c)) * c for c in found.values())
        return (total, left) if left > 0 else (total + 1, 1.0)

    def discount(self, n, c):
        return self.d[n][c] if c <= k.DISCOUNTED else 1.0

    def p(self, context, word):
        n = len(context) + 1
        total, left = self.left(n, context)
        c = self.after[n].get(context, {}).get(word, 0)
        if c:
            return self.discount(n, c) * c / total
        if n == 1:
            return left / total
        if context not in self.after[n]:
            return self.p(context[1:], word)
        seen = sum(self.p(context[1:], w) for w in self.after[n][context])
        return left / total / (1 - seen) * self.p(context[1:], word)

    def score(self, text):
        padded = ["<start>"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(padded[at - self.order + 1 : at]), padded[at])) for at in range(self.order - 1, len(padded)))

    def base(self, text):
        return sum(math.log10((self.counts[1][(t,)] + 0.5) / (self.n + 0.5 * (self.types + 1))) for t in tokens(text))


WORDS = "the of and a cat dog Cat sat on mat ran far away from home one two three four five".split()


def corpus(n):
    """Texts with a few frequent words, by rule."""
    out = []
    for i in range(n):
        at = [zlib.crc32(f"{i}/{j}".encode()) for j in range(5 + i % 9)]
        out.append(" ".join(WORDS[min(x % 23 % 19, x % 7 + 3) if x % 3 else x % 2] for x in at))
    return out + ["", "  \t ", "unseen words only", "the cat", "the cat", None]


@pytest.mark.parametrize("order,heavy", [(1, 1 << 16), (2, 1 << 16), (2, 10), (3, 10)])
def test_scores_equal_plain_dictionaries(spark, order, heavy):
    texts = corpus(120)
    rows = [(i, t, i % 5 == 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(5)
    scores, model = k.katz(docs, held_out=F.col("held"), order=order, bucket_bytes=100, heavy=heavy)
    plain = Plain([t for _, t, held in rows if not held], order)
    found = {r["doc_id"]: r for r in scores.collect()}
    assert len(found) == len(rows) and model.n == plain.n and model.types == plain.types
    for i, text, held in rows:
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held, len(tokens(text)), plain.n)
        assert r["n_known"] == sum(plain.counts[1][(t,)] > 0 for t in tokens(text))
        assert r["base_score"] == pytest.approx(plain.base(text), rel=1e-12)
        assert r["score"] == pytest.approx(plain.score(text), rel=1e-9)
    # a model goes on to other texts, and their words add nothing to it
    others = ["the cat sat far", "nothing known", None]
    again = k.katz(spark.createDataFrame(list(enumerate(others)), "doc_id long, text string"), model=model)[0].collect()
    assert {r["doc_id"]: pytest.approx(r["score"], rel=1e-9) for r in again} == {i: plain.score(t) for i, t in enumerate(others)}


def test_every_context_adds_up_to_one():
    plain = Plain([t for t in corpus(150)], 3)
    vocabulary = [w for (w,) in plain.counts[1]] + ["never seen"]
    for context in [("<start>", "<start>"), ("the", "of"), ("cat", "dog"), ("never", "seen"), ("of", "never")]:
        assert sum(plain.p(context, w) for w in vocabulary) == pytest.approx(1, abs=1e-12)


def test_discounts():
    d = k.discounts([100, 40, 22, 14, 10, 8])
    assert all(0 < x < 1 for x in d[1:]) and d[1] < d[5]
    assert k.discounts([0, 3, 0, 0, 0, 0])[1:] == [1.0] * 5  # nothing seen once: no discount
    assert all(0 < x <= 1 for x in k.discounts([5, 1, 7, 0, 0, 2])[1:])


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert k.katz(empty, order=2)[0].collect() == []
    rows = [(None, "a a b", 1), (7, None, 2), (7, "", 3), (8, "x " * 30_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    out = k.katz(docs, order=2)[0].collect()
    assert sorted(r["n_tokens"] for r in out) == [1, 1, 4, 30_001]
    held = k.katz(docs, held_out=F.lit(True), order=2)[0].collect()
    assert all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in held)
