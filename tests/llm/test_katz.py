"""The language model against a plain one, of orders 1 to 3, and its probabilities' sums."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.llm import katz

K = katz.MOST_DISCOUNTED


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def trained(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 != 1


def discount(counts):
    n = Counter(counts.values())
    above = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    out = {}
    for r in range(1, K + 1):
        share = ((r + 1) * n[r + 1] / (r * n[r]) - above) / (1 - above) if n[r] and above != 1 else 0
        out[r] = share if 0 < share < 1 else (r - 0.5) / r
    return out


class Plain:
    """Katz's model of the training texts, by definition."""

    def __init__(self, docs, order):
        self.counts = [Counter() for _ in range(order + 1)]
        for i, text in docs:
            if trained(i):
                said = tokens(text)
                for k in range(1, order + 1):
                    start = [None] if k > 1 else []
                    padded = start + said
                    for at in range(len(start), len(padded)):
                        if at - (k - 1) >= 0:
                            self.counts[k][tuple(padded[at - k + 1 : at + 1])] += 1
        self.left = [discount(c) for c in self.counts]
        self.after = [defaultdict(list) for _ in self.counts]
        for k, counts in enumerate(self.counts):
            for gram in counts:
                self.after[k][gram[:-1]].append(gram[-1])
        self.weights = {}

    def rest(self, context):
        k = len(context) + 1
        if context not in self.weights:
            counts = [self.counts[k][(*context, w)] for w in self.after[k][context]]
            total = sum(counts)
            lost = sum(r * (1 - self.left[k][r]) for r in counts if r <= K) / total if total else 0
            factor, rest = (1.0, lost) if lost > 0 else (total / (total + 1), 1 / (total + 1))
            below = sum(self.p(context[1:], w) for w in self.after[k][context]) if k > 1 else 0
            self.weights[context] = (total, factor, rest / (1 - below) if total else 1.0)
        return self.weights[context]

    def p(self, context, word):
        k = len(context) + 1
        total, factor, rest = self.rest(context)
        r = self.counts[k][(*context, word)]
        if r:
            return factor * self.left[k].get(r, 1) * r / total
        return rest * (self.p(context[1:], word) if k > 1 else 1.0)


def prose(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "cat", "dog", "é", "sat", "x" * 40, *(f"w{k}" for k in range(60))]
    weights = [30, 5, 20, 9, 9, 3, 9, 1, *(60 / (k + 3) for k in range(60))]
    return " \t\n"[seed % 3].join(r.choices(words, weights, k=n))


@pytest.fixture(scope="module")
def docs():
    rows = [(i, prose(i, 5 + 7 * i % 90)) for i in range(120)]
    rows += [(3, prose(3, 40)), (None, "no id here"), (None, None), (200, ""), (201, None), (202, " \x0b\x0c "), (203, "\x1c odd\x85space\xa0 here \x00"), (204, "y" * 70_000 + " " + "Y" * 70_000 + " z"), (205, prose(5, 30_000))]
    return rows


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, docs, order, monkeypatch):
    monkeypatch.setattr(katz, "SPLIT", 40)
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("block", "key", "shard", "level", "payload", "score")])
    got = katz.scored(df, order=order).collect()
    plain = Plain(docs, order)
    n, v = sum(plain.counts[1].values()), len(plain.counts[1])
    want = []
    for i, text in docs:
        said = tokens(text)
        base = sum(math.log10((plain.counts[1][(w,)] + 0.5) / (n + 0.5 * (v + 1))) for w in said)
        total = 0.0
        for at, w in enumerate(said):
            context = tuple(said[max(0, at - order + 1) : at]) if order > 1 else ()
            if order > 1 and at < order - 1:
                context = (None, *context)
            if order == 3 and at == 0:
                context = (None,)
            total += math.log10(plain.p(context, w))
        want.append((str(i), not trained(i), len(said), sum(plain.counts[1][(w,)] > 0 for w in said), n, base, total))
    got = [(str(r[0]), *r[1:]) for r in got]
    assert [r[:5] for r in sorted(got)] == [r[:5] for r in sorted(want)]
    assert np.allclose([r[5:] for r in sorted(got)], [r[5:] for r in sorted(want)], rtol=1e-9)
    # After any context all words and the unknown one come to 1.
    words = [w for (w,) in plain.counts[1]]
    for context in [c for c in plain.after[order]][:40]:
        assert sum(plain.p(context, w) for w in [*words, b"\xff"]) == pytest.approx(1, abs=1e-9)


def test_tables(spark, docs):
    """The stored counts are those of the training texts, each in one shard."""
    rows = katz.Rounds(spark.createDataFrame(docs, "doc_id long, text string"), order=2).tables().collect()
    plain = Plain(docs, 2)
    for k in (1, 2):
        mine = [r for r in rows if r.level == k]
        assert Counter(r.n for r in mine) == Counter(plain.counts[k].values())
        assert len({(r.context, r.word) for r in mine}) == len(mine) == len({r.number for r in mine})


def test_little(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.scored(empty).collect() == []
    held = next(i for i in range(99) if not trained(i))
    (row,) = katz.scored(spark.createDataFrame([(held, "never trained")], "doc_id long, text string")).collect()
    assert tuple(row) == (held, True, 3, 0, 0, 0.0, 0.0)
    (row,) = katz.scored(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert row.n_tokens == row.n_known == row.train_tokens == 1 and -1 < row.score < 0
