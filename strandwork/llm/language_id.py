"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the byte n-grams of its words with their boundaries. Each hashes to a row of an embedding table;
the mean of the rows goes through a linear layer to a softmax. Both are trained by stochastic gradient descent in
numpy on a bounded sample. A temperature fitted on a part of the sample that training does not see calibrates the
probabilities, and a quantile of the calibrated scores there gives the score below which a prediction is rejected.

For scoring, table and layer are multiplied once, so a text costs one gather of as many numbers as there are languages
for each n-gram; the sum over n-grams is over the whole text, taken in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm._rows import in_slices, spare
from strandwork.llm._sample import byte_spans, collected, drawn, excerpt, fold_of

UNDETERMINED = "und"
SIZES = (2, 3, 4)
OVERLAP = max(SIZES) - 1
BUCKET_BITS = 14
BLOCK = 1 << 17


def _letters() -> np.ndarray:
    table = np.full(256, 32, np.uint32)
    table[128:] = np.arange(128, 256)
    for c in range(ord("a"), ord("z") + 1):
        table[c] = table[c - 32] = c
    return table


def subwords(data: np.ndarray, starts: np.ndarray, before: bool = False, after: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams within words of the texts laid end to end in ``data``, and the span each is in.

    With ``before`` or ``after``, ``data`` is a piece of one text that goes on there. A piece repeats the last ``OVERLAP``
    bytes of the one before; n-grams that lie in them are that one's.
    """
    code = _letters()[data]
    edges = np.append(starts, len(code))  # no n-gram crosses texts
    code = np.insert(code, edges[int(before) : len(edges) - int(after)], 32)
    first = starts + np.arange(len(starts))
    owner = np.zeros(len(code), np.int32)
    owner[first[1:]] = 1
    owner = np.cumsum(owner, dtype=np.int32)
    space = code == 32
    mixed, inner = code.copy(), np.zeros(len(code), bool)
    buckets, owners = [], []
    for n in range(2, max(SIZES) + 1):
        mixed = mixed[:-1] * np.uint32(0x01000193) + code[n - 1 :]
        if n > 2:
            inner = inner[:-1] | space[n - 2 : -1]
        else:
            inner = inner[:-1]
        if n in SIZES:
            ok = ~inner & ~(space[: len(mixed)] & space[n - 1 :])
            if before:
                ok[: OVERLAP + 1 - n] = False
            hashed = (mixed[ok] * np.uint32(0x9E3779B1) + np.uint32(n)) * np.uint32(0x85EBCA6B)
            buckets.append((hashed >> np.uint32(32 - BUCKET_BITS)).astype(np.int32))
            owners.append(owner[: len(mixed)][ok])
    return np.concatenate(buckets), np.concatenate(owners)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    weights: np.ndarray  # bucket x label: embedding table times layer
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities of each text, and the number of its n-grams."""
        sums, counts = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        for data, starts, rows, before, after in byte_spans(texts, BLOCK, OVERLAP):
            bucket, owner = subwords(data, starts, before, after)
            counts[rows] += np.bincount(owner, minlength=len(rows))
            for k in range(len(self.labels)):
                sums[rows, k] += np.bincount(owner, weights=self.weights[bucket, k], minlength=len(rows))
        z = sums / np.maximum(counts, 1)[:, None] + self.bias
        return _softmax(z / self.temperature), counts


def fit(sample: list[tuple[bytes, str]], dim: int = 16, epochs: int = 6, rate: float = 0.6, seed: int = 7, keep_out: int = 5, tolerance: float = 0.001) -> LanguageModel:
    """Trains on ``sample``; every ``keep_out``-th text calibrates instead. Without labelled texts, no label is learned."""
    labels = tuple(sorted({lang for _, lang in sample}))
    if not labels:
        return LanguageModel((), np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, dim**-0.5, (1 << BUCKET_BITS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    texts = []
    for body, lang in sample:
        data = np.frombuffer(body, np.uint8)
        bucket, times = np.unique(subwords(data, np.zeros(1, np.int64))[0] if len(data) else np.zeros(0, np.int32), return_counts=True)
        texts.append((bucket, (times / max(1, times.sum())).astype(np.float32), labels.index(lang)))
    train = [t for i, t in enumerate(texts) if i % keep_out] or texts
    held = [t for i, t in enumerate(texts) if not i % keep_out]
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            bucket, share, label = train[i]
            mean = share @ table[bucket]
            grad = _softmax((mean @ layer + bias)[None])[0].astype(np.float32)
            grad[label] -= 1
            lr = np.float32(rate * (1 - step / steps))
            back = layer @ grad
            layer -= lr * np.outer(mean, grad)
            bias -= lr * np.float32(0.01) * grad
            table[bucket] -= (lr * len(labels) * 4) * share[:, None] * back
            step += 1
    weights = table @ layer
    z = np.array([share @ weights[bucket] + bias for bucket, share, _ in held])
    truth = np.array([label for *_, label in held])
    temperatures = np.geomspace(0.25, 5.0, 60)
    loss = [-np.log(_softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean() for t in temperatures]
    best = float(temperatures[int(np.argmin(loss))])
    scores = _softmax(z / best).max(axis=1)
    return LanguageModel(labels, weights.astype(np.float32), bias, best, float(min(0.5, np.quantile(scores, tolerance))))


def predicted(model: LanguageModel, text: Column) -> Column:
    """A struct of ``lang_pred, score, rejected``. Null texts and texts without a letter are ``und``, score 0, rejected."""

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([judged(some) for some in in_slices([texts])] or [judged(texts)])

    def judged(texts: pa.Array) -> pa.Array:
        letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
        if not model.labels:
            best, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        else:
            p, _ = model.probabilities(texts)
            best = np.where(letters, np.array(model.labels, object)[p.argmax(axis=1)], UNDETERMINED)
            score = np.where(letters, p.max(axis=1), 0.0)
        rejected = ~letters | (score < model.reject_below)
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score), pa.array(rejected)], ["lang_pred", "score", "rejected"])

    return run(text)


TRAIN_FOLDS, HELD_OUT_FOLD = 4, 2
PER_LANGUAGE, EXCERPT = 800, 1 << 12


def trained_on(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fits on about ``PER_LANGUAGE`` labelled documents of each language, fewer of each where there are very many.

    Of texts of over ``EXCERPT`` characters a part of that length is learned from. Rows with null text or language are
    not learned from; an empty table, or one without languages, gives a model that knows none.
    """
    rows = docs.where(fold_of(F.col(doc_id), TRAIN_FOLDS) != HELD_OUT_FOLD)
    rows = rows.select(F.col(doc_id).cast("long").alias("key"), excerpt(F.col(text), F.col(doc_id), EXCERPT).alias("text"), F.col(lang).alias("lang"))
    return fit(collected(drawn(rows, "key", "lang", PER_LANGUAGE, EXCERPT), "key", "text", "lang"))


def identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred, score, rejected`` (clashing columns are replaced).

    Each row is judged by its whole text alone: equal texts get equal answers, repeated rows and ids stay. Null texts and
    texts without a letter are ``und``. Of equally likely languages the first by name is predicted. An empty table gives
    an empty result.
    """
    found = f"{spare(docs)}found"
    added = {c: F.col(f"{found}.{c}") for c in ("lang_pred", "score", "rejected")}
    return docs.withColumn(found, predicted(model, F.col(text))).withColumns(added).drop(found)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of all whole ``documents``; held-out ones are never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = trained_on(docs)
    held_out = fold_of(F.col("doc_id"), TRAIN_FOLDS) == HELD_OUT_FOLD
    found = identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
