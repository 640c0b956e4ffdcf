"""Quality classifier: a convolutional network over bytes, in numpy.

A text's bytes are embedded and cut into overlapping chunks of ``BLOCKS`` blocks of ``STEP`` bytes, one chunk starting at
every block, so that the chunks cover the whole text. Learned filters run over each chunk; the largest response of each
filter anywhere in the text (max pooling) goes through one hidden layer to a probability. Scoring takes texts in blocks
of bounded size, and a long text in several that overlap, so that no chunk is left out, keeping only running maxima.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm._rows import in_slices
from strandwork.llm._sample import byte_spans, collected, drawn, excerpt, fold_of

STEP, BLOCKS = 8, 2
DIM, FILTERS, HIDDEN = 8, 32, 16
PAD = 256
BLOCK = 1 << 18


@dataclass
class Network:
    emb: np.ndarray  # byte value or padding x DIM
    filters: np.ndarray  # STEP * DIM x (BLOCKS * FILTERS)
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        emb = normal(0.5, PAD + 1, DIM)
        emb[PAD] = 0
        wide = BLOCKS * STEP * DIM
        return cls(emb, normal((2 / wide) ** 0.5, STEP * DIM, BLOCKS * FILTERS), np.zeros(FILTERS, np.float32), normal((1 / FILTERS) ** 0.5, FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), normal((1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1, np.float32))

    def responses(self, data: np.ndarray, starts: np.ndarray):
        """Largest response of each filter in each span, the embedded blocks, and the chunk that gave it."""
        sizes = np.diff(np.append(starts, len(data)))
        blocks = np.maximum(-(-sizes // STEP), BLOCKS)
        first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        padded = np.full(int(blocks.sum()) * STEP, PAD, np.int32)
        shift = np.repeat(first * STEP - starts, sizes)
        padded[np.arange(len(data)) + shift] = data
        inputs = self.emb[padded].reshape(-1, STEP * DIM)
        product = inputs @ self.filters
        n = len(inputs) - BLOCKS + 1
        act = product[:n, :FILTERS].copy()
        for j in range(1, BLOCKS):
            act += product[j : j + n, j * FILTERS : (j + 1) * FILTERS]
        last = first + blocks - BLOCKS + 1
        bounds = np.stack([first, last], 1).ravel()
        return np.maximum.reduceat(act, bounds[:-1] if bounds[-1] >= n else bounds, axis=0)[::2], (act, inputs, padded, first, last)

    def combined(self, pooled: np.ndarray):
        relu = np.maximum(pooled + self.bias, 0)
        deep = np.tanh(relu @ self.hidden + self.hidden_bias)
        return deep @ self.out + self.out_bias[0], (relu, deep)

    def logits(self, texts: pa.Array) -> np.ndarray:
        pooled = np.full((len(texts), FILTERS), -np.inf, np.float32)
        for data, starts, rows, *_ in byte_spans(texts, BLOCK, (BLOCKS - 1) * STEP):
            pooled[rows] = np.maximum(pooled[rows], self.responses(data, starts)[0])
        empty = np.isinf(pooled[:, 0])
        pooled[empty] = 0
        return self.combined(pooled)[0]


def _gradients(net: Network, data: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    pooled, (act, inputs, padded, first, last) = net.responses(data, starts)
    z, (relu, deep) = net.combined(pooled)
    d = ((1 / (1 + np.exp(-z)) - y) * weight / len(y)).astype(np.float32)
    g = {"out": deep.T @ d, "out_bias": d.sum(keepdims=True)}
    back = np.outer(d, net.out) * (1 - deep**2)
    g |= {"hidden": relu.T @ back, "hidden_bias": back.sum(0)}
    back = (back @ net.hidden.T) * (relu > 0)
    g["bias"] = back.sum(0)
    best = np.stack([act[a:b].argmax(0) + a for a, b in zip(first, last, strict=True)])  # document x filter
    g["filters"] = np.zeros_like(net.filters)
    g["emb"] = np.zeros_like(net.emb)
    for j in range(BLOCKS):
        seen = inputs[best + j]  # document x filter x (STEP * DIM)
        part = slice(j * FILTERS, (j + 1) * FILTERS)
        g["filters"][:, part] = np.einsum("nfi,nf->if", seen, back)
        to = (back[:, :, None] * net.filters[:, part].T[None]).reshape(-1, DIM)
        of = padded.reshape(-1, STEP)[best + j].ravel()
        for k in range(DIM):
            g["emb"][:, k] += np.bincount(of, weights=to[:, k], minlength=PAD + 1).astype(np.float32)
    g["emb"][PAD] = 0
    return g


def fit(sample: list[tuple[bytes, int]], prior: float | None = None, epochs: int = 12, min_steps: int = 800, batch: int = 24, rate: float = 4e-3, seed: int = 11) -> Network:
    """Adam on balanced classes; the output's bias is then moved to the share ``prior`` of label 1. No sample: chance."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    sample = [(b, y) for b, y in sample if b]
    y = np.array([label for _, label in sample], np.float32)
    if not sample or y.min() == y.max():
        net.out[:], net.out_bias[:] = 0, 0 if not sample else (4 if y[0] else -4)
        return net
    share = y.mean()
    weights = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    names = [f.name for f in fields(Network)]
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    batches = -(-len(sample) // batch)
    epochs = max(epochs, -(-min_steps // batches))
    step, steps = 0, epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(sample))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            bodies = [sample[i][0] for i in chosen]
            starts = np.cumsum([0, *map(len, bodies[:-1])])
            grads = _gradients(net, np.frombuffer(b"".join(bodies), np.uint8), starts, y[chosen], weights[chosen])
            step += 1
            lr = rate * (1 - step / (steps + 1))
            for n in names:
                first[n] += 0.1 * (grads[n] - first[n])
                second[n] += 0.001 * (grads[n] ** 2 - second[n])
                move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                setattr(net, n, (getattr(net, n) - lr * move).astype(np.float32))
    if prior is not None and 0 < prior < 1:
        net.out_bias = net.out_bias + np.float32(np.log(prior / (1 - prior)))
    return net


def scored(net: Network, text: Column) -> Column:
    """Probability of good quality; null counts as empty, and all empty texts have one score."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        logits = np.concatenate([np.zeros(0), *(net.logits(some) for some in in_slices([texts]))])
        return pa.array(1 / (1 + np.exp(-logits.astype(np.float64))))

    return run(text)


FOLDS, HELD_OUT_FOLD = 3, 1
PER_LABEL, EXCERPT = 1500, 1 << 13


def trained_on(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Network:
    """Fits on about ``PER_LABEL`` documents of either label, chosen by hash among those not held out.

    Keys are drawn from the labels, and the few thousand that are drawn go to the documents. Of texts of over ``EXCERPT``
    characters a part of that length is learned from. Labels that are null, or of ids that are null or unknown, count for
    nothing; where one id has several labels or texts, all are taken. Without documents or labels every score is 0.5.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(quality).alias("label")).where(F.col("label").isin(0, 1) & F.col("_id").isNotNull())
    known = known.where(fold_of(F.col("_id"), FOLDS) != HELD_OUT_FOLD)
    share = known.agg(F.avg("label")).first()[0]
    some = drawn(known, "_id", "label", PER_LABEL, EXCERPT)
    rows = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text")).join(F.broadcast(some), F.col("key") == F.col("_id"))
    return fit(collected(rows.withColumn("text", excerpt(F.col("text"), F.col("key"), EXCERPT)), "key", "text", "label"), share)


def with_quality(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``predicted`` (1 from a score of 0.5); clashing columns are replaced.

    Each row is scored by its whole text alone: equal texts have equal scores, repeated rows and ids stay, null and empty
    texts all have the score of no bytes. An empty table gives an empty result.
    """
    found = docs.withColumn("score", scored(net, F.col(text)))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_quality_model(spark, sf_dir: str) -> DataFrame:
    """Scores all whole ``documents`` for quality; labels of held-out documents are never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = trained_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = fold_of(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD
    return with_quality(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted")
