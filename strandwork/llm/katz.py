"""An n-gram language model with Katz backoff, learned and applied by questions and answers between texts and counts.

The counts of each order are a table partitioned by shards of contexts. A block of documents asks the shards about the
distinct n-grams that it has, adding what its training documents count; a shard adds up what all blocks say, and answers
each block with the whole counts and with what backoff needs to know of the contexts. The answers of one order give the
block its n-grams of the next: a gram is named by its context's number and its word's, so every order is one such round,
and the probability of each token is that of its longest known n-gram, or the context's backoff weight times that of the
next shorter one. Documents are exchanged once, and each round reads that exchange.

A context with many occurrences is split by word over as many shards as its share of all calls for, and each of them
answers for its part. The empty context of the first order is the extreme case: it is split over all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm._spans import Texts, dealt
from strandwork.llm.prefix_trie import CRC32_SQL

ORDER = 2
FOLDS, HELD_OUT = 5, 1
#: Counts up to this one are discounted by Good and Turing's estimate.
MOST_DISCOUNTED = 5
#: What a count loses where too few n-grams have it or the next one for an estimate.
LOSS = 0.5
END = np.uint64(1)
#: Numbers of contexts and words: none, the beginning of a text, those never seen in training, and no word at all.
BEGIN, UNSEEN, NOTHING = 0, np.uint64((1 << 63) - 1), np.uint64((1 << 63) - 2)
LONG_WORD, SLICE = 1 << 16, 1 << 20
SPLIT = 4

_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = np.array([xxhash.xxh64_intdigest(bytes([b]), 1) for b in _LOWER], np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers whose every bit depends on all bits of the given ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name for each word of ``data`` (bytes), upper-case A-Z being lower-case."""
    found = np.empty(len(starts), np.uint64)
    n = min(len(data), SLICE + LONG_WORD) + 1
    up, down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    at = 0
    while at < len(starts):
        first = starts[at]
        last = max(at + 1, int(np.searchsorted(ends, first + SLICE, "right")))
        if ends[at] - first > LONG_WORD:
            found[at] = xxhash.xxh64_intdigest(_LOWER[data[first : ends[at]]].astype(np.uint8).tobytes(), 2)
            at += 1
            continue
        size = int(ends[last - 1] - first)
        sums = np.zeros(size + 1, np.uint64)
        np.multiply(_VALUE[data[first : first + size]], up[:size], out=sums[1:])
        np.cumsum(sums, out=sums)
        s, e = starts[at:last] - first, ends[at:last] - first
        found[at:last] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        long = at + np.flatnonzero(e - s > LONG_WORD)
        for k in long.tolist():
            found[k] = xxhash.xxh64_intdigest(_LOWER[data[starts[k] : ends[k]]].astype(np.uint8).tobytes(), 2)
        at = last
    return found


def tokens_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of all texts, an end behind each text's, and where each text's tokens end."""
    texts = texts.combine_chunks().cast(pa.binary())
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.binary())
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]] if raw is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    word = ~_SPACE[data]
    new, over = word.copy(), word.copy()
    new[1:] &= ~word[:-1]
    over[:-1] &= ~word[1:]
    inner = edges[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    new[inner] = word[inner]
    over[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(new), np.flatnonzero(over) + 1
    del word, new, over
    until = np.searchsorted(starts, edges[1:])
    stops = until + np.arange(1, len(texts) + 1)
    found = np.full(len(starts) + len(texts), END, np.uint64)
    is_word = np.ones(len(found), bool)
    is_word[stops - 1] = False
    found[is_word] = word_names(data, starts, ends)
    return found, stops


def packed_numbers(*columns: np.ndarray) -> bytes:
    """Columns of numbers as bytes: alike bytes of a column together, compressed."""
    parts = []
    for c in columns:
        body = np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes()
        small = pa.compress(body, codec="zstd", asbytes=True) if body else b""
        parts.append(np.array([len(c), len(small)], "<i8").tobytes() + small)
    return b"".join(parts)


def unpacked_numbers(body: bytes, *kinds: str) -> list[np.ndarray]:
    found, at = [], 0
    for kind in kinds:
        n, size = np.frombuffer(body, "<i8", 2, at).tolist()
        at += 16
        width = np.dtype(kind).itemsize
        raw = pa.decompress(body[at : at + size], n * width, codec="zstd", asbytes=True) if size else b""
        at += size
        found.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).reshape(n))
    return found


QUESTION = ("<u8", "<u4", "<u8", "<u4", "<u4", "<f8", "<u4")


def question(context: np.ndarray, word: np.ndarray, count: np.ndarray, lower: np.ndarray) -> bytes:
    """Equal contexts, which stand together, as one with how many there are; words and probabilities as places in lists of
    the different ones."""
    heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])[: len(context)])
    words, w = np.unique(word, return_inverse=True)
    values, v = np.unique(lower, return_inverse=True)
    runs = np.diff(np.append(heads, len(context)))
    return packed_numbers(context[heads], runs.astype("<u4"), np.diff(words, prepend=np.uint64(0)), w.astype("<u4"), count.astype("<u4"), values, v.astype("<u4"))


def asked_in(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words, counts and probabilities of a ``question``."""
    context, runs, words, w, count, values, v = unpacked_numbers(body, *QUESTION)
    return np.repeat(context, runs), np.cumsum(words, dtype=np.uint64)[w], count, values[v]


#: Counts, numbers of n-grams (of the last order none), and of contexts: words in all, n-grams of each count, probabilities.
ANSWER = ("<u8", "<u8", "<u8", "<u8", "<f8", "<u8")
K = MOST_DISCOUNTED


def discounts(having: np.ndarray) -> np.ndarray:
    """What is left of counts 0 to ``K``, as shares, from how many n-grams have each count up to ``K + 1``.

    Good and Turing's estimate, scaled so that counts above ``K`` lose nothing; where it says that a count keeps nothing,
    or all or more, as it may with few n-grams, the count loses ``LOSS``.
    """
    out = np.ones(K + 1)
    above = (K + 1) * having[K + 1] / having[1] if having[1] else 1.0
    for r in range(1, K + 1):
        share = ((r + 1) * having[r + 1] / (r * having[r]) - above) / (1 - above) if having[r] and above != 1 else 0.0
        out[r] = share if 0 < share < 1 else (r - LOSS) / r
    return out


def kept_mass(counts: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts by how many words they have in all and how many n-grams of each count up to ``K`` (rows): the factor of
    their seen words' discounted shares, and what is left for unseen ones, always more than nothing."""
    total, having = counts[:, 0].astype(float), counts[:, 1:].astype(float)
    r = np.arange(1, K + 1)
    lost = (having * (r * (1 - left[1:]))).sum(axis=1) / np.maximum(total, 1)
    # Without a discounted word the context gives up as much as one more occurrence.
    factor = np.where(lost > 0, 1.0, total / (total + 1))
    return factor, np.where(total > 0, np.where(lost > 0, lost, 1 / (total + 1)), 1.0)


@dataclass
class Told:
    """What the shards have answered to a block about its n-grams of one order, in the order of its questions."""

    counts: np.ndarray
    grams: np.ndarray
    contexts: np.ndarray  # a row for each distinct context: all, and how many n-grams of each count up to K
    lower: np.ndarray
    having: np.ndarray


def shards_of(context: np.ndarray, word: np.ndarray, ways: np.ndarray, shards: int) -> np.ndarray:
    part = mixed(word) % ways.astype(np.uint64)
    return ((mixed(context) + part) % np.uint64(shards)).astype(np.int64)


class Asked:
    """The questions of a block about one order: distinct (context, word), contexts together, with training counts, the
    probability by the next shorter context, and over how many shards each context is split."""

    def __init__(self, context, word, count, lower, ways, shards: int):
        self.n, self.shards = len(context), shards
        heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])[: self.n])
        # Each part of a split context is asked about, if only for what it has of the context.
        w = np.where(ways[heads] > 1, ways[heads], 0).astype(np.int64)
        more = np.repeat(context[heads], w)
        nth = np.arange(len(more)) - np.repeat(np.cumsum(w) - w, w)
        part = ((mixed(more) + nth.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        self.context = np.concatenate([context, more])
        self.which = np.concatenate([np.repeat(np.arange(len(heads)), np.diff(np.append(heads, self.n))), np.repeat(np.arange(len(heads)), w)])
        self.n_contexts = len(heads)
        self.word = np.concatenate([word, np.full(len(more), NOTHING)])
        self.count = np.concatenate([count, np.zeros(len(more), np.int64)])
        self.lower = np.concatenate([lower, np.zeros(len(more))])
        shard = np.concatenate([shards_of(context, word, ways, shards), part]).astype(np.uint16 if shards < 1 << 16 else np.int64)
        by_context = np.argsort(self.which, kind="stable")
        self.order = by_context[np.argsort(shard[by_context], kind="stable")]
        self.cuts = np.searchsorted(shard[self.order], np.arange(shards + 1))

    def questions(self, block: int) -> pa.Table:
        bodies = []
        for s in range(self.shards):
            at = self.order[self.cuts[s] : self.cuts[s + 1]]
            bodies.append(question(self.context[at], self.word[at], self.count[at], self.lower[at]))
        return pa.table({"shard": pa.array(np.arange(self.shards), pa.int32()), "block": pa.array([block] * self.shards, pa.int32()), "payload": pa.array(bodies, pa.binary())})

    def told(self, answers: dict[int, bytes]) -> Told:
        counts, grams = np.zeros(len(self.word), np.int64), np.zeros(len(self.word), np.uint64)
        contexts, lower, having = np.zeros((self.n_contexts, K + 1), np.int64), np.zeros(self.n_contexts), np.zeros(K + 2, np.int64)
        for s, body in sorted(answers.items()):
            at = self.order[self.cuts[s] : self.cuts[s + 1]]
            n, name, total, of_count, below, here = unpacked_numbers(body, *ANSWER)
            counts[at], grams[at] = n, name if len(name) else UNSEEN
            having += here.astype(np.int64)
            if len(at):
                which = self.which[at][np.concatenate([[True], self.context[at][1:] != self.context[at][:-1]])]
                contexts[which, 0] += total.astype(np.int64)
                contexts[which, 1:] += of_count.reshape(-1, K).astype(np.int64)
                lower[which] += below
        return Told(counts[: self.n], grams[: self.n], contexts, lower, having)


def answers_of(bodies: list[tuple[int, bytes]], shard: int, shards: int, last: bool = False) -> tuple[list[tuple[int, bytes]], tuple]:
    """A shard's answers to the blocks' questions, and its part of the table: contexts, words, their numbers and counts.
    In the last order nobody needs the numbers."""
    asked = [asked_in(body) for _, body in bodies]
    context, word, count, lower = (np.concatenate([a[i] for a in asked]) for i in range(4))
    order = np.lexsort((word, context))
    c, w = context[order], word[order]
    new_context = np.concatenate([[True], c[1:] != c[:-1]])[: len(c)]
    new = new_context | np.concatenate([[True], w[1:] != w[:-1]])[: len(c)]
    heads = np.flatnonzero(new)
    total = np.add.reduceat(count[order].astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
    gram = np.cumsum(new) - 1
    # Numbers are small where counts are large.
    by_count = np.argsort(-total, kind="stable")
    number = np.empty(len(total), np.uint64)
    number[by_count] = np.uint64(1 + shard) + np.arange(len(total), dtype=np.uint64) * np.uint64(shards)
    number[total == 0] = UNSEEN
    starts = np.flatnonzero(new_context[heads]) if len(heads) else np.zeros(0, np.int64)
    seen = total > 0
    sums = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0, x.dtype)
    of_all = sums(total)
    of_count = np.stack([sums((total == r).astype(np.int64)) for r in range(1, K + 1)], axis=1)
    below = sums(np.where(seen, lower[order][heads], 0.0)) if len(heads) else np.zeros(0)
    having = np.array([(total == r).sum() for r in range(K + 2)], np.int64)
    having[0] = int(seen.sum())
    back, which = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    back[order], which[order] = gram, np.cumsum(new_context) - 1
    out, at = [], 0
    for (block, _), one in zip(bodies, asked, strict=True):
        here, ctx = back[at : at + len(one[0])], which[at : at + len(one[0])]
        at += len(one[0])
        distinct = ctx[np.concatenate([[True], ctx[1:] != ctx[:-1]])[: len(ctx)]]
        body = (total[here], number[here[:0] if last else here], of_all[distinct], of_count[distinct].reshape(-1), below[distinct], having)
        out.append((block, packed_numbers(*(x.astype(k) for x, k in zip(body, ANSWER, strict=True)))))
    return out, (c[heads][seen], w[heads][seen], number[seen], total[seen])


@dataclass
class Known:
    """What a block knows of its tokens after an order: numbers of its words and grams with the grams' counts, which of them
    each token has (a gram at -1 is none), and each token's probability."""

    words: np.ndarray
    word_at: np.ndarray
    grams: np.ndarray
    counts: np.ndarray
    gram_at: np.ndarray
    p: np.ndarray


class Block:
    """The tokens of a block of documents, looked at order by order."""

    def __init__(self, docs: pa.Table, shards: int):
        self.names, self.stops = tokens_of(docs.column("text"))
        self.held_out = np.array([x is not None and zlib.crc32(str(x).encode()) % FOLDS == HELD_OUT for x in docs.column("doc_id").to_pylist()], bool)
        self.sizes = np.diff(self.stops, prepend=0)
        self.train, self.shards = ~np.repeat(self.held_out, self.sizes), shards
        self.n = self.distinct = 0
        self.word_counts = np.zeros(0, np.int64)

    def first(self) -> tuple[Asked, np.ndarray]:
        """Questions about words, and which of them each token is."""
        word, back = np.unique(self.names, return_inverse=True)
        count = np.bincount(back[self.train], minlength=len(word))
        return Asked(np.full(len(word), BEGIN, np.uint64), word, count, np.zeros(len(word)), np.full(len(word), self.shards), self.shards), back

    def longer(self, known: Known, k: int) -> tuple[Asked, np.ndarray, np.ndarray]:
        """Questions about grams of order ``k``, which of them tokens have, and which tokens have one: those whose context
        has been seen in training."""
        begin = len(known.grams)
        numbers, counts = np.append(known.grams, np.uint64(BEGIN)), np.append(known.counts, 0)
        firsts = self.stops - self.sizes
        context = np.empty(len(self.names), np.int64)
        context[1:] = known.gram_at[:-1]
        context[firsts] = begin if k == 2 else -1
        if k == 2 and len(self.stops):
            counts[begin] = known.counts[known.gram_at[self.stops[0] - 1]]  # a text begins as often as it ends
        at = np.flatnonzero((context >= 0) & (counts[context] > 0))
        wide = len(known.words)
        pair, back = np.unique(context[at] * wide + known.word_at[at], return_inverse=True)
        lower = np.empty(len(pair))
        lower[back] = known.p[at]
        count = np.bincount(back[self.train[at]], minlength=len(pair))
        c = pair // wide
        ways = np.minimum(counts[c] * (SPLIT * self.shards) // max(self.n, 1) + 1, self.shards)
        return Asked(numbers[c], known.words[pair % wide], count, lower, ways, self.shards), back, at

    def probabilities(self, asked: Asked, told: Told, first: bool) -> np.ndarray:
        """Katz's probability of each gram: its discounted share, or what its context leaves for words not seen after it,
        shared out by the next shorter context."""
        left = discounts(told.having)
        factor, rest = kept_mass(told.contexts, left)
        which = asked.which[: asked.n]
        share = factor[which] * left[np.where(told.counts > K, 0, told.counts)] * told.counts / np.maximum(told.contexts[which, 0], 1)
        others = rest[which] if first else rest[which] / (1 - told.lower[which]) * asked.lower[: asked.n]
        return np.where(told.counts > 0, share, others)

    def known(self, answers: dict[int, dict[int, bytes]], upto: int) -> Known:
        asked, back = self.first()
        told = asked.told(answers[1])
        self.n, self.distinct = int(told.contexts[:, 0].sum()), int(told.having[0])
        self.word_counts = told.counts[back]
        found = Known(told.grams, back, told.grams, told.counts, back, self.probabilities(asked, told, True)[back])
        for k in range(2, upto + 1):
            asked, back, at = self.longer(found, k)
            told = asked.told(answers[k])
            gram_at, p = np.full(len(self.names), -1), found.p.copy()
            gram_at[at], p[at] = back, self.probabilities(asked, told, False)[back]
            found = Known(found.words, found.word_at, told.grams, told.counts, gram_at, p)
        return found


QUESTIONS = "shard int, block int, payload binary"
ANSWERS = "block int, level int, shard int, payload binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
TABLE = "level int, shard int, context decimal(20,0), word decimal(20,0), number decimal(20,0), n long"


def _answers(table: pa.Table) -> dict[int, dict[int, bytes]]:
    found: dict[int, dict[int, bytes]] = {}
    for level, shard, body in zip(*(table.column(c).to_pylist() for c in ("level", "shard", "payload")), strict=True):
        found.setdefault(level, {})[shard] = body
    return found


def _shard_by_shard(batches) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    now, held = None, []
    for batch in batches:
        for shard, block, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if shard != now and held:
                yield now, held
                held = []
            now = shard
            held.append((block, body))
    if held:
        yield now, held


class Rounds:
    """The rounds of questions and answers over documents dealt to blocks."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER):
        self.texts: Texts = dealt(docs, doc_id, text)
        self.order, self.shards = order, self.texts.blocks
        self.asked: list[DataFrame] = []
        self.told: DataFrame | None = None
        for k in range(1, order + 1):
            self.asked.append(self._questions(k))
            answers = self._at_shards(self.asked[-1]).mapInArrow(self._answering(k), ANSWERS)
            self.told = answers if self.told is None else self.told.unionByName(answers)

    def _at_shards(self, asked: DataFrame) -> DataFrame:
        return asked.repartitionById(self.texts.blocks, F.pmod("shard", F.lit(self.texts.blocks))).sortWithinPartitions("shard", "block")

    def _questions(self, k: int) -> DataFrame:
        shards = self.shards

        def first(docs: pa.Table) -> pa.Table:
            return Block(docs, shards).first()[0].questions(docs.column("block")[0].as_py())

        def later(docs: pa.Table, known: pa.Table) -> pa.Table:
            block = Block(docs, shards)
            return block.longer(block.known(_answers(known), k - 1), k)[0].questions(docs.column("block")[0].as_py())

        return self.texts.each(first, QUESTIONS) if k == 1 else self.texts.each_with(self.told, later, QUESTIONS)

    def _answering(self, k: int):
        shards, last = self.shards, k == self.order

        def run(batches):
            for shard, bodies in _shard_by_shard(batches):
                for block, body in answers_of(bodies, shard, shards, last)[0]:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([k], pa.int32()), pa.array([shard], pa.int32()), pa.array([body], pa.binary())], ["block", "level", "shard", "payload"])

        return run

    def tables(self) -> DataFrame:
        """The model's counts: a row for each n-gram of training, with the numbers of its context and word (of a word, order
        1, its 64-bit name) and its own; a shard's rows are a partition's."""
        shards = self.shards

        def table(k: int):
            def run(batches):
                for shard, bodies in _shard_by_shard(batches):
                    rows = answers_of(bodies, shard, shards)[1]
                    names = [pa.array(x.tolist(), pa.decimal128(20)) for x in rows[:3]]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows[0]), pa.int32()), pa.array([shard] * len(rows[0]), pa.int32()), *names, pa.array(rows[3], pa.int64())], ["level", "shard", "context", "word", "number", "n"])

            return run

        parts = [self._at_shards(asked).mapInArrow(table(k), TABLE) for k, asked in enumerate(self.asked, 1)]
        found = parts[0]
        for more in parts[1:]:
            found = found.unionByName(more)
        return found

    def scores(self) -> DataFrame:
        order, shards = self.order, self.shards

        def run(docs: pa.Table, known: pa.Table) -> pa.Table:
            block = Block(docs, shards)
            found = block.known(_answers(known), order)
            starts = block.stops - block.sizes
            sums = lambda x: np.add.reduceat(x, starts)
            base = np.log10((block.word_counts + 0.5) / (block.n + 0.5 * (block.distinct + 1)))
            columns = [pa.array(block.held_out), pa.array(block.sizes), pa.array(sums((block.word_counts > 0).astype(np.int64))), pa.array(np.full(len(starts), block.n)), pa.array(sums(base)), pa.array(sums(np.log10(found.p)))]
            return pa.table([docs.column("doc_id"), *columns], names=[c.split()[0] for c in SCORES.split(", ")])

        return self.texts.each_with(self.told, run, SCORES)


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Null and empty texts are their end alone; a null id is in training; rows that repeat an id or a text are documents of
    their own; a text of any length is scored whole; an empty table gives an empty result; other columns are not read.
    Without a training document every probability of the model is 1. Words are told apart by 64-bit names.
    """
    return Rounds(docs, doc_id, text, order).scores()


def op12_katz(spark, sf_dir: str) -> DataFrame:
    """Scores of all whole ``documents`` by words and pairs of words."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _discount_sql(level: str) -> str:
    """CTEs ``h`` (how many n-grams have each count) and ``d`` (what is left of each count) of ``c`` and ``level``."""
    having = ", ".join(f"CAST(count(*) FILTER (WHERE c = {r}) AS DOUBLE) AS n{r}" for r in range(1, K + 2))
    above = f"coalesce({K + 1} * n{K + 1} / nullif(n1, 0), 1)"
    shares = ", ".join(f"(({r + 1} * n{r + 1} / nullif({r} * n{r}, 0)) - {above}) / nullif(1 - {above}, 0) AS s{r}" for r in range(1, K + 1))
    left = " UNION ALL ".join(f"SELECT {r} AS c, CASE WHEN s{r} > 0 AND s{r} < 1 THEN s{r} ELSE {(r - LOSS) / r!r} END AS d FROM h{level}" for r in range(1, K + 1))
    return f"h{level} AS (SELECT {shares} FROM (SELECT {having} FROM c{level}) x), d{level} AS ({left})"


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEPT = "CASE WHEN lost > 0 THEN 1 ELSE n / (n + 1) END AS f, CASE WHEN lost > 0 THEN lost ELSE 1 / (n + 1) END AS rest"
#: An end is an empty word, a beginning a space.
ORACLE_SQL = rf"""
WITH x AS (SELECT doc_id, {CRC32_SQL.format('CAST(doc_id AS VARCHAR)')} % {FOLDS} = {HELD_OUT} AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^ 	-
]+'), '') AS words FROM documents),
t AS (SELECT doc_id, held_out, unnest(words) AS w, unnest(list_concat([' '], words[:-2])) AS h FROM x),
c1 AS (SELECT w, CAST(count(*) AS DOUBLE) AS c FROM t WHERE NOT held_out GROUP BY w), {_discount_sql("1")},
k1 AS (SELECT n, v, {_KEPT} FROM (SELECT sum(c) AS n, count(*) AS v, sum(c * (1 - coalesce(d, 1))) / sum(c) AS lost FROM c1 LEFT JOIN d1 USING (c)) y),
p1 AS (SELECT w, c, f * coalesce(d, 1) * c / n AS p FROM c1 LEFT JOIN d1 USING (c), k1),
c2 AS (SELECT h, w, CAST(count(*) AS DOUBLE) AS c FROM t WHERE NOT held_out GROUP BY h, w), {_discount_sql("2")},
k2 AS (SELECT h, n, seen, {_KEPT} FROM (SELECT h, sum(c2.c) AS n, sum(p) AS seen, sum(c2.c * (1 - coalesce(d, 1))) / sum(c2.c) AS lost FROM c2 LEFT JOIN d2 USING (c) JOIN p1 USING (w) GROUP BY h) y),
s AS (SELECT doc_id, held_out, p1.c, coalesce(k2.f * coalesce(d, 1) * c2.c / k2.n, k2.rest / (1 - seen) * coalesce(p1.p, k1.rest), p1.p, k1.rest) AS p, k1.n, k1.v
  FROM t CROSS JOIN k1 LEFT JOIN p1 USING (w) LEFT JOIN c2 ON c2.h = t.h AND c2.w = t.w LEFT JOIN d2 ON d2.c = c2.c LEFT JOIN k2 ON k2.h = t.h)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(max(n) AS BIGINT) AS train_tokens, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS base_score, sum(log10(p)) AS score FROM s GROUP BY doc_id, held_out
"""
