"""The most similar name, and groups of similar names, with the result of scoring all pairs of names.

Names meet in lists of an index that has every pair that can reach the threshold in one list at least (``keys_of``). Where
so many names share a key that its list would be dealt out pair by pair, its names are dealt to blocks instead, and these
blocks meet once, whatever the number of such keys. The pairs of lists are bounded all at once, in a pair of blocks one name
against all the others (shared letters, then common subsequences, in numpy), and only pairs whose bound reaches the threshold
and the best so far are scored. Bounds never fall below scores. A task has a bounded number of pairs, and gives no more rows
than names come to it.

For the most similar name those that are a letter apart at most are looked for first (``near_keys``): a name that has one
needs no other, as all that are further apart score less. So the names of one family, all of them alike, do not all meet.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions.fuzzy import SCORERS, words
from strandwork.session import settled, shuffled, spread

BLOCK = 1000
LETTERS = " abcdefghijklmnopqrstuvwxyz0123456789"
CODES = {c: i + 1 for i, c in enumerate(LETTERS)}
#: What a list of the index may come to in pairs, about what a task compares of them, and up to how many in all the names
#: meet in blocks at once, which is then sooner done.
LIST_PAIRS, TASK_PAIRS, FEW_PAIRS = 1 << 22, 1 << 22, 1 << 25
#: How many rows of lists a task has, how many pairs of them are made and bounded at once, and how many letters of a name are
#: laid out for that.
TASK_ROWS, CELLS, STEP, LAID = 1 << 19, 1 << 20, 1 << 16, 128
#: Into how many tasks for each core work is dealt, which Spark would deal by bytes.
TASKS_A_CORE = 4
#: The weighted score's discounts: of the word forms, and of parts of a longer name. Above the threshold that they give
#: together, two names whose lengths differ by half can only be alike if one is a part of the other.
WORD_SHARE, PART_SHARE = 0.95, 0.9
INDEXED_ABOVE = 100 * WORD_SHARE * PART_SHARE
#: Scores are rounded to four places.
SLACK = 1e-3


def _codes(texts: list[str]) -> np.ndarray:
    """A row of codes for each text, filled up with 0."""
    found = np.zeros((len(texts), max(map(len, texts), default=0)), np.uint8)
    for row, text in zip(found, texts, strict=True):
        row[: len(text)] = [CODES[c] for c in text]
    return found


def _common(a: str, others: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a``, of at most 64 letters, and each row of codes."""
    masks = np.zeros(len(CODES) + 1, np.uint64)
    for i, c in enumerate(a):
        masks[CODES[c]] |= np.uint64(1 << i)
    full = np.uint64((1 << len(a)) - 1)
    row = np.full(len(others), full, np.uint64)
    for column in others.T:
        hit = row & masks[column]
        row = (row + hit) | (row - hit)
    return len(a) - np.bitwise_count(row & full).astype(np.int64)


class Block:
    """Names, laid out so that one name is bounded against all of them at once."""

    def __init__(self, names: list[str], scorer: str):
        self.names, self.scorer = names, scorer
        if scorer != "weighted":
            return
        split = [words(n) for n in names]
        self.plain, self.ordered = (_codes([" ".join(f(w)) for w in split]) for f in (list, sorted))
        self.long = np.array([len(" ".join(w)) for w in split], np.int64)
        self.set_long = np.array([len(" ".join(set(w))) for w in split], np.int64)
        self.n_words = np.array([len(set(w)) for w in split], np.int64)
        self.bags = np.stack([(self.plain == c).sum(axis=1) for c in CODES.values()]).astype(np.uint16)
        rows = defaultdict(list)
        for i, w in enumerate(split):
            for x in set(w):
                rows[x].append(i)
        self.rows = {w: np.array(v) for w, v in rows.items()}

    def bounded(self, name: str, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows that can have ``threshold`` or more against ``name``, and what they have at most; highest first."""
        if self.scorer != "weighted":
            return np.arange(len(self.names)), np.full(len(self.names), 100.0)
        w = words(name)
        plain, ordered, one, n_words = " ".join(w), " ".join(sorted(w)), len(" ".join(set(w))), len(set(w))
        bag = np.zeros(len(self.names), np.int64)
        for c, counts in zip(CODES, self.bags, strict=True):
            if most := plain.count(c):
                bag += np.minimum(counts, most)
        both, shared = np.zeros(len(self.names), np.int64), np.zeros(len(self.names), np.int64)
        for x in set(w):
            if x in self.rows:
                both[self.rows[x]] += len(x) + 1
                shared[self.rows[x]] += 1
        both = np.maximum(both - 1, 0)

        def most(at: np.ndarray, whole: np.ndarray, sort: np.ndarray) -> np.ndarray:
            """Bounds of the weighted score from bounds of the common subsequences: of the names, and of their sorted words."""
            a, b, sa, sb = len(plain), self.long[at], one, self.set_long[at]
            n, sn, k, o = np.minimum(a, b), np.minimum(sa, sb), shared[at], both[at]
            longer = np.maximum(a, b) / np.maximum(n, 1)
            part = lambda m, n: 200 * np.minimum(m, n) / np.maximum(n + np.minimum(m, n), 1)
            alike = 200 * np.minimum(whole, n) / np.maximum(a + b, 1)
            set_of = lambda m: 200 * np.minimum(m, sn) / np.maximum(sa + sb, 1)
            inside = np.where((k == n_words) | (k == self.n_words[at]), 100.0, np.maximum(200 * o / np.maximum(o + sn, 1), set_of(bag[at])))
            near = np.maximum(alike, 0.95 * np.maximum(200 * np.minimum(sort, n) / np.maximum(a + b, 1), np.where(k > 0, inside, set_of(sort))))
            discount = np.where(longer < 8, 0.9, 0.6)
            far = np.maximum(alike, discount * np.maximum(part(whole, n), 0.95 * np.maximum(part(sort, n), np.where(k > 0, 100.0, part(sort, sn)))))
            return np.where(longer < 1.5, near, far) * (n > 0) + SLACK

        at = np.arange(len(self.names))
        top = most(at, bag, bag)
        at, top = at[top >= threshold], top[top >= threshold]
        if len(at) and len(plain) <= 64:
            top = most(at, _common(plain, self.plain[at]), _common(ordered, self.ordered[at]))
            at, top = at[top >= threshold], top[top >= threshold]
        order = np.argsort(-top, kind="stable")
        return at[order], top[order]


class _Side:
    """Names, laid out so that some of them are bounded against as many others, pair by pair."""

    def __init__(self, names: list[str]):
        split = [words(n) for n in names]
        self.sets = [frozenset(w) for w in split]
        plain, ordered = ([" ".join(f(w)) for w in split] for f in (list, sorted))
        self.long = np.array([len(x) for x in plain], np.int64)
        self.set_long = np.array([len(" ".join(w)) for w in self.sets], np.int64)
        width = min(LAID, max(1, self.long.max(initial=1)))
        table = np.zeros(256, np.uint8)
        table[[ord(c) for c in CODES]] = list(CODES.values())
        self.plain, self.ordered = (table[np.array([x[:width].encode() for x in side], f"S{width}").view(np.uint8).reshape(-1, width)] for side in (plain, ordered))
        self.bags = np.stack([(self.plain == c).sum(axis=1) for c in CODES.values()], axis=1).astype(np.uint16)
        for i in np.flatnonzero(self.long > width):
            self.bags[i] = [plain[i].count(c) for c in CODES]
        #: A bit for each word: names without a common bit share none.
        self.bits = np.array([sum({1 << hash(x) % 63 for x in w}) for w in self.sets], np.uint64)

    def masks(self, at: np.ndarray, ordered: bool) -> np.ndarray:
        """For each of the names and each code the places, of the first 64, that have it."""
        codes, found = (self.ordered if ordered else self.plain)[at], np.zeros((len(at), len(CODES) + 1), np.uint64)
        every = np.arange(len(at))
        for k, column in enumerate(codes.T[:64]):
            found[every, column] |= np.uint64(1 << k)
        found[:, 0] = 0
        return found


def _common_of(a: _Side, i: np.ndarray, b: _Side, j: np.ndarray, ordered: bool) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs, the first of at most 64 letters, the other of as many as are laid
    out."""
    at, place = np.unique(i, return_inverse=True)
    masks, codes, long = a.masks(at, ordered), (b.ordered if ordered else b.plain), a.long[i].astype(np.uint64)
    full = np.uint64(2**64 - 1) >> (np.uint64(64) - long)
    row = full.copy()
    for k in range(int(b.long[j].max(initial=0))):
        hit = row & masks[place, codes[j, k]]
        row = (row + hit) | (row - hit)
    return a.long[i] - np.bitwise_count(row & full).astype(np.int64)


def _bounded(a: _Side, i: np.ndarray, b: _Side, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs ``i, j`` those that can have ``threshold`` or more, which is above ``INDEXED_ABOVE``, and what they have at
    most."""

    def most(at: np.ndarray, whole: np.ndarray, sort: np.ndarray, of_set: np.ndarray) -> np.ndarray:
        x, y = a.long[i[at]], b.long[j[at]]
        n = np.minimum(x, y)
        alike, sorts = (200 * np.minimum(m, n) / np.maximum(x + y, 1) for m in (whole, sort))
        part = 200 * np.minimum(whole, n) / np.maximum(n + np.minimum(whole, n), 1)
        longer = np.maximum(x, y) / np.maximum(n, 1)
        far = np.maximum(alike, np.where(longer < 8, PART_SHARE, 0.6) * part)
        return np.where(longer < 1.5, np.maximum(alike, WORD_SHARE * np.maximum(sorts, of_set)), far) * (n > 0) + SLACK

    def set_of(at: np.ndarray, m: np.ndarray) -> np.ndarray:
        x, y = a.set_long[i[at]], b.set_long[j[at]]
        return 200 * np.minimum(m, np.minimum(x, y)) / np.maximum(x + y, 1)

    def inside(at: np.ndarray) -> np.ndarray:
        """What names that share words come to by these; 0 where they share none."""
        found = np.zeros(len(at))
        for k, (p, q) in enumerate(zip(i[at].tolist(), j[at].tolist(), strict=True)):
            if both := a.sets[p] & b.sets[q]:
                o = sum(map(len, both)) + len(both) - 1
                least = min(a.set_long[p], b.set_long[q])
                found[k] = 100.0 if len(both) in (len(a.sets[p]), len(b.sets[q])) else 200 * o / (o + least)
        return found

    every = np.arange(len(i))
    bag = np.minimum(a.bags[i], b.bags[j]).sum(axis=1, dtype=np.int64)
    n = np.minimum(a.long[i], b.long[j])
    near = np.maximum(a.long[i], b.long[j]) < 1.5 * n
    sharing = np.flatnonzero(near & ((a.bits[i] & b.bits[j]) != 0))
    shared = np.zeros(len(i))
    shared[sharing] = inside(sharing)
    of_bag = set_of(every, bag)
    top = most(every, bag, bag, np.maximum(shared, of_bag))
    at = np.flatnonzero(top >= threshold)
    top = top[at]
    laid = np.flatnonzero((a.long[i[at]] <= 64) & (b.long[j[at]] <= LAID))
    if len(laid):
        some = at[laid]
        whole, sort = (_common_of(a, i[some], b, j[some], ordered) for ordered in (False, True))
        of_set = np.where(shared[some] > 0, np.maximum(shared[some], of_bag[some]), set_of(some, sort))
        top[laid] = most(some, whole, sort, of_set)
    keep = top >= threshold
    return at[keep], top[keep]


def edits(n: int, share: float) -> int:
    """By how many bigrams, at most, a name of ``n`` letters can differ from one that it has ``share`` in common with: two
    for each letter that it alone has, one for each that the other one has."""
    most, loss = 0, 1 - share + SLACK / 100
    for mine in range(n + 1):
        others = math.floor((loss * 2 * n - (1 + loss) * mine) / (1 - loss))
        if others >= 0:
            most = max(most, 2 * mine + others)
    return most


def bigrams(text: str) -> list[tuple[str, int]]:
    """Two letters and how often they have come before, for each place."""
    seen: Counter = Counter()
    out = []
    for g in map("".join, zip(text, text[1:], strict=False)):
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def reach(n: int, share: float) -> int:
    """How many letters, at most, a name of ``n`` and one that it has ``share`` in common with have alone, both together."""
    loss = 1 - share + SLACK / 100
    return math.floor(2 * n * loss / (1 - loss))


def fits(n: int, other: int, share: float) -> bool:
    """Whether names of so many letters can have ``share`` in common."""
    return abs(n - other) <= (1 - share + SLACK / 100) * (n + other)


@lru_cache(None)
def pieces(n: int, share: float) -> list[tuple[int, int]]:
    """Start and end of as many pieces of a name of ``n`` letters that one is left whole in all that it has ``share`` in
    common with: a letter that one of them has alone is in one piece at most."""
    k = reach(n, share) + 1
    return [(i * n // k, (i + 1) * n // k) for i in range(k)]


def runs(w: list[str], n: int, share: float, rare: Callable) -> set[str]:
    """As many runs of equal length, the longest that there are so many of, in words that come to ``n`` letters, the rarest
    ones first: as with ``pieces`` one is left whole, in a word, in whatever order the words are."""
    k = reach(n, share) + 1
    q = next((q for q in range(max(map(len, w)), 1, -1) if sum(len(x) // q for x in w) >= k), 1)
    every = [x[at : at + q] for x in w for at in range(0, len(x) - q + 1, q)]
    return set(sorted(every, key=rare)[:k])


class Shape(NamedTuple):
    """What of a name decides which keys meet it: its letters, those of its distinct words, and the lengths of its runs."""

    n: int
    distinct: int
    run: int
    distinct_run: int


#: Runs are looked for in names of so many lengths at once.
SPAN = 4


def shape_of(name: str, threshold: float) -> Shape | None:
    w = words(name)
    if not w:
        return None
    distinct, share = list(dict.fromkeys(w)), threshold / 100 / WORD_SHARE
    sizes = [len(" ".join(x)) for x in (w, distinct)]
    if share > 1:
        return Shape(*sizes, 0, 0)
    return Shape(*sizes, *(len(next(iter(runs(x, n, share, len)))) for x, n in zip((w, distinct), sizes, strict=True)))


def near_keys(name: str, others: set[int]) -> tuple[set[str], set[str]]:
    """Keys under which ``name`` looks for others, of ``others`` letters, that are a letter apart at most, and under which
    others find it."""
    plain = " ".join(words(name))
    n = len(plain)
    less = {plain[:i] + plain[i + 1 :] for i in range(n)} if n - 1 in others else set()
    if not plain:
        return set(), set()
    return {f"-{x}" for x in less} | {f"-{plain}", f"+{plain}"}, {f"+{x}" for x in less} | {f"-{plain}"}


def keys_of(name: str, threshold: float, grams: dict[str, int], common: dict[str, int], others: Iterable[Shape] | None = None) -> dict[str, tuple[set[str], set[str]]]:
    """Keys under which ``name`` looks for others and those under which others find it, by the way in which two names can
    reach the weighted score ``threshold``. ``grams`` and ``common`` say how frequent bigrams and frequent words are, and
    ``others`` which shapes the other names have (any, if not given): keys for others are left out.

    * Alike letter by letter (``p``): then one of the other's ``pieces`` is in both, at about the same place.
    * Alike word by word (``w``), words being in any order: then one of the other's ``runs`` is in a word of both.
    * Most of one name's letters are in words that the other has, too (``t``): then it has one of a few words of which the
      others come to less.
    * One is (but for a letter, if long) a part of a longer one (``f``): then that has it, or one of a few of its bigrams.
    """
    w = words(name)
    plain, share, word_share, part_share = " ".join(w), threshold / 100, threshold / 100 / WORD_SHARE, threshold / 100 / PART_SHARE
    if not w:
        return {}
    n, distinct = len(plain), list(dict.fromkeys(w))
    sizes = {n, len(" ".join(distinct))}
    longs = range(1, 2 * n + 1) if others is None else {x.n for x in others}
    rare = lambda g: (grams.get(g[0], 0), g)
    found: dict[str, tuple[set[str], set[str]]] = {}
    mine = {f"{n}:{i}:{plain[x:y]}" for i, (x, y) in enumerate(pieces(n, share))} if any(fits(n, m, share) for m in longs) else set()
    probe = set()
    for m in longs:
        if fits(n, m, share):
            most = math.floor((1 - share + SLACK / 100) * (n + m))
            for i, (x, y) in enumerate(pieces(m, share)):
                # Letters alone before the piece move it, and those behind it make up for the lengths.
                for at in range(max(0, x - (most - n + m) // 2), min(n - y + x, x + (most + n - m) // 2) + 1):
                    probe.add(f"{m}:{i}:{plain[at : at + y - x]}")
    found["p"] = (probe, mine)
    if word_share <= 1:
        shapes = None if others is None else {(m, q) for x in others for m, q in ((x.n, x.run), (x.distinct, x.distinct_run)) if any(fits(k, m, word_share) for k in sizes)}
        in_words = lambda q: {x[at : at + q] for x in distinct for at in range(len(x) - q + 1)}
        if shapes is None:
            shapes = {(m, q) for m in range(1, 2 * n + 1) if any(fits(k, m, word_share) for k in sizes) for q in range(1, max(map(len, w)) + 1)}
        probe = {f"{m}:{x}" for m, q in {(m // SPAN, q) for m, q in shapes} for x in in_words(q)}
        rarest = lambda g: (min((grams.get(x + y, 0) for x, y in zip(g, g[1:], strict=False)), default=0), g)
        mine = {f"{m // SPAN}:{x}" for some, m in ((w, n), (distinct, len(" ".join(distinct)))) for x in runs(some, m, word_share, rarest)} if shapes else set()
        found["w"] = (probe, mine)
        distinct = sorted(distinct, key=lambda x: (common.get(x, 0), -len(x), x))
        left, probe = sum(map(len, distinct)) + len(distinct) - 1, set()
        needed = left * word_share / (2 - word_share) - SLACK
        for x in distinct:
            if left < needed:
                break
            probe.add(x)
            left -= len(x) + 1
        found["t"] = (probe, set(distinct))
    if part_share <= 1:
        most = edits(n, part_share) if n > 1 else 1
        longer, shorter = (any(2 * m >= 3 * n for m in longs) if others is not None else True), [m for m in longs if 2 * n >= 3 * m]
        inner = {f"={plain}"} if not most else {g for g, _ in sorted(bigrams(plain), key=rare)[: most + 1]} or {plain[0]}
        whole = {f"={plain[at : at + m]}" for m in shorter if m > 1 and not edits(m, part_share) for at in range(n - m + 1)}
        if any(m < 2 or edits(m, part_share) for m in shorter):
            whole |= {*map("".join, zip(plain, plain[1:], strict=False)), *(plain if n < 9 else set(plain))}
        found["f"] = (inner if longer else set(), whole)
    return found


def _frequencies(*sides: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """How many times each bigram is in names, and in how many names each frequent word is. There are no more than 40 x 40
    bigrams of letters, and no more frequent words than five hundred times what a name has of them."""
    every = sides[0].toDF("name")
    for side in sides[1:]:
        every = every.unionByName(side.toDF("name"))
    text = F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " "))
    split = every.select(F.split(text, " ").alias("w"), text.alias("t"))
    n = max(split.count() // 500, 100)
    pairs = split.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - 1, F.lit(1))), lambda i: F.substring("t", i, F.lit(2)))).alias("g"))
    frequent = split.select(F.explode(F.array_distinct("w")).alias("x")).groupBy("x").count().where(F.col("count") > n)
    return dict(map(tuple, pairs.groupBy("g").count().collect())), dict(map(tuple, frequent.collect()))


def _shapes(names: DataFrame, threshold: float) -> set[Shape]:
    """Which shapes names have, of which there are few."""

    def run(parts: Iterator[pd.DataFrame]):
        for part in parts:
            yield pd.DataFrame(list({x for name in part["name"] if (x := shape_of(name, threshold))}), columns=Shape._fields)

    return {Shape(*r) for r in names.toDF("name").mapInPandas(run, ", ".join(f"{x} int" for x in Shape._fields)).distinct().collect()}


def _posted(names: DataFrame, keys: Callable[[str], dict[str, tuple[set[str], set[str]]]], left: bool) -> DataFrame:
    """``key, name`` of each list that a name is in; on the left it looks where the right is found, and the other way round
    where the keys of a kind do not hold for all names that are found."""

    def run(parts: Iterator[pd.DataFrame]):
        for whole in parts:
            for at in range(0, len(whole), 1000):
                out = [(f"{kind}{way}{key}", name) for name in whole["name"][at : at + 1000] for kind, sides in keys(name).items() for way in ("<>" if kind in "tf" else "<") for key in sides[(way == ">") == left]]
                yield pd.DataFrame(out, columns=["key", "name"])

    return names.toDF("name").mapInPandas(run, "key string, name string").select(F.xxhash64("key").alias("key"), "name")


#: A name, others, the places of those that can reach the threshold with it, and what they have at most, highest first.
Candidates = Iterator[tuple[str, list[str], np.ndarray, np.ndarray]]


def _blocks(left: DataFrame, right: DataFrame, threshold: float, scorer: str, run: Callable[[Candidates], pd.DataFrame], schema: str, half: bool) -> DataFrame:
    """``run`` on every pair of blocks of ``name`` and ``found``; with ``half``, where both are the same names, each once."""
    n, m = (-(-max(x.count(), 1) // BLOCK) for x in (left, right))
    dealt = lambda x, n, out: x.withColumn(out, F.pmod(F.xxhash64(x.columns[0]), F.lit(n)).cast("int"))
    every = lambda n, at: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(at)
    a, b = dealt(left, n, "_i").select("*", every(m, "_j")), dealt(right, m, "_j").select("*", every(n, "_i"))
    if half:
        a, b = a.where("_i <= _j"), b.where("_i <= _j")

    def met(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        block = Block(y["found"].tolist(), scorer)
        return run((name, block.names, *block.bounded(name, threshold)) for name in x["name"])

    tasks = min(n * m, TASKS_A_CORE * left.sparkSession.sparkContext.defaultParallelism)
    a, b = (x.repartition(tasks, "_i", "_j") for x in (a, b))
    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInPandas(met, schema)


def _in_lists(x: pd.DataFrame, y: pd.DataFrame, threshold: float, half: bool) -> Candidates:
    """Candidates from the lists of ``x`` (``key, name``) and ``y`` (``key, found``); with ``half`` each pair once."""
    if not len(x) or not len(y):
        return
    (i, names), (j, others) = pd.factorize(x["name"]), pd.factorize(y["found"])
    names, others = names.tolist(), others.tolist()
    a, b = _Side(names), _Side(others)
    if half:
        place = {name: k for k, name in enumerate(sorted({*names, *others}))}
        first, second = (np.array([place[name] for name in side]) for side in (names, others))
    order = np.argsort(y["key"].to_numpy(), kind="stable")
    keys, starts, many = np.unique(y["key"].to_numpy()[order], return_index=True, return_counts=True)
    j = j[order]
    at = np.minimum(np.searchsorted(keys, x["key"].to_numpy()), len(keys) - 1)
    hit = keys[at] == x["key"].to_numpy()
    rows = np.argsort(i[hit], kind="stable")  # by name, so that a name is seldom in two steps
    i, starts, many = i[hit][rows], starts[at[hit]][rows], many[at[hit]][rows]
    total = np.cumsum(many)
    here = 0
    while here < len(i):
        to = max(here + 1, int(np.searchsorted(total, (total[here - 1] if here else 0) + CELLS, "right")))
        m = many[here:to]
        place = np.repeat(starts[here:to] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
        pair = np.unique(np.repeat(i[here:to], m) * len(others) + j[place])
        here = to
        p, q = pair // len(others), pair % len(others)
        if half:
            once = first[p] < second[q]
            p, q = p[once], q[once]
        for low in range(0, len(p), STEP):
            some, top = _bounded(a, p[low : low + STEP], b, q[low : low + STEP], threshold)
            p_some, q_some = p[low + some], q[low + some]
            order = np.lexsort((-top, p_some))
            p_some, q_some, top = p_some[order], q_some[order], top[order]
            for k in np.split(np.arange(len(order)), np.flatnonzero(np.diff(p_some)) + 1) if len(order) else ():
                yield names[p_some[k[0]]], others, q_some[k], top[k]


def _listed(left: DataFrame, right: DataFrame, keys: tuple[Callable, Callable], threshold: float, scorer: str, run: Callable, schema: str, half: bool = False) -> DataFrame:
    """``run`` on what meets in the lists that ``keys`` of either side's names make."""
    a, b = settled(_posted(left, keys[0], True)), settled(_posted(right, keys[1], False).withColumnRenamed("name", "found"))
    count = lambda x, n: x.groupBy("key").agg(F.count("*").alias(n), F.max(F.xxhash64(x.columns[1])).alias(f"_{n}"))
    sizes = count(a, "n").join(shuffled(count(b, "m")), "key").withColumn("pairs", F.col("n") * F.col("m"))
    if half:  # a name alone with itself
        sizes = sizes.where("pairs > 1 or _n <> _m")
    sizes = settled(sizes.select("key", "pairs", (F.col("n") + F.col("m")).alias("rows")))
    lists, dense = sizes.where(F.col("pairs") <= LIST_PAIRS), sizes.where(F.col("pairs") > LIST_PAIRS).select("key")
    work = lists.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    tasks = TASKS_A_CORE * left.sparkSession.sparkContext.defaultParallelism
    slots = max(work[0] // TASK_PAIRS, work[1] // TASK_ROWS, tasks)
    slot = lists.select("key", F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int").alias("slot"))
    x, y = (side.join(shuffled(slot), "key").select(F.col("slot").alias(at), "key", side.columns[1]).repartition(tasks, at) for side, at in ((a, "here"), (b, "there")))
    found = x.groupBy("here").cogroup(y.groupBy("there")).applyInPandas(lambda x, y: run(_in_lists(x, y, threshold, half)), schema)
    crowd = [settled(x.join(shuffled(dense), "key", "left_semi").select(x.columns[1]).distinct()) for x in (a, b)] if not dense.isEmpty() else []
    if not crowd or crowd[0].isEmpty() or crowd[1].isEmpty():
        return found
    if half:  # names look for and are found under other keys, but both meet both
        every = settled(crowd[0].toDF("name").unionByName(crowd[1].toDF("name")).distinct())
        crowd = [every, every.toDF("found")]
    return found.unionByName(_blocks(crowd[0], crowd[1], threshold, scorer, run, schema, half))


def _few(left: DataFrame, right: DataFrame, threshold: float, scorer: str) -> bool:
    """Whether names meet in blocks at once."""
    return scorer != "weighted" or threshold <= INDEXED_ABOVE or left.count() * right.count() <= FEW_PAIRS


def _compared(left: DataFrame, right: DataFrame, threshold: float, scorer: str, run: Callable, schema: str, half: bool = False) -> DataFrame:
    """``run`` on candidates among names (of ``left``, column ``name``) and others (of ``right``, column ``found``) that have
    each pair that can reach the threshold."""
    if _few(left, right, threshold, scorer):
        return _blocks(left, right, threshold, scorer, run, schema, half)
    grams, common = _frequencies(left, right)
    shapes = [_shapes(left, threshold)]
    shapes.append(shapes[0] if half else _shapes(right, threshold))
    keys = tuple(lambda name, others=others: keys_of(name, threshold, grams, common, others) for others in reversed(shapes))
    return _listed(left, right, keys, threshold, scorer, run, schema, half)


def _beyond_a_letter(n: int) -> float:
    """What a name of ``n`` letters scores at most with one that is more than a letter apart: as one with two letters more,
    or by its words."""
    return max(100 * (1 - 2 / (2 * n + 2)), 100 * WORD_SHARE) + SLACK


def nearest(names: DataFrame, known: DataFrame, threshold: float, scorer: str = "weighted") -> DataFrame:
    """``name, found, score``: for each of the distinct ``names`` (one column) the most similar of the distinct ``known``,
    the smallest of several, where it has ``threshold`` or more."""
    schema = "name string, found string, score double"

    def run(candidates: Candidates) -> pd.DataFrame:
        best: dict[str, tuple[float, str]] = {}
        for name, others, at, tops in candidates:
            now = best.get(name, (-threshold, ""))
            for i, top in zip(at.tolist(), tops.tolist(), strict=True):
                if top < -now[0]:
                    break
                score = round(SCORERS[scorer](name, others[i]), 4)
                if score >= threshold and (not now[1] or (-score, others[i]) < now):
                    now = (-score, others[i])
            if now[1]:
                best[name] = now
        return pd.DataFrame([(n, f, -s) for n, (s, f) in best.items()], columns=["name", "found", "score"])

    def best_of(met: DataFrame) -> DataFrame:
        # Of equal scores the smallest name, so not max_by alone.
        return met.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "found")).alias("b")).select("name", "b.found", (-F.col("b.s")).alias("score"))

    left, right = settled(spread(names.toDF("name").dropna())), settled(spread(known.toDF("found").dropna()))
    if _few(left, right, threshold, scorer):
        return best_of(_blocks(left, right, threshold, scorer, run, schema, False))
    longs = [{x.n for x in _shapes(side, threshold)} for side in (left, right)]
    keys = tuple(lambda name, others=others: {"n": near_keys(name, others)} for others in reversed(longs))
    first = best_of(_listed(left, right, keys, threshold, scorer, run, schema))
    enough = F.udf(lambda name, score: score > _beyond_a_letter(len(" ".join(words(name)))), "boolean")
    first = settled(first.where(enough("name", "score")))
    rest = settled(left.join(shuffled(first.select("name")), "name", "left_anti"))
    return first.unionByName(best_of(_compared(rest, right, threshold, scorer, run, schema)))


def links(names: DataFrame, threshold: float, scorer: str = "weighted") -> DataFrame:
    """``a, b``: similar pairs of the distinct ``names`` (one column) that join the same names as all similar pairs do.

    Each task gives a forest, so that many names that are alike give a row each.
    """

    def run(candidates: Candidates) -> pd.DataFrame:
        found, root = [], {}

        def top(x: str) -> str:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for name, others, at, _ in candidates:
            for i in at.tolist():
                here, there = top(name), top(others[i])
                if here != there and round(SCORERS[scorer](name, others[i]), 4) >= threshold:
                    root[there] = here
                    found.append((name, others[i]))
        return pd.DataFrame(found, columns=["a", "b"])

    left = settled(spread(names.toDF("name").dropna()))
    return _compared(left, left.toDF("found"), threshold, scorer, run, "a string, b string", True)
