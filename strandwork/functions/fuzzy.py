"""Similarity of names by longest common subsequences, as Arrow UDFs over candidate pairs.

Scores run from 0 to 100. ``ratio`` counts what two strings share in order; the token forms sort words or set shared
words apart; ``weighted_ratio`` takes the best of them with discounts for the looser ones.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _masks(a: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def common_subsequence(a: str, b: str, masks: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, by bit-parallel rows; ``masks`` of ``a`` serve for many ``b``."""
    if not a or not b:
        return 0
    masks = masks or _masks(a)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit) | (row - hit)
        row &= full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 * 2 * common_subsequence(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string against windows of its length in the longer one."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    n, masks = len(a), _masks(a)
    windows = {b[max(0, i) : i + n] for i in range(1 - n, len(b))}
    return max(100.0 * 2 * common_subsequence(a, w, masks) / (n + len(w)) for w in windows)


def words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(words(a))), " ".join(sorted(words(b))))


def token_set_ratio(a: str, b: str, score=ratio) -> float:
    x, y = set(words(a)), set(words(b))
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(score(both, one) if both else 0.0, score(both, two) if both else 0.0, score(one, two))


def weighted_ratio(a: str, b: str) -> float:
    """Plain ratio and token forms at 95 %; for strings of unlike lengths also their best parts, discounted further."""
    a, b = " ".join(words(a)), " ".join(words(b))
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(ratio(a, b), 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    discount = 0.9 if longer < 8 else 0.6
    tokens = max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), token_set_ratio(a, b, partial_ratio))
    return max(ratio(a, b), discount * partial_ratio(a, b), 0.95 * discount * tokens)


SCORERS = {"ratio": ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "weighted": weighted_ratio}


def similarity(a: Column, b: Column, scorer: str = "weighted") -> Column:
    score = SCORERS[scorer]

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else round(score(p, q), 4) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)
