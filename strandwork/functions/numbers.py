"""Numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_confidence(strength: Column, impact: Column) -> Column:
    """Geometric mean of the two, negatives as zero."""
    zero = F.lit(0.0)
    return F.sqrt(F.greatest(zero, strength) * F.greatest(zero, impact))


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def heat_colour(heat: Column, cold: tuple[int, int, int] = (40, 80, 160), hot: tuple[int, int, int] = (230, 60, 40)) -> Column:
    """A colour between cold and hot as ``#RRGGBB``."""
    part = lambda a, b: F.lpad(F.hex(F.floor(a + (b - a) * clamped(heat) + 0.5)), 2, "0")
    return F.concat(F.lit("#"), *[part(a, b) for a, b in zip(cold, hot, strict=True)])


def level(confidence: Column) -> Column:
    return F.when(confidence < 0.5, "low").when(confidence < 0.8, "mid").otherwise("high")


def backoff(attempt: Column, base: float = 1.5, most: float = 30.0) -> Column:
    """Seconds before the given attempt, without jitter."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))
