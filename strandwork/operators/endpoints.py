"""Helpers for edge lists: endpoints, names, drop reasons, visibility."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_endpoints(edges: DataFrame, once: bool = True) -> DataFrame:
    """One row per edge and endpoint (``entity_id``): an OR-join on either end becomes a hash join on one column.

    With ``once`` a self-loop gives one row, as a membership test would; without, two, as a degree count would.
    """
    ends = F.array("entity_a_id", "entity_b_id")
    return edges.withColumn("entity_id", F.explode(F.array_distinct(ends) if once else ends))


def with_names(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds ``from_name`` and ``to_name``; edges without one of the ends go."""
    a = entities.select(F.col("entity_id").alias("entity_a_id"), F.col("name").alias("from_name"))
    b = entities.select(F.col("entity_id").alias("entity_b_id"), F.col("name").alias("to_name"))
    return edges.join(a, "entity_a_id").join(b, "entity_b_id")


def visible(status: Column, show_invalidated: bool = False) -> Column:
    """Active and materialised edges, on demand invalidated ones; stale edges never."""
    return status.isin("active", "materialized", *(["invalidated"] if show_invalidated else []))


def within_days(day: Column, as_of, days: int) -> Column:
    """The trailing window of ``days`` up to ``as_of``, first day included; 0 or less: no window."""
    return F.lit(True) if days <= 0 else day >= F.date_sub(F.lit(as_of), days)


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of those conditions that are given."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def drop_reason(known_types: list[str], confidence_drop: float = 0.30) -> Column:
    """Why an extracted edge goes, first reason first: unknown type, end not among the entities, low confidence."""
    ends = F.array_contains("entities", F.col("entity_a")) & F.array_contains("entities", F.col("entity_b"))
    return (
        F.when(~F.col("rel_type").isin(known_types), "unknown_rel_type")
        .when(~ends, "endpoint_not_in_entities")
        .when(F.col("confidence") < confidence_drop, "low_confidence")
    )


def shown_handle(handle: Column, confidence: Column, least: float = 0.8) -> Column:
    """A handle unless its confidence is known to be below ``least``."""
    return F.when(confidence < least, F.lit(None)).otherwise(handle)
