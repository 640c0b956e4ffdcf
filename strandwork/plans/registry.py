"""All queries of the graph side with their SQL twins."""

from __future__ import annotations

from strandwork.plans import aggregates, cards, changes, filters, handles, insights, joins, pipelines, ranking, text_queries
from strandwork.plans.base import ORACLES, QUERIES

FLAGSHIP = "front_page"
MODULES = [aggregates, cards, changes, filters, handles, insights, joins, pipelines, ranking, text_queries]

__all__ = ["FLAGSHIP", "MODULES", "ORACLES", "QUERIES"]
