"""How a query is registered: a function of the graph tables, and SQL that gives the same rows elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandwork.sources.graph_tables import BASE_SQL, GraphTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(*names: str, sql: str | None = None, base: bool = True):
    """Registers ``f(tables)`` under a name, or several that it has had. ``sql``, the last of ``names`` if it is not given
    by name, may use the four graph tables (``base``) and the raw ones."""
    if sql is None and " " in names[-1]:
        *names, sql = names
    body = None
    if sql is not None:
        body = sql.strip()
        if base:
            recursive = body.upper().startswith("WITH RECURSIVE ")
            head, rest = ("WITH RECURSIVE ", body[15:]) if recursive else ("WITH ", body[5:] if body.upper().startswith("WITH ") else "")
            body = head + BASE_SQL.strip() + (",\n" + rest if rest else "\n" + body)

    def register(f: Callable[[GraphTables], DataFrame]):
        for name in names:
            if name in QUERIES:
                raise ValueError(f"{name} is registered twice")
            QUERIES[name] = lambda spark, folder: f(GraphTables(spark, folder))
            if body is not None:
                ORACLES[name] = body
        return f

    return register
