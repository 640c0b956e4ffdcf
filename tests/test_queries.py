"""Every query against its SQL twin on the smallest data."""

from __future__ import annotations

import os

import pytest

from strandwork.plans.registry import FLAGSHIP, ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat().removesuffix("T00:00:00")
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return round(float(value), 5)
    return value


def multiset(rows):
    return sorted(repr([plain(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [[r[c] for c in columns] for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    found = duck.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert multiset(got) == multiset([[r[i] for i in at] for r in found.fetchall()])


def test_flagship():
    assert FLAGSHIP in QUERIES and FLAGSHIP in ORACLES


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["j2_endpoint_join", "j5_missing_handles", "j6_orphans", "j13_partners", "p13_missing_handles", "p6_graph_nodes"])
def test_no_nested_loops(spark, name):
    """Joins are by key: no plan pairs all rows with all rows."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
