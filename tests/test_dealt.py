"""Many edges, dealt to tasks by their number: the same rows, and tasks that do not grow."""

from __future__ import annotations

import os

import pytest

from strandwork.plans.registry import ORACLES, QUERIES
from strandwork.sources import graph_tables
from test_queries import DATA, multiset

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


@pytest.mark.parametrize("name", ["p22_reextracted", "u6_stated_edges", "j14_entity_headlines", "w7_related_names", "p31_primary_subject", "j13_partners", "x10_latest_extraction", "o4_edges_by_confidence", "c25_prompt_lines"])
def test_dealt(spark, monkeypatch, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    monkeypatch.setattr(graph_tables, "FEW_LINES", 0)
    monkeypatch.setattr(graph_tables, "TASK_LINES", 200)
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    df = QUERIES[name](spark, DATA)
    assert f", {-(-lines // 200)}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    columns = sorted(df.columns)
    found = con.sql(ORACLES[name])
    at = [found.columns.index(c) for c in columns]
    assert multiset([[r[c] for c in columns] for r in df.collect()]) == multiset([[r[i] for i in at] for r in found.fetchall()])
