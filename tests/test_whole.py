"""Whole results: operators against brute force on fixtures that a cut would show."""

from __future__ import annotations

import os
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.functions import fuzzy
from strandwork.operators.layout import layout, placed
from strandwork.operators.resolver import exact, learned, resolved
from strandwork.operators.similar import Block, keys_of, nearest
from strandwork.plans import ranking
from strandwork.plans.registry import QUERIES


def test_bounds_hold():
    rng = random.Random(5)
    stock = ["acme", "robotics", "inc", "nvidia", "nvdia", "a", "group", "the", "the", "supplier", "000001", "0000001", "x" * 70, "öl", "&"]
    names = ["", "#", *(" ".join(rng.choices(stock, k=rng.randint(1, 5))) for _ in range(150))]
    block = Block(names, "weighted")
    for name in names:
        for threshold in (60.0, 88.0):
            rows, tops = block.bounded(name, threshold)
            most = dict(zip(rows.tolist(), tops.tolist(), strict=True))
            for i, other in enumerate(names):
                score = fuzzy.weighted_ratio(name, other)
                assert score < threshold or most[i] >= round(score, 4)


def misspelt(rng, name):
    letters = list(name)
    for _ in range(rng.randint(0, 4)):
        k = rng.randrange(len(letters) + 1)
        letters[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "0", " ", "xy"])
    return "".join(letters)


@pytest.mark.parametrize("threshold", [86.0, 88.0, 93.0, 97.0])
def test_index_has_every_similar_pair(threshold):
    """Names that reach the threshold share a key, whatever is said of how frequent bigrams and words are."""
    rng = random.Random(threshold)
    stock = ["acme", "robotics", "inc", "nvidia", "a", "b", "the", "the", "supplier", "000001", "x" * 30, "international business machines", "ab"]
    names = [" ".join(rng.choices(stock, k=rng.randint(1, 5))) for _ in range(25)]
    names = sorted({*names, *(misspelt(rng, n) for n in names for _ in range(2)), *(n[: rng.randint(1, len(n))] for n in names), "", "#"})
    grams = {g: rng.randrange(50) for n in names for g in map("".join, zip(n, n[1:], strict=False))}
    keys = {n: keys_of(n, threshold, grams, {"the": 90, "acme": 30}) for n in names}
    found = 0
    for a in names:
        for b in names:
            if round(fuzzy.weighted_ratio(a, b), 4) >= threshold:
                found += 1
                assert any(keys[a][k][0] & keys[b][k][1] or keys[a][k][1] & keys[b][k][0] for k in keys[a]), (a, b)
    assert found > 80


@pytest.mark.parametrize(("scorer", "list_pairs"), [("weighted", 1 << 22), ("weighted", 500), ("token_set", 0)])
def test_resolver_compares_all_pairs(spark, monkeypatch, scorer, list_pairs):
    """Typos in the first letters, and more than 200 names with one word, over several blocks and lists."""
    monkeypatch.setattr("strandwork.operators.similar.BLOCK", 90)
    monkeypatch.setattr("strandwork.operators.similar.LIST_PAIRS", list_pairs)
    monkeypatch.setattr("strandwork.operators.similar.FEW_PAIRS", 0)
    entities = [(i, f"Supplier#{i:09d}") for i in range(1, 231)] + [(900, "Nvidia"), (901, "Boston Dynamics"), (902, "Nvidia")]
    said = ["Nvdia", "Supplier#00000001", "Suppplier#000000007", "Bsoton Dynamics", "Figrue AI", "Figure AI", "iFgure AI", "Unlike All", "nvidia"]
    rows = resolved(spark.createDataFrame([(m, m) for m in said], "mention string, resolved string"), spark.createDataFrame(entities, "entity_id long, name string"), spark.createDataFrame([], "alias string, entity_id long"), scorer=scorer).collect()
    score = lambda a, b: round(fuzzy.SCORERS[scorer](a, b), 4)
    best = {m: min((-score(m, n), n, e) for e, n in entities) for m in said}
    got = {r["mention"]: (r["tier"], r["entity_id"], r["matched_name"]) for r in rows}
    assert len(rows) == len(said) and got.pop("nvidia") == (1, 900, "Nvidia")
    near = {m: (2, b[2], b[1]) for m, b in best.items() if m in got and -b[0] >= 88}
    fresh = [m for m in got if m not in near]
    root = {m: m for m in fresh}
    for a in fresh:
        for b in fresh:
            if score(a, b) >= 88:
                root = {m: min(root[a], root[b]) if r in (root[a], root[b]) else r for m, r in root.items()}
    assert got == near | {m: (3, None, r) for m, r in root.items()}
    assert scorer != "weighted" or near["Nvdia"] == (2, 900, "Nvidia")


def test_unlike_names_seldom_meet():
    """Names without a rare word or bigram to tell them by, as hashes are, do not meet all the others; being equally long,
    none is a part of another (``f``)."""
    rng = random.Random(9)
    names = [" ".join("".join(rng.choices("0123456789abcdef", k=12)) for _ in range(2)) for _ in range(400)]
    grams = Counter(g for n in names for g in map("".join, zip(n, n[1:], strict=False)))
    found, pairs = {}, set()
    keys = {n: {k: v for k, v in keys_of(n, 88.0, grams, {}).items() if k != "f"} for n in names}
    for n, kinds in keys.items():
        for kind, (_, mine) in kinds.items():
            for key in mine:
                found.setdefault((kind, key), []).append(n)
    for n, kinds in keys.items():
        pairs |= {(n, m) for kind, (probe, _) in kinds.items() for key in probe for m in found.get((kind, key), ()) if m != n}
    assert len(pairs) < 0.03 * len(names) ** 2


def test_names_of_a_family_do_not_all_meet(spark, monkeypatch):
    """Names that differ in their numbers alone, looked for with a letter too many: none goes to blocks where all meet all."""
    monkeypatch.setattr("strandwork.operators.similar.LIST_PAIRS", 2000)
    monkeypatch.setattr("strandwork.operators.similar.FEW_PAIRS", -1)
    monkeypatch.setattr("strandwork.operators.similar._blocks", None)
    known = [f"Supplier#{i:09d}" for i in range(400)]
    said = {k.replace("#", "r#" if i % 2 else "#0"): k for i, k in enumerate(known)}
    rows = nearest(spark.createDataFrame([(x,) for x in said], "name string"), spark.createDataFrame([(x,) for x in known], "name string"), 88.0).collect()
    best = {x: min((-round(fuzzy.weighted_ratio(x, k), 4), k) for k in known) for x in list(said)[:40]}
    got = {r.name: (-r.score, r.found) for r in rows}
    assert got.keys() == said.keys() and all(got[x] == b for x, b in best.items())


def test_resolver_broadcasts_no_names(spark):
    """What is known by name goes to the executors by shuffles; its files are small where it is not."""
    entities = spark.range(50).select(F.col("id").alias("entity_id"), F.concat(F.lit("Name "), F.col("id").cast("string")).alias("name"))
    mentions = entities.select(F.col("name").alias("mention"), F.concat("name", F.lit("q")).alias("resolved"))
    aliases = entities.select(F.col("name").alias("alias"), "entity_id")
    found = resolved(mentions, entities, aliases)
    for df in (exact(mentions, entities, aliases), found, learned(found, aliases)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_layout_places_every_node(spark):
    """Over 600 nodes in a group, and one without an edge."""
    edges = [("a", i, i + 1) for i in range(700)] + [("b", 1, 2)]
    nodes = [("a", i) for i in range(701)] + [("a", 5000), ("b", 1), ("b", 2)]
    rows = layout(spark.createDataFrame(nodes, "g string, node long"), spark.createDataFrame(edges, "g string, a long, b long"), "g").collect()
    assert sorted((r["g"], r["node"]) for r in rows) == sorted(nodes)
    xy = placed(702, np.array([e[1:] for e in edges[:-1]]), 30, 42)
    assert np.allclose([(r["x"], r["y"]) for r in sorted(rows, key=lambda r: r["node"]) if r["g"] == "a"], xy)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no data")
def test_layout_of_the_newest_cards(spark):
    d = "/root/testdata/sf0.01"
    read = lambda name, *c: spark.read.parquet(f"{d}/{name}.parquet").select(*c).collect()
    sector = dict(read("customer", "c_custkey", "c_mktsegment"))
    orders = {}
    for key, customer, day in sorted(read("orders", "o_orderkey", "o_custkey", "o_orderdate")):
        if customer in sector:
            orders.setdefault(sector[customer], []).append((str(day)[:10], key, customer))
    newest = {key: (s, customer) for s, found in orders.items() for _, key, customer in sorted(found, reverse=True)[:200]}
    nodes = set()
    for key, supplier in read("lineitem", "l_orderkey", "l_suppkey"):
        if key in newest:
            s, customer = newest[key]
            nodes |= {(s, supplier), (s, customer + 10_000_000)}
    rows = QUERIES["m9_layout"](spark, d).collect()
    assert len(rows) == len(nodes) and {(r["sector"], r["node"]) for r in rows} == nodes
    assert max(sum(r["sector"] == s for r in rows) for s in orders) > 120


def test_painting_order_has_both_ends(spark):
    rng = random.Random(3)
    edges = [(rng.randint(1, 20), 10_000_000 + int(rng.random() ** 2 * 90), rng.randint(1, 8) / 8) for _ in range(400)]
    n, heat = Counter(), Counter()
    for a, b, confidence in edges:
        for end in (a, b):
            n[end] += 1
            heat[end] += confidence
    batch = {e: i // 15 for i, e in enumerate(sorted(n, key=lambda e: (-n[e], -heat[e], e)))}
    relationships = spark.createDataFrame(edges, "entity_a_id long, entity_b_id long, confidence double")
    rows = ranking.w4(SimpleNamespace(relationships=relationships)).collect()
    assert {r["edge_batch"]: r["n_edges"] for r in rows} == Counter(max(batch[a], batch[b]) for a, b, _ in edges)
    assert max(batch.values()) >= 3


DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
def test_whole_tables(spark):
    """Every id of the tables is in the queries, with what plain Python makes of it."""
    from strandwork.sources.graph_tables import GraphTables

    t = GraphTables(spark, DATA)
    got = lambda name: [tuple(r) for r in QUERIES[name](spark, DATA).collect()]
    name = {r[0]: r[1] for r in t.entities.select("entity_id", "name").collect()}
    events = {}
    for r in t.relationships.select("catalyst_id", "entity_a_id", "rel_type", "entity_b_id", "confidence", "l_partkey", "l_linenumber").collect():
        events.setdefault(r.catalyst_id, []).append(r)
    places, related, sets, lines = [], set(), set(), set()
    for c, edges in events.items():
        edges.sort(key=lambda r: (-r.confidence, r.rel_type, r.entity_a_id, r.entity_b_id, r.l_partkey, r.l_linenumber))
        places += [(c, r.rel_type, r.entity_a_id, i) for i, r in enumerate(edges, 1)]
        # Ids are numbers, sorted as such.
        sets.add((c, ",".join(map(str, sorted({e for r in edges for e in (r.entity_a_id, r.entity_b_id)})))))
        lines.add((c, "\n".join(f"[{i}] {x}" for i, x in enumerate(sorted({r.rel_type for r in edges})[:8], 1))))
        known = [r for r in edges if r.entity_a_id in name and r.entity_b_id in name]
        known.sort(key=lambda r: (-r.confidence, name[r.entity_a_id], r.rel_type, r.l_partkey, r.l_linenumber))
        first = {}
        for i, r in enumerate(known, 1):
            for e in (r.entity_a_id, r.entity_b_id):
                if i > 1 and e not in (known[0].entity_a_id, known[0].entity_b_id):
                    first.setdefault(name[e], i)
        related |= {(c, x, i) for x, i in sorted(first.items(), key=lambda p: (p[1], p[0]))[:4]}
    assert sorted(got("o4_edges_by_confidence_all")) == sorted(places)
    assert set(got("x2_name_sets_all")) == sets and set(got("c25_prompt_lines_all")) == lines
    assert set(got("w7_related_names_all")) == related
    assert {r[0] for r in got("u1_similar_names")} == set(name.values())
    orders = [tuple(r) for r in t.raw("orders").selectExpr("o_custkey", "unix_date(cast(o_orderdate as date))", "o_orderkey", "o_totalprice").collect()]
    mine = {}
    for c, *rest in orders:
        mine.setdefault(c, []).append(tuple(rest))
    after = lambda c, d, n: max(x for x in mine[c] if d <= x[0] <= d + n)[2]
    assert set(got("p30_track_record_all")) == {(o, *(after(c, d, n) for n in (30, 60, 90))) for c, d, o, _ in orders}
    headline = {r[0]: r[1] for r in t.catalysts.select("catalyst_id", "headline").collect()}
    price = dict(t.raw("orders").select("o_orderkey", "o_totalprice").collect())
    sure = {c for c, edges in events.items() if max(r.confidence for r in edges) >= 0.6}
    titles = {(k, headline[k] if k in sure else "A signal from the graph" if p >= 100000 else "redirect") for k, p in price.items()}
    assert {r[:2] for r in got("f23_preview_text_all")} == titles
    told = {}
    for c, edges in events.items():
        for r in edges:
            for e in (r.entity_a_id, r.entity_b_id):
                if e in name and c in headline:
                    told.setdefault(e, set()).add(headline[c])
    assert sorted(got("j14_entity_headlines_all")) == sorted((e, h) for e, found in told.items() for h in sorted(found)[:20])


def test_titles_that_may_match_are_scored(spark):
    """What expressions rule out has no score that counts, and what they take for the same has the highest."""
    from pyspark.sql import functions as F

    from strandwork.plans.handles import match_score, title_scores

    rng = random.Random(6)
    stock = ["Acme Robotics Inc", "Société Générale SA", "Boston Dynamics", "Elm2 & Co", "Cedar Robotics GmbH", "x", "", "Fir Ltd Holdings"]
    names = [n for n in stock for _ in range(3)]
    rows = [(misspelt(rng, n) if rng.random() < 0.6 else " ".join(rng.sample(n.split(), len(n.split()))), n, k) for n in names for k in range(4)]
    rows += [(a, b, 0) for a in stock for b in stock] + [(None, "x", 0), ("ACME robotics inc", "acme robotics INC", 1)]
    df = spark.createDataFrame(rows, "title string, name_key string, pos int")
    for threshold in (75.0, 90.0):
        want = Counter((r.title, r.name_key, r.s) for r in df.select("title", "name_key", match_score(F.col("title"), F.col("name_key")).alias("s")).collect() if r.s is not None and r.s >= threshold)
        got = Counter((r.title, r.name_key, r.score) for r in title_scores(df, threshold).collect() if r.score is not None and r.score >= threshold)
        assert got == want and len(want) > 10
