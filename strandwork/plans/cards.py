"""Cards, statistics and the graph that is shown."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions import text as tx
from strandwork.operators.endpoints import shown_handle, visible, with_endpoints, within_days
from strandwork.plans.aggregates import BUCKET_SQL, bucket
from strandwork.plans.base import query
from strandwork.session import settled, shared_dir
from strandwork.sources import files
from strandwork.sources.graph_tables import AS_OF, GraphTables

EDGE_ORDER = ["rel_type", "entity_a_id", "l_partkey", "l_linenumber", "ship_date"]


def card_events(t: GraphTables, sector: str, limit: int) -> DataFrame:
    """The newest events of a sector: the only rows that cards are made of, found before any join."""
    return t.catalysts.where(F.col("sector") == sector).orderBy(F.desc("ts"), F.desc("entry_id")).limit(limit)


def cards(t: GraphTables, sector: str = "BUILDING", limit: int = 200) -> DataFrame:
    """One nested card for each event: entities with handles, edges by confidence, texts to share.

    What would be three lookups per card is one pass over the edges: each meets its two ends, and one aggregate makes both
    lists of a card. Edges without one of their ends or that are not visible are in no list, but their ends are entities.
    """
    events = card_events(t, sector, limit)
    wide = t.handles.groupBy("name_key").agg(F.max(F.when(F.col("channel") == "linkedin", shown_handle(F.col("handle"), F.col("confidence")))).alias("linkedin_handle"))
    known = t.entities.withColumn("name_key", tx.name_key(F.col("name"))).join(wide, "name_key", "left")
    who = known.select("entity_id", F.struct("name", "ticker", "type", "linkedin_handle", "entity_id").alias("who"))
    edges = t.relationships.join(events.select("catalyst_id"), "catalyst_id")
    for end, to in (("entity_a_id", "a"), ("entity_b_id", "b")):
        edges = edges.join(who.toDF(end, to), end, "left")
    rank = F.struct(-F.col("confidence"), *[F.col(c) for c in EDGE_ORDER])
    edge = F.struct(F.col("a.name").alias("from"), F.col("rel_type").alias("rel"), F.col("b.name").alias("to"), "confidence", "evidence_type", "status")
    shown = visible(F.col("status")) & F.col("a").isNotNull() & F.col("b").isNotNull()
    lists = edges.groupBy("catalyst_id").agg(
        F.array_sort(F.collect_list(F.when(shown, F.struct(rank.alias("o"), edge.alias("e"))))).alias("l"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array("a", "b")))))).alias("n"),
    )
    lists = lists.select(
        "catalyst_id",
        F.transform("l", lambda x: x["e"]).alias("relationships"),
        F.transform("n", lambda x: F.struct(x["name"].alias("name"), x["ticker"].alias("ticker"), x["type"].alias("type"), x["linkedin_handle"].alias("linkedin_handle"))).alias("entities"),
    )

    top = F.get("relationships", F.lit(0))
    tickers = F.filter(F.transform("entities", lambda e: e["ticker"]), lambda x: x.isNotNull())
    joined = events.join(lists, "catalyst_id", "left")
    return joined.select(
        F.col("entry_id").alias("card_id"),
        F.when(top.isNull(), "catalyst").otherwise(bucket(top["rel"])).alias("card_type"),
        F.col("ts").alias("date"),
        "headline",
        tx.short_subtitle(F.col("sentiment_takeaways")).alias("subtitle"),
        F.coalesce("entities", F.array()).alias("entities"),
        F.coalesce("relationships", F.array()).alias("relationships"),
        F.col("sentiment_label").alias("sentiment"),
        F.round(top["confidence"], 2).alias("confidence"),
        F.round("significance_score", 2).alias("significance"),
        tx.short_post(F.col("headline"), F.coalesce(tickers, F.array().cast("array<string>"))).alias("twitter_text"),
    )


CARDS_SQL = f"""
ev AS (SELECT * FROM catalysts WHERE sector = 'BUILDING' ORDER BY ts DESC, entry_id DESC LIMIT 200),
ed AS (SELECT r.*, a.name AS from_name, b.name AS to_name, row_number() OVER (PARTITION BY r.catalyst_id ORDER BY confidence DESC, rel_type, entity_a_id, l_partkey, l_linenumber, ship_date) AS place
  FROM relationships r JOIN ev USING (catalyst_id) JOIN entities a ON a.entity_id = entity_a_id JOIN entities b ON b.entity_id = entity_b_id WHERE status IN ('active', 'materialized')),
en AS (SELECT DISTINCT r.catalyst_id, e.name, e.ticker FROM relationships r JOIN ev USING (catalyst_id) JOIN entities e ON e.entity_id IN (r.entity_a_id, r.entity_b_id))
"""


@query("front_page", f"""
WITH {CARDS_SQL.strip()}
SELECT ev.entry_id AS card_id, ts AS date, headline, CASE WHEN ed.rel_type IS NULL THEN 'catalyst' ELSE {BUCKET_SQL} END AS card_type, ed.from_name, ed.rel_type AS rel, ed.to_name, round(ed.confidence, 2) AS confidence,
       (SELECT string_agg(name, '|' ORDER BY name) FROM en WHERE en.catalyst_id = ev.catalyst_id) AS entities
FROM ev LEFT JOIN ed ON ed.catalyst_id = ev.catalyst_id AND ed.place = 1""")
def front_page(t):
    """The newest cards of a sector with their strongest edge and their entities."""
    top = F.get("relationships", F.lit(0))
    names = F.array_join(F.transform("entities", lambda e: e["name"]), "|")
    return cards(t).select("card_id", "date", "headline", "card_type", top["from"].alias("from_name"), top["rel"].alias("rel"), top["to"].alias("to_name"), "confidence", F.nullif(names, F.lit("")).alias("entities"))


@query("p4_card_details", f"""
WITH {CARDS_SQL.strip()}
SELECT entry_id AS card_id, trim(substring(string_split(sentiment_takeaways, chr(10))[1], 8)) AS subtitle, sentiment_label AS sentiment, round(significance_score, 2) AS significance,
  (SELECT count(*) FROM ed WHERE ed.catalyst_id = ev.catalyst_id) AS n_edges, (SELECT count(*) FROM en WHERE en.catalyst_id = ev.catalyst_id) AS n_entities FROM ev""")
def p4_details(t):
    return cards(t).select("card_id", "subtitle", "sentiment", "significance", F.size("relationships").cast("long").alias("n_edges"), F.size("entities").cast("long").alias("n_entities"))


@query("p5_stats", """
SELECT (SELECT count(*) FROM catalysts WHERE sector = 'BUILDING') AS total_catalysts, (SELECT count(*) FROM catalysts WHERE sector = 'BUILDING' AND ts >= DATE '2001-08-01' - 7) AS catalysts_last_7d,
 (SELECT e.name FROM relationships r JOIN catalysts c USING (catalyst_id) JOIN entities e ON e.entity_id IN (r.entity_a_id, r.entity_b_id) WHERE sector = 'BUILDING' GROUP BY e.name ORDER BY count(*) DESC, e.name LIMIT 1) AS top_chokepoint_entity,
 (SELECT rel_type FROM relationships JOIN catalysts c USING (catalyst_id) WHERE sector = 'BUILDING' AND ts >= DATE '2001-08-01' - 14 GROUP BY rel_type ORDER BY count(*) DESC, rel_type LIMIT 1) AS fastest_accelerating_relationship""")
def p5(t):
    """The four numbers above the graph. Each is a one-row aggregate; they meet by a constant key."""
    events = t.catalysts.where("sector = 'BUILDING'").select("catalyst_id", "ts")
    edges = t.relationships.select("catalyst_id", "entity_a_id", "entity_b_id", "rel_type").join(events, "catalyst_id")
    totals = events.agg(F.count("*").alias("total_catalysts"), F.count_if(within_days(F.col("ts"), AS_OF, 7)).alias("catalysts_last_7d"))
    degree = with_endpoints(edges).groupBy("entity_id").agg(F.count("*").alias("n")).join(t.entities.select("entity_id", "name"), "entity_id")
    top = degree.agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("top_chokepoint_entity"))
    rel = edges.where(within_days(F.col("ts"), AS_OF, 14)).groupBy("rel_type").agg(F.count("*").alias("n"))
    fastest = rel.agg(F.min_by("rel_type", F.struct(-F.col("n"), F.col("rel_type"))).alias("fastest_accelerating_relationship"))
    key = F.lit(1).alias("key")
    return totals.select(key, "*").join(top.select(key, "*"), "key").join(fastest.select(key, "*"), "key").drop("key")


@query("p6_graph_nodes", f"""
WITH {CARDS_SQL.strip()},
g AS (SELECT * FROM ev WHERE ts >= DATE '2001-08-01' - 90), e2 AS (SELECT ed.* FROM ed JOIN g USING (catalyst_id)),
h AS (SELECT from_name AS name, confidence FROM e2 UNION ALL SELECT to_name, confidence FROM e2),
n AS (SELECT DISTINCT en.name FROM en JOIN g USING (catalyst_id)),
s AS (SELECT n.name, coalesce(sum(confidence), 0) AS heat, count(confidence) AS edge_count FROM n LEFT JOIN h USING (name) GROUP BY n.name)
SELECT name, edge_count, round(heat / (SELECT CASE WHEN max(heat) > 0 THEN max(heat) ELSE 1.0 END FROM s), 3) AS heat FROM s""")
def p6(t):
    """Nodes of the graph: all entities of the cards in the window, also those without a visible edge."""
    window = cards(t).where(within_days(F.col("date"), AS_OF, 90)).select("entities", "relationships")
    names = window.select(F.explode("entities").alias("e")).select("e.name").distinct()
    ends = window.select(F.explode("relationships").alias("r")).select(F.explode(F.array("r.from", "r.to")).alias("name"), "r.confidence")
    heat = ends.groupBy("name").agg(F.sum("confidence").alias("heat"), F.count("*").alias("edge_count"))
    nodes = names.join(heat, "name", "left").select("name", F.coalesce("heat", F.lit(0.0)).alias("heat"), F.coalesce("edge_count", F.lit(0).cast("long")).alias("edge_count"))
    top = F.max("heat").over(Window.partitionBy(F.lit(1)))  # over the nodes of so many cards as are drawn, not over a table
    return nodes.select("name", "edge_count", F.round(F.col("heat") / F.when(top > 0, top).otherwise(1.0), 3).alias("heat"))


@query("p6_graph_edges", f"""
WITH {CARDS_SQL.strip()}
SELECT from_name, to_name, rel_type AS rel, evidence_type, status, round(confidence, 4) AS confidence, ev.entry_id AS card_id FROM ed JOIN ev USING (catalyst_id) WHERE ts >= DATE '2001-08-01' - 90""")
def p6e(t):
    window = cards(t).where(within_days(F.col("date"), AS_OF, 90))
    r = window.select("card_id", F.explode("relationships").alias("r"))
    return r.select(F.col("r.from").alias("from_name"), F.col("r.to").alias("to_name"), "r.rel", "r.evidence_type", "r.status", F.round("r.confidence", 4).alias("confidence"), "card_id")


@query("k7_teaser", "SELECT entry_id AS card_id, headline FROM catalysts WHERE sector = 'BUILDING' ORDER BY ts DESC, entry_id DESC LIMIT 4")
def k7(t):
    return cards(t, limit=4).select("card_id", "headline")


@query("s12_sector_payloads", """
WITH r AS (SELECT sector, entry_id, row_number() OVER (PARTITION BY sector ORDER BY ts DESC, entry_id DESC) AS place FROM catalysts)
SELECT sector, string_agg(entry_id, ',' ORDER BY place) AS cards FROM r WHERE place <= 5 GROUP BY sector""")
def s12(t):
    """The newest cards of every sector, one document each."""
    place = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("ts"), F.desc("entry_id")))
    few = t.catalysts.select("sector", "entry_id", place.alias("place")).where("place <= 5")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "entry_id"))), lambda x: x["entry_id"])
    return few.groupBy("sector").agg(F.array_join(ids, ",").alias("cards"))


@query("p24_shown_elements", """
WITH e AS (SELECT r.catalyst_id, least(entity_a_id, entity_b_id) AS lo, greatest(entity_a_id, entity_b_id) AS hi FROM relationships r JOIN catalysts c USING (catalyst_id)
  WHERE status <> 'invalidated' AND confidence >= 0.5 AND ts >= DATE '2001-08-01' - 30)
SELECT lo, hi, count(*) AS n_parallel, (count(*) - 1) / 2.0 * 40 AS widest FROM e GROUP BY lo, hi""")
def p24(t):
    """Edges that a reader sees, bundled by pair with the width of their fan."""
    recent = t.catalysts.where(within_days(F.col("ts"), AS_OF, 30)).select("catalyst_id")
    edges = t.relationships.where("status <> 'invalidated' and confidence >= 0.5").join(recent, "catalyst_id")
    pairs = edges.groupBy(F.least("entity_a_id", "entity_b_id").alias("lo"), F.greatest("entity_a_id", "entity_b_id").alias("hi")).agg(F.count("*").alias("n_parallel"))
    return pairs.withColumn("widest", (F.col("n_parallel") - 1) / F.lit(2.0) * 40)


def payload(t: GraphTables, sector: str = "BUILDING", limit: int = 200) -> DataFrame:
    """The versioned document of a sector: cards and edges as JSON, one row."""
    made = cards(t, sector, limit)
    return made.agg(F.lit(1).alias("schema_version"), F.lit(sector).alias("sector"), F.to_json(F.array_sort(F.collect_list(F.struct("card_id", "headline", "card_type", "relationships")))).alias("cards"))


@query("k1_payload", f"""
WITH {CARDS_SQL.strip()}
SELECT 1 AS schema_version, 'BUILDING' AS sector, string_agg(concat(ev.entry_id, '=', headline, '=', (SELECT count(*) FROM ed WHERE ed.catalyst_id = ev.catalyst_id)), ';' ORDER BY ev.entry_id) AS cards FROM ev""")
def k1(t):
    """The document, read back: its cards with their headlines and numbers of edges."""
    read = F.from_json("cards", "array<struct<card_id: string, headline: string, relationships: array<struct<rel: string>>>>")
    line = F.transform(read, lambda c: F.concat_ws("=", c["card_id"], c["headline"], F.size(c["relationships"]).cast("string")))
    return payload(t).select("schema_version", "sector", F.array_join(line, ";").alias("cards"))


@query("k1_versioned_payload", f"""
WITH {CARDS_SQL.strip()}
SELECT 'v00000002' AS version, 50 AS after_failure, ev.entry_id AS card_id, headline, (SELECT string_agg(concat(from_name, '|', rel_type, '|', to_name, '|', evidence_type, '|', status), ';' ORDER BY place) FROM ed WHERE ed.catalyst_id = ev.catalyst_id) AS edges FROM ev""")
def k1_versioned(t):
    """A document of cards with their edges, a first version, a write that fails in one of its tasks, and a second version:
    what readers see after the failure, and the whole last version."""
    place = f"{shared_dir(t.spark).rstrip('/')}/payload-{uuid.uuid4().hex}"
    files.register(t.spark)
    made = settled(cards(t).select(F.to_json(F.struct("card_id", "headline", "card_type", "relationships")).alias("value"), F.row_number().over(Window.orderBy(F.desc("date"), F.desc("card_id"))).alias("nth")))
    write = lambda rows: rows.select("value").write.format("versioned_document").mode("append").save(place)
    read = lambda: t.spark.read.format("versioned_document").option("path", place).load()
    write(made.where("nth <= 50"))
    try:
        write(made.withColumn("value", F.when(F.col("nth") == 120, F.raise_error(F.lit("the disk is full"))).otherwise(F.col("value"))))
    except PySparkException:
        after = read().count()
    write(made)
    card = F.from_json("value", "struct<card_id: string, headline: string, relationships: array<struct<`from`: string, rel: string, `to`: string, evidence_type: string, status: string>>>")
    line = F.transform("c.relationships", lambda r: F.concat_ws("|", r["from"], r["rel"], r["to"], r["evidence_type"], r["status"]))
    whole = read().select(card.alias("c"))
    return whole.select(F.lit(files.versions(place)[-1]).alias("version"), F.lit(after).alias("after_failure"), "c.card_id", "c.headline", F.nullif(F.array_join(line, ";"), F.lit("")).alias("edges"))


@query("f20_payload_guards", """
SELECT sector, CASE sector WHEN 'AUTOMOBILE' THEN 'unreadable' WHEN 'HOUSEHOLD' THEN 'wrong version' WHEN 'MACHINERY' THEN 'empty' ELSE 'ok' END AS state, CASE WHEN sector IN ('BUILDING', 'FURNITURE') THEN least(count(*), 50) END AS n_cards FROM catalysts GROUP BY sector""")
def f20(t):
    """What a reader of payloads checks before it shows one: that it can be read, has the version it knows, and has cards.
    Of the payloads of all sectors, one is cut off, one is of another version and one has no cards."""
    place = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("ts"), F.desc("entry_id")))
    newest = t.catalysts.select("sector", "entry_id", place.alias("place")).where("place <= 50")
    ids = F.when(F.col("sector") != "MACHINERY", F.struct(F.col("entry_id").alias("card_id")))
    version = F.when(F.col("sector") == "HOUSEHOLD", 2).otherwise(1)
    made = newest.groupBy("sector").agg(F.collect_list(ids).alias("cards")).select("sector", F.to_json(F.struct(version.alias("schema_version"), "cards")).alias("body"))
    sent = made.withColumn("body", F.when(F.col("sector") == "AUTOMOBILE", F.expr("left(body, length(body) - 5)")).otherwise(F.col("body")))
    read = F.from_json("body", "struct<schema_version: int, cards: array<struct<card_id: string>>>")
    rows = sent.select("sector", F.when(F.try_parse_json("body").isNotNull(), read).alias("p"))
    state = F.when(F.col("p").isNull(), "unreadable").when(F.col("p.schema_version") != 1, "wrong version").when(F.coalesce(F.size("p.cards"), F.lit(0)) == 0, "empty").otherwise("ok")
    return rows.select("sector", state.alias("state"), F.when(state == "ok", F.size("p.cards").cast("long")).alias("n_cards"))
