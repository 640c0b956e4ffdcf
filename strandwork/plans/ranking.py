"""Sorts, limits, top-k in all and per group."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandwork.operators.endpoints import with_endpoints, with_names
from strandwork.plans.base import query
from strandwork.session import settled


@query("o1_newest_cards", "SELECT catalyst_id, entry_id, ts FROM catalysts WHERE sector = 'BUILDING' ORDER BY ts DESC, entry_id DESC LIMIT 200")
def o1(t):
    return t.catalysts.where("sector = 'BUILDING'").orderBy(F.desc("ts"), F.desc("entry_id")).limit(200).select("catalyst_id", "entry_id", "ts")


@query("o2_oldest_first", "SELECT entry_id, ts FROM catalysts WHERE sector = 'AUTOMOBILE' ORDER BY ts, entry_id LIMIT 50")
def o2(t):
    return t.catalysts.where("sector = 'AUTOMOBILE'").orderBy("ts", "entry_id").limit(50).select("entry_id", "ts")


@query("o3_stable_newest", "SELECT event_id, CAST(ts AS DATE) AS day FROM events ORDER BY day DESC, event_id LIMIT 300", base=False)
def o3(t):
    """By day, newest first; within a day in the order of the log."""
    return t.raw("events").select("event_id", F.col("ts").cast("date").alias("day")).orderBy(F.desc("day"), "event_id").limit(300)


@query("o4_edges_by_confidence", "o4_edges_by_confidence_all", """
SELECT catalyst_id, rel_type, entity_a_id, row_number() OVER (PARTITION BY catalyst_id ORDER BY confidence DESC, rel_type, entity_a_id, entity_b_id, l_partkey, l_linenumber) AS place
FROM relationships""")
def o4(t):
    order = Window.partitionBy("catalyst_id").orderBy(F.desc("confidence"), "rel_type", "entity_a_id", "entity_b_id", "l_partkey", "l_linenumber")
    return t.relationships.select("catalyst_id", "rel_type", "entity_a_id", F.row_number().over(order).cast("long").alias("place"))


@query("o5_due_entities", """
SELECT e.entity_id, max(CASE WHEN h.source = 'blocked' THEN 1 ELSE 0 END) AS was_blocked FROM entities e LEFT JOIN handles h ON h.name_key = lower(e.name)
GROUP BY e.entity_id ORDER BY was_blocked, entity_id LIMIT 25""")
def o5(t):
    blocked = t.handles.groupBy("name_key").agg(F.max((F.col("source") == "blocked").cast("int")).alias("b"))
    rows = t.entities.select("entity_id", F.lower("name").alias("name_key")).join(blocked, "name_key", "left")
    return rows.select("entity_id", F.coalesce("b", F.lit(0)).alias("was_blocked")).orderBy("was_blocked", "entity_id").limit(25)


@query("o6_review_list", "SELECT name_key, channel, source FROM handles WHERE handle IS NULL ORDER BY channel, name_key LIMIT 40")
def o6(t):
    return t.handles.where("handle is null").orderBy("channel", "name_key").limit(40).select("name_key", "channel", "source")


@query("o7_hottest_nodes", """
WITH e AS (SELECT entity_a_id AS id, confidence FROM relationships UNION ALL SELECT entity_b_id, confidence FROM relationships)
SELECT id AS entity_id, round(sum(confidence), 4) AS heat FROM e GROUP BY id ORDER BY round(sum(confidence), 4) DESC, id LIMIT 50""")
def o7(t):
    ends = with_endpoints(t.relationships.select("entity_a_id", "entity_b_id", "confidence"), once=False)
    return ends.groupBy("entity_id").agg(F.round(F.sum("confidence"), 4).alias("heat")).orderBy(F.desc("heat"), "entity_id").limit(50)


@query("o8_social_candidates", """
SELECT c.catalyst_id, ts, round(max(confidence), 6) AS max_confidence FROM catalysts c JOIN relationships r USING (catalyst_id)
WHERE catalyst_id NOT IN (SELECT catalyst_id FROM catalysts WHERE catalyst_id % 4 = 0) GROUP BY c.catalyst_id, ts HAVING max(confidence) >= 0.6
ORDER BY ts DESC, round(max(confidence), 6) DESC, c.catalyst_id LIMIT 3""")
def o8(t):
    """The newest events with a confident edge that have not been posted."""
    posted = t.catalysts.where("catalyst_id % 4 = 0").select("catalyst_id")
    best = t.relationships.groupBy("catalyst_id").agg(F.round(F.max("confidence"), 6).alias("max_confidence")).where("max_confidence >= 0.6")
    rows = t.catalysts.select("catalyst_id", "ts").join(best, "catalyst_id").join(posted, "catalyst_id", "left_anti")
    return rows.orderBy(F.desc("ts"), F.desc("max_confidence"), "catalyst_id").limit(3)


@query("o9_render_queue", """
WITH r AS (SELECT entry_id, ts FROM catalysts WHERE sector = 'HOUSEHOLD'), done AS (SELECT entry_id FROM r WHERE entry_id LIKE '%2')
SELECT entry_id, ts FROM r WHERE entry_id NOT IN (SELECT entry_id FROM done) ORDER BY ts DESC, entry_id DESC LIMIT 60""")
def o9(t):
    rows = t.catalysts.where("sector = 'HOUSEHOLD'").select("entry_id", "ts")
    waiting = rows.join(rows.where("entry_id like '%2'").select("entry_id"), "entry_id", "left_anti")
    return waiting.orderBy(F.desc("ts"), F.desc("entry_id")).limit(60)


@query("o10_ego_view", """
SELECT r.catalyst_id, entity_a_id, entity_b_id, ts, l_linenumber, l_partkey FROM relationships r JOIN catalysts c USING (catalyst_id) WHERE entity_a_id = 5 OR entity_b_id = 5
ORDER BY ts DESC, r.catalyst_id, entity_b_id, l_linenumber, l_partkey LIMIT 20""")
def o10(t):
    mine = t.relationships.where("entity_a_id = 5 or entity_b_id = 5").select("catalyst_id", "entity_a_id", "entity_b_id", "l_linenumber", "l_partkey")
    dated = mine.join(t.catalysts.select("catalyst_id", "ts"), "catalyst_id")
    return dated.orderBy(F.desc("ts"), "catalyst_id", "entity_b_id", "l_linenumber", "l_partkey").limit(20)


@query("o11_best_candidate", """
SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1""", base=False)
def o11(t):
    """Best of the candidates, the first where several are as good."""
    best = t.raw("events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct(F.col("value"), -F.col("event_id"))).alias("b"))
    return best.select("user_id", "b.event_id", "b.value")


@query("o12_page_of_users", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40", base=False)
def o12(t):
    return t.raw("customer").orderBy(F.desc("c_acctbal"), "c_custkey").offset(40).limit(20).select("c_custkey", "c_name")


@query("o13_node_panel", """
WITH e AS (SELECT entity_a_id AS entity_id, catalyst_id, rel_type, confidence, l_partkey, l_linenumber FROM relationships UNION ALL SELECT entity_b_id, catalyst_id, rel_type, confidence, l_partkey, l_linenumber FROM relationships WHERE entity_a_id <> entity_b_id),
n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, catalyst_id, rel_type, l_partkey, l_linenumber) AS place FROM e)
SELECT entity_id, place, catalyst_id, rel_type, round(confidence, 6) AS confidence FROM n WHERE place <= 5""")
def o13(t):
    """Five most confident edges of every node. Spark limits each group before the shuffle, so a hub is no hot task."""
    ends = with_endpoints(t.relationships)
    order = Window.partitionBy("entity_id").orderBy(F.desc("confidence"), "catalyst_id", "rel_type", "l_partkey", "l_linenumber")
    top = ends.withColumn("place", F.row_number().over(order)).where("place <= 5")
    return top.select("entity_id", F.col("place").cast("long").alias("place"), "catalyst_id", "rel_type", F.round("confidence", 6).alias("confidence"))


def heats(relationships):
    ends = with_endpoints(relationships.select("entity_a_id", "entity_b_id", "confidence"), once=False)
    return ends.groupBy("entity_id").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("heat"))


def batches(heat, size: int = 15):
    """``entity_id, batch``: nodes are numbered in sorted ranges, each after the counts of the ranges before it."""
    order = [F.desc("n"), F.desc("heat"), F.asc("entity_id")]
    ranged = settled(settled(heat).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").count().withColumn("_before", F.sum("count").over(Window.orderBy("_p")) - F.col("count")).drop("count")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    placed = ranged.withColumn("_n", inside).join(F.broadcast(counts), "_p")
    return placed.select("entity_id", F.floor((F.col("_before") + F.col("_n")) / size).alias("batch"))


@query("w4_paint_batches", "w4_paint_all", """
WITH e AS (SELECT entity_a_id AS id, confidence FROM relationships UNION ALL SELECT entity_b_id, confidence FROM relationships),
h AS (SELECT id, count(*) AS n, round(sum(confidence), 6) AS heat FROM e GROUP BY id),
b AS (SELECT id, CAST(floor((row_number() OVER (ORDER BY n DESC, heat DESC, id) - 1) / 15) AS BIGINT) AS batch FROM h)
SELECT greatest(x.batch, y.batch) AS edge_batch, count(*) AS n_edges FROM relationships r JOIN b x ON x.id = r.entity_a_id JOIN b y ON y.id = r.entity_b_id GROUP BY 1""")
def w4(t):
    """Nodes are painted fifteen at a time by degree and heat; an edge comes with the later of its ends."""
    batch = batches(heats(t.relationships))
    edges = t.relationships.select("entity_a_id", "entity_b_id").join(batch.toDF("entity_a_id", "a"), "entity_a_id").join(batch.toDF("entity_b_id", "b"), "entity_b_id")
    return edges.groupBy(F.greatest("a", "b").alias("edge_batch")).agg(F.count("*").alias("n_edges"))


@query("w7_related_names", "w7_related_names_all", """
WITH r AS (SELECT catalyst_id, a.name AS x, b.name AS y, row_number() OVER (PARTITION BY catalyst_id ORDER BY confidence DESC, a.name, rel_type, l_partkey, l_linenumber) AS place
  FROM relationships JOIN entities a ON a.entity_id = entity_a_id JOIN entities b ON b.entity_id = entity_b_id),
top AS (SELECT catalyst_id, x, y FROM r WHERE place = 1),
n AS (SELECT r.catalyst_id, unnest([r.x, r.y]) AS name, place FROM r WHERE place > 1),
f AS (SELECT n.catalyst_id, name, min(place) AS place FROM n JOIN top USING (catalyst_id) WHERE name <> top.x AND name <> top.y GROUP BY 1, 2)
SELECT catalyst_id, name, place FROM f QUALIFY row_number() OVER (PARTITION BY catalyst_id ORDER BY place, name) <= 4""")
def w7(t):
    """Up to four other names on an event's edges, in the order of the edges."""
    wanted = ["catalyst_id", "entity_a_id", "entity_b_id", "rel_type", "confidence", "l_partkey", "l_linenumber"]
    edges = t.dealt(with_names(t.relationships.select(*wanted), t.entities), "catalyst_id")
    w = Window.partitionBy("catalyst_id").orderBy(F.desc("confidence"), "from_name", "rel_type", "l_partkey", "l_linenumber")
    whole = Window.partitionBy("catalyst_id").orderBy("place")
    ranked = edges.withColumn("place", F.row_number().over(w))
    ranked = ranked.withColumn("x", F.first("from_name").over(whole)).withColumn("y", F.first("to_name").over(whole)).where("place > 1")
    names = ranked.select("catalyst_id", "x", "y", "place", F.explode(F.array("from_name", "to_name")).alias("name")).where("name <> x and name <> y")
    firsts = names.groupBy("catalyst_id", "name").agg(F.min("place").alias("place"))
    nth = F.row_number().over(Window.partitionBy("catalyst_id").orderBy("place", "name"))
    return firsts.withColumn("nth", nth).where("nth <= 4").select("catalyst_id", "name", F.col("place").cast("long").alias("place"))
