"""Joins of entities, events, edges and handles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandwork.functions import text as tx
from strandwork.operators.endpoints import shown_handle, with_endpoints, with_names
from strandwork.plans.base import query
from strandwork.sources.graph_tables import AS_OF


@query("j1_edge_names", """
SELECT r.catalyst_id, a.name AS from_name, rel_type, b.name AS to_name, round(confidence, 6) AS confidence FROM relationships r
JOIN entities a ON r.entity_a_id = a.entity_id JOIN entities b ON r.entity_b_id = b.entity_id WHERE confidence >= 0.6""")
def j1(t):
    named = with_names(t.relationships.where("confidence >= 0.6"), t.entities)
    return named.select("catalyst_id", "from_name", "rel_type", "to_name", F.round("confidence", 6).alias("confidence"))


@query("j2_endpoint_join", """
SELECT e.name, count(*) AS n_edges, count(DISTINCT r.catalyst_id) AS n_catalysts FROM relationships r JOIN entities e ON e.entity_id IN (r.entity_a_id, r.entity_b_id) GROUP BY e.name""")
def j2(t):
    ends = with_endpoints(t.relationships.select("catalyst_id", "entity_a_id", "entity_b_id"))
    per = ends.groupBy("entity_id").agg(F.count("*").alias("n_edges"), F.countDistinct("catalyst_id").alias("n_catalysts"))
    return per.join(t.entities.select("entity_id", "name"), "entity_id").groupBy("name").agg(F.sum("n_edges").alias("n_edges"), F.sum("n_catalysts").alias("n_catalysts"))


@query("j4_aliases_and_blocks", """
SELECT e.entity_id, e.name, coalesce(string_agg(a.alias, ',' ORDER BY a.alias), '') AS aliases, max(CASE WHEN h.source = 'blocked' THEN 1 ELSE 0 END) AS was_blocked
FROM entities e LEFT JOIN (SELECT entity_id, ticker AS alias FROM entities WHERE ticker IS NOT NULL UNION ALL SELECT entity_id, lower(name) FROM entities WHERE entity_id % 5 = 0) a USING (entity_id)
LEFT JOIN handles h ON h.name_key = lower(trim(e.name)) AND h.channel = 'linkedin' AND h.source = 'blocked' GROUP BY e.entity_id, e.name""")
def j4(t):
    e = t.entities
    alias = e.where("ticker is not null").select("entity_id", F.col("ticker").alias("alias"))
    alias = alias.unionByName(e.where("entity_id % 5 = 0").select("entity_id", F.lower("name").alias("alias")))
    alias = alias.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), ",").alias("aliases"))
    blocked = t.handles.where("channel = 'linkedin' and source = 'blocked'").select("name_key", F.lit(1).alias("b")).distinct()
    found = e.select("entity_id", "name", tx.name_key(F.col("name")).alias("name_key")).join(alias, "entity_id", "left").join(blocked, "name_key", "left")
    return found.select("entity_id", "name", F.coalesce("aliases", F.lit("")).alias("aliases"), F.coalesce("b", F.lit(0)).alias("was_blocked"))


@query("j5_missing_handles", """
SELECT e.entity_id, e.name FROM entities e WHERE lower(e.type) LIKE '%company%' AND NOT EXISTS (
  SELECT 1 FROM handles h WHERE h.name_key = lower(trim(e.name)) AND h.channel = 'linkedin' AND (h.source <> 'blocked' OR h.resolved_on > DATE '2001-08-01' - 14))""")
def j5(t):
    settled = t.handles.where("channel = 'linkedin'").where((F.col("source") != "blocked") | (F.col("resolved_on") > F.date_sub(F.lit(AS_OF), 14)))
    companies = t.entities.where(F.lower("type").like("%company%")).withColumn("name_key", tx.name_key(F.col("name")))
    return companies.join(settled.select("name_key"), "name_key", "left_anti").select("entity_id", "name")


@query("j6_orphans", """
WITH kept_c AS (SELECT * FROM catalysts WHERE catalyst_id % 10 <> 3), kept_e AS (SELECT * FROM entities WHERE entity_id % 11 <> 4)
SELECT count(*) AS n_edges, count(*) FILTER (WHERE catalyst_id NOT IN (SELECT catalyst_id FROM kept_c) OR entity_a_id NOT IN (SELECT entity_id FROM kept_e)
  OR entity_b_id NOT IN (SELECT entity_id FROM kept_e)) AS n_orphans FROM relationships""")
def j6(t):
    """Edges whose event or one of whose ends is gone: one anti-join after another instead of OR-ed subqueries."""
    events = t.catalysts.where("catalyst_id % 10 <> 3").select("catalyst_id")
    known = t.entities.where("entity_id % 11 <> 4")
    edges = t.relationships.select("catalyst_id", "entity_a_id", "entity_b_id")
    whole = edges.join(events, "catalyst_id", "left_semi")
    for end in ("entity_a_id", "entity_b_id"):
        whole = whole.join(known.select(F.col("entity_id").alias(end)), end, "left_semi")
    both = edges.select(F.lit(1).alias("all"), F.lit(0).alias("whole")).unionAll(whole.select(F.lit(0), F.lit(1)))
    return both.agg(F.sum("all").alias("n_edges"), (F.sum("all") - F.sum("whole")).alias("n_orphans"))


@query("j7_new_entries", "SELECT entry_id FROM catalysts WHERE sector = 'BUILDING' AND entry_id NOT IN (SELECT entry_id FROM catalysts WHERE ts < DATE '2001-01-01')")
def j7(t):
    done = t.catalysts.where("ts < date'2001-01-01'").select("entry_id")
    return t.catalysts.where("sector = 'BUILDING'").select("entry_id").join(done, "entry_id", "left_anti")


@query("j8_from_anchor", """
WITH anchor AS (SELECT ts AS ats, entry_id AS aid FROM catalysts WHERE sector = 'BUILDING' ORDER BY ts DESC, entry_id DESC LIMIT 1 OFFSET 20)
SELECT entry_id, ts FROM catalysts, anchor WHERE sector = 'BUILDING' AND (ts > ats OR (ts = ats AND entry_id >= aid))""")
def j8(t):
    """Rows from an anchor on; the anchor is one row, a scalar subquery, and without it there are none."""
    rows = t.catalysts.where("sector = 'BUILDING'").select("entry_id", "ts")
    anchor = rows.orderBy(F.desc("ts"), F.desc("entry_id")).offset(20).limit(1).select(F.struct("ts", "entry_id").alias("a")).scalar()
    return rows.where(F.struct("ts", "entry_id") >= anchor)


@query("j9_top_confidence", """
SELECT c.catalyst_id, round(max(confidence), 6) AS max_confidence FROM catalysts c LEFT JOIN relationships r USING (catalyst_id)
WHERE sector = 'MACHINERY' GROUP BY c.catalyst_id HAVING max(confidence) >= 0.9""")
def j9(t):
    best = t.relationships.groupBy("catalyst_id").agg(F.max("confidence").alias("m")).where("m >= 0.9")
    events = t.catalysts.where("sector = 'MACHINERY'").select("catalyst_id")
    return events.join(best, "catalyst_id").select("catalyst_id", F.round("m", 6).alias("max_confidence"))


@query("j10_entity_handles", """
SELECT e.entity_id, e.name, max(CASE WHEN h.channel = 'linkedin' AND NOT coalesce(h.confidence < 0.8, false) THEN h.handle END) AS linkedin_handle,
       max(CASE WHEN h.channel = 'x' THEN h.handle END) AS x_handle
FROM entities e LEFT JOIN (SELECT * FROM handles UNION ALL SELECT name_key, 'x', concat('@x', name_key), 1.0, 'x_serp_verified', resolved_on FROM handles WHERE confidence > 0.9) h
ON h.name_key = lower(e.name) GROUP BY e.entity_id, e.name""")
def j10(t):
    """Channels of the handle cache as columns beside the entity."""
    more = t.handles.where("confidence > 0.9").withColumns({"channel": F.lit("x"), "handle": F.concat(F.lit("@x"), "name_key"), "confidence": F.lit(1.0)})
    cache = t.handles.unionByName(more)
    shown = shown_handle(F.col("handle"), F.col("confidence"))
    wide = cache.groupBy("name_key").agg(*[F.max(F.when(F.col("channel") == c, shown)).alias(f"{c}_handle") for c in ("linkedin", "x")])
    return t.entities.select("entity_id", "name", tx.name_key(F.col("name")).alias("name_key")).join(wide, "name_key", "left").drop("name_key")


@query("j11_edge_ids", """
SELECT count(*) AS n_edges, count(*) FILTER (WHERE a.entity_id IS NOT NULL AND b.entity_id IS NOT NULL) AS n_resolved FROM
(SELECT a.name AS na, CASE WHEN l_partkey % 9 = 0 THEN 'Nobody' ELSE b.name END AS nb FROM relationships r JOIN entities a ON a.entity_id = entity_a_id JOIN entities b ON b.entity_id = entity_b_id) x
LEFT JOIN entities a ON a.name = na LEFT JOIN entities b ON b.name = nb""")
def j11(t):
    """Names back to ids; an edge with an unknown end is left out and counted."""
    named = with_names(t.relationships, t.entities).select("from_name", F.when(F.col("l_partkey") % 9 == 0, "Nobody").otherwise(F.col("to_name")).alias("to_name"))
    ids = t.entities.select("name", "entity_id")
    found = named.join(ids.toDF("from_name", "a"), "from_name", "left").join(ids.toDF("to_name", "b"), "to_name", "left")
    return found.agg(F.count("*").alias("n_edges"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n_resolved"))


@query("j12_nodes_of_edges", """
SELECT entity_id, name FROM entities WHERE entity_id IN (SELECT entity_a_id FROM relationships WHERE confidence >= 0.95 UNION SELECT entity_b_id FROM relationships WHERE confidence >= 0.95)""")
def j12(t):
    ends = with_endpoints(t.relationships.where("confidence >= 0.95").select("entity_a_id", "entity_b_id")).select("entity_id")
    return t.entities.select("entity_id", "name").join(ends, "entity_id", "left_semi")


@query("j13_partners", """
WITH p AS (SELECT entity_a_id AS entity_id, entity_b_id AS partner FROM relationships UNION SELECT entity_b_id, entity_a_id FROM relationships),
n AS (SELECT p.entity_id, e.name AS partner, row_number() OVER (PARTITION BY p.entity_id ORDER BY e.name) AS place FROM p JOIN entities e ON e.entity_id = p.partner)
SELECT entity_id, partner, place FROM n WHERE place <= 30""")
def j13(t):
    """Up to 30 partners of every entity, by name."""
    edges = t.relationships.select("entity_a_id", "entity_b_id")
    pairs = t.dealt(edges.toDF("entity_id", "partner_id").union(edges.select("entity_b_id", "entity_a_id")), "partner_id").distinct()
    named = t.dealt(pairs.join(t.entities.select(F.col("entity_id").alias("partner_id"), F.col("name").alias("partner")), "partner_id"), "entity_id")
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("partner"))
    return named.select("entity_id", "partner", place.alias("place")).where("place <= 30").withColumn("place", F.col("place").cast("long"))


@query("j14_entity_headlines", "j14_entity_headlines_all", """
WITH h AS (SELECT DISTINCT e.entity_id, c.headline FROM relationships r JOIN entities e ON e.entity_id IN (r.entity_a_id, r.entity_b_id) JOIN catalysts c USING (catalyst_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY headline) AS place FROM h) SELECT entity_id, headline FROM n WHERE place <= 20""")
def j14(t):
    """Up to 20 headlines of every entity, by name."""
    known = with_endpoints(t.relationships.select("catalyst_id", "entity_a_id", "entity_b_id")).join(t.entities.select("entity_id"), "entity_id", "left_semi")
    ends = t.dealt(known.select("entity_id", "catalyst_id"), "catalyst_id").distinct()
    lines = t.dealt(ends.join(t.catalysts.select("catalyst_id", "headline"), "catalyst_id").select("entity_id", "headline"), "entity_id").distinct()
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("headline"))
    return lines.withColumn("place", place).where("place <= 20").drop("place")


@query("j15_reconcile", """
WITH l AS (SELECT page_id, md5(html) AS m FROM pages WHERE page_id % 7 <> 0), r AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN md5(url) ELSE md5(html) END AS m FROM pages WHERE page_id % 6 <> 0)
SELECT CASE WHEN r.page_id IS NULL THEN 'missing' WHEN l.page_id IS NULL THEN 'extra' WHEN l.m = r.m THEN 'in_sync' ELSE 'stale' END AS state, count(*) AS n
FROM l FULL JOIN r USING (page_id) GROUP BY 1""", base=False)
def j15(t):
    pages = t.raw("pages")
    here = pages.where("page_id % 7 <> 0").select("page_id", F.md5("html").alias("here"))
    there = pages.where("page_id % 6 <> 0").select("page_id", F.when(F.col("page_id") % 5 == 0, F.md5("url")).otherwise(F.md5("html")).alias("there"))
    both = here.join(there, "page_id", "full")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("here").isNull(), "extra").when(F.col("here") == F.col("there"), "in_sync").otherwise("stale")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("j17_materialised", """
SELECT i.entity_a_id, i.rel_type, i.entity_b_id, i.ship_date AS inferred_on, min(d.ship_date) AS confirmed_on, CAST(min(d.ship_date) - i.ship_date AS BIGINT) AS lead_days
FROM (SELECT DISTINCT entity_a_id, rel_type, entity_b_id, ship_date FROM relationships WHERE evidence_type = 'inferred') i
JOIN relationships d ON d.evidence_type = 'direct' AND d.entity_a_id = i.entity_a_id AND d.rel_type = i.rel_type AND d.entity_b_id = i.entity_b_id AND d.ship_date > i.ship_date
GROUP BY i.entity_a_id, i.rel_type, i.entity_b_id, i.ship_date""")
def j17(t):
    """The first direct edge that confirms an inferred one, found in one sort of each triple instead of a self-join."""
    key = ["entity_a_id", "rel_type", "entity_b_id"]
    days = t.relationships.where("evidence_type in ('inferred', 'direct')").groupBy(*key, "ship_date").agg(F.max((F.col("evidence_type") == "direct").cast("int")).alias("d"), F.max((F.col("evidence_type") == "inferred").cast("int")).alias("i"))
    later = Window.partitionBy(*key).orderBy("ship_date").rowsBetween(1, Window.unboundedFollowing)
    found = days.withColumn("confirmed_on", F.min(F.when(F.col("d") == 1, F.col("ship_date"))).over(later)).where("i = 1 and confirmed_on is not null")
    return found.select(*key, F.col("ship_date").alias("inferred_on"), "confirmed_on", F.datediff("confirmed_on", "ship_date").cast("long").alias("lead_days"))


@query("j18_pair_history", """
WITH e AS (SELECT least(entity_a_id, entity_b_id) AS lo, greatest(entity_a_id, entity_b_id) AS hi, ship_date, rel_type, l_partkey, l_linenumber, catalyst_id FROM relationships)
SELECT lo, hi, ship_date, catalyst_id, count(*) OVER (PARTITION BY lo, hi ORDER BY ship_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS n_before FROM e""")
def j18(t):
    """How many edges a pair had before the day of each edge."""
    edges = t.relationships.select(F.least("entity_a_id", "entity_b_id").alias("lo"), F.greatest("entity_a_id", "entity_b_id").alias("hi"), "ship_date", "catalyst_id", F.unix_date("ship_date").alias("day"))
    before = Window.partitionBy("lo", "hi").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    return edges.select("lo", "hi", "ship_date", "catalyst_id", F.count("*").over(before).alias("n_before"))


@query("j19_neighbourhood", """
WITH n AS (SELECT entity_b_id AS id FROM relationships WHERE entity_a_id = 3 UNION SELECT entity_a_id FROM relationships WHERE entity_b_id = 3 UNION SELECT 3)
SELECT entity_a_id, entity_b_id, count(*) AS n_edges FROM relationships WHERE entity_a_id IN (SELECT id FROM n) AND entity_b_id IN (SELECT id FROM n) GROUP BY 1, 2""")
def j19(t):
    """A node, its neighbours and all edges among them."""
    edges = t.relationships.select("entity_a_id", "entity_b_id")
    near = edges.where("entity_a_id = 3 or entity_b_id = 3").select(F.explode(F.array("entity_a_id", "entity_b_id")).alias("id")).distinct()
    inside = edges
    for end in ("entity_a_id", "entity_b_id"):
        inside = inside.join(near.withColumnRenamed("id", end), end, "left_semi")
    return inside.groupBy("entity_a_id", "entity_b_id").agg(F.count("*").alias("n_edges"))


@query("j20_two_patterns", """
SELECT entity_id, name FROM entities WHERE type = 'private_company' AND entity_id IN (SELECT entity_a_id FROM relationships WHERE rel_type = 'supplies' AND entity_b_id % 3 = 0)
AND entity_id IN (SELECT entity_a_id FROM relationships WHERE rel_type = 'partners_with' AND entity_b_id % 3 = 1)""")
def j20(t):
    """Private companies that supply one group and partner with another."""
    edges = t.relationships.select(F.col("entity_a_id").alias("entity_id"), "rel_type", (F.col("entity_b_id") % 3).alias("g"))
    found = t.entities.where("type = 'private_company'").select("entity_id", "name")
    return found.join(edges.where("rel_type = 'supplies' and g = 0"), "entity_id", "left_semi").join(edges.where("rel_type = 'partners_with' and g = 1"), "entity_id", "left_semi")


@query("j21_post_analytics", """
WITH posts AS (SELECT catalyst_id, concat('p', CAST(catalyst_id AS VARCHAR)) AS post_id FROM catalysts WHERE catalyst_id % 20 = 0),
stats AS (SELECT concat('p', CAST(user_id * 20 AS VARCHAR)) AS post_id, count(*) AS impressions, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY 1)
SELECT catalyst_id, post_id, coalesce(impressions, 0) AS impressions, coalesce(clicks, 0) AS clicks FROM posts LEFT JOIN stats USING (post_id)""")
def j21(t):
    posts = t.catalysts.where("catalyst_id % 20 = 0").select("catalyst_id", F.concat(F.lit("p"), F.col("catalyst_id").cast("string")).alias("post_id"))
    post = F.concat(F.lit("p"), (F.col("user_id") * 20).cast("string")).alias("post_id")
    stats = t.raw("events").groupBy(post).agg(F.count("*").alias("impressions"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    zero = F.lit(0).cast("long")
    return posts.join(stats, "post_id", "left").select("catalyst_id", "post_id", F.coalesce("impressions", zero).alias("impressions"), F.coalesce("clicks", zero).alias("clicks"))
