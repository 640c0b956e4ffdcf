"""Set operations and changes: the version of a table that follows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwork.operators.changes import inserted_if_absent, latest, merged, without
from strandwork.plans.base import query


@query("x1_set_difference", "SELECT name_key FROM handles EXCEPT SELECT lower(name) FROM entities WHERE type = 'government'")
def x1(t):
    return t.handles.select("name_key").subtract(t.entities.where("type = 'government'").select(F.lower("name")))


@query("x2_name_sets", "x2_name_sets_all", """
SELECT catalyst_id, array_to_string(list_sort(list_distinct(list(n))), ',') AS names FROM (
SELECT catalyst_id, unnest([entity_a_id, entity_b_id]) AS n FROM relationships) GROUP BY catalyst_id""")
def x2(t):
    ends = t.relationships.select("catalyst_id", F.explode(F.array("entity_a_id", "entity_b_id")).alias("n"))
    return ends.groupBy("catalyst_id").agg(F.array_join(F.array_sort(F.collect_set("n")), ",").alias("names"))


@query("x3_watermarks", """
WITH old AS (SELECT sector, max(ts) AS last_day, max(entry_id) AS last_id FROM catalysts WHERE ts < DATE '2001-07-01' AND sector <> 'MACHINERY' GROUP BY sector),
new AS (SELECT sector, max(ts) AS last_day, max(entry_id) AS last_id FROM catalysts WHERE ts >= DATE '2001-07-01' AND sector <> 'BUILDING' GROUP BY sector)
SELECT sector, coalesce(n.last_day, o.last_day) AS last_day, coalesce(n.last_id, o.last_id) AS last_id FROM old o FULL JOIN new n USING (sector)""")
def x3(t):
    def marks(rows):
        return rows.groupBy("sector").agg(F.max("ts").alias("last_day"), F.max("entry_id").alias("last_id"))

    old = marks(t.catalysts.where("ts < date'2001-07-01' and sector <> 'MACHINERY'"))
    return merged(old, marks(t.catalysts.where("ts >= date'2001-07-01' and sector <> 'BUILDING'")), ["sector"])


@query("x4_entity_upsert", """
WITH new AS (SELECT name, CASE WHEN entity_id % 2 = 0 THEN 'NEW' END AS ticker, 'organization' AS type FROM entities WHERE entity_id % 3 = 0 UNION ALL SELECT 'Newcomer', 'NC', 'private_company')
SELECT coalesce(e.name, n.name) AS name, coalesce(n.ticker, e.ticker) AS ticker, CASE WHEN e.name IS NOT NULL THEN e.type ELSE n.type END AS type FROM (SELECT name, ticker, type FROM entities) e FULL JOIN new n ON e.name = n.name""")
def x4(t):
    """An entity that is seen again gets a ticker if it comes with one; its type stays."""
    old = t.entities.select("name", "ticker", "type")
    again = t.entities.where("entity_id % 3 = 0").select("name", F.when(F.col("entity_id") % 2 == 0, "NEW").alias("ticker"), F.lit("organization").alias("type"))
    one = t.spark.range(1).select(F.lit("Newcomer").alias("name"), F.lit("NC").alias("ticker"), F.lit("private_company").alias("type"))
    return merged(old, again.unionByName(one), ["name"], keep_old=["ticker"], fixed=["type"])


@query("x5_insert_if_absent", """
SELECT entity_id, ticker AS alias FROM entities WHERE ticker IS NOT NULL UNION
SELECT entity_id, CASE WHEN entity_id % 2 = 0 AND ticker IS NOT NULL THEN ticker ELSE lower(name) END FROM entities""")
def x5(t):
    old = t.entities.where("ticker is not null").select("entity_id", F.col("ticker").alias("alias"))
    again = F.when((F.col("entity_id") % 2 == 0) & F.col("ticker").isNotNull(), F.col("ticker")).otherwise(F.lower("name"))
    return inserted_if_absent(old, t.entities.select("entity_id", again.alias("alias")), ["entity_id", "alias"])


@query("x6_last_write_wins", """
SELECT user_id, event_type AS source, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""", base=False)
def x6(t):
    rows = t.raw("events").select("user_id", F.col("event_type").alias("source"), "ts", "event_id", "value")
    return latest(rows, ["user_id", "source"], "ts", "event_id").select("user_id", "source", "value")


@query("x7_cascading_delete", """
WITH gone AS (SELECT catalyst_id FROM catalysts WHERE entry_id LIKE 'BUI-01%')
SELECT (SELECT count(*) FROM catalysts WHERE catalyst_id NOT IN (SELECT catalyst_id FROM gone)) AS catalysts,
       (SELECT count(*) FROM relationships WHERE catalyst_id NOT IN (SELECT catalyst_id FROM gone)) AS edges, (SELECT count(*) FROM entities) AS entities""")
def x7(t):
    """Events that are deleted take their edges with them; entities stay."""
    gone = t.catalysts.where("entry_id like 'BUI-01%'")
    counts = [without(t.catalysts.select("catalyst_id"), gone, ["catalyst_id"]), without(t.relationships.select("catalyst_id"), gone, ["catalyst_id"]), t.entities]
    names = ["catalysts", "edges", "entities"]
    sizes = None
    for name, rows in zip(names, counts, strict=True):
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        sizes = one if sizes is None else sizes.unionByName(one)
    return sizes.groupBy().pivot("what", names).agg(F.first("n"))


@query("x8_orphan_sweep", """
SELECT catalyst_id, count(*) AS n FROM relationships WHERE entity_b_id IN (SELECT entity_id FROM entities WHERE entity_id % 11 <> 4) GROUP BY catalyst_id""")
def x8(t):
    known = t.entities.where("entity_id % 11 <> 4").select(F.col("entity_id").alias("entity_b_id"))
    return t.relationships.select("catalyst_id", "entity_b_id").join(known, "entity_b_id", "left_semi").groupBy("catalyst_id").agg(F.count("*").alias("n"))


@query("x9_counters", "SELECT name_key, CASE WHEN name_key LIKE '%1' THEN 1 ELSE 0 END AS used, CASE WHEN name_key LIKE '%1' THEN DATE '2001-08-01' ELSE resolved_on END AS stamped FROM handles")
def x9(t):
    hit = F.col("name_key").like("%1")
    return t.handles.select("name_key", F.when(hit, 1).otherwise(0).alias("used"), F.when(hit, F.lit("2001-08-01").cast("date")).otherwise(F.col("resolved_on")).alias("stamped"))


@query("x10_latest_extraction", """
WITH runs AS (SELECT catalyst_id, rel_type, l_linenumber % 2 AS version FROM relationships), newest AS (SELECT catalyst_id, max(version) AS version FROM runs GROUP BY catalyst_id)
SELECT catalyst_id, rel_type, count(*) AS n FROM runs JOIN newest USING (catalyst_id, version) GROUP BY catalyst_id, rel_type""")
def x10(t):
    """All edges of the last run over an event; a run replaces the ones before it."""
    runs = t.relationships.select("catalyst_id", "rel_type", (F.col("l_linenumber") % 2).alias("version"))
    counted = runs.groupBy("catalyst_id", "version", "rel_type").agg(F.count("*").alias("n"))
    newest = counted.groupBy("catalyst_id").agg(F.max("version").alias("version"))
    return counted.join(newest, ["catalyst_id", "version"]).select("catalyst_id", "rel_type", "n")


@query("x11_merge_patch", """
WITH old AS (SELECT user_id, min(ts) AS created, max(value) AS best, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
patch AS (SELECT user_id, min(ts) AS created, CASE WHEN user_id % 2 = 0 THEN max(value) END AS best FROM events WHERE event_id % 2 = 1 GROUP BY user_id)
SELECT user_id, coalesce(old.created, patch.created) AS created, coalesce(patch.best, old.best) AS best, n FROM old FULL JOIN patch USING (user_id)""", base=False)
def x11(t):
    """Only the fields of a patch that have a value change; the time of creation is set once."""
    e = t.raw("events")
    old = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.min("ts").alias("created"), F.max("value").alias("best"), F.count("*").alias("n"))
    patch = e.where("event_id % 2 = 1").groupBy("user_id").agg(F.min("ts").alias("created"), F.when(F.col("user_id") % 2 == 0, F.max("value")).alias("best"))
    return merged(old, patch, ["user_id"], keep_old=["best"], fixed=["created"])


@query("x12_review_queue", """
WITH q AS (SELECT entity_id, name AS mention, CASE entity_id % 3 WHEN 0 THEN 'existing' WHEN 1 THEN 'new' ELSE 'discard' END AS decision FROM entities WHERE type = 'organization')
SELECT mention, decision <> 'discard' AS resolved, CASE decision WHEN 'existing' THEN entity_id - 1 WHEN 'new' THEN entity_id END AS resolved_to FROM q""")
def x12(t):
    decision = F.element_at(F.array(F.lit("existing"), F.lit("new"), F.lit("discard")), (F.col("entity_id") % 3 + 1).cast("int"))
    queue = t.entities.where("type = 'organization'").select("entity_id", F.col("name").alias("mention"), decision.alias("decision"))
    to = F.when(F.col("decision") == "existing", F.col("entity_id") - 1).when(F.col("decision") == "new", F.col("entity_id"))
    return queue.select("mention", (F.col("decision") != "discard").alias("resolved"), to.alias("resolved_to"))


@query("k2_card_merge", """
WITH old AS (SELECT catalyst_id AS card_id, headline, significance_score FROM catalysts WHERE catalyst_id % 3 <> 1), new AS (SELECT catalyst_id AS card_id, CASE WHEN catalyst_id % 2 = 0 THEN concat(headline, '!') END AS headline FROM catalysts WHERE catalyst_id % 3 <> 2)
SELECT card_id, coalesce(new.headline, old.headline) AS headline, significance_score FROM old FULL JOIN new USING (card_id)""")
def k2(t):
    k = F.col("catalyst_id")
    old = t.catalysts.where(k % 3 != 1).select(k.alias("card_id"), "headline", "significance_score")
    new = t.catalysts.where(k % 3 != 2).select(k.alias("card_id"), F.when(k % 2 == 0, F.concat("headline", F.lit("!"))).alias("headline"))
    return merged(old, new, ["card_id"], keep_old=["headline"])


@query("k5_upload_plan", """
WITH l AS (SELECT page_id, base64(unhex(md5(html))) AS m FROM pages), r AS (SELECT page_id, base64(unhex(md5(CASE WHEN page_id % 4 = 0 THEN url ELSE html END))) AS m FROM pages WHERE page_id % 3 <> 0)
SELECT count(*) FILTER (WHERE r.m IS DISTINCT FROM l.m) AS uploaded, count(*) FILTER (WHERE r.m = l.m) AS skipped FROM l LEFT JOIN r USING (page_id)""", base=False)
def k5(t):
    """Only content that differs from what is there goes up."""
    def tag(c):
        return F.base64(F.unhex(F.md5(c)))

    pages = t.raw("pages")
    here = pages.select("page_id", tag("html").alias("here"))
    there = pages.where("page_id % 3 <> 0").select("page_id", tag(F.when(F.col("page_id") % 4 == 0, F.col("url")).otherwise(F.col("html"))).alias("there"))
    same = F.col("here").eqNullSafe(F.col("there"))
    return here.join(there, "page_id", "left").agg(F.count_if(~same).alias("uploaded"), F.count_if(same).alias("skipped"))


@query("k8_completion_event", "SELECT sector, count(*) AS written FROM catalysts WHERE ts >= DATE '2001-07-25' GROUP BY sector HAVING count(*) > 0")
def k8(t):
    return t.catalysts.where("ts >= date'2001-07-25'").groupBy("sector").agg(F.count("*").alias("written"))


@query("j16_posts_by_entry", """
WITH posted AS (SELECT entry_id, concat('post-', entry_id) AS post_id FROM catalysts WHERE catalyst_id % 15 = 0 UNION ALL SELECT 'XXX-000000-000', 'post-lost')
SELECT c.catalyst_id, p.post_id FROM posted p JOIN catalysts c USING (entry_id)""")
def j16(t):
    """Rows that name an event by its entry id get the event's key; those that name none are left out."""
    posted = t.catalysts.where("catalyst_id % 15 = 0").select("entry_id", F.concat(F.lit("post-"), "entry_id").alias("post_id"))
    lost = t.spark.range(1).select(F.lit("XXX-000000-000").alias("entry_id"), F.lit("post-lost").alias("post_id"))
    return posted.unionByName(lost).join(t.catalysts.select("entry_id", "catalyst_id"), "entry_id").select("catalyst_id", "post_id")


@query("k3_sector_graphs", """
SELECT sector, count(*) AS n_edges, count(DISTINCT entity_a_id) AS n_sources, round(max(confidence), 6) AS best FROM relationships JOIN catalysts USING (catalyst_id) WHERE status IN ('active', 'materialized') GROUP BY sector""")
def k3(t):
    """One document for each sector; a run replaces the sectors that it has."""
    shown = t.relationships.where("status in ('active', 'materialized')").select("catalyst_id", "entity_a_id", "confidence")
    rows = shown.join(t.catalysts.select("catalyst_id", "sector"), "catalyst_id").groupBy("sector", "entity_a_id").agg(F.count("*").alias("n"), F.max("confidence").alias("c"))
    return rows.groupBy("sector").agg(F.sum("n").alias("n_edges"), F.count("*").alias("n_sources"), F.round(F.max("c"), 6).alias("best"))


@query("k4_last_runs", """
SELECT event_type AS sector, max(event_id) AS run, arg_max(value, event_id) AS written FROM events GROUP BY event_type""", base=False)
def k4(t):
    """Only the last run of each sector is kept."""
    return t.raw("events").groupBy(F.col("event_type").alias("sector")).agg(F.max("event_id").alias("run"), F.max_by("value", "event_id").alias("written"))


@query("p22_reextracted", """
WITH old AS (SELECT catalyst_id, rel_type, count(*) AS n FROM relationships GROUP BY 1, 2), again AS (SELECT DISTINCT catalyst_id FROM catalysts WHERE catalyst_id % 6 = 0)
SELECT catalyst_id, rel_type, n, 'v1' AS prompt_version FROM old WHERE catalyst_id NOT IN (SELECT catalyst_id FROM again)
UNION ALL SELECT catalyst_id, rel_type, n * 2, 'v2' FROM old WHERE catalyst_id IN (SELECT catalyst_id FROM again)""")
def p22(t):
    """Events that are extracted again lose their old edges and get the new ones in one version of the table."""
    old = t.relationships.groupBy("catalyst_id", "rel_type").agg(F.count("*").alias("n"))
    again = t.catalysts.where("catalyst_id % 6 = 0").select("catalyst_id")
    new = old.join(again, "catalyst_id", "left_semi").select("catalyst_id", "rel_type", (F.col("n") * 2).alias("n"), F.lit("v2").alias("prompt_version"))
    return without(old, again, ["catalyst_id"]).withColumn("prompt_version", F.lit("v1")).unionByName(new)


@query("r5_dry_run", "SELECT sector, count(*) AS would_read, count(*) FILTER (WHERE ts > DATE '2001-06-01') AS new FROM catalysts GROUP BY sector")
def r5(t):
    """What a run would read and find new, without writing."""
    return t.catalysts.groupBy("sector").agg(F.count("*").alias("would_read"), F.count_if(F.col("ts") > F.lit("2001-06-01").cast("date")).alias("new"))
