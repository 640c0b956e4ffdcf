"""Counts, sums, extremes and windows over the graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandwork.operators.endpoints import with_endpoints
from strandwork.plans.base import query
from strandwork.schema import CARD_BUCKETS
from strandwork.sources.graph_tables import AS_OF

BUCKET_SQL = "CASE rel_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CARD_BUCKETS.items()) + " ELSE 'catalyst' END"


def bucket(rel_type):
    """The kind of card that an edge makes."""
    out = F.lit("catalyst")
    for kind in dict.fromkeys(CARD_BUCKETS.values()):
        out = F.when(rel_type.isin([k for k, v in CARD_BUCKETS.items() if v == kind]), kind).otherwise(out)
    return out


@query("a1_totals", "SELECT count(*) AS total, count(*) FILTER (WHERE ts >= DATE '2001-08-01' - 7) AS last_7d FROM catalysts")
def a1(t):
    return t.catalysts.agg(F.count("*").alias("total"), F.count_if(F.col("ts") >= F.date_sub(F.lit(AS_OF), 7)).alias("last_7d"))


@query("a2_top_entity", """
SELECT e.name, count(*) AS n FROM relationships r JOIN entities e ON e.entity_id IN (r.entity_a_id, r.entity_b_id) GROUP BY e.name ORDER BY n DESC, name LIMIT 1""")
def a2(t):
    counts = with_endpoints(t.relationships.select("entity_a_id", "entity_b_id")).groupBy("entity_id").agg(F.count("*").alias("n"))
    return counts.join(t.entities.select("entity_id", "name"), "entity_id").orderBy(F.desc("n"), "name").limit(1).select("name", "n")


@query("a3_top_relation", """
SELECT rel_type, count(*) AS n FROM relationships r JOIN catalysts c USING (catalyst_id) WHERE ts >= DATE '2001-08-01' - 14 GROUP BY rel_type ORDER BY n DESC, rel_type LIMIT 1""")
def a3(t):
    recent = t.catalysts.where(F.col("ts") >= F.date_sub(F.lit(AS_OF), 14)).select("catalyst_id")
    return t.relationships.join(recent, "catalyst_id").groupBy("rel_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rel_type").limit(1)


@query("a5_alias_lists", """
SELECT type, count(*) AS n, array_to_string(list_sort(list(ticker))[1:5], ',') AS first_tickers FROM entities WHERE ticker IS NOT NULL GROUP BY type""")
def a5(t):
    """A few tickers of each type: the smallest five, kept by a bounded ranking instead of a whole list."""
    have = t.entities.where("ticker is not null")
    place = F.row_number().over(Window.partitionBy("type").orderBy("ticker"))
    few = have.withColumn("place", place).where("place <= 5").groupBy("type").agg(F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("first_tickers"))
    return have.groupBy("type").agg(F.count("*").alias("n")).join(few, "type")


@query("a6_distinct_pairs", "SELECT DISTINCT entity_a_id, rel_type FROM relationships")
def a6(t):
    return t.relationships.select("entity_a_id", "rel_type").distinct()


@query("a7_node_heat", """
WITH e AS (SELECT entity_a_id AS id, confidence FROM relationships UNION ALL SELECT entity_b_id, confidence FROM relationships)
SELECT id AS entity_id, round(sum(confidence), 4) AS heat, count(*) AS edge_count FROM e GROUP BY id""")
def a7(t):
    """Sum of the confidence of a node's edges; a self-loop counts twice."""
    ends = with_endpoints(t.relationships.select("entity_a_id", "entity_b_id", "confidence"), once=False)
    return ends.groupBy("entity_id").agg(F.round(F.sum("confidence"), 4).alias("heat"), F.count("*").alias("edge_count"))


@query("a8_relative_heat", """
WITH e AS (SELECT entity_a_id AS id, confidence FROM relationships UNION ALL SELECT entity_b_id, confidence FROM relationships),
h AS (SELECT id, sum(confidence) AS heat FROM e GROUP BY id), m AS (SELECT max(heat) AS top FROM h)
SELECT id AS entity_id, round(heat / CASE WHEN top = 0 THEN 1.0 ELSE top END, 3) AS heat FROM h, m""")
def a8(t):
    """Heat relative to the hottest node; the maximum is a scalar subquery over the same aggregate."""
    ends = with_endpoints(t.relationships.select("entity_a_id", "entity_b_id", "confidence"), once=False)
    heat = ends.groupBy("entity_id").agg(F.sum("confidence").alias("heat"))
    top = F.nullif(heat.agg(F.max("heat")).scalar(), F.lit(0.0))
    return heat.select("entity_id", F.round(F.col("heat") / F.coalesce(top, F.lit(1.0)), 3).alias("heat"))


@query("a9_card_type", f"""
WITH r AS (SELECT catalyst_id, rel_type, row_number() OVER (PARTITION BY catalyst_id ORDER BY confidence DESC, rel_type) AS place FROM relationships)
SELECT catalyst_id, {BUCKET_SQL} AS card_type FROM r WHERE place = 1""")
def a9(t):
    """The kind of a card follows its most confident edge."""
    best = t.relationships.groupBy("catalyst_id").agg(F.min_by("rel_type", F.struct(-F.col("confidence"), F.col("rel_type"))).alias("rel_type"))
    return best.select("catalyst_id", bucket(F.col("rel_type")).alias("card_type"))


@query("a10_label_counts", "SELECT sector, sentiment_label, count(*) AS n, min(ts) AS first_day, max(ts) AS last_day FROM catalysts GROUP BY sector, sentiment_label")
def a10(t):
    return t.catalysts.groupBy("sector", "sentiment_label").agg(F.count("*").alias("n"), F.min("ts").alias("first_day"), F.max("ts").alias("last_day"))


@query("a12_run_summary", """
SELECT channel, count(*) FILTER (WHERE source IN ('human', 'linkedin_verified', 'linkedin_serp_verified')) AS resolved, count(*) FILTER (WHERE source = 'abstain') AS abstained,
       count(*) FILTER (WHERE source = 'blocked') AS blocked FROM handles GROUP BY channel""")
def a12(t):
    outcome = F.when(F.col("source").isin("abstain", "blocked"), F.col("source")).otherwise("resolved")
    wide = t.handles.withColumn("outcome", outcome).groupBy("channel").pivot("outcome", ["resolved", "abstain", "blocked"])
    return wide.count().na.fill(0).withColumnRenamed("abstain", "abstained")


@query("a13_stage_funnel", """
WITH s AS (SELECT 1 AS step, 'upstream' AS stage, count(*) AS n FROM orders UNION ALL SELECT 2, 'ingested', count(*) FROM catalysts
  UNION ALL SELECT 3, 'exported', count(*) FROM catalysts WHERE significance_score >= 0.3 UNION ALL SELECT 4, 'published', count(*) FROM catalysts WHERE significance_score >= 0.6)
SELECT step, stage, n, lag(n) OVER (ORDER BY step) - n AS gap FROM s""")
def a13(t):
    """How many rows reach each stage, and what is lost on the way."""
    counts = t.catalysts.agg(F.count("*").alias("ingested"), F.count_if(F.col("significance_score") >= 0.3).alias("exported"), F.count_if(F.col("significance_score") >= 0.6).alias("published"))
    upstream = t.raw("orders").agg(F.count("*").alias("upstream"))
    key = F.lit(1).alias("key")
    both = upstream.select(key, "*").join(counts.select(key, "*"), "key")
    stages = [F.struct(F.lit(step).alias("step"), F.lit(stage).alias("stage"), F.col(stage).alias("n")) for step, stage in enumerate(["upstream", "ingested", "exported", "published"], 1)]
    rows = both.select(F.array(*stages).alias("s")).select(F.posexplode("s").alias("at", "r"), "s")
    before = F.get("s", F.col("at") - 1)["n"]
    return rows.select("r.*", (before - F.col("r.n")).alias("gap"))


@query("a14_parallel_edges", """
SELECT least(entity_a_id, entity_b_id) AS lo, greatest(entity_a_id, entity_b_id) AS hi, count(*) AS n, (count(*) - 1) / 2.0 * 40 AS widest FROM relationships GROUP BY 1, 2 HAVING count(*) > 1""")
def a14(t):
    pair = [F.least("entity_a_id", "entity_b_id").alias("lo"), F.greatest("entity_a_id", "entity_b_id").alias("hi")]
    return t.relationships.groupBy(*pair).agg(F.count("*").alias("n")).where("n > 1").withColumn("widest", (F.col("n") - 1) / F.lit(2.0) * 40)


@query("a15_node_sizes", """
WITH e AS (SELECT entity_a_id AS id FROM relationships UNION ALL SELECT entity_b_id FROM relationships), c AS (SELECT id, count(*) AS n FROM e GROUP BY id), m AS (SELECT max(n) AS top FROM c)
SELECT id AS entity_id, round(18 + 30 * (n / top), 4) AS size FROM c, m""")
def a15(t):
    counts = with_endpoints(t.relationships.select("entity_a_id", "entity_b_id"), once=False).groupBy("entity_id").agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n")).scalar()
    return counts.select("entity_id", F.round(18 + 30 * (F.col("n") / top), 4).alias("size"))


@query("a16_extraction_quality", """
WITH g AS (SELECT l.doc_id, l.quality = 1 AS right_rel, l.toxic = 0 AS right_way, d.lang, d.n_chars < 600 AS gap FROM labels l JOIN documents d USING (doc_id))
SELECT round(avg(CASE WHEN right_rel THEN 1.0 ELSE 0 END), 6) AS precision, round(avg(CASE WHEN right_way THEN 1.0 ELSE 0 END), 6) AS direction,
       round(avg(CASE WHEN gap THEN 1.0 ELSE 0 END), 6) AS vocab_gap,
       avg(CASE WHEN right_rel THEN 1.0 ELSE 0 END) >= 0.85 AND avg(CASE WHEN right_way THEN 1.0 ELSE 0 END) >= 0.90 AND avg(CASE WHEN gap THEN 1.0 ELSE 0 END) <= 0.10 AS passes FROM g""", base=False)
def a16(t):
    """Precision, direction accuracy and vocabulary gap of labelled edges, and whether they pass the gates."""
    gold = t.raw("labels").join(t.raw("documents").select("doc_id", "n_chars"), "doc_id")
    rate = lambda c: F.avg(c.cast("double"))
    rates = gold.agg(rate(F.col("quality") == 1).alias("precision"), rate(F.col("toxic") == 0).alias("direction"), rate(F.col("n_chars") < 600).alias("vocab_gap"))
    passes = (F.col("precision") >= 0.85) & (F.col("direction") >= 0.90) & (F.col("vocab_gap") <= 0.10)
    return rates.select(*[F.round(c, 6).alias(c) for c in rates.columns], passes.alias("passes"))


@query("a17_weekly_pulse", """
SELECT c.sector, count(DISTINCT c.catalyst_id) FILTER (WHERE ts > DATE '2001-07-25') AS catalysts, count(*) FILTER (WHERE ts > DATE '2001-07-25') AS new_edges,
       count(*) FILTER (WHERE ts > DATE '2001-07-18' AND ts <= DATE '2001-07-25') AS edges_before FROM catalysts c JOIN relationships r USING (catalyst_id)
WHERE ts > DATE '2001-07-18' GROUP BY c.sector""")
def a17(t):
    recent = t.catalysts.where("ts > date'2001-07-18'").select("catalyst_id", "sector", (F.col("ts") > F.lit("2001-07-25").cast("date")).alias("now"))
    per = t.relationships.groupBy("catalyst_id").agg(F.count("*").alias("n")).join(recent, "catalyst_id")
    sums = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return per.groupBy("sector").agg(F.count_if("now").alias("catalysts"), sums(F.col("now")).alias("new_edges"), sums(~F.col("now")).alias("edges_before"))


@query("a18_daily_edges", "SELECT ts, rel_type, count(*) AS n FROM relationships JOIN catalysts USING (catalyst_id) GROUP BY ts, rel_type")
def a18(t):
    return t.relationships.select("catalyst_id", "rel_type").join(t.catalysts.select("catalyst_id", "ts"), "catalyst_id").groupBy("ts", "rel_type").agg(F.count("*").alias("n"))


@query("a19_log_checks", r"""
WITH l AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'ROB-1' ELSE concat('ROB-', strftime(ts, '%m%d%y'), '-', lpad(CAST(event_id % 40 AS VARCHAR), 3, '0')) END AS id,
  CASE WHEN event_id % 33 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS d FROM events),
p AS (SELECT *, lag(d) OVER (ORDER BY event_id) AS before, count(*) OVER (PARTITION BY id) AS same FROM l)
SELECT count(*) FILTER (WHERE same > 1) AS duplicate_ids, count(*) FILTER (WHERE NOT regexp_full_match(id, '[A-Z]{3}-[0-9]{6}-[0-9]{3,}')) AS malformed_ids,
       count(*) FILTER (WHERE d IS NULL) AS missing_dates, count(*) FILTER (WHERE d < before) AS out_of_order FROM p""", base=False)
def a19(t):
    """Checks of a log: repeated and malformed ids, missing dates, dates that run backwards.

    Order is checked within slices of the log and across their edges, so no task gets the whole log.
    """
    e = F.col("event_id")
    number = F.concat(F.lit("ROB-"), F.date_format("ts", "MMddyy"), F.lit("-"), F.format_string("%03d", e % 40))
    log = t.raw("events").select("event_id", F.when(e % 50 == 0, "ROB-1").otherwise(number).alias("id"), F.when(e % 33 != 0, F.col("ts").cast("date")).alias("d"))
    per_id = log.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_ids"))
    width = 4096
    slices = log.withColumn("s", F.floor(e / width))
    edge = slices.groupBy("s").agg(F.max_by("d", "event_id").alias("last"))
    edge = edge.select((F.col("s") + 1).alias("s"), "last")
    before = F.lag("d").over(Window.partitionBy("s").orderBy("event_id"))
    first = F.row_number().over(Window.partitionBy("s").orderBy("event_id")) == 1
    seen = slices.withColumn("b", before).withColumn("f", first).join(edge, "s", "left").withColumn("before", F.when(F.col("f"), F.col("last")).otherwise(F.col("b")))
    counts = seen.agg(F.count_if(~F.col("id").rlike("^[A-Z]{3}-[0-9]{6}-[0-9]{3,}$")).alias("malformed_ids"), F.count_if(F.col("d").isNull()).alias("missing_dates"), F.count_if(F.col("d") < F.col("before")).alias("out_of_order"))
    one = F.lit(1).alias("one")
    return per_id.select(one, "duplicate_ids").join(counts.select(one, "*"), "one").drop("one")


@query("a20_gaps", """
SELECT (SELECT count(*) FROM catalysts) - (SELECT count(*) FROM catalysts WHERE catalyst_id % 3 = 0) AS without_image,
       (SELECT count(*) FROM catalysts WHERE significance_score >= 0.5) - (SELECT count(*) FROM catalysts WHERE significance_score >= 0.5 AND catalyst_id % 2 = 0) AS not_exported""")
def a20(t):
    k, strong = F.col("catalyst_id"), F.col("significance_score") >= 0.5
    return t.catalysts.agg(F.count_if(k % 3 != 0).alias("without_image"), F.count_if(strong & (k % 2 != 0)).alias("not_exported"))


@query("w1_numbered_ids", """
SELECT o_orderkey, row_number() OVER (PARTITION BY c_mktsegment, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS nth FROM orders JOIN customer ON o_custkey = c_custkey""", base=False)
def w1(t):
    rows = t.raw("orders").join(t.raw("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    nth = F.row_number().over(Window.partitionBy("c_mktsegment", F.col("o_orderdate").cast("date")).orderBy("o_orderkey"))
    return rows.select("o_orderkey", nth.cast("long").alias("nth"))


@query("w2_top_edge", """
SELECT catalyst_id, rel_type, entity_a_id, round(confidence, 6) AS confidence FROM relationships
QUALIFY row_number() OVER (PARTITION BY catalyst_id ORDER BY confidence DESC, rel_type, entity_a_id, l_partkey, l_linenumber, ship_date) = 1""")
def w2(t):
    """The most confident edge of each event: an aggregate that combines on the map side, not a sort of every group."""
    row = F.struct("rel_type", "entity_a_id", "confidence")
    order = F.struct(-F.col("confidence"), F.col("rel_type"), F.col("entity_a_id"), F.col("l_partkey"), F.col("l_linenumber"), F.col("ship_date"))
    best = t.relationships.groupBy("catalyst_id").agg(F.min_by(row, order).alias("r"))
    return best.select("catalyst_id", "r.rel_type", "r.entity_a_id", F.round("r.confidence", 6).alias("confidence"))


@query("w3_fan_out", """
WITH p AS (SELECT least(entity_a_id, entity_b_id) AS lo, greatest(entity_a_id, entity_b_id) AS hi, catalyst_id, rel_type, l_linenumber, l_partkey, ship_date, confidence FROM relationships),
n AS (SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY catalyst_id, rel_type, l_linenumber, l_partkey, ship_date, confidence) - 1 AS i, count(*) OVER (PARTITION BY lo, hi) AS n FROM p)
SELECT lo, hi, catalyst_id, i, (i - (n - 1) / 2.0) * 40 AS bend FROM n""")
def w3(t):
    """Parallel edges bend to either side of the straight line."""
    pairs = t.relationships.withColumns({"lo": F.least("entity_a_id", "entity_b_id"), "hi": F.greatest("entity_a_id", "entity_b_id")})
    w = Window.partitionBy("lo", "hi")
    i = F.row_number().over(w.orderBy("catalyst_id", "rel_type", "l_linenumber", "l_partkey", "ship_date", "confidence")) - 1
    return pairs.select("lo", "hi", "catalyst_id", i.cast("long").alias("i"), F.count("*").over(w).alias("n")).select("lo", "hi", "catalyst_id", "i", ((F.col("i") - (F.col("n") - 1) / F.lit(2.0)) * 40).alias("bend"))


@query("w5_circuit_breaker", """
WITH e AS (SELECT user_id, event_id, event_type = 'error' AS blocked FROM events),
g AS (SELECT *, sum(CASE WHEN blocked THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e),
s AS (SELECT *, count(*) FILTER (WHERE blocked) OVER (PARTITION BY user_id, island ORDER BY event_id) AS streak FROM g)
SELECT user_id, min(event_id) AS opened_at FROM s WHERE blocked AND streak >= 3 GROUP BY user_id""", base=False)
def w5(t):
    """Where a run of three blocked attempts opens the breaker: gaps and islands over a replayed log."""
    log = t.raw("events").select("user_id", "event_id", (F.col("event_type") == "error").alias("blocked"))
    island = F.sum((~F.col("blocked")).cast("int")).over(Window.partitionBy("user_id").orderBy("event_id"))
    streak = F.count_if("blocked").over(Window.partitionBy("user_id", "island").orderBy("event_id"))
    seen = log.withColumn("island", island).withColumn("streak", streak)
    return seen.where("blocked and streak >= 3").groupBy("user_id").agg(F.min("event_id").alias("opened_at"))


@query("w6_straggler_probe", """
WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS won, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
  coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wins FROM events)
SELECT user_id, count(*) FILTER (WHERE n <= 5 OR wins > 0) AS tried, count(*) FILTER (WHERE NOT (n <= 5 OR wins > 0)) AS deferred FROM e GROUP BY user_id""", base=False)
def w6(t):
    """After five attempts without a win the rest is deferred."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    wins = F.coalesce(F.sum((F.col("event_type") == "purchase").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goes = (F.row_number().over(w) <= 5) | (wins > 0)
    seen = t.raw("events").select("user_id", goes.alias("goes"))
    return seen.groupBy("user_id").agg(F.count_if("goes").alias("tried"), F.count_if(~F.col("goes")).alias("deferred"))
