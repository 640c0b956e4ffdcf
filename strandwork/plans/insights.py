"""Detectors over time: chokepoints, narrative velocity, pairs that form and break, lifecycle, duplicate events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandwork.functions import text as tx
from strandwork.functions.numbers import clamped
from strandwork.operators.components import connected_components
from strandwork.operators.cosine_join import upstream_dropped
from strandwork.operators.same_event import alike, by_rarity, event_key, reported_again
from strandwork.plans.base import query
from strandwork.schema import CARD_BUCKETS
from strandwork.session import settled
from strandwork.sources.graph_tables import AS_OF


def dated_edges(t, *columns: str):
    """Edges with the day of their event."""
    return t.relationships.select("catalyst_id", *columns).join(t.catalysts.select("catalyst_id", "ts", "sector"), "catalyst_id")


def days_ago(n: int):
    return F.date_sub(F.lit(AS_OF), n)


@query("w8_narrative_velocity", """
WITH e AS (SELECT sector, rel_type, ts FROM relationships JOIN catalysts USING (catalyst_id)),
c AS (SELECT sector, rel_type, count(*) FILTER (WHERE ts > DATE '2001-08-01' - 30) AS current_30d, count(*) FILTER (WHERE ts <= DATE '2001-08-01' - 30) / 3.0 AS baseline FROM e WHERE ts > DATE '2001-08-01' - 120 GROUP BY 1, 2)
SELECT sector, rel_type, current_30d, round(baseline, 4) AS baseline, CASE WHEN baseline > 0 THEN round((current_30d - baseline) / baseline, 4) END AS change,
       CASE WHEN current_30d > baseline THEN 'up' WHEN current_30d < baseline THEN 'down' ELSE 'flat' END AS direction FROM c""")
def w8(t):
    """Edges of the last 30 days against the mean of the three periods before."""
    e = dated_edges(t, "rel_type").where(F.col("ts") > days_ago(120))
    now = F.col("ts") > days_ago(30)
    c = e.groupBy("sector", "rel_type").agg(F.count_if(now).alias("current_30d"), (F.count_if(~now) / F.lit(3.0)).alias("base"))
    change = F.when(F.col("base") > 0, F.round((F.col("current_30d") - F.col("base")) / F.col("base"), 4))
    way = F.when(F.col("current_30d") > F.col("base"), "up").when(F.col("current_30d") < F.col("base"), "down").otherwise("flat")
    return c.select("sector", "rel_type", "current_30d", F.round("base", 4).alias("baseline"), change.alias("change"), way.alias("direction"))


@query("w9_chokepoints", """
WITH e AS (SELECT entity_b_id, entity_a_id, ts FROM relationships JOIN catalysts USING (catalyst_id) WHERE ts > DATE '2001-08-01' - 600),
c AS (SELECT entity_b_id, count(DISTINCT entity_a_id) FILTER (WHERE ts > DATE '2001-08-01' - 300) AS cur, count(DISTINCT entity_a_id) FILTER (WHERE ts <= DATE '2001-08-01' - 300) AS prev FROM e GROUP BY 1)
SELECT e.name, cur, prev, round(cur / greatest(prev, 1), 4) AS growth FROM c JOIN entities e ON e.entity_id = entity_b_id WHERE cur >= 3 ORDER BY round(cur / greatest(prev, 1), 4) DESC, cur DESC, name LIMIT 50""")
def w9(t):
    """Entities that more and more others point to: distinct sources in a window against the one before.

    Sources are made distinct per window first, so a hub's edges combine before they meet.
    """
    now = (F.col("ts") > days_ago(300)).alias("now")
    e = dated_edges(t, "entity_a_id", "entity_b_id").where(F.col("ts") > days_ago(600)).select("entity_b_id", "entity_a_id", now).distinct()
    c = e.groupBy("entity_b_id").agg(F.count_if("now").alias("cur"), F.count_if(~F.col("now")).alias("prev")).where("cur >= 3")
    growth = F.round(F.col("cur") / F.greatest("prev", F.lit(1)), 4)
    named = c.join(t.entities.select(F.col("entity_id").alias("entity_b_id"), "name"), "entity_b_id")
    return named.select("name", "cur", "prev", growth.alias("growth")).orderBy(F.desc("growth"), F.desc("cur"), "name").limit(50)


@query("w10_pair_breaks", """
WITH e AS (SELECT least(entity_a_id, entity_b_id) AS lo, greatest(entity_a_id, entity_b_id) AS hi, ts FROM relationships JOIN catalysts USING (catalyst_id)),
c AS (SELECT lo, hi, count(*) FILTER (WHERE ts > DATE '2001-08-01' - 180) AS cur, count(*) FILTER (WHERE ts <= DATE '2001-08-01' - 180) AS before FROM e GROUP BY 1, 2)
SELECT lo, hi, cur, before, CASE WHEN before = 0 THEN 'new' ELSE 'broken' END AS kind FROM c WHERE (cur > 0 AND before = 0) OR (cur = 0 AND before >= 8)""")
def w10(t):
    """Pairs that are new in the window, or were frequent and are gone: one pass with conditional counts."""
    e = dated_edges(t, "entity_a_id", "entity_b_id")
    now = F.col("ts") > days_ago(180)
    c = e.groupBy(F.least("entity_a_id", "entity_b_id").alias("lo"), F.greatest("entity_a_id", "entity_b_id").alias("hi")).agg(F.count_if(now).alias("cur"), F.count_if(~now).alias("before"))
    kind = F.when((F.col("cur") > 0) & (F.col("before") == 0), "new").when((F.col("cur") == 0) & (F.col("before") >= 8), "broken")
    return c.withColumn("kind", kind).where("kind is not null")


@query("p25_insights", """
WITH e AS (SELECT rel_type, ts FROM relationships JOIN catalysts USING (catalyst_id))
SELECT 'velocity' AS kind, rel_type AS subject, count(*) FILTER (WHERE ts > DATE '2001-08-01' - 30) - count(*) FILTER (WHERE ts > DATE '2001-08-01' - 60 AND ts <= DATE '2001-08-01' - 30) AS score FROM e GROUP BY rel_type""")
def p25(t):
    e = dated_edges(t, "rel_type").groupBy("rel_type")
    counts = e.agg((F.count_if(F.col("ts") > days_ago(30)) - F.count_if((F.col("ts") > days_ago(60)) & (F.col("ts") <= days_ago(30)))).alias("score"))
    return counts.select(F.lit("velocity").alias("kind"), F.col("rel_type").alias("subject"), "score")


#: How many of each kind are told.
TOLD = 10


@query("p25_graph_insights", f"""
WITH d AS (SELECT sector, rel_type, entity_a_id, entity_b_id, ts FROM relationships JOIN catalysts USING (catalyst_id)),
k AS (SELECT entity_b_id, count(DISTINCT entity_a_id) FILTER (WHERE ts > DATE '2001-08-01' - 300) AS cur, count(DISTINCT entity_a_id) FILTER (WHERE ts <= DATE '2001-08-01' - 300) AS prev FROM d WHERE ts > DATE '2001-08-01' - 600 GROUP BY 1),
v AS (SELECT sector, rel_type, count(*) FILTER (WHERE ts > DATE '2001-08-01' - 30) AS cur, count(*) FILTER (WHERE ts <= DATE '2001-08-01' - 30) / 3.0 AS base FROM d WHERE ts > DATE '2001-08-01' - 120 GROUP BY 1, 2),
b AS (SELECT least(entity_a_id, entity_b_id) AS lo, greatest(entity_a_id, entity_b_id) AS hi, count(*) FILTER (WHERE ts > DATE '2001-08-01' - 180) AS cur, count(*) FILTER (WHERE ts <= DATE '2001-08-01' - 180) AS before FROM d GROUP BY 1, 2),
u AS (SELECT 'chokepoint' AS kind, name AS subject, round(cur / greatest(prev, 1), 4) AS score, concat(name, ': ', cur, ' sources, ', prev, ' before') AS headline FROM k JOIN entities ON entity_id = entity_b_id WHERE cur >= 3
  UNION ALL SELECT 'velocity', concat(sector, '/', rel_type), round((cur - base) / base, 4), concat(rel_type, ' in ', sector, ': ', cur, ' in 30 days') FROM v WHERE base > 0 AND cur > base
  UNION ALL SELECT 'cluster_break', concat(x.name, ' + ', y.name), CAST(greatest(cur, before) AS DOUBLE), CASE WHEN before = 0 THEN 'new pair' ELSE 'pair has stopped' END FROM b JOIN entities x ON x.entity_id = lo JOIN entities y ON y.entity_id = hi WHERE (cur > 0 AND before = 0) OR (cur = 0 AND before >= 8))
SELECT * FROM (SELECT kind, subject, score, headline, row_number() OVER (PARTITION BY kind ORDER BY score DESC, subject) AS place FROM u) z WHERE place <= {TOLD}""")
def p25_all(t):
    """What the graph is told to show, the strongest of each kind: chokepoints by growth, relations that speed up, and pairs
    that have formed or stopped."""
    named = t.entities.select("entity_id", "name")
    e = dated_edges(t, "entity_a_id", "entity_b_id").where(F.col("ts") > days_ago(600)).select("entity_b_id", "entity_a_id", (F.col("ts") > days_ago(300)).alias("now")).distinct()
    c = e.groupBy("entity_b_id").agg(F.count_if("now").alias("cur"), F.count_if(~F.col("now")).alias("prev")).where("cur >= 3").join(named.withColumnRenamed("entity_id", "entity_b_id"), "entity_b_id")
    growth = F.round(F.col("cur") / F.greatest("prev", F.lit(1)), 4)
    chokepoints = c.select(F.lit("chokepoint").alias("kind"), F.col("name").alias("subject"), growth.alias("score"), F.concat("name", F.lit(": "), F.col("cur").cast("string"), F.lit(" sources, "), F.col("prev").cast("string"), F.lit(" before")).alias("headline"))
    v = w8(t).where("direction = 'up' and change is not null")
    velocity = v.select(F.lit("velocity").alias("kind"), F.concat("sector", F.lit("/"), "rel_type").alias("subject"), F.col("change").alias("score"), F.concat("rel_type", F.lit(" in "), "sector", F.lit(": "), F.col("current_30d").cast("string"), F.lit(" in 30 days")).alias("headline"))
    b = w10(t).join(named.toDF("lo", "lo_name"), "lo").join(named.toDF("hi", "hi_name"), "hi")
    pairs = b.select(F.lit("cluster_break").alias("kind"), F.concat("lo_name", F.lit(" + "), "hi_name").alias("subject"), F.greatest("cur", "before").cast("double").alias("score"), F.when(F.col("kind") == "new", "new pair").otherwise("pair has stopped").alias("headline"))
    told = [kind.orderBy(F.desc("score"), "subject").limit(TOLD) for kind in (chokepoints, velocity, pairs)]
    every = told[0].unionByName(told[1]).unionByName(told[2])
    return every.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "subject")))


@query("p26_lifecycle", """
WITH e AS (SELECT least(entity_a_id, entity_b_id) AS lo, greatest(entity_a_id, entity_b_id) AS hi, ship_date, confidence, status, catalyst_id, l_linenumber, l_partkey FROM relationships),
n AS (SELECT *, max(ship_date) OVER (PARTITION BY lo, hi) AS last_seen FROM e)
SELECT catalyst_id, l_linenumber, l_partkey, CASE WHEN status = 'active' AND ship_date < DATE '2001-08-01' - 90 AND last_seen = ship_date THEN 'stale' ELSE status END AS status,
       round(CASE WHEN last_seen > ship_date THEN least(1.0, confidence + 0.15) WHEN status = 'invalidated' THEN greatest(0.0, confidence - 0.30) ELSE confidence END, 6) AS confidence FROM n""")
def p26(t):
    """Old active edges that nothing on their pair followed go stale; followed ones gain, invalidated ones lose confidence."""
    pair = [F.least("entity_a_id", "entity_b_id"), F.greatest("entity_a_id", "entity_b_id")]
    e = t.relationships.withColumn("last_seen", F.max("ship_date").over(Window.partitionBy(*pair)))
    stale = (F.col("status") == "active") & (F.col("ship_date") < days_ago(90)) & (F.col("last_seen") == F.col("ship_date"))
    c = F.col("confidence")
    new = F.when(F.col("last_seen") > F.col("ship_date"), clamped(c + 0.15)).when(F.col("status") == "invalidated", clamped(c - 0.30)).otherwise(c)
    return e.select("catalyst_id", "l_linenumber", "l_partkey", F.when(stale, "stale").otherwise(F.col("status")).alias("status"), F.round(new, 6).alias("confidence"))


def event_classes(t):
    """``catalyst_id, event``: events of one day with the same entities and words are one class, named by its smallest; and
    ``event, ts, ids, words`` of each class, its entities from the rarest to the most frequent."""
    ends = t.relationships.select("catalyst_id", F.explode(F.array("entity_a_id", "entity_b_id")).alias("entity_id")).distinct()
    ends = ends.join(ends.groupBy("entity_id").agg(F.count("*").alias("n")), "entity_id")
    sets = ends.groupBy("catalyst_id").agg(F.array_sort(F.collect_list(F.struct("n", "entity_id"))).alias("ids"))
    words = F.array_sort(tx.context_terms(F.regexp_replace("headline", "order [0-9]+", "order")))
    events = t.catalysts.select("catalyst_id", "ts", words.alias("words")).join(sets, "catalyst_id").withColumn("ids", F.transform("ids", lambda x: x["entity_id"]))
    found = events.groupBy("ts", "ids", "words").agg(F.min("catalyst_id").alias("event"))
    return events.join(found, ["ts", "ids", "words"]).select("catalyst_id", "event"), found


def same_events(classes, least_shared: int = 2, overlap: float = 0.7):
    """Pairs of classes that share entities on one day and most of their words, by the index of ``operators.same_event``:
    a class has entries for its entities but the most frequent, each with its words, so that neither an entity of every
    event nor a word of every headline makes pairs of all events."""
    classes = settled(classes)
    rare = by_rarity(classes, "event", "words")
    days = classes.select(F.col("event").alias("class"), F.unix_date("ts").alias("bucket"), "ids").join(rare.withColumnRenamed("event", "class"), "class")
    return alike(days, least_shared, overlap, (0,)).where("a < b")


WORDS_SQL = r"""
n AS (SELECT entity_id, count(*) AS n FROM (SELECT DISTINCT catalyst_id, unnest([entity_a_id, entity_b_id]) AS entity_id FROM relationships) GROUP BY 1),
s AS (SELECT catalyst_id, list(entity_id ORDER BY n, entity_id) AS ids FROM (SELECT DISTINCT catalyst_id, unnest([entity_a_id, entity_b_id]) AS entity_id FROM relationships) JOIN n USING (entity_id) GROUP BY 1),
w AS (SELECT catalyst_id, ts, ids, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(regexp_replace(headline, 'order [0-9]+', 'order')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 3))) AS words
  FROM catalysts JOIN s USING (catalyst_id)),
cls AS (SELECT ts, ids, words, min(catalyst_id) AS event FROM w GROUP BY 1, 2, 3)
"""
PAIRS_SQL = f"""
{WORDS_SQL.strip()},
pairs AS (SELECT a.event AS a, b.event AS b FROM cls a JOIN cls b ON a.ts = b.ts AND a.event < b.event
  WHERE len(list_intersect(a.ids, b.ids)) >= 2 AND len(list_intersect(a.words, b.words)) >= 0.7 * least(len(a.words), len(b.words)))
"""


@query("p27_duplicate_events", f"WITH {PAIRS_SQL.strip()} SELECT a, b FROM pairs")
def p27(t):
    return same_events(event_classes(t)[1])


@query("p27_event_classes", f"WITH {WORDS_SQL.strip()} SELECT catalyst_id, event FROM w JOIN cls USING (ts, ids, words)")
def p27_classes(t):
    """The class of every event, which the pairs are between."""
    return event_classes(t)[0]


@query("p27_event_groups", f"""
WITH RECURSIVE {PAIRS_SQL.strip()},
ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT a AS event, a AS root FROM ways UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.event),
roots AS (SELECT event, min(root) AS root FROM reach GROUP BY 1),
every AS (SELECT coalesce(r.root, w2.event) AS event, w2.catalyst_id FROM (SELECT catalyst_id, event FROM w JOIN cls USING (ts, ids, words)) w2 LEFT JOIN roots r ON r.event = w2.event)
SELECT event, count(*) AS copies FROM every GROUP BY 1 HAVING count(*) > 1""")
def p27_groups(t):
    """Groups of duplicate events, copies and all that pairs of classes reach, named by their smallest member."""
    members, classes = event_classes(t)
    roots = connected_components(same_events(classes))
    grouped = members.join(roots, F.col("event") == F.col("node"), "left").select(F.coalesce("root", "event").alias("event"))
    return grouped.groupBy("event").agg(F.count("*").alias("copies")).where("copies > 1")


def told_events(t):
    """Events with entities, the words of their headlines, and a key of primary entity, type and a rounded amount."""
    ends = t.relationships.select("catalyst_id", F.explode(F.array("entity_a_id", "entity_b_id")).alias("e"))
    edges = t.relationships.groupBy("catalyst_id").agg(F.min("rel_type").alias("type"))
    sets = ends.groupBy("catalyst_id").agg(F.collect_set("e").alias("ids"))
    thousands = F.round(F.col("o_totalprice") / 50000).cast("int") * 50
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" for $"), thousands.cast("string"), F.lit("K"))).otherwise(F.concat(F.lit(" for $"), F.format_number(thousands * 1000, 0)))
    prices = t.raw("orders").select(F.col("o_orderkey").alias("catalyst_id"), said.alias("said"))
    words = tx.context_terms(F.regexp_replace("headline", "order [0-9]+", "order"))
    rows = t.catalysts.select("catalyst_id", "ts", "headline", words.alias("words")).join(prices, "catalyst_id").join(edges, "catalyst_id").join(sets, "catalyst_id").join(p31(t), "catalyst_id")
    return rows.select(F.col("catalyst_id").alias("event_id"), F.unix_date("ts").alias("day"), "ids", "words", event_key(F.col("entity_a_id"), F.col("type"), F.concat("headline", "said")).alias("key"))


@query("p27_reported_again", """
WITH d AS (SELECT catalyst_id, entity_a_id FROM (SELECT catalyst_id, entity_a_id, sum(confidence * impact_magnitude) AS w FROM relationships GROUP BY 1, 2) x
  QUALIFY row_number() OVER (PARTITION BY catalyst_id ORDER BY round(w, 6) DESC, entity_a_id) = 1),
n AS (SELECT DISTINCT catalyst_id, unnest([entity_a_id, entity_b_id]) AS e FROM relationships),
y AS (SELECT catalyst_id, min(rel_type) AS type FROM relationships GROUP BY 1),
v AS (SELECT catalyst_id, ts, subject, concat(entity_a_id, ':', type, ':', CAST(round(o_totalprice / 50000) AS INT)) AS key FROM catalysts JOIN orders ON o_orderkey = catalyst_id JOIN y USING (catalyst_id) JOIN d USING (catalyst_id)),
m AS (SELECT a.catalyst_id AS event_id, b.catalyst_id AS earlier FROM n a JOIN n b ON a.e = b.e AND a.catalyst_id <> b.catalyst_id JOIN v x ON x.catalyst_id = a.catalyst_id JOIN v z ON z.catalyst_id = b.catalyst_id
  WHERE x.subject = z.subject AND x.ts - z.ts BETWEEN 0 AND 45 AND (z.ts < x.ts OR b.catalyst_id < a.catalyst_id) GROUP BY 1, 2 HAVING count(*) >= 2),
l AS (SELECT event_id, arg_max(earlier, date_diff('day', DATE '1970-01-01', ts) * 100000000 + earlier) AS earlier FROM m JOIN v ON v.catalyst_id = earlier GROUP BY event_id)
SELECT event_id, earlier, CASE WHEN a.key = b.key THEN 'supersedes' ELSE 'follows_from' END AS link FROM l JOIN v a ON a.catalyst_id = event_id JOIN v b ON b.catalyst_id = earlier""")
def p27_again(t):
    """Events that one of the 45 days before has reported, by shared entities and words; headlines name their customer, so
    most of their words are the same only where that is."""
    return reported_again(told_events(t))


@query("p28_upstream_dedup", """
SELECT url, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY url""", base=False)
def p28(t):
    """The first layer of upstream dedup: one page for each address."""
    return t.raw("pages").groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


def reported(t):
    """Documents as findings: their first words are the title, every fifth has no address and some share one; capitalised
    words are names."""
    text, d = F.coalesce("text", F.lit("")), F.col("doc_id")
    bare = F.regexp_replace(text, "[.,;:!?]", "")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.regexp_extract_all(F.translate(bare, capitals, capitals.lower()), F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    names = F.filter(F.regexp_extract_all(bare, F.lit(r"([^\x20\x09-\x0D]+)"), 1), lambda w: w.rlike("^[A-Z][a-z]{4,}$"))
    url = F.when(d % 5 != 0, F.concat(F.lit("https://news.example/"), (d - F.when(d % 41 == 3, 1).otherwise(0)).cast("string")))
    return t.raw("documents").select(d.alias("finding_id"), F.substring(text, 1, 60).alias("title"), url.alias("url"), words.alias("words"), names.alias("entities"))


def _alike_sql(name: str, column: str, weight: str, least: int) -> str:
    """CTEs that give the smallest earlier finding alike by the terms of ``column``, from all pairs that share one."""
    return f"""
{name}_t AS (SELECT finding_id, term, count(*) AS n FROM (SELECT finding_id, unnest({column}) AS term FROM f) GROUP BY 1, 2),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_t GROUP BY 1),
{name}_r AS (SELECT finding_id, term, {weight} AS w FROM {name}_t JOIN {name}_d USING (term), (SELECT count(DISTINCT finding_id) AS rows FROM {name}_t)),
{name}_v AS (SELECT finding_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY finding_id)) AS w FROM {name}_r),
{name}_p AS (SELECT a.finding_id AS a, b.finding_id AS b, round(sum(a.w * b.w), 6) AS score FROM {name}_v a JOIN {name}_v b ON a.term = b.term AND a.finding_id < b.finding_id GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 6) >= 0.8 AND count(*) >= {least}),
{name} AS (SELECT b AS finding_id, min(a) AS matched_id, arg_min(score, a) AS score FROM {name}_p GROUP BY b)"""


@query("p28_upstream_dropped", rf"""
WITH f AS (SELECT doc_id AS finding_id, substring(text, 1, 60) AS title, CASE WHEN doc_id % 5 <> 0 THEN concat('https://news.example/', CAST(doc_id - CASE WHEN doc_id % 41 = 3 THEN 1 ELSE 0 END AS VARCHAR)) END AS url,
  regexp_extract_all(translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words, list_distinct(list_filter(regexp_extract_all(bare, '[^\x20\x09-\x0D]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{4,}}'))) AS entities
  FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[.,;:!?]', '', 'g') AS bare FROM documents) x),
u AS (SELECT finding_id, first AS matched_id FROM f JOIN (SELECT url, min(finding_id) AS first FROM f WHERE url IS NOT NULL GROUP BY url) USING (url) WHERE first < finding_id),
{_alike_sql("words", "words", "n * (ln((1.0 + rows) / (1.0 + df)) + 1)", 1).strip()},
{_alike_sql("names", "entities", "1.0::DOUBLE", 2).strip()}
SELECT f.finding_id, title, coalesce(u.matched_id, words.matched_id, names.matched_id) AS matched_id, CASE WHEN u.matched_id IS NOT NULL THEN 'url_match' WHEN words.matched_id IS NOT NULL THEN 'tfidf_match' ELSE 'entity_overlap' END AS reason,
  CASE WHEN u.matched_id IS NULL THEN words.score END AS tfidf, CASE WHEN u.matched_id IS NULL AND words.matched_id IS NULL THEN names.score END AS entity
FROM f LEFT JOIN u USING (finding_id) LEFT JOIN words USING (finding_id) LEFT JOIN names USING (finding_id) WHERE coalesce(u.matched_id, words.matched_id, names.matched_id) IS NOT NULL""", base=False)
def p28_dropped(t):
    """All three layers, over documents as findings: what is dropped, and as whose copy."""
    return upstream_dropped(reported(t))


@query("p29_sentiment_scores", """
WITH s AS (SELECT catalyst_id, CASE sentiment_label WHEN 'Very Bullish' THEN 2 WHEN 'Bullish' THEN 1 WHEN 'Neutral' THEN 0 WHEN 'Bearish' THEN -1 ELSE -2 END AS w FROM catalysts)
SELECT entity_a_id AS entity_id, round(sum(w * confidence), 4) AS score FROM relationships JOIN s USING (catalyst_id) GROUP BY entity_a_id""")
def p29(t):
    weight = F.col("sentiment_label")
    w = F.when(weight == "Very Bullish", 2).when(weight == "Bullish", 1).when(weight == "Neutral", 0).when(weight == "Bearish", -1).otherwise(-2)
    rows = t.relationships.select("catalyst_id", "entity_a_id", "confidence").join(t.catalysts.select("catalyst_id", w.alias("w")), "catalyst_id")
    return rows.groupBy(F.col("entity_a_id").alias("entity_id")).agg(F.round(F.sum(F.col("w") * F.col("confidence")), 4).alias("score"))


#: What a relation says of its two ends: alike, or one against the other; the rest says nothing.
COLLABORATIVE = [r for r, b in CARD_BUCKETS.items() if b in ("partnership", "deal", "technical")]
ADVERSARIAL = [r for r, b in CARD_BUCKETS.items() if b in ("competitive", "regulatory")]


@query("p29_entity_sentiment", f"""
WITH s AS (SELECT catalyst_id, catalyst_id % 2 = 0 AS named, CASE WHEN catalyst_id % 7 = 0 THEN NULL ELSE CASE sentiment_label WHEN 'Very Bullish' THEN 2 WHEN 'Bullish' THEN 1 WHEN 'Neutral' THEN 0 WHEN 'Bearish' THEN -1 ELSE -2 END END AS w FROM catalysts),
e AS (SELECT r.entity_a_id, r.entity_b_id, confidence, confidence * coalesce(w, 0) AS c, named, CASE WHEN rel_type IN ({', '.join(repr(r) for r in COLLABORATIVE)}) THEN 1 WHEN rel_type IN ({', '.join(repr(r) for r in ADVERSARIAL)}) THEN -1 ELSE 0 END AS polarity FROM relationships r JOIN s USING (catalyst_id)),
x AS (SELECT entity_a_id AS entity_id, confidence, CASE WHEN named THEN 0 ELSE c * 0.5 * abs(polarity) END AS sentiment FROM e UNION ALL SELECT entity_b_id, confidence, CASE WHEN named THEN c ELSE c * 0.5 * polarity END FROM e)
SELECT entity_id, round(sum(confidence), 4) AS heat, round(sum(sentiment), 4) AS sentiment, round(sum(confidence + sentiment), 4) AS score FROM x GROUP BY entity_id""")
def p29_both_ends(t):
    """Heat of an entity's edges and the sentiment that falls to it. Where a finding names whose sentiment it is (here those
    with an even number do, their customer), it is that one's; otherwise a collaborative relation gives each end half, an
    adversarial one takes from the end that it is against, and others give none. A finding without sentiment is heat alone."""
    label, even = F.col("sentiment_label"), F.col("catalyst_id") % 2 == 0
    w = F.when(label == "Very Bullish", 2).when(label == "Bullish", 1).when(label == "Neutral", 0).when(label == "Bearish", -1).otherwise(-2)
    said = t.catalysts.select("catalyst_id", even.alias("named"), F.when(F.col("catalyst_id") % 7 != 0, w).alias("w"))
    polarity = F.when(F.col("rel_type").isin(COLLABORATIVE), 1).when(F.col("rel_type").isin(ADVERSARIAL), -1).otherwise(0)
    edges = t.relationships.select("catalyst_id", "entity_a_id", "entity_b_id", "confidence", polarity.alias("polarity")).join(said, "catalyst_id")
    c = F.col("confidence") * F.coalesce("w", F.lit(0))
    ends = F.array(
        F.struct(F.col("entity_a_id").alias("entity_id"), F.when(F.col("named"), 0.0).otherwise(c * 0.5 * F.abs("polarity")).alias("sentiment")),
        F.struct(F.col("entity_b_id").alias("entity_id"), F.when(F.col("named"), c).otherwise(c * 0.5 * F.col("polarity")).alias("sentiment")),
    )
    each = edges.select("confidence", F.explode(ends).alias("x")).select("confidence", "x.*")
    sums = [F.round(F.sum(v), 4).alias(n) for n, v in (("heat", F.col("confidence")), ("sentiment", F.col("sentiment")), ("score", F.col("confidence") + F.col("sentiment")))]
    return each.groupBy("entity_id").agg(*sums)


@query("p30_track_record", "p30_track_record_all", f"""
WITH s AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 10000000000 + o_orderkey AS k, o_totalprice FROM orders)
SELECT o_orderkey, {", ".join(f"arg_max(o_totalprice, k) OVER (PARTITION BY o_custkey ORDER BY d RANGE BETWEEN CURRENT ROW AND INTERVAL {n} DAY FOLLOWING) AS price_{n}d" for n in (30, 60, 90))} FROM s""", base=False)
def p30(t):
    """The last price known so many days after an event, from the event on: an as-of join as one window over each customer."""
    s = t.raw("orders").select("o_custkey", "o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("d"), "o_totalprice")
    w = Window.partitionBy("o_custkey").orderBy("d")
    last = [F.max(F.struct("d", "o_orderkey", "o_totalprice")).over(w.rangeBetween(0, n))["o_totalprice"].alias(f"price_{n}d") for n in (30, 60, 90)]
    return s.select("o_orderkey", *last)


@query("p31_primary_subject", """
SELECT catalyst_id, entity_a_id FROM (SELECT catalyst_id, entity_a_id, sum(confidence * impact_magnitude) AS w FROM relationships GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY catalyst_id ORDER BY round(w, 6) DESC, entity_a_id) = 1""")
def p31(t):
    w = t.relationships.groupBy("catalyst_id", "entity_a_id").agg(F.round(F.sum(F.col("confidence") * F.col("impact_magnitude")), 6).alias("w"))
    return w.groupBy("catalyst_id").agg(F.min_by("entity_a_id", F.struct(-F.col("w"), F.col("entity_a_id"))).alias("entity_a_id"))
