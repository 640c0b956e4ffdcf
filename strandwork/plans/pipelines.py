"""Extraction post-processing, resolution of mentions, log correction, layout and streams as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandwork.functions import fuzzy
from strandwork.functions.extract import stated_edges
from strandwork.functions.numbers import edge_confidence
from strandwork.operators import log_corrector as lc
from strandwork.operators.endpoints import drop_reason, visible, with_names
from strandwork.operators.layout import layout
from strandwork.operators.resolver import exact, learned, resolved, unresolved
from strandwork.plans.base import query
from strandwork.plans.filters import EXTRACTED_SQL, extracted
from strandwork.schema import REL_TYPES, SECTORS
from strandwork.session import shared_dir, spread
from strandwork.sources import documents
from strandwork.sources.graph_tables import AS_OF, CUSTOMER_OFFSET, nth
from strandwork.streaming import attempts, edges, ingest
from strandwork.streaming.audit import Audit
from strandwork.streaming.store import Busy, Store


@query("p3_postprocessed_edges", f"""
WITH {EXTRACTED_SQL.strip()},
s AS (SELECT x.*, significance_score FROM extracted x JOIN catalysts USING (catalyst_id)),
g AS (SELECT *, CASE WHEN evidence_type = 'inferred' AND l_partkey % 6 = 1 THEN 'speculative' ELSE evidence_type END AS ev, sqrt(greatest(0, mechanism_strength) * greatest(0, impact_magnitude)) AS conf
  FROM s WHERE significance_score >= 0.5 OR evidence_type = 'direct'),
d AS (SELECT *, CASE WHEN rel_type = 'sues' THEN 'unknown_rel_type' WHEN NOT (list_contains(entities, entity_a) AND list_contains(entities, entity_b)) THEN 'endpoint_not_in_entities' WHEN conf < 0.30 THEN 'low_confidence' END AS drop_reason FROM g)
SELECT coalesce(drop_reason, 'kept') AS outcome, ev AS evidence_type, drop_reason IS NULL AND (ev = 'speculative' OR conf < 0.60) AS flagged, count(*) AS n FROM d GROUP BY 1, 2, 3""")
def p3(t):
    """Significance gate, downgrade of unsourced inferences, confidence, drop reasons and flags, in this order."""
    found = extracted(t).join(t.catalysts.select("catalyst_id", "significance_score"), "catalyst_id")
    gated = found.where((F.col("significance_score") >= 0.5) | (F.col("evidence_type") == "direct"))
    refs = F.when(F.col("l_partkey") % 6 == 1, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    ev = F.when((F.col("evidence_type") == "inferred") & (F.size(refs) == 0), "speculative").otherwise(F.col("evidence_type"))
    scored = gated.withColumn("evidence_type", ev).withColumn("confidence", edge_confidence(F.col("mechanism_strength"), F.col("impact_magnitude")))
    judged = scored.withColumn("drop_reason", drop_reason(REL_TYPES))
    flagged = F.col("drop_reason").isNull() & ((F.col("evidence_type") == "speculative") | (F.col("confidence") < 0.60))
    return judged.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome"), "evidence_type", flagged.alias("flagged")).agg(F.count("*").alias("n"))


def mentions(t):
    """Names as texts have them: as they are, in upper case, as a ticker, misspelt, or new."""
    k, name = F.col("entity_id") % 6, F.col("name")
    said = F.when(k == 0, name).when(k == 1, F.upper("name")).when(k == 2, F.coalesce("ticker", name)).when(k == 3, F.regexp_replace("name", "([a-z])#", "$1$1#")).when(k == 4, F.concat(name, F.lit(" Holdings"))).otherwise(F.concat(F.lit("Newcomer "), (F.col("entity_id") % 40).cast("string")))
    return t.entities.select(F.concat(said, F.lit("")).alias("mention"), said.alias("resolved"))


def tickers(t):
    return t.entities.where("ticker is not null").select(F.col("ticker").alias("alias"), "entity_id")


#: Texts say names as they are, in another case, with a letter twice, or say some that are like no other.
MENTIONS_SQL = """
m AS (SELECT entity_id, name, CASE entity_id % 4 WHEN 0 THEN name WHEN 1 THEN upper(name) WHEN 2 THEN concat(name[1], name) ELSE concat(substr(md5(name), 1, 12), ' ', substr(md5(name), 13, 12)) END AS resolved, concat('the ', lower(name)) AS mention FROM entities),
judged AS (SELECT mention, resolved, CASE WHEN entity_id % 4 = 3 THEN NULL ELSE entity_id END AS entity_id, CASE entity_id % 4 WHEN 2 THEN 'similar' WHEN 3 THEN 'new' ELSE 'resolved' END AS how FROM m)
"""


def said(t):
    k, name = F.col("entity_id") % 4, F.col("name")
    strange = F.concat(F.substring(F.md5(name), 1, 12), F.lit(" "), F.substring(F.md5(name), 13, 12))
    form = F.when(k == 0, name).when(k == 1, F.upper(name)).when(k == 2, F.concat(F.substring(name, 1, 1), name)).otherwise(strange)
    return t.entities.select(F.concat(F.lit("the "), F.lower(name)).alias("mention"), form.alias("resolved"))


@query("p1_exact_tier", """
WITH m AS (SELECT CASE WHEN entity_id % 3 = 0 THEN upper(name) WHEN entity_id % 3 = 1 THEN coalesce(ticker, 'nobody') ELSE concat(name, 'x') END AS resolved, name AS mention FROM entities),
k AS (SELECT lower(name) AS k, entity_id, 0 AS p FROM entities UNION ALL SELECT lower(ticker), entity_id, 1 FROM entities WHERE ticker IS NOT NULL),
b AS (SELECT k, arg_min(entity_id, p * 100000000 + entity_id) AS entity_id FROM k GROUP BY k)
SELECT resolved, mention, coalesce(x.entity_id, y.entity_id) AS entity_id FROM m LEFT JOIN b x ON x.k = lower(resolved) LEFT JOIN b y ON y.k = lower(mention)""")
def p1_exact(t):
    k = F.col("entity_id") % 3
    said = F.when(k == 0, F.upper("name")).when(k == 1, F.coalesce("ticker", F.lit("nobody"))).otherwise(F.concat("name", F.lit("x")))
    rows = t.entities.select(said.alias("resolved"), F.col("name").alias("mention"))
    return exact(rows, t.entities.select("entity_id", "name"), tickers(t)).select("resolved", "mention", "entity_id")


@query("p1_resolver", """
WITH m AS (SELECT entity_id, name, entity_id % 6 AS k, CASE entity_id % 6 WHEN 0 THEN name WHEN 1 THEN upper(name) WHEN 2 THEN coalesce(ticker, name) WHEN 3 THEN regexp_replace(name, '([a-z])#', '\\1\\1#') WHEN 4 THEN concat(name, ' Holdings') ELSE concat('Newcomer ', CAST(entity_id % 40 AS VARCHAR)) END AS said FROM entities)
SELECT said AS mention, said AS resolved, CASE WHEN k < 3 THEN 1 WHEN k < 5 THEN 2 ELSE 3 END AS tier, CASE WHEN k < 5 THEN entity_id END AS entity_id,
  CASE WHEN k < 5 THEN name ELSE min(CASE WHEN k = 5 THEN said END) OVER () END AS matched_name, CASE WHEN k < 3 THEN 'resolved' WHEN k < 5 THEN 'similar' ELSE 'new' END AS matched_by FROM m""")
def p1(t):
    """A misspelt or longer name is nearest to its own entity; newcomers, which differ in a digit or two, are one."""
    return resolved(mentions(t), t.entities.select("entity_id", "name"), tickers(t))


@query("p1_aliases", f"""
WITH {MENTIONS_SQL.strip()}
SELECT DISTINCT alias, entity_id FROM (
  SELECT mention AS alias, entity_id FROM judged WHERE how = 'resolved' AND lower(mention) <> lower(resolved)
  UNION ALL SELECT unnest(CASE WHEN mention = resolved THEN [resolved] ELSE [resolved, mention] END), entity_id FROM judged WHERE how = 'similar')
WHERE lower(alias) NOT IN (SELECT lower(ticker) FROM entities WHERE ticker IS NOT NULL)""")
def p1_aliases(t):
    """Names that resolution has learned, of mentions that are like one name by far: exact, in capitals, with a letter twice."""
    found = resolved(said(t), t.entities.select("entity_id", "name"), tickers(t))
    return learned(found, tickers(t))


@query("p1_unresolved", f"""
WITH {MENTIONS_SQL.strip()}
SELECT mention, resolved AS suggested_name FROM judged WHERE how = 'new'""")
def p1_unresolved(t):
    """Mentions that stand for entities nobody knows, for review."""
    return unresolved(resolved(said(t), t.entities.select("entity_id", "name"), tickers(t)))


@query("u1_similar_names", """
WITH n AS (SELECT name, length(name) AS n FROM entities)
SELECT name, concat('The ', lower(name), ' Group') AS other, round(200.0::DOUBLE * (n - 1) / (2 * n + 10), 4) AS ratio, round(200.0::DOUBLE * n / (2 * n + 10), 4) AS token_sort, 100.0::DOUBLE AS token_set,
  CASE WHEN 2 * (n + 10) >= 3 * n AND n + 10 < 8 * n THEN 90.0::DOUBLE END AS weighted FROM n""")
def u1(t):
    """A name within a longer one, ten letters more: all but its capital is common, and all of its words are."""
    pairs = t.entities.select("name", F.concat(F.lit("The "), F.lower("name"), F.lit(" Group")).alias("other"))
    return spread(pairs).select("name", "other", *[fuzzy.similarity(F.col("name"), F.col("other"), s).alias(s) for s in fuzzy.SCORERS])


@query("m9_layout")
def m9(t):
    """Every node of the newest 200 cards of each sector, which the payload is made of, also those without a visible edge."""
    newest = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("ts"), F.desc("entry_id")))
    cards = t.catalysts.select("catalyst_id", "sector", "ts", "entry_id").withColumn("_p", newest).where("_p <= 200")
    ends = t.relationships.select("catalyst_id", "entity_a_id", "entity_b_id", "status").join(cards.select("catalyst_id", "sector"), "catalyst_id")
    nodes = ends.select("sector", F.explode(F.array("entity_a_id", "entity_b_id")).alias("node"))
    return layout(nodes, ends.where(visible(F.col("status"), False)).select("sector", F.col("entity_a_id").alias("a"), F.col("entity_b_id").alias("b")), "sector")


#: Takeaways for the test of each step: as the log has them, as they should be, and the steps that change them.
TAKEAWAYS = [
    ("Direct: up | Indirect: down", "Direct: up. Indirect: down", "pipe"),
    ("Direct: demand grows. Sentiment: Bullish.", "Bullish. Direct: demand grows.", "explicit"),
    ("Orders recover. very bullish 🟢", "Very Bullish. Orders recover.", "trailing"),
    ("Highly positive. Margins widen.", "Very Bullish. Margins widen.", "opening"),
    ("Mixed (Bullish on parts). Wait.", "Neutral. Mixed (Bullish on parts). Wait.", "opening"),
    ("Volatile / actionable, for now", "Neutral. Volatile / actionable, for now", "opening"),
    ("Positive  sentiment for parts", "Bullish. Positive  sentiment for parts", "opening"),
    ("Macro Bearish. Rates rise.", "Bearish. Rates rise.", "opening"),
    ("Bullish. Strongly bullish on supply.", "Bullish. Very Bullish on supply.", "strength"),
    ("Nothing to say", "Nothing to say", ""),
    ("Constructive policy helps", "Constructive policy helps", ""),
    ("Neutral. Flat quarter..  Next.", "Neutral. Flat quarter.  Next.", ""),
    ("", "", ""),
]

#: Takeaways are made of an opening, a body and an end. Openings: words, the label they stand for, whether they stay.
OPENINGS = [
    ("", None, True), ("Highly positive. ", "Very Bullish", False), ("Negative sentiment. ", "Bearish", False), ("Constructive on ", "Bullish", True),
    ("Mixed, ", "Neutral", True), ("Macro Bearish. ", "Bearish", False), ("Neutral. ", "Neutral", False),
]
ENDS = [(".", None, ""), (". Strongly bullish.", "Very Bullish", "trailing"), (". Sentiment: Bearish.", "Bearish", "explicit")]


def _pick(values: list, place: str) -> str:
    return f"([{', '.join('NULL' if v is None else chr(39) + str(v) + chr(39) for v in values)}])[CAST({place} AS INT) + 1]"


TAKEAWAYS_SQL = f"""
parts AS (SELECT *, event_id % 7 AS o, (event_id // 7) % 3 AS z, (event_id // 21) % 2 AS bar, concat(event_type, ' volumes reach ', CAST(event_id AS VARCHAR)) AS body FROM events),
said AS (SELECT *, {_pick([w for w, *_ in OPENINGS], 'o')} AS opening, {_pick([la for _, la, _ in OPENINGS], 'o')} AS opens, {_pick(['y' if k else 'n' for *_, k in OPENINGS], 'o')} = 'y' AS stays, {_pick([la for _, la, _ in ENDS], 'z')} AS ends,
  concat(body, '. Direct: flows') AS core FROM parts),
corrected AS (SELECT *, CASE WHEN o = 6 AND z = 1 THEN concat('Neutral. ', core, '. Very Bullish.') WHEN o = 6 THEN concat('Neutral. ', core, '.')
    WHEN ends IS NOT NULL THEN concat(ends, '. ', opening, core, '.') WHEN opens IS NULL THEN concat(core, '.') ELSE concat(opens, '. ', CASE WHEN stays THEN opening ELSE '' END, core, '.') END AS takeaways,
  concat_ws('+', CASE WHEN bar = 1 THEN 'pipe' END, CASE WHEN z = 2 THEN 'explicit' END, CASE WHEN z = 1 AND o <> 6 THEN 'trailing' END, CASE WHEN z = 0 AND o NOT IN (0, 6) THEN 'opening' END, CASE WHEN z = 1 AND o = 6 THEN 'strength' END) AS changed,
  o = 0 AND z = 0 AS residual FROM said)
"""


def takeaways(t):
    """The takeaways of a log: every opening with every end, with bars or stops between sections, about each event."""
    e = F.col("event_id")
    opening, end = nth([w for w, *_ in OPENINGS], (e % 7).cast("int")), nth([w for w, *_ in ENDS], (F.floor(e / 7) % 3).cast("int"))
    body = F.concat("event_type", F.lit(" volumes reach "), e.cast("string"))
    stop = F.when(F.floor(e / 21) % 2 == 1, " | Direct: flows").otherwise(". Direct: flows")
    return F.concat(opening, body, stop, end)


@query("c18_corrected_takeaways", f"WITH {TAKEAWAYS_SQL.strip()} SELECT event_id, takeaways, changed, residual FROM corrected", base=False)
def c18(t):
    """C18 to C24: separators, labels in front, other words for strength, and what is left without a label."""
    done = lc.corrected_takeaways(t.raw("events").select("event_id", takeaways(t).alias("takeaways")), "takeaways")
    left = (lc.strip(F.col("takeaways")) != "") & ~lc.opens_with_label(F.col("takeaways"))
    return done.select("event_id", "takeaways", F.array_join("changed", "+").alias("changed"), left.alias("residual"))


@query("p19_corrected_log", f"""
WITH {TAKEAWAYS_SQL.strip()},
r AS (SELECT event_id, event_id % 7 AS k, CASE WHEN event_id % 45 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS d, takeaways, residual FROM corrected),
n AS (SELECT *, row_number() OVER (PARTITION BY k, d ORDER BY event_id) AS n FROM r)
SELECT event_id, CASE WHEN k <> 6 AND d IS NOT NULL THEN concat((['ROB', 'CRY', 'AIS', 'SPD', 'PWE', 'STM'])[CAST(k AS INT) + 1], '-', strftime(d, '%m%d%y'), '-', CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END) END AS entry_id,
  CASE WHEN k = 6 THEN 'unknown category' WHEN d IS NULL THEN 'unreadable date' END AS rejected, takeaways, residual FROM n""", base=False)
def p19(t):
    e = F.col("event_id")
    category = nth([*SECTORS, "Weather"], (e % 7).cast("int"))
    raw = F.when(e % 45 == 0, "next spring").when(e % 2 == 0, F.date_format("ts", "MMMM d, yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    log = t.raw("events").select("event_id", e.alias("pos"), F.lit(None).cast("string").alias("entry_id"), raw.alias("timestamp"), category.alias("category"), takeaways(t).alias("sentiment_takeaways"))
    return lc.corrected_log(log).select("event_id", "entry_id", "rejected", F.col("sentiment_takeaways").alias("takeaways"), "residual")


@query("r1_stream_cursors", """
SELECT event_type, max(CAST(ts AS DATE)) AS last_day, arg_max(event_id, epoch(date_trunc('day', ts)) * 10000000 + event_id) AS last_id FROM events GROUP BY event_type""", base=False)
def r1(t):
    """R1, R2 and R4: a bounded run over the log, each event once, and its cursors."""
    return ingest.ingested(t.spark, t.folder, maxFilesPerTrigger=1).read("cursors")


@query("r2_stream_log", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type", base=False)
def r2(t):
    return ingest.ingested(t.spark, t.folder).read("log").groupBy("event_type").agg(F.count("*").alias("n"))


@query("r3_late_rows", """
WITH c AS (SELECT TIMESTAMP '2024-01-20' AS cursor), s AS (SELECT event_id, ts, event_id % 10 = 3 AS failed FROM events)
SELECT count(*) FILTER (WHERE ts > cursor) AS strict_cursor, count(*) FILTER (WHERE ts > cursor OR failed) AS with_late_rows FROM s, c""", base=False)
def r3(t):
    """Rows that a strict cursor takes, and those that a comparison with what is there takes: failed ones come again."""
    new = F.col("ts") > F.lit("2024-01-20").cast("timestamp_ntz")
    failed = F.col("event_id") % 10 == 3
    rows = t.raw("events").select("event_id", new.alias("new"), failed.alias("failed"))
    there = rows.where("not new and not failed").select("event_id")
    return rows.join(there, "event_id", "left_anti").agg(F.count_if("new").alias("strict_cursor"), F.count("*").alias("with_late_rows"))


@query("r3_late_arrivals", """
WITH e AS (SELECT event_id, event_type, CAST(ts AS DATE) AS day, ts < TIMESTAMP '2024-01-20' AND event_id % 10 <> 3 AS first FROM events),
c AS (SELECT event_type, max(day) AS last_day, arg_max(event_id, epoch(day) * 10000000 + event_id) AS last_id FROM e WHERE first GROUP BY event_type),
m AS (SELECT 'all' AS mode, event_type, day FROM e UNION ALL SELECT 'strict', event_type, day FROM e JOIN c USING (event_type) WHERE first OR day > last_day OR (day = last_day AND event_id > last_id))
SELECT mode, event_type, day, count(*) AS n FROM m GROUP BY 1, 2, 3""", base=False)
def r3_arrivals(t):
    """A log that arrives in two parts, the second with rows behind the cursors of the first, in both modes of ingest."""
    first = (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("event_id") % 10 != 3)
    place, rows = own_place(t, "arrivals"), t.raw("events")
    roots = {mode: f"{place}/{mode}" for mode in ("all", "strict")}
    for part in (first, ~first):
        rows.where(part).write.mode("append").parquet(f"{place}/events.parquet")
        logs = [ingest.ingested(t.spark, place, root, strict_cursor=mode == "strict").read("log").select(F.lit(mode).alias("mode"), "event_type", "day") for mode, root in roots.items()]
    return logs[0].unionByName(logs[1]).groupBy("mode", "event_type", "day").agg(F.count("*").alias("n"))


@query("r8_stream_weeks", """
SELECT CAST(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS DATE) AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2""", base=False)
def r8(t):
    return ingest.collected(ingest.counted_by_week(ingest.events(t.spark, t.folder)), "complete")


@query("r9_stream_distinct", "SELECT count(DISTINCT event_id) AS n FROM events", base=False)
def r9(t):
    """The log read twice at once gives each event once."""
    twice = ingest.events(t.spark, t.folder).union(ingest.events(t.spark, t.folder))
    return ingest.collected(ingest.without_repeats(twice)).agg(F.count("*").alias("n"))


@query("r9_cooldown", """
WITH RECURSIVE a AS (SELECT user_id AS name, ts, event_type = 'purchase' AS verdict FROM events),
g AS (SELECT name, min(ts) AS ts, arg_min(verdict, ts) AS verdict FROM a GROUP BY name
  UNION ALL SELECT a.name, min(a.ts), arg_min(a.verdict, a.ts) FROM g JOIN a ON a.name = g.name AND NOT g.verdict AND a.ts >= g.ts + INTERVAL 14 DAY GROUP BY a.name, g.ts),
w AS (SELECT a.name, a.ts, a.verdict, g.ts AS granted, g.verdict AS settled FROM a ASOF JOIN g ON g.name = a.name AND g.ts <= a.ts)
SELECT name, ts, CASE WHEN ts = granted AND verdict THEN 'verdict' WHEN ts = granted THEN 'refused' WHEN settled THEN 'settled' ELSE 'cooling' END AS outcome FROM w
UNION ALL SELECT name, ts + INTERVAL 14 DAY, 'due' FROM g WHERE NOT verdict AND ts + INTERVAL 14 DAY <= (SELECT max(ts) FROM a)""", base=False)
def r9_cooldown(t):
    """Events as attempts of their users, purchases as verdicts: a refused name waits for 14 days, and is told when it is due."""
    own = attempts.stateful_session(t.spark)
    tries = ingest.events(own, t.folder).select(F.col("user_id").alias("name"), F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("verdict"))
    return attempts.decided(tries, reader=t.spark).withColumnRenamed("at", "ts")


@query("r10_stream_lifecycle", """
SELECT least(entity_a_id, entity_b_id) AS lo, greatest(entity_a_id, entity_b_id) AS hi, max(ship_date) AS last_seen, count(*) AS n_edges,
  CASE WHEN count(*) > 1 THEN 'followed' WHEN max(ship_date) < DATE '2001-08-01' - 90 THEN 'stale' ELSE 'new' END AS state FROM relationships GROUP BY 1, 2""")
def r10(t):
    """Pairs as their edges arrive: lines are a stream, joined with the orders that say whose they are."""
    lines = t.spark.readStream.schema(t.raw("lineitem").schema).parquet(f"{t.folder}/lineitem.parque[t]")
    orders = t.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") + CUSTOMER_OFFSET).alias("b"))
    edges = lines.select("l_orderkey", F.col("l_suppkey").cast("long").alias("a"), F.col("l_shipdate").cast("date").alias("ship_date")).join(orders, "l_orderkey")
    pairs = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "ship_date")
    return ingest.pair_states(ingest.lifecycle(pairs), AS_OF)


@query("r10_edge_changes", """
WITH e AS (SELECT least(entity_a_id, entity_b_id) AS lo, greatest(entity_a_id, entity_b_id) AS hi, ship_date, confidence, status, catalyst_id, l_linenumber, l_partkey FROM relationships),
n AS (SELECT *, max(ship_date) OVER (PARTITION BY lo, hi) AS last_seen FROM e)
SELECT catalyst_id, l_linenumber, l_partkey, CASE WHEN status = 'active' AND ship_date < DATE '2001-08-01' - 90 AND last_seen = ship_date THEN 'stale' ELSE status END AS status,
       round(CASE WHEN last_seen > ship_date THEN least(1.0, confidence + 0.15) WHEN status = 'invalidated' THEN greatest(0.0, confidence - 0.30) ELSE confidence END, 6) AS confidence FROM n""")
def r10_changes(t):
    """Edges as a stream, each arrival changing those that it follows and time those that nothing does: what they come to."""
    own = attempts.stateful_session(t.spark)
    return edges.final(t.relationships, edges.changed(edges.arriving(own, t.folder), AS_OF, reader=t.spark))


#: What a search says in each pass, by the customer of the name: refused for good or for now, silent, or a verdict.
SEARCH_SQL = """
s AS (SELECT h.*, CAST(substr(name_key, length(name_key) - 8) AS BIGINT) AS c FROM handles h),
due AS (SELECT *, CASE WHEN c % 5 = 0 THEN 'refused' WHEN c % 7 = 1 THEN 'kept' END AS first, c % 10 = 0 AS never FROM s WHERE source NOT IN ('human', 'blocked') AND confidence <= 0.9),
v AS (SELECT name_key, channel, first, never, CASE WHEN c % 3 = 0 THEN NULL WHEN c % 3 = 1 THEN handle ELSE concat('@new', CAST(c AS VARCHAR)) END AS new_handle FROM due)
"""


def searched(claims, nth):
    """A search whose answers follow from the name: every fifth is refused in the first pass, every tenth in all."""
    c = F.substring("name_key", -9, 9).cast("long")
    refused = (c % 10 == 0) | ((c % 5 == 0) & F.lit(nth == 0))
    silent = c % 7 == 1
    blocked = refused | silent
    handle = F.when(~blocked, F.when(c % 3 == 1, F.col("handle")).when(c % 3 == 2, F.concat(F.lit("@new"), c.cast("string"))))
    source = F.when(blocked, "blocked").when(handle.isNull(), "abstain").otherwise("linkedin_serp_verified")
    comment = F.when(refused, "quota").when(silent, "no evidence: search is empty").otherwise("title and name agree")
    return claims.select("*", handle.alias("new_handle"), F.when(handle.isNull(), 0.0).otherwise(0.95).alias("new_confidence"), source.alias("new_source"), comment.alias("comment"))


@query("r8_resumed_audit", f"""
WITH {SEARCH_SQL.strip()},
o AS (SELECT *, CASE WHEN first = 'refused' AND never THEN NULL WHEN first = 'refused' THEN 1 ELSE 0 END AS audited_in, CASE WHEN c7 THEN 'kept' WHEN new_handle IS NOT DISTINCT FROM old THEN 'confirmed' WHEN new_handle IS NULL THEN 'abstained' ELSE 'changed' END AS outcome
  FROM (SELECT v.*, s.handle AS old, s.c % 7 = 1 AS c7 FROM v JOIN s USING (name_key, channel)) x)
SELECT s.name_key, s.channel, CASE WHEN audited_in IS NULL OR outcome = 'kept' THEN handle ELSE new_handle END AS handle,
  CASE WHEN audited_in IS NULL OR outcome = 'kept' THEN confidence WHEN new_handle IS NULL THEN 0.0 ELSE 0.95 END AS confidence,
  CASE WHEN audited_in IS NULL OR outcome = 'kept' THEN source WHEN new_handle IS NULL THEN 'abstain' ELSE 'linkedin_serp_verified' END AS source, audited_in, CASE WHEN audited_in IS NOT NULL THEN outcome END AS outcome
FROM s LEFT JOIN o USING (name_key, channel)""")
def r8_audit(t):
    """An audit that is killed after two steps, begun again elsewhere, and followed by a second pass over what was refused."""
    audit = Audit(t.spark)
    audit.begin(t.handles, 0.9, max(1, t.handles.count() // 5))

    class Killed(Exception):
        pass

    def killed(claims, nth):
        if audit.store.commits().keys() >= {1, 2}:
            raise Killed
        return searched(claims, nth)

    try:
        audit.run(killed)
    except Killed:
        pass
    again = Audit(t.spark, audit.root)
    again.begin(t.handles, 0.9, 1)  # it has begun: nothing is claimed anew
    for nth in (0, 1):
        again.run(searched, nth)
    return again.handles(t.handles)


@query("k8_completion_events", "SELECT event_type, count(DISTINCT event_id) AS written FROM events GROUP BY event_type", base=False)
def k8_events(t):
    """What is announced once batches are written: each kind with the rows that were new, kinds without any left out. Two
    listeners are told; that one of them fails does not stop the run."""
    told = Store(t.spark, {"done": "event_type string, written bigint"})

    def done(rows):
        told.change(len(told.commits()), lambda change: change.append("done", rows))
        raise OSError("the second listener is away")

    ingest.ingested(t.spark, t.folder, done=done, maxFilesPerTrigger=1)
    return told.read("done").groupBy("event_type").agg(F.sum("written").alias("written"))


@query("k9_transactions", """
WITH c AS (SELECT catalyst_id, sector FROM catalysts WHERE sector IN ('BUILDING', 'FURNITURE')), r AS (SELECT entity_a_id, entity_b_id FROM relationships JOIN c USING (catalyst_id))
SELECT 'catalysts' AS written, count(*) AS n FROM c UNION ALL SELECT 'edges', count(*) FROM r
UNION ALL SELECT 'entities', count(DISTINCT entity_id) FROM entities WHERE entity_id IN (SELECT entity_a_id FROM r UNION SELECT entity_b_id FROM r)""")
def k9(t):
    """Events, their edges and their entities are written together, a sector a step; a step that fails leaves nothing."""
    store = Store(t.spark, {"catalysts": "catalyst_id bigint, sector string", "edges": "catalyst_id bigint, entity_a_id bigint, entity_b_id bigint", "entities": "entity_id bigint, name string"})

    def write(sector, fails):
        cards = t.catalysts.where(F.col("sector") == sector).select("catalyst_id", "sector")
        edges = t.relationships.select("catalyst_id", "entity_a_id", "entity_b_id").join(cards.select("catalyst_id"), "catalyst_id")
        ends = edges.select(F.explode(F.array("entity_a_id", "entity_b_id")).alias("entity_id"))
        known = t.entities.select("entity_id", "name").join(ends, "entity_id", "left_semi").join(store.read("entities").select("entity_id"), "entity_id", "left_anti")

        def work(change):
            change.append("catalysts", cards)
            change.append("edges", edges)
            if fails:
                raise ValueError(f"{sector}: the entities cannot be written")
            change.append("entities", known)

        return work

    for step, (sector, fails) in enumerate([("BUILDING", False), ("MACHINERY", True), ("FURNITURE", False)]):
        try:
            store.change(step, write(sector, fails))
        except ValueError:
            continue
    counts = [store.read(name).select(F.lit(name).alias("written")).groupBy("written").agg(F.count("*").alias("n")) for name in store.schemas]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("u6_stated_edges", """
SELECT r.catalyst_id, a.name AS entity_a, r.rel_type, b.name AS entity_b, CASE WHEN r.evidence_type = 'speculative' THEN 'speculative' ELSE 'direct' END AS evidence_type, count(*) AS n
FROM relationships r JOIN entities a ON a.entity_id = r.entity_a_id JOIN entities b ON b.entity_id = r.entity_b_id GROUP BY 1, 2, 3, 4, 5""")
def u6(t):
    """Findings written from edges, a text for each event, and read back by the rule-based extractor."""
    named = with_names(t.relationships.select("catalyst_id", "entity_a_id", "entity_b_id", "rel_type", "evidence_type"), t.entities)
    hedge = F.when(F.col("evidence_type") == "speculative", "may ").otherwise("")
    sentence = F.concat("from_name", F.lit(" "), hedge, F.replace("rel_type", F.lit("_"), F.lit(" ")), F.lit(" "), "to_name", F.lit(". It was said today."))
    findings = t.dealt(named, "catalyst_id").groupBy("catalyst_id").agg(F.array_join(F.collect_list(sentence), " ").alias("finding"))
    edges = findings.select("catalyst_id", F.explode(stated_edges(F.col("finding"))).alias("e"))
    return edges.select("catalyst_id", "e.*").groupBy("catalyst_id", "entity_a", "rel_type", "entity_b", "evidence_type").agg(F.count("*").alias("n"))


FINDINGS_SQL = "SELECT entry_id, CAST(ts AS VARCHAR) AS timestamp, sector AS category, headline AS finding, sentiment_takeaways FROM catalysts"


def findings(t):
    return t.catalysts.select("entry_id", F.col("ts").cast("string").alias("timestamp"), F.col("sector").alias("category"), F.col("headline").alias("finding"), "sentiment_takeaways")


def own_place(t, name):
    return f"{shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("s4_findings_array", f"{FINDINGS_SQL} ORDER BY ts DESC, entry_id DESC LIMIT 500")
def s4(t):
    """The newest 500 findings as one JSON array, written and read again."""
    place = own_place(t, "array")
    documents.write_json_array(findings(t).orderBy(F.desc("timestamp"), F.desc("entry_id")).limit(500), place)
    return documents.read_findings(t.spark, place).select("entry_id", "timestamp", "category", "finding", "sentiment_takeaways")


@query("s5_all_findings", FINDINGS_SQL)
def s5(t):
    """A whole collection as JSON lines, written and read again without a filter."""
    place = own_place(t, "lines")
    documents.write_json_lines(findings(t), place)
    return documents.read_findings(t.spark, place, lines=True).select("entry_id", "timestamp", "category", "finding", "sentiment_takeaways")


@query("k6_run_dump", """
SELECT entry_id, CASE WHEN significance_score < 0.05 THEN 'no edges were found' END AS error, CASE WHEN significance_score >= 0.05 THEN n END AS n_edges
FROM catalysts LEFT JOIN (SELECT catalyst_id, count(*) AS n FROM relationships GROUP BY 1) USING (catalyst_id)""")
def k6(t):
    """One record for each entry of a run, those that failed with their error, as JSON lines."""
    n = t.relationships.groupBy("catalyst_id").agg(F.count("*").alias("n"))
    failed = F.col("significance_score") < 0.05
    records = t.catalysts.join(n, "catalyst_id", "left").select("entry_id", F.when(failed, "no edges were found").alias("error"), F.when(~failed, F.col("n")).alias("n_edges"))
    place = own_place(t, "dump")
    documents.write_json_lines(records, place)
    return t.spark.read.schema("entry_id string, error string, n_edges bigint").json(place)


@query("r6_single_writer", """
SELECT run, outcome, n FROM (SELECT 'first' AS run, 'written' AS outcome, count(*) AS n FROM events WHERE event_type = 'view' UNION ALL SELECT 'meanwhile', 'refused', 0 UNION ALL SELECT 'after', 'written', count(*) FROM events WHERE event_type = 'click')""", base=False)
def r6(t):
    """A run that starts while another writes is refused and leaves nothing; one that comes after it is not."""
    schemas, outcomes = {"log": "run string, event_id bigint"}, {}
    store = Store(t.spark, schemas)

    def attempt(run, step, kind, during=None):
        rows = t.raw("events").where(F.col("event_type") == kind).select(F.lit(run).alias("run"), "event_id")

        def work(change):
            change.append("log", rows)
            if during is not None:
                during()

        try:
            Store(t.spark, schemas, store.root).change(step, work)
            outcomes[run] = "written"
        except Busy:
            outcomes[run] = "refused"

    attempt("first", 0, "view", lambda: attempt("meanwhile", 1, "purchase"))
    attempt("after", 2, "click")
    told = t.spark.createDataFrame(list(outcomes.items()), "run string, outcome string")
    counts = store.read("log").groupBy("run").agg(F.count("*").alias("n"))
    return told.join(counts, "run", "left").select("run", "outcome", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
