"""Handle resolution over stored search results, the handle cache, and search budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions import dates as dt
from strandwork.functions import fuzzy
from strandwork.functions import text as tx
from strandwork.operators.changes import merged
from strandwork.operators.endpoints import shown_handle
from strandwork.plans.base import query
from strandwork.sources.graph_tables import AS_OF

#: Search results made from customers: up to three for each, their titles near the name, the same slug at times twice.
SERP_SQL = """
serp AS (SELECT lower(c_name) AS name_key, CAST(p AS INT) AS pos, CASE WHEN (c_custkey + p) % 4 = 0 THEN 'Someone Else' ELSE c_name END AS title,
  concat('https://l.example/company/', CASE WHEN c_custkey % 5 = 0 THEN 'same' ELSE concat('c', CAST(c_custkey + p AS VARCHAR)) END) AS link,
  CASE WHEN (c_custkey * 3 + p) % 7 < 2 THEN concat(c_mktsegment, ' makers') ELSE 'unrelated words' END AS snippet, c_mktsegment AS sector FROM customer, range(0, 3) t(p) WHERE c_custkey % 9 <> 0)
"""


def serp(t) -> DataFrame:
    c = t.raw("customer").where("c_custkey % 9 <> 0").select("*", F.explode(F.array(*[F.lit(p) for p in range(3)])).alias("pos"))
    k, p = F.col("c_custkey"), F.col("pos")
    return c.select(
        F.lower("c_name").alias("name_key"),
        "pos",
        F.when((k + p) % 4 == 0, "Someone Else").otherwise(F.col("c_name")).alias("title"),
        F.concat(F.lit("https://l.example/company/"), F.when(k % 5 == 0, "same").otherwise(F.concat(F.lit("c"), (k + p).cast("string")))).alias("link"),
        F.when((k * 3 + p) % 7 < 2, F.concat("c_mktsegment", F.lit(" makers"))).otherwise("unrelated words").alias("snippet"),
        F.col("c_mktsegment").alias("sector"),
    )


def match_score(page: Column, name: Column) -> Column:
    """How alike two names are, 0 to 100: the better of the names as they are and without marks and filler words."""
    bare = lambda c: F.array_join(tx.strip_generic(tx.tokens(tx.folded(c))), " ")
    return F.greatest(fuzzy.similarity(F.lower(page), F.lower(name), "token_sort"), fuzzy.similarity(bare(page), bare(name), "token_sort"))


def title_scores(results: DataFrame, threshold: float) -> DataFrame:
    """``results`` with ``score``, how alike title and name are (``match_score``); null where it is below ``threshold``.

    Most titles are the name or nothing like it, which expressions say: names with a common subsequence of so many letters
    differ in few edits. Only what is left, and what is not plain ASCII, is scored.
    """
    page, name = F.lower("title"), F.lower("name_key")
    ordered = lambda words: F.array_join(F.array_sort(words), " ")
    plain = lambda c: F.filter(F.split(F.regexp_replace(c, "[^a-z0-9]+", " "), " "), lambda w: w != "")
    few = lambda a, b: F.levenshtein(a, b) <= (1 - threshold / 100) * (F.length(a) + F.length(b)) + 1e-6
    near = few(ordered(plain(page)), ordered(plain(name))) | few(*[ordered(tx.strip_generic(tx.tokens(F.col(c)))) for c in ("title", "name_key")])
    ascii_ = F.concat("title", "name_key").rlike(r"^[\x00-\x7f]*$")
    how = F.when(page == name, "same").when(~ascii_ | near, "near").otherwise("far")
    told = results.withColumn("how", how)
    scores = {"same": F.lit(100.0), "near": match_score(F.col("title"), F.col("name_key")), "far": F.lit(None).cast("double")}
    parts = [told.where(F.col("how") == k).withColumn("score", score).drop("how") for k, score in scores.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def verified_by_search(results: DataFrame, most: int = 4, threshold: float = 90.0) -> DataFrame:
    """``name_key, slug, confidence, outcome`` from search results.

    Results whose title scores ``threshold`` or more against the name are matches. One slug among them wins: with its score
    as confidence if the context speaks for it, 0.75 if not. Of several slugs one wins only if more context words speak
    for it than for every other.
    """
    scored = title_scores(results.where(F.col("pos") < most), threshold)
    words = tx.context_hits(F.concat_ws(" ", "title", "snippet"), F.split(F.lower("sector"), " "), F.split("name_key", "#"))
    slugs = scored.select("name_key", F.when(F.col("score") >= threshold, tx.slug_from_url(F.col("link"))).alias("slug"), words.alias("hits"), "pos", "score")
    slugs = slugs.unionByName(results.where(F.col("pos") >= most).select("name_key"), allowMissingColumns=True)
    best = slugs.groupBy("name_key", "slug").agg(F.max("hits").alias("hits"), F.min("pos").alias("pos"), F.max("score").alias("score"))
    # Names without a match have one row here, whose slug is null and comes last in every order.
    none, hits = F.col("slug").isNull(), F.col("hits")
    one = best.groupBy("name_key").agg(
        F.count("slug").alias("n"),
        F.min_by(F.struct("slug", "hits", "score"), F.struct(none, -hits, F.col("pos"))).alias("b"),
        F.min_by("slug", F.struct(none, -hits, F.col("slug"))).alias("low"),
        F.max_by("slug", F.struct(~none, hits, F.col("slug"))).alias("high"),
    )
    spoken_for = F.col("b.hits") >= 1
    won = (F.col("n") == 1) | ((F.col("n") > 1) & spoken_for & (F.col("low") == F.col("high")))
    outcome = F.when(F.col("n") == 0, "no match").when(~won, "ambiguous").when(spoken_for, "verified").otherwise("industry unconfirmed")
    confidence = F.when(won & spoken_for, F.col("b.score") / 100).when(won, 0.75).otherwise(0.0)
    return one.select("name_key", F.when(won, F.col("b.slug")).alias("slug"), confidence.alias("confidence"), outcome.alias("outcome"))


VERIFIED_SQL = f"""
{SERP_SQL.strip()},
h AS (SELECT name_key, regexp_extract(link, '/company/([^/?#]+)', 1) AS slug, CASE WHEN snippet LIKE '%makers' THEN 1 ELSE 0 END AS hits, pos FROM serp WHERE lower(title) = name_key),
b AS (SELECT name_key, slug, max(hits) AS hits, min(pos) AS pos FROM h GROUP BY 1, 2),
r AS (SELECT *, count(*) OVER w AS n, max(hits) OVER w AS most, row_number() OVER (PARTITION BY name_key ORDER BY hits DESC, pos) AS place FROM b WINDOW w AS (PARTITION BY name_key)),
q AS (SELECT *, count(*) FILTER (WHERE hits = most) OVER (PARTITION BY name_key) AS ties FROM r),
x AS (SELECT name_key, slug, hits, n = 1 OR (most >= 1 AND ties = 1) AS won FROM q WHERE place = 1),
verified AS (SELECT s.name_key, CASE WHEN won THEN slug END AS slug, CASE WHEN won THEN CASE WHEN hits >= 1 THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN x.name_key IS NULL THEN 'no match' WHEN NOT won THEN 'ambiguous' WHEN hits >= 1 THEN 'verified' ELSE 'industry unconfirmed' END AS outcome
FROM (SELECT DISTINCT name_key FROM serp) s LEFT JOIN x USING (name_key))
"""


@query("p7_search_verification", f"WITH {VERIFIED_SQL.strip()} SELECT * FROM verified", base=False)
def p7(t):
    return verified_by_search(serp(t))


@query("p8_x_verification", r"""
WITH s AS (SELECT lower(c_name) AS name_key, concat(c_name, ' (@', CASE WHEN c_custkey % 4 = 0 THEN 'fan' ELSE 'C' END, CAST(c_custkey AS VARCHAR), ') / X') AS title, concat('https://x.com/c', CAST(c_custkey AS VARCHAR)) AS link FROM customer)
SELECT name_key, CASE WHEN lower(regexp_extract(title, '\(@([A-Za-z0-9_]+)\)', 1)) = regexp_extract(link, 'x\.com/([a-z0-9_]+)', 1) THEN concat('@', regexp_extract(title, '\(@([A-Za-z0-9_]+)\)', 1)) END AS handle FROM s""", base=False)
def p8(t):
    key = F.col("c_custkey").cast("string")
    rows = t.raw("customer").select(
        F.lower("c_name").alias("name_key"),
        F.concat("c_name", F.lit(" (@"), F.when(F.col("c_custkey") % 4 == 0, "fan").otherwise("C"), key, F.lit(") / X")).alias("title"),
        F.concat(F.lit("https://x.com/c"), key).alias("link"),
    )
    said, linked = F.regexp_extract("title", r"\(@([A-Za-z0-9_]+)\)", 1), F.regexp_extract("link", r"x\.com/([A-Za-z0-9_]+)", 1)
    return rows.select("name_key", F.when(F.lower(said) == F.lower(linked), F.concat(F.lit("@"), said)).alias("handle"))


@query("p9_slug_probes", """
WITH p AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 429 WHEN 'view' THEN 404 ELSE 200 END AS code FROM events),
s AS (SELECT *, coalesce(sum(CASE WHEN code = 429 OR code = 200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM p)
SELECT user_id, count(*) AS probes, max(code) AS last_code FROM s WHERE ended = 0 GROUP BY user_id""", base=False)
def p9(t):
    """Candidates are tried in order until one is found or the site refuses."""
    code = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "view", 404).otherwise(200)
    tried = t.raw("events").select("user_id", "event_id", code.alias("code"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("code").isin(429, 200)).over(w), F.lit(False))
    return tried.withColumn("ended", ended).where("not ended").groupBy("user_id").agg(F.count("*").alias("probes"), F.max("code").alias("last_code"))


@query("p10_channel_fallbacks", f"""
WITH {VERIFIED_SQL.strip()},
direct AS (SELECT lower(c_name) AS name_key, concat('@', lower(replace(c_name, '#', ''))) AS handle FROM customer WHERE c_acctbal > 8000),
names AS (SELECT lower(c_name) AS name_key FROM customer)
SELECT n.name_key, coalesce(h.handle, d.handle, '@' || v.slug) AS handle,
  CASE WHEN h.handle IS NOT NULL THEN 'human' WHEN d.handle IS NOT NULL THEN 'direct' WHEN v.slug IS NOT NULL THEN 'search' ELSE coalesce(v.outcome, 'nothing found') END AS path
FROM names n LEFT JOIN handles h ON h.name_key = n.name_key AND h.source = 'human' LEFT JOIN direct d ON d.name_key = n.name_key LEFT JOIN verified v ON v.name_key = n.name_key""")
def p10(t):
    """What a human has set, else a page that was probed directly, else what a search verifies, else why there is none."""
    c = t.raw("customer")
    names = c.select(F.lower("c_name").alias("name_key"))
    human = t.handles.where("source = 'human'").select("name_key", F.col("handle").alias("human"))
    direct = c.where("c_acctbal > 8000").select(F.lower("c_name").alias("name_key"), F.concat(F.lit("@"), F.lower(F.replace("c_name", F.lit("#"), F.lit("")))).alias("direct"))
    found = verified_by_search(serp(t)).select("name_key", F.concat(F.lit("@"), "slug").alias("search"), "outcome")
    rows = names.join(human, "name_key", "left").join(direct, "name_key", "left").join(found, "name_key", "left")
    path = F.coalesce(*[F.when(F.col(p).isNotNull(), p) for p in ("human", "direct", "search")], F.col("outcome"), F.lit("nothing found"))
    return rows.select("name_key", F.coalesce("human", "direct", "search").alias("handle"), path.alias("path"))


PROVIDER_SQL = """
providers AS (SELECT c_mktsegment AS region, c_custkey AS provider, CAST(c_custkey % 50 AS INT) AS priority, c_custkey % 3 <> 0 AS enabled, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 100 AS INT) END AS quota,
  CAST(c_custkey % 120 AS INT) AS used, DATE '2001-07-15' AS cs, CAST(c_custkey % 28 + 1 AS INT) AS rd FROM customer)
"""


def providers(t) -> DataFrame:
    k = F.col("c_custkey")
    return t.raw("customer").select(
        F.col("c_mktsegment").alias("region"), k.alias("provider"), (k % 50).cast("int").alias("priority"), (k % 3 != 0).alias("enabled"),
        F.when(k % 4 != 0, (k % 100).cast("int")).alias("quota"), (k % 120).cast("int").alias("used"), F.lit("2001-07-15").cast("date").alias("cs"), (k % 28 + 1).cast("int").alias("rd"),
    )


@query("p11_provider_choice", f"""
WITH {PROVIDER_SQL.strip()}
SELECT region, provider FROM providers WHERE enabled AND (quota IS NULL OR quota - used > 0) QUALIFY row_number() OVER (PARTITION BY region ORDER BY priority, provider) = 1""", base=False)
def p11(t):
    """The first provider by priority that is enabled and has searches left."""
    able = providers(t).where("enabled and (quota is null or quota > used)")
    return able.groupBy("region").agg(F.min_by("provider", F.struct("priority", "provider")).alias("provider"))


@query("p12_budget_guard", f"""
WITH {PROVIDER_SQL.strip()}
SELECT region, sum(CASE WHEN quota IS NULL THEN 0 ELSE greatest(0, quota - used) END)::BIGINT AS remaining, count(*) FILTER (WHERE quota IS NOT NULL AND used >= quota) AS exhausted,
  min(CASE WHEN quota IS NOT NULL AND used >= quota THEN make_date(2001, 8, rd) END) AS next_refill FROM providers WHERE enabled GROUP BY region""", base=False)
def p12(t):
    """What is left in all, and when the first of the exhausted comes back."""
    spent = F.col("quota").isNotNull() & (F.col("used") >= F.col("quota"))
    left = F.when(F.col("quota").isNull(), 0).otherwise(F.greatest(F.lit(0), F.col("quota") - F.col("used")))
    back = F.when(spent, dt.next_refill(F.col("cs"), F.col("rd")))
    return providers(t).where("enabled").groupBy("region").agg(F.sum(left).alias("remaining"), F.count_if(spent).alias("exhausted"), F.min(back).alias("next_refill"))


@query("p13_missing_handles", """
SELECT e.entity_id, e.name, max(CASE WHEN b.source = 'blocked' THEN 1 ELSE 0 END) AS was_blocked FROM entities e LEFT JOIN handles b ON b.name_key = lower(e.name) AND b.source = 'blocked'
WHERE lower(e.type) LIKE '%company%' AND NOT EXISTS (SELECT 1 FROM handles h WHERE h.name_key = lower(e.name) AND (h.source <> 'blocked' OR h.resolved_on > DATE '2001-08-01' - 14))
GROUP BY 1, 2 ORDER BY was_blocked, e.entity_id LIMIT 30""")
def p13(t):
    """Companies that still need a handle; refused ones come last, and only after two weeks."""
    companies = t.entities.where(F.lower("type").like("%company%")).select("entity_id", "name", tx.name_key(F.col("name")).alias("name_key"))
    fresh = (F.col("source") != "blocked") | (F.col("resolved_on") > F.date_sub(F.lit(AS_OF), 14))
    due = companies.join(t.handles.where(fresh).select("name_key"), "name_key", "left_anti")
    blocked = t.handles.where("source = 'blocked'").select("name_key", F.lit(1).alias("b")).distinct()
    rows = due.join(blocked, "name_key", "left").select("entity_id", "name", F.coalesce("b", F.lit(0)).alias("was_blocked"))
    return rows.orderBy("was_blocked", "entity_id").limit(30)


@query("p14_reaudit_list", "SELECT name_key, confidence, source FROM handles WHERE source NOT IN ('human', 'blocked') AND (confidence < 0.9 OR name_key IN ('customer#000000002')) ORDER BY name_key LIMIT 100")
def p14(t):
    named = F.col("name_key").isin("customer#000000002")
    found = t.handles.where(~F.col("source").isin("human", "blocked") & ((F.col("confidence") < 0.9) | named))
    return found.select("name_key", "confidence", "source").orderBy("name_key").limit(100)


@query("p15_unresolved_report", """
SELECT name_key, source AS reason FROM handles WHERE handle IS NULL UNION ALL
SELECT lower(name), 'never attempted' FROM entities WHERE type LIKE '%company%' AND lower(name) NOT IN (SELECT name_key FROM handles)""")
def p15(t):
    tried = t.handles.where("handle is null").select("name_key", F.col("source").alias("reason"))
    companies = t.entities.where(F.col("type").like("%company%")).select(tx.name_key(F.col("name")).alias("name_key"))
    return tried.unionByName(companies.join(t.handles.select("name_key"), "name_key", "left_anti").withColumn("reason", F.lit("never attempted")))


@query("p16_lookup", """
SELECT lower(e.name) AS name_key, CASE WHEN h.source IS NULL OR h.source = 'blocked' THEN 'live' ELSE 'cache' END AS path, CASE WHEN h.source <> 'blocked' AND NOT h.confidence < 0.8 THEN h.handle END AS handle
FROM entities e LEFT JOIN handles h ON h.name_key = lower(e.name)""")
def p16(t):
    """From the cache unless it has nothing or a refusal; what is shown is always checked for confidence."""
    rows = t.entities.select(tx.name_key(F.col("name")).alias("name_key")).join(t.handles, "name_key", "left")
    live = F.col("source").isNull() | (F.col("source") == "blocked")
    handle = F.when(~live, shown_handle(F.col("handle"), F.col("confidence")))
    return rows.select("name_key", F.when(live, "live").otherwise("cache").alias("path"), handle.alias("handle"))


@query("p17_reaudit_outcomes", """
WITH new AS (SELECT name_key, CASE WHEN name_key LIKE '%0' THEN NULL WHEN name_key LIKE '%1' THEN '@changed' ELSE handle END AS handle FROM handles WHERE source <> 'human')
SELECT CASE WHEN o.handle IS NULL AND n.handle IS NULL THEN 'still_abstained' WHEN o.handle IS NULL THEN 'found' WHEN n.handle IS NULL THEN 'withdrawn' WHEN o.handle = n.handle THEN 'confirmed' ELSE 'changed' END AS outcome, count(*) AS n
FROM handles o JOIN new n USING (name_key) GROUP BY 1""")
def p17(t):
    now = F.when(F.col("name_key").like("%0"), F.lit(None)).when(F.col("name_key").like("%1"), "@changed").otherwise(F.col("handle"))
    new = t.handles.where("source <> 'human'").select("name_key", now.alias("now"))
    old = F.col("handle")
    outcome = F.when(old.isNull() & F.col("now").isNull(), "still_abstained").when(old.isNull(), "found").when(F.col("now").isNull(), "withdrawn").when(old == F.col("now"), "confirmed").otherwise("changed")
    return t.handles.join(new, "name_key").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("p18_manual_handles", """
WITH said AS (SELECT lower(c_name) AS name_key, 'linkedin' AS channel, CASE WHEN c_acctbal >= 9000 THEN '@' || lower(c_mktsegment) || CAST(c_custkey AS VARCHAR) END AS handle FROM customer WHERE c_acctbal >= 9000 OR c_acctbal < -500)
SELECT name_key, channel, CASE WHEN s.name_key IS NULL THEN h.handle ELSE s.handle END AS handle, CASE WHEN s.name_key IS NULL THEN h.confidence WHEN s.handle IS NULL THEN 0.0 ELSE 1.0 END AS confidence,
  CASE WHEN s.name_key IS NULL THEN h.source ELSE 'human' END AS source FROM handles h FULL JOIN said s USING (name_key, channel)""")
def p18(t):
    """A person's word goes over what the cache has, new names included: a handle is certain, and so is that there is none."""
    c = t.raw("customer").where("c_acctbal >= 9000 or c_acctbal < -500")
    given = F.when(F.col("c_acctbal") >= 9000, F.concat(F.lit("@"), F.lower("c_mktsegment"), F.col("c_custkey").cast("string")))
    said = c.select(F.lower("c_name").alias("name_key"), F.lit("linkedin").alias("channel"), given.alias("handle"), F.when(given.isNull(), 0.0).otherwise(1.0).alias("confidence"), F.lit("human").alias("source"))
    return merged(t.handles.select("name_key", "channel", "handle", "confidence", "source"), said, ["name_key", "channel"])


@query("p20_social_selection", """
SELECT c.entry_id, c.headline, round(max(r.confidence), 6) AS max_confidence FROM catalysts c JOIN relationships r USING (catalyst_id) WHERE c.sector = 'MACHINERY' AND c.catalyst_id % 7 <> 0 AND NOT (r.evidence_type = 'speculative')
GROUP BY c.entry_id, c.headline, c.ts HAVING max(r.confidence) >= 0.6 ORDER BY c.ts DESC, round(max(r.confidence), 6) DESC, c.entry_id LIMIT 10""")
def p20(t):
    posted = t.catalysts.where("catalyst_id % 7 = 0").select("catalyst_id")
    best = t.relationships.where("evidence_type <> 'speculative'").groupBy("catalyst_id").agg(F.round(F.max("confidence"), 6).alias("max_confidence")).where("max_confidence >= 0.6")
    rows = t.catalysts.where("sector = 'MACHINERY'").join(posted, "catalyst_id", "left_anti").join(best, "catalyst_id")
    return rows.orderBy(F.desc("ts"), F.desc("max_confidence"), "entry_id").limit(10).select("entry_id", "headline", "max_confidence")


@query("p2_enrichment_paths", """
WITH f AS (SELECT event_id, event_type, CASE WHEN event_type <> 'view' THEN user_id END AS page_id, value FROM events), p AS (SELECT page_id, length(html) > 1500 AS enough FROM pages),
m(event_type, grounding) AS (VALUES ('click', 'always'), ('view', 'missing'), ('purchase', 'never'))
SELECT coalesce(m.grounding, 'missing') AS mode, CASE WHEN f.page_id IS NOT NULL AND enough THEN 'url_fetch' WHEN coalesce(m.grounding, 'missing') = 'always' OR (coalesce(m.grounding, 'missing') = 'missing' AND f.page_id IS NULL) THEN 'grounding' ELSE 'none' END AS path, count(*) AS n
FROM f LEFT JOIN p ON p.page_id = f.page_id LEFT JOIN m ON m.event_type = f.event_type GROUP BY 1, 2""", base=False)
def p2(t):
    """The source's own page if it is there with enough on it, else a search: always, where a finding names no source, or never."""
    found = t.raw("events").select("event_type", F.when(F.col("event_type") != "view", F.col("user_id")).alias("page_id"))
    pages = t.raw("pages").select("page_id", (F.length("html") > 1500).alias("enough"))
    modes = t.spark.createDataFrame([("click", "always"), ("view", "missing"), ("purchase", "never")], "event_type string, grounding string")
    rows = found.join(pages, "page_id", "left").join(F.broadcast(modes), "event_type", "left").withColumn("mode", F.coalesce("grounding", F.lit("missing")))
    searched = (F.col("mode") == "always") | ((F.col("mode") == "missing") & F.col("page_id").isNull())
    path = F.when(F.col("page_id").isNotNull() & F.col("enough"), "url_fetch").when(searched, "grounding").otherwise("none")
    return rows.groupBy("mode", path.alias("path")).agg(F.count("*").alias("n"))


PROVIDERS = ["brave", "serper", "cse"]


@query("p32_configured_provider", """
WITH env AS (SELECT c_nationkey AS place, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'brave' WHEN c_mktsegment = 'MACHINERY' THEN 'serper' ELSE 'cse' END AS name, CASE WHEN c_acctbal > 9000 THEN 'key' ELSE '' END AS value FROM customer),
o(name, place_in_order) AS (VALUES ('brave', 1), ('serper', 2), ('cse', 3))
SELECT n_nationkey AS place, coalesce(arg_min(o.name, place_in_order), 'none') AS provider FROM nation LEFT JOIN (SELECT DISTINCT place, name FROM env WHERE value <> '') e ON e.place = n_nationkey LEFT JOIN o ON o.name = e.name GROUP BY 1""", base=False)
def p32(t):
    """The first provider for which a place's environment has a key that is not empty; registered budgets play no part."""
    segment = F.col("c_mktsegment")
    name = F.when(segment.isin("BUILDING", "FURNITURE"), "brave").when(segment == "MACHINERY", "serper").otherwise("cse")
    env = t.raw("customer").select(F.col("c_nationkey").alias("place"), name.alias("name"), F.when(F.col("c_acctbal") > 9000, "key").otherwise("").alias("value"))
    first = env.where("value <> ''").groupBy("place").agg(F.min(F.array_position(F.array(*map(F.lit, PROVIDERS)), F.col("name"))).alias("first"))
    every = t.raw("nation").select(F.col("n_nationkey").alias("place")).join(first, "place", "left")
    return every.select("place", F.coalesce(F.get(F.array(*map(F.lit, PROVIDERS)), (F.col("first") - 1).cast("int")), F.lit("none")).alias("provider"))


@query("p23_render_queue", """
WITH cards AS (SELECT entry_id, ts, catalyst_id FROM catalysts), pictures AS (SELECT o_orderkey AS catalyst_id, CASE WHEN o_orderstatus = 'F' THEN 1200 ELSE 600 END AS width FROM orders WHERE o_totalprice >= 60000)
SELECT entry_id, CASE WHEN p.width IS NULL THEN 'missing' WHEN p.width <> 1200 THEN 'wrong_size' ELSE 'done' END AS state,
  row_number() OVER (PARTITION BY CASE WHEN p.width IS NULL THEN 'missing' WHEN p.width <> 1200 THEN 'wrong_size' ELSE 'done' END, ts ORDER BY entry_id DESC, catalyst_id) AS place
FROM cards LEFT JOIN pictures p USING (catalyst_id)""")
def p23(t):
    """Pictures to make for cards, a day's in one go: those that are missing, or whose header has another size than cards
    should have."""
    wide, narrow = ("89504E470D0A1A0A0000000D49484452" + f"{w:08X}{630:08X}" for w in (1200, 600))
    orders = t.raw("orders").where("o_totalprice >= 60000")
    picture = F.unhex(F.when(F.col("o_orderstatus") == "F", wide).otherwise(narrow))
    pictures = orders.select(F.col("o_orderkey").alias("catalyst_id"), picture.alias("content"))
    rows = t.catalysts.select("catalyst_id", "entry_id", "ts").join(pictures, "catalyst_id", "left")
    width, height = tx.png_size(F.col("content"), 0), tx.png_size(F.col("content"), 1)
    state = F.when(F.col("content").isNull(), "missing").when((width != 1200) | (height != 630), "wrong_size").otherwise("done")
    queue = Window.partitionBy("state", "ts").orderBy(F.desc("entry_id"), "catalyst_id")
    return rows.withColumn("state", state).select("entry_id", "state", F.row_number().over(queue).cast("long").alias("place"))


@query("p21_prompt_diff", """
WITH o AS (SELECT catalyst_id, rel_type, count(*) AS n FROM relationships WHERE l_linenumber % 2 = 0 GROUP BY 1, 2), w AS (SELECT catalyst_id, rel_type, count(*) AS n FROM relationships WHERE l_linenumber % 3 = 0 GROUP BY 1, 2)
SELECT CASE WHEN o.n IS NULL THEN 'added' WHEN w.n IS NULL THEN 'dropped' ELSE 'same' END AS change, count(*) AS n FROM o FULL JOIN w USING (catalyst_id, rel_type) GROUP BY 1""")
def p21(t):
    """Two runs over the same events, edge by edge."""
    def run(n, name):
        return t.relationships.where(F.col("l_linenumber") % n == 0).groupBy("catalyst_id", "rel_type").agg(F.count("*").alias(name))

    both = run(2, "a").join(run(3, "b"), ["catalyst_id", "rel_type"], "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "dropped").otherwise("same")
    return both.groupBy(change.alias("change")).agg(F.count("*").alias("n"))
