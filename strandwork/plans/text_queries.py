"""Functions of text, dates, numbers and nested values over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwork.functions.redact import redacted
from strandwork.functions import dates as dt
from strandwork.functions import numbers as nm
from strandwork.functions import text as tx
from strandwork.plans.base import query
from strandwork.plans.filters import EXTRACTED_SQL, extracted
from strandwork.schema import SECTORS
from strandwork.sources.graph_tables import nth

SAMPLE_NAMES = ["Figure AI", "Johnson & Johnson", "Schaeffler Group", "Boston Dynamics Inc", "Power Labs AI"]


@query("c1_name_keys", r"SELECT name, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS name_key FROM entities")
def c1(t):
    return t.entities.select("name", tx.name_key(F.col("name")).alias("name_key"))


PLAIN_SQL = r"plain AS (SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS text FROM documents)"


@query("c2_tokens", rf"""
WITH {PLAIN_SQL}
SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''), ' ') AS words
FROM plain""", base=False)
def c2(t):
    return t.raw("documents").select("doc_id", F.array_join(tx.tokens(tx.folded(F.col("text"))), " ").alias("words"))


@query("u2_folded_text", f"WITH {PLAIN_SQL} SELECT doc_id, md5(text) AS folded FROM plain", base=False)
def u2(t):
    return t.raw("documents").select("doc_id", F.md5(tx.folded(F.col("text"))).alias("folded"))


@query("c4_slugs", """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'figure-ai,figure,figureai' WHEN 1 THEN 'johnson-and-johnson,johnsonandjohnson' WHEN 2 THEN 'schaeffler-group,schaeffler,schaefflergroup'
  WHEN 3 THEN 'boston-dynamics-inc,boston-dynamics,bostondynamicsinc' ELSE 'power-labs-ai,power,powerlabsai' END AS slugs FROM customer""", base=False)
def c4(t):
    """C3 and C4: slugs with trailing filler words and without."""
    name = nth(SAMPLE_NAMES, (F.col("c_custkey") % 5).cast("int"))
    return t.raw("customer").select("c_custkey", F.array_join(tx.slug_candidates(F.array(name)), ",").alias("slugs"))


@query("c5_page_names", r"""
SELECT page_id, CASE WHEN regexp_matches(title, '(?i)sign up|log in') THEN NULL ELSE string_split(title, ' ')[1] END AS name
FROM (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages)""", base=False)
def c5(t):
    pages = t.raw("pages").select("page_id", tx.html_title(F.col("html")).alias("title"))
    return pages.select("page_id", F.when(~F.col("title").rlike("(?i)sign up|log in"), F.get(F.split("title", " "), F.lit(0))).alias("name"))


STOP_SQL = ", ".join(f"'{w}'" for w in tx.CONTEXT_STOPWORDS)


@query("c7_context_terms", rf"""
WITH {PLAIN_SQL},
w AS (SELECT DISTINCT doc_id, unnest(string_split(trim(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' ')) AS w FROM plain)
SELECT doc_id, count(*) AS n_terms, count(*) FILTER (WHERE w IN ('tion', 'thing', 'erst', 'onthe', 'inthe', 'heat')) AS hits FROM w WHERE length(w) >= 3 AND w NOT IN ({STOP_SQL}) GROUP BY doc_id""", base=False)
def c7(t):
    """C7 and C8: context words, and how many a text has of them."""
    context = F.array(*map(F.lit, ["tion", "thing", "erst", "onthe", "inthe", "heat"]))
    docs = t.raw("documents").select("doc_id", tx.folded(F.col("text")).alias("text"))
    terms = docs.select("doc_id", F.size(tx.context_terms(F.col("text"))).cast("long").alias("n_terms"), tx.context_hits(F.col("text"), context, F.array(F.lit("ofthe"))).cast("long").alias("hits"))
    return terms.where("n_terms > 0")


@query("c9_slugs_from_urls", r"""
WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://l.example/company/acme-robotics/about' WHEN 1 THEN 'https://l.example/company/a%26b' WHEN 2 THEN 'https://l.example/in/someone' ELSE concat('https://l.example/company/p', CAST(page_id AS VARCHAR), '?x=1') END AS url FROM pages),
s AS (SELECT page_id, url_decode(regexp_extract(url, '/company/([^/?#]+)', 1)) AS s FROM u)
SELECT page_id, CASE WHEN regexp_full_match(s, '[A-Za-z0-9][A-Za-z0-9._-]*') THEN s END AS slug FROM s""", base=False)
def c9(t):
    p = F.col("page_id")
    url = F.when(p % 4 == 0, "https://l.example/company/acme-robotics/about").when(p % 4 == 1, "https://l.example/company/a%26b").when(p % 4 == 2, "https://l.example/in/someone")
    url = url.otherwise(F.concat(F.lit("https://l.example/company/p"), p.cast("string"), F.lit("?x=1")))
    return t.raw("pages").select("page_id", tx.slug_from_url(url).alias("slug"))


@query("c10_profile_titles", r"""
WITH s AS (SELECT c_custkey, concat(c_name, ' (@', CASE WHEN c_custkey % 3 = 0 THEN upper(concat('c', CAST(c_custkey AS VARCHAR))) ELSE 'other' END, ') / X') AS title, concat('https://x.com/c', CAST(c_custkey AS VARCHAR)) AS link FROM customer)
SELECT c_custkey, regexp_extract(title, '^(.*?) \(@', 1) AS name, CASE WHEN lower(regexp_extract(title, '\(@([A-Za-z0-9_]+)\)', 1)) = lower(regexp_extract(link, 'x\.com/([A-Za-z0-9_]+)', 1)) THEN regexp_extract(title, '\(@([A-Za-z0-9_]+)\)', 1) END AS handle FROM s""", base=False)
def c10(t):
    """A handle counts where title and link agree on it in any case; the title's case stays."""
    key = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    said = F.when(F.col("c_custkey") % 3 == 0, F.upper(key)).otherwise("other")
    rows = t.raw("customer").select("c_custkey", F.concat("c_name", F.lit(" (@"), said, F.lit(") / X")).alias("title"), F.concat(F.lit("https://x.com/"), key).alias("link"))
    handle, linked = F.regexp_extract("title", r"\(@([A-Za-z0-9_]+)\)", 1), F.regexp_extract("link", r"x\.com/([A-Za-z0-9_]+)", 1)
    return rows.select("c_custkey", F.regexp_extract("title", r"^(.*?) \(@", 1).alias("name"), F.when(F.lower(handle) == F.lower(linked), handle).alias("handle"))


@query("c11_subtitles", """
SELECT catalyst_id, trim(substring(string_split(sentiment_takeaways, chr(10))[1], 8)) AS subtitle, trim(substring(string_split(sentiment_takeaways, chr(10))[1], 8)) AS wide FROM catalysts""")
def c11(t):
    """C11 and C12."""
    text = F.col("sentiment_takeaways")
    return t.catalysts.select("catalyst_id", tx.short_subtitle(text).alias("subtitle"), tx.render_subtitle(text).alias("wide"))


@query("c13_posts", """
SELECT catalyst_id, concat(CASE WHEN length(h) > 235 THEN concat(substring(h, 1, 234), '…') ELSE h END, ' $AAA $BBB $CCC') AS post, concat(subject, chr(10), chr(10), 'Learn more') AS long_post
FROM (SELECT catalyst_id, subject, CASE WHEN catalyst_id % 2 = 0 THEN repeat(headline, 12) ELSE headline END AS h FROM catalysts)""")
def c13(t):
    """C13 and C14."""
    head = F.when(F.col("catalyst_id") % 2 == 0, F.repeat("headline", 12)).otherwise(F.col("headline"))
    tickers = F.array(*map(F.lit, ["AAA", "BBB", "CCC", "DDD"]))
    return t.catalysts.select("catalyst_id", tx.short_post(head, tickers).alias("post"), tx.long_post(F.col("subject"), F.lit(""), F.lit(None).cast("string"), F.lit("Learn more")).alias("long_post"))


@query("c15_cut_texts", "SELECT doc_id, CASE WHEN length(text) > 80 THEN concat(substring(text, 1, 79), '…') ELSE text END AS short FROM documents", base=False)
def c15(t):
    return t.raw("documents").select("doc_id", tx.cut(F.col("text"), 80).alias("short"))


@query("c16_labels", """
SELECT rel_type, array_to_string(list_transform(string_split(rel_type, '_'), lambda w: concat(upper(w[1]), w[2:])), ' ') AS label, replace(concat(rel_type, '/x'), '/', '__') AS doc_key, count(*) AS n FROM relationships GROUP BY rel_type""")
def c16(t):
    """C16 and C26."""
    counts = t.relationships.groupBy("rel_type").agg(F.count("*").alias("n"))
    return counts.select("rel_type", tx.label(F.col("rel_type")).alias("label"), tx.document_key(F.concat("rel_type", F.lit("/x"))).alias("doc_key"), "n")


@query("c17_entry_ids", """
SELECT event_id, concat((['ROB', 'CRY', 'AIS', 'SPD', 'PWE', 'STM'])[CAST(event_id % 6 AS INT) + 1], '-', strftime(ts, '%m%d%y'), '-', CASE WHEN event_id < 1000 THEN lpad(CAST(event_id AS VARCHAR), 3, '0') ELSE CAST(event_id AS VARCHAR) END) AS entry_id FROM events""", base=False)
def c17(t):
    """Three digits at least; larger numbers are not cut."""
    code = nth(list(SECTORS.values()), (F.col("event_id") % 6).cast("int"))
    return t.raw("events").select("event_id", F.concat(code, F.lit("-"), F.date_format("ts", "MMddyy"), F.lit("-"), F.format_string("%03d", "event_id")).alias("entry_id"))


@query("c25_prompt_lines", "c25_prompt_lines_all", """
SELECT catalyst_id, array_to_string(list_transform(list_sort(list(rel_type))[1:8], lambda r, i: concat('[', CAST(i AS VARCHAR), '] ', r)), chr(10)) AS cites FROM
(SELECT DISTINCT catalyst_id, rel_type FROM relationships) GROUP BY catalyst_id""")
def c25(t):
    """The first eight sources, numbered from 1."""
    rels = t.relationships.select("catalyst_id", "rel_type").distinct().groupBy("catalyst_id").agg(F.slice(F.array_sort(F.collect_list("rel_type")), 1, 8).alias("r"))
    lines = F.transform("r", lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), r))
    return rels.select("catalyst_id", F.array_join(lines, "\n").alias("cites"))


@query("c27_value_kinds", """
WITH v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN '-12' WHEN 2 THEN '3.5' WHEN 3 THEN 'null' WHEN 4 THEN 'abc' ELSE 'False' END AS v FROM events)
SELECT v, CASE v WHEN 'true' THEN 'bool' WHEN '-12' THEN 'int' WHEN '3.5' THEN 'float' WHEN 'null' THEN 'null' WHEN 'abc' THEN 'str' ELSE 'bool' END AS kind, count(*) AS n FROM v GROUP BY v""", base=False)
def c27(t):
    v = nth(["true", "-12", "3.5", "null", "abc", "False"], (F.col("event_id") % 6).cast("int"))
    return t.raw("events").select(v.alias("v")).groupBy("v").agg(F.count("*").alias("n")).select("v", tx.typed_value(F.col("v")).alias("kind"), "n")


@query("t1_iso_days", """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events""", base=False)
def t1(t):
    raw = F.when(F.col("event_id") % 9 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return t.raw("events").select("event_id", dt.iso_day(raw).alias("day"))


@query("t2_loose_dates", """
SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL WHEN 2 THEN DATE '2026-03-21' WHEN 3 THEN DATE '2026-03-30' WHEN 4 THEN DATE '2026-05-01' ELSE CAST(ts AS DATE) END AS day FROM events""", base=False)
def t2(t):
    """Dates as people write them: ISO, "March 24, 2026", ranges (their first day), or nothing that can be read."""
    k = F.col("event_id") % 6
    raw = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, F.date_format("ts", "MMMM d, yyyy")).when(k == 2, "March 21-22, 2026")
    raw = raw.when(k == 3, "March 30 – April 2, 2026").when(k == 4, "May 1 to May 3, 2026").otherwise("next week")
    return t.raw("events").select("event_id", dt.first_day(raw).alias("day"))


@query("t4_refill_cycles", """
WITH p AS (SELECT c_custkey, CAST(DATE '2001-01-31' + CAST(c_custkey % 150 AS INT) AS DATE) AS cs, CAST(c_custkey % 31 + 1 AS INT) AS rd FROM customer),
m AS (SELECT *, unnest(range(1, 9)) AS i FROM p),
d AS (SELECT c_custkey, cs, rd, i, CAST(least(date_trunc('month', cs) + to_months(CAST(i AS INT)) + to_days(rd - 1), last_day(date_trunc('month', cs) + to_months(CAST(i AS INT)))) AS DATE) AS r FROM m)
SELECT c_custkey, min(r) AS next_refill, coalesce(max(r) FILTER (WHERE r <= DATE '2001-08-01'), cs) AS cycle_start FROM d GROUP BY c_custkey, cs""", base=False)
def t4(t):
    """T4 and T5: always next month's refill day, clamped; cycles are rolled up to the day of the run."""
    start = F.date_add(F.lit("2001-01-31").cast("date"), (F.col("c_custkey") % 150).cast("int"))
    day = (F.col("c_custkey") % 31 + 1).cast("int")
    return t.raw("customer").select("c_custkey", dt.next_refill(start, day).alias("next_refill"), dt.rolled_cycle(start, day, F.lit("2001-08-01").cast("date")).alias("cycle_start"))


@query("t8_epoch_days", "SELECT event_id, CAST(ts AS DATE) AS day FROM events", base=False)
def t8(t):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.raw("events").select("event_id", F.to_date(F.timestamp_millis(millis)).alias("day"))


@query("m1_edge_confidence", "SELECT catalyst_id, l_linenumber, round(sqrt(greatest(0, mechanism_strength - 0.6) * greatest(0, impact_magnitude)), 6) AS confidence, round(least(1.0, confidence + 0.15), 6) AS boosted, round(greatest(0.0, confidence - 0.30), 6) AS lowered FROM relationships")
def m1(t):
    """M1 and M7."""
    c = F.col("confidence")
    return t.relationships.select("catalyst_id", "l_linenumber", F.round(nm.edge_confidence(F.col("mechanism_strength") - 0.6, F.col("impact_magnitude")), 6).alias("confidence"), F.round(nm.clamped(c + 0.15), 6).alias("boosted"), F.round(nm.clamped(c - 0.30), 6).alias("lowered"))


@query("m2_half_even", "SELECT event_id, round_even(event_id / 8.0, 2) AS r FROM events", base=False)
def m2(t):
    return t.raw("events").select("event_id", F.bround(F.col("event_id") / F.lit(8.0), 2).alias("r"))


@query("m3_heat_colours", """
SELECT event_id, concat('#', lpad(to_hex(CAST(floor(40 + 190 * h + 0.5) AS BIGINT)), 2, '0'), lpad(to_hex(CAST(floor(80 - 20 * h + 0.5) AS BIGINT)), 2, '0'), lpad(to_hex(CAST(floor(160 - 120 * h + 0.5) AS BIGINT)), 2, '0')) AS colour,
       CASE WHEN h < 0.5 THEN 'low' WHEN h < 0.8 THEN 'mid' ELSE 'high' END AS level, round(h * 5) AS dots FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS h FROM events)""", base=False)
def m3(t):
    """M3 and M5."""
    h = (F.col("event_id") % 101) / F.lit(100.0)
    return t.raw("events").select("event_id", nm.heat_colour(h).alias("colour"), nm.level(h).alias("level"), F.round(h * 5).alias("dots"))


@query("m6_budget_halves", "SELECT c_custkey, greatest(1, CAST(floor((c_custkey % 9) / 2) AS BIGINT)) AS share, least(30.0, 1.5 * pow(2, c_custkey % 7)) AS wait FROM customer", base=False)
def m6(t):
    """M6 and M8."""
    k = F.col("c_custkey")
    return t.raw("customer").select("c_custkey", F.greatest(F.lit(1).cast("long"), F.floor((k % 9) / 2)).alias("share"), nm.backoff(k % 7 + 1).alias("wait"))


@query("n1_list_columns", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, concat('[', CAST(event_id % 3 AS VARCHAR), ',7]') AS refs FROM events", base=False)
def n1(t):
    """JSON parsed where it is read and made where it is written."""
    refs = F.to_json(F.from_json(F.concat(F.lit("[ "), (F.col("event_id") % 3).cast("string"), F.lit(" , 7 ]")), "array<int>"))
    return t.raw("events").select("event_id", F.from_json("props", "struct<k: bigint>")["k"].alias("k"), refs.alias("refs"))


@query("n2_source_refs", """
SELECT catalyst_id, l_linenumber, array_to_string(list_filter([CAST(l_partkey % 5 AS INT), 2, CAST(l_linenumber AS INT)], lambda i: i BETWEEN 1 AND 4), ',') AS refs FROM relationships""")
def n2(t):
    refs = F.array((F.col("l_partkey") % 5).cast("int"), F.lit(2), F.col("l_linenumber").cast("int"))
    kept = F.filter(refs, lambda i: i.between(1, 4))
    return t.relationships.select("catalyst_id", "l_linenumber", F.array_join(kept, ",").alias("refs"))


@query("n3_downgraded", """
SELECT CASE WHEN evidence_type = 'inferred' AND l_partkey % 3 = 0 THEN 'speculative' ELSE evidence_type END AS evidence_type, count(*) AS n FROM relationships GROUP BY 1""")
def n3(t):
    """An inferred edge that names no source where there are some is speculation."""
    refs = F.when(F.col("l_partkey") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    down = (F.col("evidence_type") == "inferred") & (F.size(refs) == 0)
    return t.relationships.groupBy(F.when(down, "speculative").otherwise(F.col("evidence_type")).alias("evidence_type")).agg(F.count("*").alias("n"))


@query("n4_unknown_fields", """
SELECT catalyst_id, l_linenumber, array_to_string(list_filter([CASE WHEN l_linenumber > 3 THEN concat('note=line ', CAST(l_linenumber AS VARCHAR)) END, CASE WHEN l_partkey % 2 = 0 THEN concat('part=', CAST(l_partkey AS VARCHAR)) END], lambda x: x IS NOT NULL), ';') AS extra FROM relationships""")
def n4(t):
    """Fields of an edge that the schema does not know are carried along as they are."""
    note = F.when(F.col("l_linenumber") > 3, F.concat(F.lit("line "), F.col("l_linenumber").cast("string")))
    body = F.to_json(F.struct("rel_type", "confidence", note.alias("note"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")).alias("part")))
    extra = F.map_filter(F.from_json(body, "map<string, string>"), lambda k, v: ~k.isin("rel_type", "confidence"))
    pairs = F.transform(F.array_sort(F.map_entries(extra)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return t.relationships.select("catalyst_id", "l_linenumber", F.array_join(pairs, ";").alias("extra"))


@query("n9_required_records", """
SELECT s_suppkey, kind, value, action FROM (SELECT s_suppkey, s_name, s_nationkey FROM supplier), LATERAL (VALUES ('A', concat('10.0.', CAST(s_nationkey AS VARCHAR), '.1'), 'ADD'), ('TXT', concat('owner=', s_name), CASE WHEN s_suppkey % 2 = 0 THEN 'NONE' ELSE 'ADD' END)) r(kind, value, action)
WHERE action <> 'NONE'""", base=False)
def n9(t):
    """Records that a domain still needs, of nested answers: wanted sets, each with its records."""
    records = "array<struct<type: string, rdata: string, requiredAction: string>>"
    action = F.when(F.col("s_suppkey") % 2 == 0, "NONE").otherwise("ADD")
    a = F.struct(F.lit("A").alias("type"), F.concat(F.lit("10.0."), F.col("s_nationkey").cast("string"), F.lit(".1")).alias("rdata"), F.lit("ADD").alias("requiredAction"))
    txt = F.struct(F.lit("TXT").alias("type"), F.concat(F.lit("owner="), "s_name").alias("rdata"), action.alias("requiredAction"))
    answer = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(a).alias("records")), F.struct(F.array(txt).alias("records"))).alias("desired")).alias("requiredDnsUpdates")))
    read = F.from_json(answer, f"struct<requiredDnsUpdates: struct<desired: array<struct<records: {records}>>>>")
    flat = t.raw("supplier").select("s_suppkey", F.inline(F.flatten(read["requiredDnsUpdates"]["desired"]["records"])))
    return flat.where("requiredAction <> 'NONE'").select("s_suppkey", F.col("type").alias("kind"), F.col("rdata").alias("value"), F.col("requiredAction").alias("action"))


@query("n6_cards_to_edges", f"""
WITH {EXTRACTED_SQL.strip()}
SELECT entity_a, count(*) AS n FROM extracted GROUP BY entity_a""")
def n6(t):
    """Edges nested in cards, and flat again."""
    edge = F.struct("entity_a", "rel_type", "entity_b")
    cards = extracted(t).groupBy("catalyst_id").agg(F.collect_list(edge).alias("relationships"))
    flat = cards.select(F.explode("relationships").alias("r")).select("r.*")
    return flat.groupBy("entity_a").agg(F.count("*").alias("n"))


@query("n7_first_mentions", """
WITH m AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations) SELECT conv_id, role, n FROM m QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, n) = 1""", base=False)
def n7(t):
    """The first of several entries of a name within a list wins."""
    n = F.length("text").cast("long")
    lists = t.raw("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", n.alias("n"), "role"))).alias("m"))
    flat = lists.select("conv_id", F.posexplode("m").alias("pos", "e"))
    return flat.groupBy("conv_id", F.col("e.role").alias("role")).agg(F.min_by("e.n", "pos").alias("n"))


@query("n8_envelopes", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id END AS id FROM events""", base=False)
def n8(t):
    """Messages wrapped in base64 and JSON; what cannot be read is empty."""
    data = F.base64(F.to_json(F.struct("event_id", "event_type")).cast("binary"))
    raw = F.when(F.col("event_id") % 4 == 0, "bm90IGpzb24=").otherwise(data)
    body = F.from_json(F.unbase64(raw).cast("string"), "struct<event_id: bigint, event_type: string>")
    return t.raw("events").select("event_id", body.alias("b")).select("event_id", F.col("b.event_type").alias("kind"), F.col("b.event_id").alias("id"))


@query("n10_parameters", """
SELECT c_custkey, c_mktsegment AS sector, CAST(c_nationkey AS BIGINT) AS nation FROM customer""", base=False)
def n10(t):
    """Parameters written as ``k:v,k:v``."""
    text = F.concat(F.lit("sector:"), "c_mktsegment", F.lit(",nation:"), F.col("c_nationkey").cast("string"))
    return t.raw("customer").select("c_custkey", F.str_to_map(text, F.lit(","), F.lit(":")).alias("m")).select("c_custkey", F.col("m")["sector"].alias("sector"), F.col("m")["nation"].cast("long").alias("nation"))


@query("n11_redacted", "SELECT c_custkey, c_name FROM customer", base=False)
def n11(t):
    secret = ["c_acctbal", "c_nationkey", "c_mktsegment"]
    return t.raw("customer").drop(*secret)


@query("n11_nested_secrets", """
SELECT c_custkey, concat('{"uid":"', c_name, '","profile":{"nation":', c_nationkey, ',"phones":[{"number":"', c_custkey, '-1"},{"number":"', c_custkey, '-2"}]},"claims":{"sector":"', c_mktsegment, '"}}') AS body FROM customer""", base=False)
def n11_nested(t):
    """User documents with secrets at the top, in structs of lists and among the keys of a map, as they may be shown."""
    key = F.col("c_custkey").cast("string")
    phone = lambda n: F.struct(F.concat(key, F.lit(n)).alias("number"), F.md5(key).alias("salt"))
    profile = F.struct(F.col("c_nationkey").alias("nation"), F.array(phone("-1"), phone("-2")).alias("phones"), F.md5(key).alias("passwordHash"))
    claims = F.create_map(F.lit("sector"), "c_mktsegment", F.lit("Salt"), F.md5(key))
    docs = t.raw("customer").select("c_custkey", F.struct(F.col("c_name").alias("uid"), F.md5(key).alias("passwordHash"), F.md5(key).alias("salt"), profile.alias("profile"), claims.alias("claims")).alias("doc"))
    return redacted(docs, ["passwordHash", "salt"]).select("c_custkey", F.to_json("doc").alias("body"))
