"""Functions on the cases that define them, and properties of the plans."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from strandwork.functions import dates as dt
from strandwork.functions import fuzzy
from strandwork.functions.extract import stated_edges
from strandwork.functions import numbers as nm
from strandwork.functions import text as tx
from strandwork.operators import log_corrector as lc
from strandwork.operators.changes import inserted_if_absent, latest, merged
from strandwork.operators.components import connected_components
from strandwork.operators.resolver import learned, resolved, unresolved
from strandwork.plans.handles import match_score, verified_by_search
from strandwork.plans.pipelines import TAKEAWAYS
from strandwork.sources import documents


def values(spark, rows, expression, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.select(expression.alias("v"), "i").orderBy("i").collect()]


def test_slugs(spark):
    got = values(spark, [["Figure AI"], ["Johnson & Johnson"], ["AI"], ["Zed Inc", "Zed"]], tx.slug_candidates(F.col("x")), "array<string>")
    assert set(got[0]) >= {"figure-ai", "figure", "figureai"}
    assert "johnson-and-johnson" in got[1]
    assert got[2] == ["ai"] and len(got[3]) == len(set(got[3])) <= 6


def test_slug_from_url(spark):
    urls = ["https://l.example/company/acme-robotics/about", "https://l.example/company/a%26b", "https://l.example/in/x", "https://l.example/company/%C3%A9", None]
    assert values(spark, urls, tx.slug_from_url(F.col("x"))) == ["acme-robotics", None, None, None, None]


def test_names_and_texts(spark):
    assert values(spark, ["  Figure \t AI ", None], tx.name_key(F.col("x"))) == ["figure ai", None]
    assert values(spark, ["a" * 5, "a" * 12], tx.cut(F.col("x"), 10)) == ["aaaaa", "a" * 9 + "…"]
    assert values(spark, ["Indirect: b\nDirect: a", "none", None], tx.short_subtitle(F.col("x"))) == ["b", "", ""]
    assert values(spark, ["no label\nDirect: a", "first\nsecond"], tx.render_subtitle(F.col("x"))) == ["a", "first"]
    assert values(spark, ["Zenobē", "Ünï"], tx.folded(F.col("x"))) == ["Zenobe", "Uni"]
    post = values(spark, ["h" * 400], tx.short_post(F.col("x"), F.array(*map(F.lit, "ABCD"))))[0]
    assert len(post) <= 250 and post.endswith("… $A $B $C")


def test_similarity():
    assert fuzzy.ratio("abcd", "abcd") == 100 and fuzzy.ratio("", "") == 100 and fuzzy.ratio("a", "") == 0
    assert fuzzy.ratio("lewenstein", "levenshtein") == pytest.approx(100 * 2 * 9 / 21)
    assert fuzzy.token_sort_ratio("zenobe energy", "energy zenobe") == 100
    assert fuzzy.weighted_ratio("Figure AI", "figure ai") == 100
    assert fuzzy.weighted_ratio("Humanoid", "Schaeffler Group") < 60


def test_dates(spark):
    raw = ["2026-03-24", "2026-03-24T10:00", "March 24, 2026", "March 21-22, 2026", "March 30 – April 2, 2026", "Dec 30, 2025 to Jan 2, 2026", "24 March 2026", "soon", "", None]
    day = datetime.date
    assert values(spark, raw, dt.first_day(F.col("x"))) == [day(2026, 3, 24), day(2026, 3, 24), day(2026, 3, 24), day(2026, 3, 21), day(2026, 3, 30), day(2025, 12, 30), day(2026, 3, 24), None, None, None]
    assert values(spark, [day(2026, 7, 8), day(2026, 1, 31)], dt.next_refill(F.col("x"), F.lit(11)), "date") == [day(2026, 8, 11), day(2026, 2, 11)]
    assert values(spark, [day(2026, 1, 31)], dt.next_refill(F.col("x"), F.lit(31)), "date") == [day(2026, 2, 28)]
    today = F.lit("2026-07-20").cast("date")
    assert values(spark, [day(2026, 3, 5), day(2026, 7, 8)], dt.rolled_cycle(F.col("x"), F.lit(11), today), "date") == [day(2026, 7, 11), day(2026, 7, 8)]


def test_numbers(spark):
    assert values(spark, [0.25, -1.0], nm.edge_confidence(F.col("x"), F.lit(1.0)), "double") == [0.5, 0.0]
    assert values(spark, [0.0, 1.0, 2.0], nm.heat_colour(F.col("x")), "double") == ["#2850A0", "#E63C28", "#E63C28"]
    assert values(spark, [1, 3, 9], nm.backoff(F.col("x")), "int") == [1.5, 6.0, 30.0]


def test_takeaways_are_settled(spark):
    """Corrected takeaways are as expected, and correcting them again changes nothing."""
    df = spark.createDataFrame([(a, b) for a, b, _ in TAKEAWAYS], "t string, want string")
    once = lc.corrected_takeaways(df, "t").drop("changed")
    assert all(r.t == r.want for r in once.collect())
    again = lc.corrected_takeaways(once, "t")
    assert all(r.t == r.want and not r.changed for r in again.collect())


def test_log_is_settled(spark):
    rows = [(i, None, f"2026-03-{1 + i % 3:02d}", "Robotics" if i % 2 else "Crypto", "Highly positive. Up.") for i in range(12)] + [(99, "old", "never", "Robotics", "x"), (98, None, "2026-03-01", "Weather", "y")]
    log = spark.createDataFrame(rows, "pos int, entry_id string, timestamp string, category string, sentiment_takeaways string")
    once = lc.corrected_log(log)
    kept = once.where("rejected is null")
    ids = [r.entry_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) == 12 and "ROB-030226-001" in ids
    assert {r.rejected for r in once.where("rejected is not null").collect()} == {"unreadable date", "unknown category"}
    columns = log.columns
    twice = lc.corrected_log(kept.select(*columns)).select(*columns)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, kept.select(*columns).collect()))


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "T")], "k int, name string, ticker string")
    new = spark.createDataFrame([(2, "B", None), (3, "c", "N")], "k int, name string, ticker string")
    once = merged(old, new, ["k"], keep_old=["ticker"], fixed=["name"])
    want = {(1, "a", None), (2, "b", "T"), (3, "c", "N")}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in merged(once, new, ["k"], keep_old=["ticker"], fixed=["name"]).collect()} == want
    assert inserted_if_absent(old, new, ["k"]).count() == 3
    assert {tuple(r) for r in latest(old.unionByName(new), ["k"], "name").collect()} == {(1, "a", None), (2, "b", "T"), (3, "c", "N")}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (7, 7), (None, 3)] + [(200, 201 + i) for i in range(50)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert {found[i] for i in range(2, 61)} == {1} and found[101] == found[102] == 100 and {found[201 + i] for i in range(50)} == {200}
    assert connected_components(spark.createDataFrame([], "a int, b int")).collect() == []


def test_match_scores(spark):
    """Suffixes, filler words and marks do not tell names apart; other words do."""
    pairs = [("Figure", "Figure AI", True), ("Schaeffler Group", "Schaeffler Group", True), ("Zenobe Energy", "Zenobē", True), ("Humanoid Global Holdings", "Humanoid", False), ("Figure Skating Club", "Figure AI", False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string").coalesce(1)
    got = [r.s >= 90 for r in df.select(match_score(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [like for *_, like in pairs]


def test_stated_edges(spark):
    said = ["Acme Robotics acquires Figure AI. It may not.", "Nvidia may invests in Bolt#12 soon, and Bolt#12 supplies Nvidia.", "nothing here", "", None]
    got = values(spark, said, stated_edges(F.col("x")))
    assert [tuple(e) for e in got[0]] == [("Acme Robotics", "acquires", "Figure AI", "direct")]
    assert [tuple(e) for e in got[1]] == [("Nvidia", "invests_in", "Bolt#12", "speculative"), ("Bolt#12", "supplies", "Nvidia", "direct")]
    assert got[2:] == [[], [], []]


def test_learned_aliases(spark):
    """What resolution teaches is found exactly by the next run."""
    entities = spark.createDataFrame([(1, "Nvidia"), (2, "Figure AI")], "entity_id long, name string")
    aliases = spark.createDataFrame([("FIG", 2)], "alias string, entity_id long")
    mentions = spark.createDataFrame([("the chip maker", "Nvidia"), ("Nvdia", "Nvdia"), ("fig", "Figure Inc."), ("X", "Quite Unlike")], "mention string, resolved string")
    first = resolved(mentions, entities, aliases)
    new = learned(first, aliases)
    assert {tuple(r) for r in new.collect()} == {("the chip maker", 1), ("Nvdia", 1)}
    assert {tuple(r) for r in unresolved(first).collect()} == {("X", "Quite Unlike")}
    again = resolved(mentions, entities, aliases.unionByName(new))
    assert {(r.mention, r.tier) for r in again.collect()} == {("the chip maker", 1), ("Nvdia", 1), ("fig", 1), ("X", 3)}


def test_search_verification(spark):
    def results(*rows):
        return spark.createDataFrame([("acme#1", i, "Acme#1", f"https://l/company/{slug}", text, "robotics") for i, (slug, text) in enumerate(rows)], "name_key string, pos int, title string, link string, snippet string, sector string")

    assert verified_by_search(results(("a", "words"))).first()[1:] == ("a", 0.75, "industry unconfirmed")
    assert verified_by_search(results(("a", "words"), ("b", "robotics"))).first()[1:] == ("b", 1.0, "verified")
    assert verified_by_search(results(("a", "robotics"), ("b", "robotics"))).first()[1:] == (None, 0.0, "ambiguous")
    assert verified_by_search(results(("a", "robotics"), ("a", "robotics"))).first()[1:] == ("a", 1.0, "verified")


def test_documents(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text(json.dumps([{"entry_id": "ROB-1", "category": "Robotics", "_hash": "x"}, {"entry_id": None, "finding": "f"}]))
    log = documents.read_findings(spark, str(path))
    assert log.count() == 2 and "_hash" not in log.columns
    documents.write_json_lines(log, str(tmp_path / "lines"))
    assert sorted(map(repr, documents.read_findings(spark, str(tmp_path / "lines"), lines=True).collect())) == sorted(map(repr, log.collect()))
    for rows in ([("a", 1), ("b", 1)], [("a", 2)]):
        documents.overwrite_sectors(spark.createDataFrame(rows, "sector string, v int"), str(tmp_path / "parts"))
    assert {(r.sector, r.v) for r in spark.read.parquet(str(tmp_path / "parts")).collect()} == {("a", 2), ("b", 1)}
    (tmp_path / "cards").mkdir()
    (tmp_path / "cards" / "c1.png").write_bytes(bytes.fromhex("89504E470D0A1A0A0000000D49484452000004B000000276"))
    found = documents.content_hashes(spark, str(tmp_path / "cards"))
    row = found.select("key", tx.png_size(F.col("content"), 0).alias("w"), tx.png_size(F.col("content"), 1).alias("h")).first()
    assert tuple(row) == ("c1", 1200, 630)
    documents.write_payload(spark.createDataFrame([(1, "x")], "schema_version int, sector string"), str(tmp_path / "payload"))
    assert json.loads(spark.read.text(str(tmp_path / "payload")).first()[0]) == {"schema_version": 1, "sector": "x"}


def test_stream_equals_batch(spark, tmp_path):
    """An interrupted ingest goes on where it stopped, and a batch that runs again changes nothing."""
    from strandwork.streaming import ingest

    schema = ingest.EVENTS
    rows = [(i, datetime.datetime(2024, 1, 1 + i % 9), i % 4, "view" if i % 3 else "click", 1.0, "{}") for i in range(60)]
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 25], schema).coalesce(1).write.parquet(str(tmp_path / f"in/events.parquet/{n}"))
    flat = tmp_path / "flat" / "events.parquet"
    flat.mkdir(parents=True)
    for n, part in enumerate(sorted((tmp_path / "in").rglob("*.parquet"))):
        if part.is_file():
            part.rename(flat / f"{n}.parquet")
    root, told = f"file://{tmp_path}/store", []
    ingest.ingested(spark, str(tmp_path / "flat"), root, lambda rows: told.append({r.event_type: r.written for r in rows.collect()}), maxFilesPerTrigger=1)
    store = ingest.Store(spark, ingest.LOG, root)  # as another driver sees it
    assert sorted(r.event_id for r in store.read("log").collect()) == list(range(60))
    assert {r.event_type: r.last_day.day for r in store.read("cursors").collect()} == {"view": 9, "click": 7}
    assert len(told) == 3 and sum(sum(x.values()) for x in told) == 60
    before = sorted(map(tuple, store.read("log").collect()))
    again = spark.createDataFrame([r for r in before if r[0] >= 40], ingest.LOG["log"])
    assert not store.change(max(store.commits()), lambda change: change.append("log", again))
    assert sorted(map(tuple, store.read("log").collect())) == before

    more = [(i, datetime.datetime(2024, 2, 1), 1, "view", 1.0, "{}") for i in range(55, 64)]
    spark.createDataFrame(more, schema).coalesce(1).write.parquet(str(tmp_path / "in/more"))
    next((tmp_path / "in" / "more").glob("*.parquet")).rename(flat / "9.parquet")

    def fails(rows):
        raise OSError("nobody listens")

    ingest.ingested(spark, str(tmp_path / "flat"), root, fails)
    assert sorted(r.event_id for r in store.read("log").collect()) == list(range(64)) and len(store.commits()) == 4
    assert {r.event_type: r.last_day.month for r in store.read("cursors").collect()} == {"view": 2, "click": 1}


def test_store(spark, tmp_path):
    """Three tables change together or not at all; a second writer is refused; a step is done once."""
    from strandwork.streaming.store import Busy, Store

    schemas = {"a": "x int", "b": "y string", "c": "z int"}
    store = Store(spark, schemas, f"file://{tmp_path}/s")
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("q",)], "y string")

    def work(change):
        change.append("a", one)
        change.append("b", two)
        change.append("c", one.toDF("z"))

    def broken(change):
        change.append("a", one)
        change.replace("b", two.limit(0))
        raise ValueError("c cannot be made")

    counts = lambda: [Store(spark, schemas, store.root).read(n).count() for n in "abc"]
    assert counts() == [0, 0, 0] and store.change(0, work) and counts() == [1, 1, 1]
    with pytest.raises(ValueError, match="cannot"):
        store.change(1, broken)
    assert counts() == [1, 1, 1] and not store.change(0, work) and store.change(1, work) and counts() == [2, 2, 2]
    assert store.change(2, lambda change: change.replace("a", one)) and counts() == [1, 2, 2]
    with store.locked(), pytest.raises(Busy):
        Store(spark, schemas, store.root).change(3, work)
    with store.locked():
        store.break_lock()
        with store.locked():
            pass
    assert counts() == [1, 2, 2]


def test_scores_use_all_cores(spark):
    """Names are few bytes, and their scores much work: a small file is not left to a task or two."""
    from pyspark.sql import DataFrame

    from strandwork.plans.registry import QUERIES

    df: DataFrame = QUERIES["u1_similar_names"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_parts_of_names():
    """The best window, by its definition."""
    import random

    draw = random.Random(5)
    for _ in range(300):
        a, b = ("".join(draw.choices("abc ", k=draw.randint(0, 9))) for _ in range(2))
        a, b = sorted((a, b), key=len)
        windows = {b[max(0, i) : i + len(a)] for i in range(1 - len(a), len(b))}
        assert fuzzy.partial_ratio(a, b) == (max(fuzzy.ratio(a, w) for w in windows) if a else 100.0 if not b else 0.0)


def test_folded_a_few_at_a_time(spark):
    """Texts cross to Python only if they have something to fold, and few are taken at a time; results are those of all."""
    import unicodedata

    import pyarrow as pa

    every = ["".join(map(chr, range(k, k + 512))) for k in (*range(0, 0xD800, 512), *range(0xE000, 0x20000, 512))]
    said = ["plain", "Ça é", None, "", "ﬁ Ⅷ ½", "漢字", "\x7f\x80", "e\u0301"] * (tx.FOLDED_ROWS // 3) + every + [c for c in "".join(every[:3])]
    want = [None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode() for v in said]
    assert tx.fold(pa.array(said)).to_pylist() == want and tx.fold(pa.array([], pa.string())).to_pylist() == []
    rows = spark.createDataFrame(list(enumerate(said)), "i int, v string").orderBy("i")
    assert [r.v for r in rows.select(tx.folded(F.col("v")).alias("v")).collect()] == want
