"""Events that report earlier ones again, against all pairs, and amounts in headlines."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from strandwork.operators.same_event import alike, amount, classes_of, event_key, reported_again

EVENTS = "event_id long, day int, ids array<long>, words array<string>, key string"


def brute(rows, days, least, overlap):
    out = []
    for e, day, ids, words, key in rows:
        found = []
        for f, before, others, said, was in rows:
            w = set(words) & set(said)
            if (before, f) < (day, e) and day - before <= days and len(set(ids) & set(others)) >= least and words and said and len(w) >= overlap * min(len(set(words)), len(set(said))) - 1e-9:
                found.append((before, f, was))
        if found:
            _, f, was = max(found, key=lambda x: x[:2])
            out.append((e, f, "supersedes" if key is not None and key == was else "follows_from"))
    return sorted(out)


@pytest.mark.parametrize(("days", "least", "overlap"), [(10, 2, 0.7), (30, 1, 0.5), (7, 3, 1.0)])
def test_all_pairs(spark, days, least, overlap):
    """A hot entity and a phrase that every headline has, empty sets, copies on one day and on others."""
    r = random.Random(days)
    rows = []
    for k in range(260):
        ids = r.sample(range(1, 12), r.randint(0, 4)) + [99] * (r.random() < 0.8)
        words = r.sample("alpha beta gamma delta pi rho".split(), r.randint(0, 4)) + ["secures", "million"] * (r.random() < 0.7)
        rows.append((k, r.randrange(80), ids, words, r.choice([None, "1:deal:$5", "2:deal:$7"])))
    rows += [(300 + k, rows[k][1] + k % 9, rows[k][2], rows[k][3], rows[k][4]) for k in range(0, 90, 2)]
    got = reported_again(spark.createDataFrame(rows, EVENTS), days, least, overlap).collect()
    assert sorted(map(tuple, got)) == brute(rows, days, least, overlap)
    assert len(got) > 20 and len({r[2] for r in got}) == 2


def test_headlines(spark):
    """Formulaic headlines of different companies stay apart; the same round, said otherwise, does not."""
    rows = [
        (1, 0, [1, 2], "Alder Robotics Secures $735 Million, Intensifying Humanoid Robot Competition"),
        (2, 3, [3, 4], "Birch Dynamics Secures $520 Million Mega-Round, Intensifying Humanoid Robot Competition"),
        (3, 6, [5, 6], "Cedar Machines Secures €1 Billion Funding, Intensifying Humanoid Robot Competition"),
        (4, 9, [7, 8], "Dogwood AI Secures $400 Million Funding, Intensifying Physical AI"),
        (5, 44, [7, 8, 9], "Dogwood AI Secures $400M Funding to Advance Physical AI"),
        (6, 60, [7, 8], "Dogwood AI Funding Secures Physical AI $1.5bn"),
        (7, 400, [7, 8], "Dogwood AI Secures $400 Million Funding, Intensifying Physical AI"),
    ]
    df = spark.createDataFrame(rows, "event_id long, day int, ids array<long>, headline string")
    words = F.split(F.lower(F.regexp_replace("headline", "[^A-Za-z ]+", "")), " +")
    events = df.select("event_id", "day", "ids", words.alias("words"), event_key(F.col("ids")[0], F.lit("funding"), F.col("headline")).alias("key"))
    assert sorted(map(tuple, reported_again(events).collect())) == [(5, 4, "supersedes"), (6, 5, "follows_from")]


def test_amounts(spark):
    said = {"$400 Million": "$400000000", "raises $400M now": "$400000000", "€1 Billion": "€1000000000", "$1,250 in fees": "$1250", "£2.5bn": "£2500000000", "$3.2k": "$3200", "$5 mice": "$5", "no money": None, None: None, "$2.5 and $9": "$3", "¥5": None}
    df = spark.createDataFrame([(k,) for k in said], "text string")
    assert {r.text: r.a for r in df.select("text", amount(F.col("text")).alias("a")).collect()} == said


def test_hot_entities_do_not_square(spark):
    """Events of one day with two common entities and no word in common do not meet, events with no entity neither."""
    n = 4000
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.lit(5).alias("day"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), 100 + F.col("id")).alias("ids"), F.array(F.lit("secures"), F.lit("million"), *[F.concat(F.lit(x), F.col("id").cast("string")) for x in "abcd"]).alias("words"), F.lit(None).cast("string").alias("key"))
    members, classes = classes_of(rows, 45)
    assert members.count() == n and alike(classes, 2, 0.7).where("a <> b").count() == 0
    assert reported_again(rows).count() == 0


def test_entries_that_meet_nothing_are_small(spark):
    """What the index deals of events that meet no other does not grow with their headlines for each entry."""

    def written():
        time.sleep(1)
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    words = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.md5(F.concat_ws("-", F.col("id").cast("string"), i.cast("string"))))
    ids = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.col("id") * 6 + i)
    classes = spark.range(500).select(F.col("id").alias("class"), F.lit(0).alias("bucket"), ids.alias("ids"), words.alias("words"))
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = written()
        assert alike(classes, 2, 0.7).where("a <> b").count() == 0
        assert written() - before < 12_000_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
