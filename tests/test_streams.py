"""Streams that are stopped and go on: attempts, edges, audits, late rows, and writers that meet."""

from __future__ import annotations

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from strandwork.streaming import attempts, edges
from strandwork.streaming.audit import Audit
from strandwork.streaming.store import Busy, Store

DAY = datetime.timedelta(days=1)
BEGIN = datetime.datetime(2024, 1, 1)
TRIES = "name long, at timestamp_ntz, verdict boolean"


def outcomes_brute(rows, wait):
    out, last = [], max(at for _, at, _ in rows)
    for name in {r[0] for r in rows}:
        until = None
        for _, at, verdict in sorted(r for r in rows if r[0] == name):
            if until == "never":
                out.append((name, at, "settled"))
            elif until is not None and at < until:
                out.append((name, at, "cooling"))
            else:
                if until is not None:
                    out.append((name, until, "due"))
                until = "never" if verdict else at + wait
                out.append((name, at, "verdict" if verdict else "refused"))
        if until not in (None, "never") and until <= last:
            out.append((name, until, "due"))
    return sorted(out)


def test_cooldown_over_restarts(spark, tmp_path):
    """Four runs over what has come by then tell what one run over all of it does; timers fire whoever runs."""
    r = random.Random(2)
    rows = [(r.randrange(6), BEGIN + r.random() * 60 * DAY, r.random() < 0.04) for _ in range(300)] + [(9, BEGIN, False), (8, BEGIN + 59 * DAY, False)]
    rows = [(n, at.replace(microsecond=0), v) for n, at, v in rows]
    root = f"file://{tmp_path}/state"
    for part in range(4):
        some = [x for x in rows if part * 15 <= (x[1] - BEGIN).days < part * 15 + 15]
        spark.createDataFrame(some, TRIES).coalesce(1).write.mode("append").parquet(str(tmp_path / "tries"))
        own = attempts.stateful_session(spark)
        stream = own.readStream.schema(TRIES).parquet(str(tmp_path / "tries"))
        got = attempts.decided(stream, root, reader=spark).collect()
        so_far = [x for x in rows if (x[1] - BEGIN).days < part * 15 + 15]
        assert sorted(map(tuple, got)) == outcomes_brute(so_far, attempts.COOLDOWN)


def edge_rows():
    r = random.Random(8)
    first = datetime.date(2024, 1, 1)
    rows = []
    for k in range(160):
        a, b = r.randrange(1, 5), r.randrange(5, 9)
        rows.append((k, 1, k, a, b, r.choice(["active", "active", "invalidated", "stale"]), round(r.random(), 2), first + datetime.timedelta(days=int(k * 1.5) + r.randrange(3) * (k % 2))))
    return rows


EDGES = "catalyst_id long, l_linenumber long, l_partkey long, entity_a_id long, entity_b_id long, status string, confidence double, ship_date date"


def final_brute(rows, as_of):
    out = []
    for c, n, p, a, b, status, confidence, day in rows:
        last = max(x[7] for x in rows if (x[3], x[4]) == (a, b))
        if last > day:
            confidence = min(1.0, confidence + 0.15)
        elif status == "invalidated":
            confidence = max(0.0, confidence - 0.30)
        elif status == "active" and day < as_of - datetime.timedelta(days=90):
            status = "stale"
        out.append((c, n, p, status, round(confidence, 6)))
    return sorted(out)


def test_lifecycle_over_restarts(spark, tmp_path):
    """Edges come in three parts; each change is told once, and after each part edges are as a batch would have them."""
    rows, told = sorted(edge_rows(), key=lambda x: x[7]), 0
    parts = [rows[:50], rows[50:100], rows[100:]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, EDGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "edges"))
        as_of = part[-1][7] if k < 2 else part[-1][7] + datetime.timedelta(days=60)
        own = attempts.stateful_session(spark)
        stream = own.readStream.schema(EDGES).parquet(str(tmp_path / "edges"))
        changes = edges.changed(stream, as_of, f"file://{tmp_path}/state", reader=spark)
        found = changes.collect()
        assert len({(r.catalyst_id, r.change) for r in found}) == len(found) > told
        told = len(found)
        so_far = [x for p in parts[: k + 1] for x in p]
        assert sorted(map(tuple, edges.final(spark.createDataFrame(so_far, EDGES), changes).collect())) == final_brute(so_far, as_of)
    assert {r.change for r in found} == {"followed", "stale", "invalidated"}


def test_pairs_are_joined_not_called(spark, tmp_path):
    """A new pair costs rows, not calls; runs without edges let time pass and take no batch's place."""
    rows = [(k, 1, k, k, 100_000 + k, "active", 0.5, datetime.date(2024, 1, 1)) for k in range(30_000)]
    place, root = str(tmp_path / "edges"), f"file://{tmp_path}/state"

    def run(as_of):
        stream = attempts.stateful_session(spark).readStream.schema(EDGES).parquet(place)
        return edges.changed(stream, as_of, root, reader=spark)

    spark.createDataFrame(rows, EDGES).write.parquet(place)
    begin = time.monotonic()
    assert run(rows[0][7] + 90 * DAY).count() == 0
    assert time.monotonic() - begin < 20
    assert [run(rows[0][7] + n * DAY).count() for n in (91, 92, 93)] == [30_000] * 3
    later = [(k + 50_000, 1, k, k, 100_000 + k, "invalidated", 0.5, datetime.date(2024, 2, 1)) for k in range(10)]
    spark.createDataFrame(later, EDGES).coalesce(1).write.mode("append").parquet(place)
    counts = run(rows[0][7] + 94 * DAY).groupBy("change").count().collect()
    assert {r["change"]: r["count"] for r in counts} == {"stale": 30_000, "followed": 10, "invalidated": 10}


HANDLES = "name_key string, channel string, handle string, confidence double, source string"


def asked(claims, nth):
    """Names that end in 0 are refused, in 5 only at first; in 3 there is no evidence; even ones get another handle."""
    end = F.substring("name_key", -1, 1).cast("int")
    refused = (end == 0) | ((end == 5) & F.lit(nth == 0))
    blocked = refused | (end == 3)
    handle = F.when(~blocked, F.when(end == 1, None).when(end % 2 == 0, F.concat(F.lit("@"), "name_key")).otherwise(F.col("handle")))
    comment = F.when(refused, "quota").when(end == 3, "no evidence: walled").otherwise("")
    return claims.select("*", handle.alias("new_handle"), F.lit(0.9).alias("new_confidence"), F.when(blocked, "blocked").otherwise("x_serp_verified").alias("new_source"), comment.alias("comment"))


def test_audit_goes_on_after_a_kill(spark):
    rows = [(f"n{k}", "x", f"@old{k}", 0.5 + (k % 6) / 10, "human" if k % 17 == 0 else "blocked" if k % 19 == 0 else "x_serp_verified") for k in range(1, 200)]
    before = spark.createDataFrame(rows, HANDLES)
    whole = Audit(spark)
    whole.begin(before, 0.9, 30)
    for nth in (0, 1):
        whole.run(asked, nth)
    killed = Audit(spark)
    killed.begin(before, 0.9, 30)
    assert killed.run(asked, 0, stop_after=2) == 2
    times = []

    def counted(claims, nth):
        times.append(nth)
        return asked(claims, nth)

    again = Audit(spark, killed.root)
    again.begin(before, 0.9, 7)
    with pytest.raises(ZeroDivisionError):
        again.run(lambda claims, nth: counted(claims, nth) if len(times) < 2 else 1 / 0, 0)
    third = Audit(spark, killed.root)
    for nth in (0, 1):
        third.run(asked, nth)
    assert third.run(asked, 1) == 0
    got, want = (sorted(map(tuple, a.handles(before).collect()), key=repr) for a in (third, whole))
    assert got == want
    stamped = third.store.read("audits").where("outcome <> 'refused'").groupBy("name_key").count()
    assert stamped.where("count > 1").count() == 0
    by_name = {r[0]: r for r in got}
    for name, _, handle, confidence, source in rows:
        r, end = by_name[name], int(name[-1])
        if source in ("human", "blocked") or confidence > 0.9 or end in (0, 3):
            assert r[2:5] == (handle, confidence, source)
            assert (r[6] == "kept") == (end == 3 and source not in ("human", "blocked") and confidence <= 0.9)
        else:
            assert r[5] == (1 if end == 5 else 0) and r[6] == ("abstained" if end == 1 else "changed" if end % 2 == 0 else "confirmed")


def test_writers_that_meet(spark):
    """A step that another writer has committed meanwhile is not lost, nor is a lock that another one holds."""
    schemas = {"t": "k long"}
    store = Store(spark, schemas)
    rows = lambda k: spark.range(k, k + 1).withColumnRenamed("id", "k")

    def slow(change):
        change.append("t", rows(1))
        store.break_lock()  # somebody takes the first writer for dead
        assert Store(spark, schemas, store.root).change(0, lambda c: c.append("t", rows(2)))

    with pytest.raises(Busy):
        store.change(0, slow)
    assert [r.k for r in store.read("t").collect()] == [2]

    def stolen(change):
        change.append("t", rows(3))
        store.break_lock()
        store._put(store._path("lock"), "another writer")

    with pytest.raises(Busy):
        store.change(1, stolen)
    assert store._holds("another writer") and [r.k for r in store.read("t").collect()] == [2]
    with pytest.raises(Busy):
        store.change(2, lambda c: c.append("t", rows(4)))
    store.break_lock()
    assert store.change(1, lambda c: c.append("t", rows(5))) and not store.change(1, lambda c: None)
    assert sorted(r.k for r in store.read("t").collect()) == [2, 5]


