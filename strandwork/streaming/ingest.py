"""Incremental ingest of a log of events as a stream: cursors, no row twice, bounded runs.

Each query runs to the end of what is there and stops; its checkpoint lies beside its tables in the shared folder, so that
the next run goes on from both. A batch is one step of a store (``streaming.store``): all of it is seen or nothing.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.operators.changes import merged
from strandwork.session import settled, shared_dir
from strandwork.streaming.store import Change, Store

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The events table as a stream of files, be it one file or a folder that more come to."""
    return spark.readStream.schema(EVENTS).options(**options).parquet(f"{folder}/events.parque[t]")


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Hands what is new to ``step`` batch by batch, until there is nothing more."""
    spark = stream.sparkSession
    place = checkpoint or f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", place).trigger(availableNow=True).start()
    query.awaitTermination()


#: How many ids have a folder of the log.
BLOCK = 1 << 16
LOG = {"log": "event_id bigint, day date, event_type string, block bigint", "cursors": "event_type string, last_day date, last_id bigint"}


def ingested(spark: SparkSession, folder: str, root: str | None = None, done: Callable[[DataFrame], None] | None = None, strict_cursor: bool = False, **options) -> Store:
    """Log and cursors: each event once by its id, and the last (day, id) of each kind.

    A batch adds its new rows to the log as a part of its own, a folder for each block of ids; of what is there it reads the
    blocks that it has itself, so that its work follows the batch and not the log, whatever day an id comes with. Rows that come behind the cursor of their kind,
    late ones or such that failed before, are taken if their id is not there; with ``strict_cursor`` they are not, as with a
    source that is asked for what comes after the cursor. With ``root`` a run goes on where the last one with it stopped.

    ``done`` is told ``event_type, written`` of each batch that has written some; if it fails, the run goes on, and if the
    driver dies between the commit and the announcement, that is not made up for.
    """
    store = Store(spark, LOG, root)

    def step(batch: DataFrame, n: int) -> None:
        told = []

        def work(change: Change) -> None:
            old = store.read("cursors")
            rows = batch.select("event_id", F.col("ts").cast("date").alias("day"), "event_type", F.floor(F.col("event_id") / BLOCK).alias("block")).dropDuplicates(["event_id"])
            if strict_cursor:
                was = old.select("event_type", F.struct("last_day", "last_id").alias("_was"))
                ahead = F.col("_was").isNull() | (F.struct("day", "event_id") > F.col("_was"))
                rows = rows.join(F.broadcast(was), "event_type", "left").where(ahead).drop("_was")
            rows = settled(rows)
            blocks = [r[0] for r in rows.select("block").distinct().collect()]
            there = store.read("log").where(F.col("block").isin(blocks)).select("event_id")
            fresh = settled(rows.join(there, "event_id", "left_anti"))
            top = rows.groupBy("event_type").agg(F.max(F.struct("day", "event_id")).alias("c"))
            new = top.select("event_type", F.col("c.day").alias("last_day"), F.col("c.event_id").alias("last_id"))
            change.append("log", fresh.select("event_id", "day", "event_type", "block"), by="block")
            change.replace("cursors", merged(old, further(old, new), ["event_type"]))
            told.append(fresh)

        if store.change(n, work) and done is not None:
            try:
                done(told[0].groupBy("event_type").agg(F.count("*").alias("written")).where("written > 0"))
            except Exception:
                logging.getLogger(__name__).exception("batch %s is written, but was not announced", n)

    run_batches(events(spark, folder, **options), step, f"{store.root}/stream")
    return store


def further(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cursors that are ahead of the old ones; a cursor never goes back."""
    was = old.select("event_type", F.struct("last_day", "last_id").alias("_was"))
    ahead = F.col("_was").isNull() | (F.struct("last_day", "last_id") > F.col("_was"))
    return new.join(was, "event_type", "left").where(ahead).drop("_was")


PAIRS = {"seen": "lo bigint, hi bigint, last_seen date, n_edges bigint"}


def lifecycle(edges: DataFrame, root: str | None = None) -> Store:
    """Takes edges (``lo, hi, ship_date``, a stream) as they arrive: each batch adds what it has seen of each pair."""
    store = Store(edges.sparkSession, PAIRS, root)

    def step(batch: DataFrame, n: int) -> None:
        seen = batch.groupBy("lo", "hi").agg(F.max("ship_date").alias("last_seen"), F.count("*").alias("n_edges"))
        store.change(n, lambda change: change.append("seen", seen))

    run_batches(edges, step, f"{store.root}/stream")
    return store


def pair_states(store: Store, as_of, stale_days: int = 90) -> DataFrame:
    """``lo, hi, last_seen, n_edges, state``: followed where a later edge has come, stale where none has for long."""
    pairs = store.read("seen").groupBy("lo", "hi").agg(F.max("last_seen").alias("last_seen"), F.sum("n_edges").alias("n_edges"))
    state = F.when(F.col("n_edges") > 1, "followed").when(F.col("last_seen") < F.date_sub(F.lit(as_of), stale_days), "stale").otherwise("new")
    return pairs.withColumn("state", state)


def without_repeats(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rows whose id has not come within the watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def counted_by_week(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events of each kind in weeks of event time."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    weeks = timed.groupBy(F.window("ts", "7 days").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return weeks.select(F.col("w.start").cast("date").alias("week"), "event_type", "n")


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives until it has nothing more: in complete mode its last answer, else all it has given."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/out-{uuid.uuid4().hex}"

    def step(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/{'last' if mode == 'complete' else n}")

    place = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", place).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/*")
