"""Edges as they arrive, and what each arrival changes about the edges of its pair.

An edge that a later one of its pair follows gains confidence; one that comes invalidated, and is not followed, loses some;
an active one that nothing follows for long goes stale. The edges of a pair that nothing has followed yet, which are those
of its last day, are held in a table that each batch of the stream joins and replaces: nearly every edge has a pair of its
own, and keyed state, a few calls for each, would take longer than all the rest. Every change is told once, and a run goes
on where the last one has stopped.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwork.session import settled, shared_dir
from strandwork.sources.graph_tables import GraphTables
from strandwork.streaming.store import Change, Store

#: With its pair and day these tell an edge from others.
EDGE = ["catalyst_id", "l_linenumber", "l_partkey"]
CHANGES = "lo long, hi long, day long, catalyst_id long, l_linenumber long, l_partkey long, change string, status string, confidence double"
HELD = "lo long, hi long, day long, catalyst_id long, l_linenumber long, l_partkey long, status string, confidence double, stale boolean"
#: A batch of the stream is a step of the store, and runs that let time pass are steps between two batches.
BATCH_STEPS = 1 << 20
#: Of several changes of an edge the last is the one that comes first here.
LAST = {"followed": 0, "stale": 1, "invalidated": 2}


def arrived(held: DataFrame, batch: DataFrame, boost: float, penalty: float) -> tuple[DataFrame, DataFrame]:
    """What edges of a batch change, ``CHANGES``, and what is ``HELD`` after it: of each pair its edges of its last day.

    All pairs are judged in one sort; ``held`` are rows of the last day that each pair had before.
    """
    pair = Window.partitionBy("lo", "hi")
    rows = held.withColumn("new", F.lit(False)).unionByName(batch.select("lo", "hi", "day", *EDGE, "status", "confidence", F.lit(False).alias("stale"), F.lit(True).alias("new")))
    rows = settled(rows.withColumn("last", F.max("day").over(pair)).withColumn("was", F.max(F.when(~F.col("new"), F.col("day"))).over(pair)))
    told = lambda change, confidence: F.struct(F.lit(change).alias("change"), F.col("status"), confidence.alias("confidence"))
    invalid = F.when(F.col("new") & (F.col("status") == "invalidated") & (F.col("was").isNull() | (F.col("day") >= F.col("was"))), told("invalidated", F.greatest(F.lit(0.0), F.col("confidence") - penalty)))
    followed = F.when(F.col("day") < F.col("last"), told("followed", F.least(F.lit(1.0), F.col("confidence") + boost)))
    changes = rows.select("lo", "hi", "day", *EDGE, F.explode(F.array_compact(F.array(invalid, followed))).alias("c"))
    return changes.select("lo", "hi", "day", *EDGE, "c.*"), rows.where("day = last").drop("new", "last", "was")


def expired(held: DataFrame, before: int) -> tuple[DataFrame, DataFrame]:
    """Active edges of days before ``before`` that nothing has followed and that were not told stale yet: these as
    ``CHANGES``, and what is ``HELD`` then."""
    due = (F.col("status") == "active") & ~F.col("stale") & (F.col("day") < before)
    changes = held.where(due).select("lo", "hi", "day", *EDGE, F.lit("stale").alias("change"), F.lit("stale").alias("status"), "confidence")
    return changes, held.withColumn("stale", F.col("stale") | due)


def arriving(spark: SparkSession, folder: str, lines: str | None = None) -> DataFrame:
    """The edges of ``folder`` as a stream: lines as their files come (from ``lines``, if it is another folder), joined with
    the orders that say whose they are."""
    tables = GraphTables(spark, folder)
    schema = tables.raw("lineitem").schema
    tables._raw["lineitem"] = spark.readStream.schema(schema).parquet(lines or f"{folder}/lineitem.parque[t]")
    return tables.relationships


def changed(edges: DataFrame, as_of: datetime.date, root: str | None = None, stale_days: int = 90, boost: float = 0.15, penalty: float = 0.30, reader: SparkSession | None = None) -> DataFrame:
    """``CHANGES`` of ``edges`` (a stream of ``arriving``) up to the day ``as_of``.

    Time is ``as_of``, so that no edge comes too late, whatever its own day is. With ``root`` a run goes on where the last
    one has stopped, and its ``as_of`` is not earlier; without an edge it still lets time pass. A batch is a step of the
    store: it reads what is held, and takes the place of it. The result is read in ``reader``.
    """
    spark = edges.sparkSession
    root = root or f"{shared_dir(spark).rstrip('/')}/edges-{uuid.uuid4().hex}"
    a, b = F.col("entity_a_id"), F.col("entity_b_id")
    known = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.unix_date("ship_date").cast("long").alias("day"), *[F.col(c).cast("long").alias(c) for c in EDGE], "status", "confidence").where("lo is not null")
    store = Store(spark, {"changes": CHANGES, "held": HELD}, f"{root}/store")

    def step(change: Change, made: tuple[DataFrame, DataFrame]) -> None:
        change.append("changes", made[0])
        change.replace("held", made[1])

    def arrives(batch: DataFrame, n: int) -> None:
        store.change((n + 1) * BATCH_STEPS, lambda change: step(change, arrived(store.read("held"), batch, boost, penalty)))

    known.writeStream.foreachBatch(arrives).option("checkpointLocation", f"{root}/stream").trigger(availableNow=True).start().awaitTermination()
    now = (as_of - datetime.date(1970, 1, 1)).days
    store.change(max(store.commits(), default=0) + 1, lambda change: step(change, expired(store.read("held"), now - stale_days)))
    return Store(reader or spark, store.schemas, store.root).read("changes")


def final(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Status and confidence of each edge after its changes."""
    order = F.element_at(F.create_map(*[F.lit(x) for pair in LAST.items() for x in pair]), F.col("change"))
    key = ["lo", "hi", "day", *EDGE]
    last = changes.groupBy(*key).agg(F.min_by(F.struct("status", "confidence"), order).alias("now"))
    a, b = F.col("entity_a_id"), F.col("entity_b_id")
    named = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.unix_date("ship_date").cast("long").alias("day"), *[F.col(c).cast("long").alias(c) for c in EDGE], "status", "confidence")
    return named.join(last, key, "left").select(*EDGE, F.coalesce("now.status", "status").alias("status"), F.round(F.coalesce("now.confidence", "confidence"), 6).alias("confidence"))
