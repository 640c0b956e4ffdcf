"""Attempts to find handles as a stream: who may try again, and when.

A name that was refused may be tried again once its cooldown is over, one that got a verdict never. What a name waits for
is keyed state with a timer in event time, so that a run goes on where the last one has stopped, whoever runs it, and state
that nobody asks for goes by itself.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from strandwork.session import shared_dir

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COOLDOWN = datetime.timedelta(days=14)
OUTCOMES = "name long, at long, outcome string"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own for keyed state, which needs a store with timers; the caller's settings stay."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", "UTC")
    return own


class Cooldown(StatefulProcessor):
    """Grants or refuses each attempt of a name, and tells when a refused name is due again.

    The state is when the name may be tried again, in microseconds; ``NEVER`` once there is a verdict, which has no timer.
    A name is told due once for each granted attempt that was refused: by its timer, or by the attempt that comes sooner.
    """

    NEVER = (1 << 63) - 1

    def __init__(self, cooldown: datetime.timedelta):
        self.wait = int(cooldown.total_seconds()) * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        until = self.until.get()[0] if self.until.exists() else None
        was = until
        for at, refused in sorted((r["micros"], not r["verdict"]) for r in rows):
            if until == self.NEVER:
                yield Row(name=key[0], at=at, outcome="settled")
                continue
            if until is not None and at < until:
                yield Row(name=key[0], at=at, outcome="cooling")
                continue
            if until is not None:
                yield Row(name=key[0], at=until, outcome="due")
            until = at + self.wait if refused else self.NEVER
            yield Row(name=key[0], at=at, outcome="refused" if refused else "verdict")
        if until != was:
            if was is not None:
                self.handle.deleteTimer(-(-was // 1000))
            self.until.update((until,))
            if until != self.NEVER:
                self.handle.registerTimer(-(-until // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.until.exists():
            until = self.until.get()[0]
            if until != self.NEVER and -(-until // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
                self.until.clear()
                yield Row(name=key[0], at=until, outcome="due")

    def close(self) -> None:
        pass


def decided(attempts: DataFrame, root: str | None = None, cooldown: datetime.timedelta = COOLDOWN, reader: SparkSession | None = None) -> DataFrame:
    """``name, at, outcome`` of ``attempts`` (a stream of ``name, at, verdict`` from ``stateful_session``), for each attempt
    one of ``refused, verdict, cooling, settled``, and ``due`` when a refused name may be tried again.

    Runs until nothing is left. With ``root`` a run goes on where the last one has stopped: names keep what they wait for.
    Attempts that come in a later batch than later ones are too late and dropped. The result is read in ``reader``.
    """
    spark = attempts.sparkSession
    root = root or f"{shared_dir(spark).rstrip('/')}/attempts-{uuid.uuid4().hex}"
    timed = attempts.select("name", F.col("at").cast("timestamp").alias("at"), "verdict").withWatermark("at", "0 seconds")
    timed = timed.select("name", "at", F.unix_micros("at").alias("micros"), "verdict")
    found = timed.groupBy("name").transformWithState(Cooldown(cooldown), OUTCOMES, "Append", "EventTime")
    query = found.writeStream.format("parquet").option("path", f"{root}/outcomes").option("checkpointLocation", f"{root}/stream").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = (reader or spark).read.schema(OUTCOMES).parquet(f"{root}/outcomes")
    return kept.select("name", F.timestamp_micros("at").cast("timestamp_ntz").alias("at"), "outcome")
