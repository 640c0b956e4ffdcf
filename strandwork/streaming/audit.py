"""A re-audit of stored handles that can be stopped at any point and goes on where it was.

Handles are dealt to steps of bounded size when the audit begins. A step asks about its handles and commits, in one go, what
became of each, with a stamp; a step that was committed is not run again, so whoever goes on after a stop audits every
handle once. A refusal never overwrites a handle: where there was no evidence the old value stays and is stamped, where the
search itself was refused it stays without a stamp and is due in the next pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.streaming.store import Store

HANDLE = "name_key string, channel string, handle string, confidence double, source string"
TABLES = {"claims": f"{HANDLE}, step int", "audits": f"{HANDLE}, step int, pass int, outcome string"}
#: Never asked about again: what people have set, and what was refused when it was first looked for.
UNTOUCHED = ("human", "blocked")


class Audit:
    """An audit under ``root``, the one that is there or a new one."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.store = Store(spark, TABLES, root)
        self.root = self.store.root

    def begin(self, handles: DataFrame, most: float, rows_a_step: int) -> None:
        """Claims the handles of at most ``most`` confidence, steps of about ``rows_a_step``; once for an audit."""
        due = handles.where(~F.col("source").isin(*UNTOUCHED) & (F.col("confidence") <= most))

        def work(change) -> None:
            steps = max(1, -(-due.count() // rows_a_step))
            change.append("claims", due.select("name_key", "channel", "handle", "confidence", "source", F.pmod(F.xxhash64("name_key", "channel"), F.lit(steps)).cast("int").alias("step")))

        self.store.change(0, work)

    def left(self, nth: int) -> DataFrame:
        """Claims that no pass before ``nth`` has stamped."""
        done = self.store.read("audits").where((F.col("pass") < nth) & (F.col("outcome") != "refused"))
        return self.store.read("claims").join(done.select("name_key", "channel"), ["name_key", "channel"], "left_anti")

    def run(self, ask: Callable[[DataFrame, int], DataFrame], nth: int = 0, stop_after: int | None = None) -> int:
        """The steps of pass ``nth`` that are not done yet, no more than ``stop_after``; gives how many were.

        ``ask(claims, nth)`` adds ``new_handle, new_confidence, new_source`` and ``comment`` to claims: a verdict, or source
        ``blocked``, with a comment beginning with ``no evidence`` where there is none either way.
        """
        claims, before = self.store.read("claims"), self.left(nth)
        steps = (claims.agg(F.max("step")).first()[0] or 0) + 1
        ran = 0
        for step in range(steps):
            if stop_after is not None and ran >= stop_after:
                break
            ran += self.store.change(1 + nth * steps + step, lambda change, step=step: change.append("audits", self._judged(ask(before.where(F.col("step") == step), nth), nth)))
        return ran

    def _judged(self, asked: DataFrame, nth: int) -> DataFrame:
        refused = F.col("new_source") == "blocked"
        silent = refused & F.col("comment").startswith("no evidence")
        outcome = F.when(silent, "kept").when(refused, "refused").when(F.col("new_handle").eqNullSafe(F.col("handle")), "confirmed").when(F.col("new_handle").isNull(), "abstained").otherwise("changed")
        now = lambda c: F.when(refused, F.col(c)).otherwise(F.col(f"new_{c}")).alias(c)
        return asked.select("name_key", "channel", now("handle"), now("confidence"), now("source"), "step", F.lit(nth).alias("pass"), outcome.alias("outcome"))

    def handles(self, before: DataFrame) -> DataFrame:
        """``before`` as the audit has left it, with ``audited_in`` (the pass of the stamp) and ``outcome``."""
        stamped = self.store.read("audits").where("outcome <> 'refused'")
        new = stamped.select("name_key", "channel", F.struct("handle", "confidence", "source").alias("now"), F.col("pass").alias("audited_in"), "outcome")
        both = before.join(new, ["name_key", "channel"], "left")
        kept = [F.when(F.col("now").isNotNull(), F.col(f"now.{c}")).otherwise(F.col(c)).alias(c) for c in ("handle", "confidence", "source")]
        return both.select("name_key", "channel", *kept, "audited_in", "outcome")
