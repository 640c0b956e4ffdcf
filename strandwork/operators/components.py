"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.session import settled


SALTS = 16


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with their ``a``'s row of ``least``. A hub has as many edges as its component has nodes, so the join
    is dealt by node and a part of the other end, and each row of ``least`` goes to every part."""
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    spread = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["a", "_salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node points its larger neighbours to its smallest one."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _met(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node points itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _met(down, least).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b")


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Maps each node of ``edges`` (two columns of one orderable type, any names) to the smallest node of its component.

    Gives ``node, root``; nodes without an edge to another node are not in it. Each round settles its edges in the
    shared folder, and the rounds end when they no longer change; a chain of n nodes takes about log n rounds.
    """
    first, second = edges.columns
    now = edges.select(F.col(first).alias("a"), F.col(second).alias("b")).where("a <> b").dropna().distinct()
    now = settled(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        now = settled(_small_star(_large_star(now)).distinct())
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == seen or not row[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(row)
    raise RuntimeError("components did not settle")
