"""Changes to tables as plans: plain files have no updates, so a change gives the table's next version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(old: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str] = (), fixed: list[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` inserted or, by key, updated.

    A column in ``keep_old`` changes only to a value that is not null; one in ``fixed`` never changes once there.
    Columns that ``new`` lacks stay. ``new`` has one row per key.
    """
    there = F.col("_new").isNotNull()
    fresh = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys], F.lit(1).alias("_new"))
    both = old.withColumn("_old", F.lit(1)).join(fresh, keys, "full")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
        elif c not in new.columns:
            out.append(F.col(c))
        elif c in fixed:
            out.append(F.when(F.col("_old").isNotNull(), F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c))
        elif c in keep_old:
            out.append(F.coalesce(f"_n_{c}", c).alias(c))
        else:
            out.append(F.when(there, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def inserted_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it does not have."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is last by the columns ``order``: an aggregate, which combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}") for c in rows.columns])


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")
