"""Names for helper columns, and rows told apart where ids are not."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.session import broadcast_if_small


def spare(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has, whatever the case: helper columns behind it clash with nothing."""
    taken, prefix = [c.lower() for c in df.columns], "_x_"
    while any(c.startswith(prefix) for c in taken):
        prefix = "_" + prefix
    return prefix


def in_slices(batches: Iterable, rows: int = 1000) -> Iterator:
    """``rows`` rows at a time of Arrow batches or arrays: rows here have texts, of which what is made of a whole batch would
    be held several times over. The session's own size of batches stays as it is."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def raw_hash(text: Column) -> Column:
    """With the id it tells rows apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def least_row(doc_id: Column, raw: Column) -> Column:
    """Orders rows by id, null last, then by the hash of the text; its minimum is the row of a group that stays."""
    return F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), raw.alias("raw"))


def only_kept(docs: DataFrame, judged: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that ``judged`` (``doc_id, raw, kept``, a row for each) keeps; all columns stay.

    Rows are told apart by id and hash of the text, so one that repeats an id has a fate of its own. Of rows that repeat
    both, one stays, that with the smallest hash over all columns.
    """
    p = spare(docs)
    id_, raw = F.col(doc_id).cast("long"), raw_hash(F.col(text))

    def named(rows: DataFrame) -> DataFrame:
        return broadcast_if_small(rows.select(F.col("doc_id").alias(f"{p}id"), F.col("raw").alias(f"{p}raw")))

    same = id_.eqNullSafe(F.col(f"{p}id")) & (raw == F.col(f"{p}raw"))
    rest = docs.join(named(judged.where("not kept").select("doc_id", "raw").distinct()), same, "left_anti")
    repeated = judged.where("kept").groupBy("doc_id", "raw").count().where("count > 1")
    if not repeated.head(1):
        return rest
    several = named(repeated)
    one = Window.partitionBy(id_, raw).orderBy(F.xxhash64(*docs.columns))
    single = rest.join(several, same, "left_semi").withColumn(f"{p}n", F.row_number().over(one)).where(f"{p}n = 1").drop(f"{p}n")
    return rest.join(several, same, "left_anti").unionByName(single)
