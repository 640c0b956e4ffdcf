"""Byte spans of documents: unique keys to name documents by, blocks of texts, shards of records, and cutting spans out.

Texts are exchanged once. Documents are dealt to blocks by a hash of their keys, a block is a partition, and what is found
out about a block comes back to it by its number: a plan that looks at the texts several times has one exchange of them,
which Spark runs once and reads again. Records that must meet go to shards; how many blocks and shards there are follows
from the bytes of the texts, so that a task's memory does not grow with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.session import settled

SPAN = np.dtype([("key", "<i8"), ("start", "<u4"), ("end", "<u4")])
BLOCK_BYTES, SHARD_BYTES = 1 << 25, 1 << 23


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``key, doc_id, text`` with a unique long ``key`` in the order of ``doc_id``; null text becomes empty.

    The key is the id itself where ids are unique and not null, as one aggregate over the ids finds. Otherwise rows are
    numbered in the order of id (nulls last) and text hash: ranges of ids are sorted, and each range's rows are numbered
    after the counts of the ranges before it.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    repeated = rows.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("slot"), "doc_id").count().where("count > 1 or doc_id is null")
    if not repeated.head(1):
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text")
    hashed = rows.withColumn("_null", F.col("doc_id").isNull()).withColumn("_h", F.xxhash64("text"))
    ranged = settled(hashed.repartitionByRange("_null", "doc_id", "_h").sortWithinPartitions("_null", "doc_id", "_h").withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").count().withColumn("_before", F.sum("count").over(Window.orderBy("_p")) - F.col("count")).drop("count")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("_null", "doc_id", "_h")) - 1
    return ranged.withColumn("_n", inside).join(counts, "_p").select((F.col("_before") + F.col("_n")).cast("long").alias("key"), "doc_id", "text")


@dataclass(frozen=True)
class Texts:
    """``rows`` (``block, key, doc_id, text``) dealt by block, and the numbers of blocks and shards for them."""

    rows: DataFrame
    blocks: int
    shards: int

    def by_block(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``block``) dealt as the texts are."""
        return rows.repartitionById(self.blocks, F.col("block"))

    def each(self, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        """``run`` on the texts of every block."""
        return self.rows.groupBy("block").applyInArrow(run, schema)

    def each_with(self, known: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """``run`` on the texts of every block and the rows of ``known`` (with ``block``) for it."""
        return self.rows.groupBy("block").cogroup(self.by_block(known).groupBy("block")).applyInArrow(run, schema)


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    """The blocks of keys, as ``dealt`` has them."""
    some, back = np.unique(keys.astype("<i8"), return_inverse=True)
    raw = some.tobytes()
    hashed = np.array([xxhash.xxh64_intdigest(raw[i : i + 8], 42) for i in range(0, len(raw), 8)], np.uint64)
    return np.mod(hashed.view(np.int64), blocks)[back]


def dealt(docs: DataFrame, doc_id: str, text: str) -> Texts:
    """The documents, keyed and dealt to blocks."""
    rows = keyed(docs, doc_id, text)
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(least, total // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block")
    dealt_rows = rows.select(block, "key", "doc_id", "text").repartitionById(blocks, F.col("block"))
    return Texts(dealt_rows, blocks, max(2 * blocks, total // SHARD_BYTES))


def groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end in sorted columns; no rows, no runs."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    heads = np.flatnonzero(new)
    return heads, np.append(heads[1:], n)


def joined_spans(spans: np.ndarray) -> np.ndarray:
    """Sorted, with overlapping and touching spans of a key as one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["key"]))]
    same = spans["key"][1:] == spans["key"][:-1]
    group = np.concatenate([[0], np.cumsum(~same)])
    # ends so far within a key: each key is lifted over what a 32-bit end can be, so that one running maximum serves all
    lift = np.int64(1) << 32
    furthest = np.maximum.accumulate(spans["end"] + group * lift) - group * lift
    new = np.concatenate([[True], ~same | (spans["start"][1:] > furthest[:-1])])
    heads = np.flatnonzero(new)
    out = spans[heads].copy()
    out["end"] = np.maximum.reduceat(spans["end"], heads)
    return out


RECORDS, SPANS = 0, 1
PACKED = "shard int, kind int, payload binary"
OF_BLOCK = "block int, payload binary"


def packed(shard: np.ndarray, records: np.ndarray, kind: int) -> pa.Table:
    """One row for each shard that has records: their bytes, end to end."""
    order = np.argsort(shard, kind="stable")
    shard, records = shard[order], records[order]
    heads, ends = groups(shard)
    bodies = [records[a:b].tobytes() for a, b in zip(heads, ends, strict=True)]
    return packed_bodies(shard[heads], bodies, kind)


def packed_bodies(shards: np.ndarray, bodies: list[bytes], kind: int) -> pa.Table:
    return pa.table({"shard": pa.array(shards, pa.int32()), "kind": pa.array([kind] * len(bodies), pa.int32()), "payload": pa.array(bodies, pa.binary())})


def sharded(rows: DataFrame, texts: Texts) -> DataFrame:
    """Brings each shard's rows together in a partition, sorted by shard."""
    return rows.repartitionById(texts.blocks, F.pmod("shard", F.lit(texts.blocks))).sortWithinPartitions("shard")


def shard_by_shard(batches: Iterable[pa.RecordBatch], fold: Callable, finish: Callable, most: int = 1 << 25) -> Iterator:
    """Records of one shard after another, from rows of ``PACKED`` that arrive sorted by shard.

    ``fold`` makes one payload of several and says what it has settled on the way; it is called whenever a shard's payloads
    have grown by ``most`` bytes, so that what is held follows what differs and not how often it is repeated. ``finish``
    says what the payloads of a whole shard give. Rows of ``SPANS`` pass through.
    """
    now, held, size, bound = None, [], 0, most
    for batch in batches:
        for shard, kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if kind == SPANS:
                yield np.frombuffer(payload.as_py(), SPAN)
                continue
            if shard != now:
                if held:
                    yield from finish(held)
                now, held, size, bound = shard, [], 0, most
            held.append(payload.as_py())
            size += len(held[-1])
            if size > bound:
                body, settled_now = fold(held)
                yield settled_now
                held, size = [body], len(body)
                bound = max(most, 2 * size)
    if held:
        yield from finish(held)


def spans_of_blocks(spans: Iterable[np.ndarray], blocks: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Arrays of spans as rows of ``OF_BLOCK``: one row for each block and ``most`` spans of a task."""

    def rows():
        joined = joined_spans(np.concatenate(held))
        block = block_of(joined["key"], blocks)
        order = np.argsort(block, kind="stable")
        joined, block = joined[order], block[order]
        heads, ends = groups(block)
        bodies = [joined[a:b].tobytes() for a, b in zip(heads, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[heads], pa.int32()), pa.array(bodies, pa.binary())], ["block", "payload"])

    held, size = [], 0
    for some in spans:
        held.append(some)
        size += len(some)
        if size >= most:
            yield rows()
            held, size = [], 0
    if size:
        yield rows()


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_out(texts: Texts, spans: DataFrame, min_run: int = 1, kept: bool = False) -> DataFrame:
    """Removes ``spans`` (rows of ``OF_BLOCK``) from the texts.

    Joined spans shorter than ``min_run`` bytes stay. Gives the counts and the SHA-256 of the remaining bytes, and with
    ``kept`` these bytes.
    """

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        spans = joined_spans(np.frombuffer(b"".join(known.column("payload").to_pylist()), SPAN))
        spans = spans[spans["end"].astype(np.int64) - spans["start"] >= min_run]
        first = np.searchsorted(spans["key"], docs.column("key").to_numpy(), "left").tolist()
        last = np.searchsorted(spans["key"], docs.column("key").to_numpy(), "right").tolist()
        places = np.stack([spans["start"], spans["end"]], axis=1).tolist()
        rows = []
        for a, b, text in zip(first, last, docs.column("text").cast(pa.binary()), strict=True):
            data, at, pieces = text.as_py(), 0, []
            for start, end in places[a:b]:
                pieces.append(data[at:start])
                at = end
            pieces.append(data[at:])
            left = b"".join(pieces)
            rows.append((len(data), len(data) - len(left), b - a, hashlib.sha256(left).hexdigest(), left if kept else b""))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 if kept else 4]
        columns = {name: pa.array([r[i] for r in rows], kinds[i]) for i, name in enumerate(names)}
        return pa.table({"doc_id": docs.column("doc_id")} | columns)

    return texts.each_with(spans, run, CUT + ", kept binary" * kept)
