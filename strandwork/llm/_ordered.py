"""Rows of groups in their order, over ranges of rows: a group of any size takes as many partitions as it needs.

Rows are sorted over all partitions. What a partition must know of the ones beside it is one small summary each, of the
group that crosses the border; these summaries, a row for each partition, are all that the driver sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.session import settled

#: Pieces of a digest travel in chunks of about so many bytes.
CHUNK = 1 << 16
TAILS = pa.schema([("p", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("sums", pa.list_(pa.int64()))])


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` sorted by ``order`` over all partitions, and ``_p``, which partition it is; settled. Equal keys share one."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return settled(ranged.withColumn("_p", F.spark_partition_id()))


def _groups(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def _lanes(batch: pa.RecordBatch, names: Iterable[str]) -> np.ndarray:
    """Long columns as rows of unsigned numbers, after a column of ones."""
    return np.stack([np.ones(batch.num_rows, np.uint64), *(batch.column(n).to_numpy().view(np.uint64) for n in names)], axis=1)


def _carried(tails: list[tuple[int, int, int, list[int]]]) -> dict[int, tuple[int, list[int]]]:
    """For each partition the group that comes into it and its sums so far, from (partition, first group, last group, sums
    of the last group there)."""
    found, group, sums = {}, None, []
    for p, first, last, here in sorted(tails):
        if group is not None:
            found[p] = (group, sums)
        sums = [(a + b) % (1 << 64) for a, b in zip(sums, here, strict=True)] if group == first == last else here
        group = last
    return found


def running(ranged: DataFrame, group: str, lanes: list[str]) -> DataFrame:
    """Adds ``nth``, a row's number in its group from 1 on, and for every long column of ``lanes`` its sum in the group
    before the row and with it, ``before_`` and ``after_`` its name. Sums wrap as 64-bit numbers do. ``ranged`` comes from
    ``in_ranges`` by ``group`` (long, not null) and an order; ``_p`` goes."""

    def tails(batches):
        first = now = p = None
        sums = np.zeros(1 + len(lanes), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            first, p = (keys[0], batch.column(1)[0].as_py()) if first is None else (first, p)
            at = _groups(keys)[-1]
            here = _lanes(batch, lanes)[at:].sum(axis=0)
            sums, now = (sums + here if at == 0 and now == keys[0] else here), keys[-1]
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"p": p, "first": int(first), "last": int(now), "sums": sums.view(np.int64).tolist()}], TAILS)

    found = ranged.select(group, "_p", *lanes).mapInArrow(tails, "p int, first long, last long, sums array<long>").collect()
    carried = _carried([(r[0], r[1], r[2], [x % (1 << 64) for x in r[3]]) for r in found])
    names = [c for c in ranged.columns if c != "_p"]
    more = ["nth", *(f"{when}_{c}" for c in lanes for when in ("before", "after"))]

    def run(batches):
        now, sums = None, np.zeros(1 + len(lanes), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            if now is None:
                now, start = carried.get(batch.column("_p")[0].as_py(), (None, None))
                sums = np.array(start, np.uint64) if start else sums
            keys, values = batch.column(group).to_numpy(), _lanes(batch, lanes)
            heads = _groups(keys)
            total = values.cumsum(axis=0)
            base = np.vstack([np.zeros((1, values.shape[1]), np.uint64), total[heads[1:] - 1]])
            if keys[0] == now:
                base[0] -= sums
            after = total - np.repeat(base, np.diff(np.append(heads, len(keys))), axis=0)
            now, sums = keys[-1], after[-1].copy()
            before = after - values
            columns = [after[:, 0], *(x[:, 1 + i] for i in range(len(lanes)) for x in (before, after))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns)], [*names, *more])

    schema = T.StructType([ranged.schema[n] for n in names] + [T.StructField(n, T.LongType()) for n in more])
    return ranged.mapInArrow(run, schema)


def ordered_digests(rows: DataFrame, groups: list[str], order: list[str], piece: str, separator: bytes) -> DataFrame:
    """``groups`` (longs, null being a value) and ``sha256`` of each group's pieces (binary, not null) in their order, with
    ``separator`` between them.

    Pieces are packed into chunks where they lie, and a group's chunks are hashed as they come, so that a task holds a
    chunk and not a group.
    """
    width = len(groups)
    names = [f"g{i}" for i in range(width)]
    longs = ", ".join(f"{n} long" for n in names)

    def keys_of(batch: pa.RecordBatch) -> list[tuple]:
        return list(zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True))

    def batch_of(keys: list[tuple], more: dict[str, pa.Array]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(width)]
        return pa.RecordBatch.from_arrays([*columns, *more.values()], [*names, *more])

    def chunks(batches):
        held, size, n, now, p = [], 0, 0, None, None

        def row():
            return batch_of([now], {"p": pa.array([p], pa.int32()), "n": pa.array([n], pa.int64()), "chunk": pa.array([separator.join(held)], pa.binary())})

        for batch in batches:
            for key, here, body in zip(keys_of(batch), batch.column(width).to_pylist(), batch.column(width + 1), strict=True):
                if held and (key != now or size > CHUNK):
                    yield row()
                    held, size, n = [], 0, n + 1
                now, p = key, here
                held.append(body.as_py())
                size += len(held[-1]) + len(separator)
        if held:
            yield row()

    def hashed(batches):
        now, digest = None, None
        for batch in batches:
            done = []
            for key, body in zip(keys_of(batch), batch.column(width), strict=True):
                if key == now:
                    digest.update(separator)
                else:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                digest.update(body.as_py())
            yield batch_of([k for k, _ in done], {"sha256": pa.array([d for _, d in done], pa.string())})
        if now is not None:
            yield batch_of([now], {"sha256": pa.array([digest.hexdigest()], pa.string())})

    named = rows.select(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)], *order, F.col(piece).alias("piece"))
    ranged = in_ranges(named, *names, *order)
    packed = ranged.select(*names, "_p", "piece").mapInArrow(chunks, f"{longs}, p int, n long, chunk binary")
    dealt = packed.repartition(*names).sortWithinPartitions(*names, "p", "n").select(*names, "chunk")
    return dealt.mapInArrow(hashed, f"{longs}, sha256 string").select(*[F.col(n).alias(g) for g, n in zip(groups, names, strict=True)], "sha256")
