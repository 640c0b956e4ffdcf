"""Bounded samples of labelled rows for fitting, and the byte view of a column of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a sample may hold in all; it is collected to the driver, where models are fitted.
SAMPLE_BYTES = 1 << 28


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def drawn(labelled: DataFrame, key: str, label: str, per_label: int, characters: int) -> DataFrame:
    """Rows of ``labelled`` by a hash of their keys, about ``per_label`` of each label.

    Twice the expected number is the most that is taken, and fewer are expected where so many texts of ``characters``
    could have more than ``SAMPLE_BYTES``. The labels themselves are collected.
    """
    known = labelled.where(F.col(label).isNotNull())
    counts = known.groupBy(label).count().collect()
    expected = max(1, min(per_label, SAMPLE_BYTES // (8 * characters * max(1, len(counts)))))
    shares = known.sparkSession.createDataFrame([(r[0], expected / r[1]) for r in counts], known.select(F.col(label).alias("_label"), F.lit(0.0).alias("_share")).schema)
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.withColumn("_draw", draw).join(F.broadcast(shares), F.col(label) == F.col("_label")).where("_draw < _share")
    return chosen.orderBy("_draw", key, label).limit(2 * expected * len(counts)).select(*labelled.columns)


def excerpt(text: Column, key: Column, most: int) -> Column:
    """``text``, and of a long one a part of ``most`` characters, where a hash of its key puts it."""
    starts = F.greatest(F.length(text) - most, F.lit(0)) + 1
    return F.substring(text, (F.pmod(F.xxhash64(F.lit("excerpt"), key), starts) + 1).cast("int"), F.lit(most))


def collected(rows: DataFrame, key: str, text: str, label: str) -> list[tuple[bytes, object]]:
    """(text, label) of rows that have a text, in the order of their keys."""
    found = rows.where(F.col(text).isNotNull()).select(key, text, label).collect()
    return [(r[1].encode(), r[2]) for r in sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]


def byte_spans(texts: pa.Array, most: int, overlap: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool, bool]]:
    """UTF-8 bytes of a column of texts in blocks: bytes, start of each span in them, the row of each span, and whether
    the row has bytes before and after.

    A block has whole rows, about ``most`` bytes of them; a longer row comes alone, in spans of ``most`` of which each
    repeats the last ``overlap`` bytes of the one before. Rows that are null or empty come in no block.
    """
    texts = texts.cast(pa.binary())
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    sizes = np.diff(ends)
    if texts.null_count:
        sizes = np.where(np.asarray(texts.is_valid()), sizes, 0)
    rows = np.flatnonzero(sizes)
    held: list[int] = []
    size = 0
    for row in [*rows.tolist(), None]:
        if held and (row is None or size + sizes[row] > most):
            yield np.concatenate([data[ends[r] : ends[r] + sizes[r]] for r in held]), np.cumsum([0, *sizes[held[:-1]]]), np.array(held), False, False
            held, size = [], 0
        if row is None:
            break
        if sizes[row] > most:
            first, last = int(ends[row]), int(ends[row + 1])
            for at in range(first, last - overlap, most - overlap):
                yield data[at : min(at + most, last)], np.zeros(1, np.int64), np.array([row]), at > first, at + most < last
            continue
        held.append(row)
        size += int(sizes[row])
