"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 32 bytes ends a chunk where its top bits are zero, so the ends move with the content and
an insertion shifts only the chunks around it. A chunk is a copy if its digest occurs in a document of smaller id, or
earlier in its own. Runs of adjacent copies are removed where they have ``min_run`` bytes or more; shorter ones are
chance and stay.

The chunks of a block of documents are digested together. Of every digest the block's first occurrence goes to the
digest's shard, however often a passage is repeated in the block; the others are copies already.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm import _spans
from strandwork.llm._spans import SPAN, Texts, cut_out, dealt, packed, shard_by_shard

#: A digest is two numbers, which sort faster than bytes.
CHUNK = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("key", "<i8"), ("start", "<u4"), ("size", "<u2")])
WINDOW = 32
MIN_CHUNK, MAX_CHUNK, MASK_BITS = 16, 256, 4
MIN_RUN = 100


def gear(seed: int = 5) -> np.ndarray:
    """A random number for each byte value."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(data: np.ndarray, table: np.ndarray) -> list[int]:
    """Where the chunks of one text end, exclusive."""
    h = table[data]
    width = 1
    while width < WINDOW:  # the hash of 2w bytes from those of w bytes
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    candidates = (np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist()
    ends, start = [], 0
    for end in [*candidates, len(data)]:
        while end - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if end - start >= MIN_CHUNK:
            ends.append(end)
            start = end
    if start < len(data):
        ends.append(len(data))
    return ends


def _first(chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence of each digest, and all others."""
    chunks = chunks[np.lexsort((chunks["start"], chunks["key"], chunks["d2"], chunks["d1"]))]
    new = np.zeros(len(chunks), bool)
    new[_spans.groups(chunks["d1"], chunks["d2"])[0]] = True
    return chunks[new], chunks[~new]


def _as_spans(chunks: np.ndarray) -> np.ndarray:
    out = np.empty(len(chunks), SPAN)
    out["key"], out["start"], out["end"] = chunks["key"], chunks["start"], chunks["start"] + chunks["size"]
    return out


def digested(key: int, body: bytes, table: np.ndarray) -> np.ndarray:
    """The chunks of one text."""
    ends = chunk_ends(np.frombuffer(body, np.uint8), table)
    out, starts = np.empty(len(ends), CHUNK), [0, *ends[:-1]]
    raw = b"".join([hashlib.blake2b(body[a:b], digest_size=16).digest() for a, b in zip(starts, ends, strict=True)])
    out["d1"], out["d2"] = np.frombuffer(raw, "<u8").reshape(-1, 2).T
    out["key"], out["start"] = key, starts
    out["size"] = np.diff(np.array([0, *ends]))
    return out


def copied_spans(texts: Texts) -> DataFrame:
    """Spans of all chunks that are copies, by block."""
    shards, blocks = texts.shards, texts.blocks

    def chunks(docs: pa.Table) -> pa.Table:
        table, bodies = gear(), docs.column("text").cast(pa.binary())
        held = [digested(key, body, table) for key, body in zip(docs.column("key").to_pylist(), bodies.to_pylist(), strict=True) if body]
        first, rest = _first(np.concatenate(held) if held else np.zeros(0, CHUNK))
        shard = first["d1"] % np.uint64(shards)
        spans = _spans.joined_spans(_as_spans(rest))
        return pa.concat_tables([packed(shard.astype(np.int32), first, _spans.RECORDS), packed((spans["key"] % shards).astype(np.int32), spans, _spans.SPANS)])

    def fold(bodies: list[bytes]) -> tuple[bytes, np.ndarray]:
        first, rest = _first(np.frombuffer(b"".join(bodies), CHUNK))
        return first.tobytes(), _as_spans(rest)

    def copies(batches):
        return _spans.spans_of_blocks(shard_by_shard(batches, fold, lambda bodies: [fold(bodies)[1]]), blocks)

    return _spans.sharded(texts.each(chunks, _spans.PACKED), texts).mapInArrow(copies, _spans.OF_BLOCK)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_run: int = MIN_RUN, texts: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``texts``, the bytes ``kept``.

    Null text counts as empty. Rows that repeat an id, or have none, are taken in the order of their texts' hashes, null
    ids last. Texts shorter than ``min_run`` lose nothing; a long text is one group's work and is held whole. An empty
    table gives an empty result. Other columns are not read.
    """
    rows = dealt(docs, doc_id, text)
    return cut_out(rows, copied_spans(rows), min_run, texts)


def op4_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    """What all ``documents`` lose to chunks of smaller ones, see ``deduplicated``."""
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), texts=False)
