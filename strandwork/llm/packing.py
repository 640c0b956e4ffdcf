"""Packing by power-of-two decomposition: a document's tokens are cut into pieces of binary lengths.

A document of n tokens gives n // limit pieces of the limit and one piece for every bit of the rest, longest first.
Pieces of equal length go to one bucket; each is a sequence of its own, so no sequence crosses documents and none has
padding. Sequences are numbered bucket by bucket.

Token ids are those of the ``tokenizers`` library for the given vocabulary; where a rank file of the same vocabulary
is given, ``tiktoken`` makes the same ids several times faster. Texts with a special token's string, or with very long
runs of or without white space, go the first way.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.llm._rows import in_slices
from strandwork.session import settled

LIMIT = 2048
END_ID = 1
SLOTS_A_GROUP = 4096


def unbroken(text: str, most: int = 1 << 14) -> bool:
    """Whether ``text`` has ``most`` or more characters in a row that are all white space, or none of which is: a piece that
    the faster library may not get through."""
    if len(text) < most:
        return False
    return re.search(rf"\s{{{most}}}", text) is not None or max(map(len, text.split()), default=0) >= most


@lru_cache(maxsize=4)
def encoder(tokenizer: str, ranks: str | None, pattern: str | None):
    """A function from text to a sequence of ids; built once in each Python worker, the vocabulary of ``tokenizers`` only
    where a text needs it."""

    @lru_cache(maxsize=1)
    def exact():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(tokenizer)

    if ranks is None:
        return lambda text: exact().encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    with open(tokenizer) as body:
        special = [t["content"] for t in json.load(body)["added_tokens"]]

    def encode(text: str):
        if any(s in text for s in special) or unbroken(text):
            return exact().encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def piece_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """Whole limits, then the binary digits of the rest, longest first. ``limit`` is a power of two."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << b for b in range(limit.bit_length() - 2, -1, -1) if rest >> b & 1]


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("token_ids", T.BinaryType()),
    ]
)


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, limit: int = LIMIT, flush_tokens: int = 1 << 20) -> DataFrame:
    """Pieces with their ids as packed little-endian unsigned 32-bit integers.

    Null and empty texts are ``end_id`` alone; a text of any length is encoded whole, in one task. Rows that repeat an id
    or a text are cut each for itself; an empty table gives an empty result; other columns are not read.
    """
    if limit & (limit - 1) or limit < 1:
        raise ValueError("limit must be a power of two")

    def cut(batches):
        encode = encoder(tokenizer, ranks, pattern)
        cols: list[list] = [[], [], [], [], []]
        held = 0
        for batch in in_slices(batches):
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = array("I", encode(body.as_py() or ""))
                ids.append(end_id)
                raw, n, start = memoryview(np.frombuffer(ids, np.uint32).astype("<u4").tobytes()), len(ids), 0
                for size in piece_lengths(n, limit):
                    for col, value in zip(cols, (key, start, size, n, bytes(raw[4 * start : 4 * (start + size)])), strict=True):
                        col.append(value)
                    start += size
                held += n
                if held >= flush_tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.binary(),), strict=True)], PIECES.names)
                    cols, held = [[], [], [], [], []], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.binary(),), strict=True)], PIECES.names)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut, PIECES)


def in_sequences(cut: DataFrame, per_slot: int = 100_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``: every piece is a sequence, numbered from 0 by length and place in its bucket.

    A bucket is numbered in slots of about ``per_slot`` pieces, dealt by a hash of document and start; slot offsets
    come from one count per slot, added up in groups and then over the groups, of which there are few.
    """
    cut = settled(cut)
    slots = max(1, cut.count() // per_slot)
    cut = cut.withColumn("_slot", F.pmod(F.xxhash64("doc_id", "start"), F.lit(slots)))
    counts = settled(cut.groupBy("length", "_slot").count().withColumn("_group", F.floor(F.col("_slot") / SLOTS_A_GROUP)))
    inside = F.sum("count").over(Window.partitionBy("length", "_group").orderBy("_slot")) - F.col("count")
    totals = counts.groupBy("length", "_group").agg(F.sum("count").alias("_all"))
    earlier = totals.select("length", "_group", (F.sum("_all").over(Window.orderBy("length", "_group")) - F.col("_all")).alias("_earlier"))
    places = counts.withColumn("_inside", inside).join(earlier, ["length", "_group"]).select("length", "_slot", (F.col("_earlier") + F.col("_inside")).alias("_before"))
    rest = [c for c in cut.columns if c not in ("length", "_slot", "doc_id", "start")]
    order = Window.partitionBy("length", "_slot").orderBy("doc_id", "start", *rest)
    numbered = cut.withColumn("_n", F.row_number().over(order) - 1)
    numbered = numbered.join(places, ["length", "_slot"])
    return numbered.withColumn("sequence_id", (F.col("_before") + F.col("_n")).cast("long")).withColumn("offset", F.lit(0).cast("long")).drop("_slot", "_n", "_before")


def packed(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, **options) -> DataFrame:
    """The packed corpus: one row per sequence with its ``token_ids``."""
    return in_sequences(pieces(docs, tokenizer, ranks, pattern, **options))


def packed_digests(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, **options) -> DataFrame:
    """As ``packed``, with a CRC-32 in place of the ids."""
    cut = pieces(docs, tokenizer, ranks, pattern, **options)
    cut = cut.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens")
    return in_sequences(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def public_vocabulary() -> tuple[str, str, str]:
    """Files of the public byte-level vocabulary: tokenizer, the same as ranks, and the splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in power-of-two pieces of ids, a sequence each, see ``pieces``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed_digests(docs, *public_vocabulary())
