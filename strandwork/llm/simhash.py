"""SimHash near-duplicates through an inverted index over byte positions with count filtering.

Two fingerprints of 8 bytes that differ in at most 2 bits have at least 6 equal bytes in equal positions, so 6 is the
count that a pair must reach. Posting lists of single positional bytes would pair almost everything with everything
(2048 lists however many documents), so postings are blocked: a list is named by four positions, two of the four pairs of
neighbours, and their bytes. A pair with the count has two such pairs whole and meets in a list. There the shared
positional bytes of each pair are tallied, pairs that reach the count are retained, and these are verified by the bits in
which they differ.

Lists of more than ``FEW`` members would make all pairs of a group. They are split by two more positions in each way that
a pair with the count can share them, and what is still long has only two bytes free, so that a member's neighbours are
looked up by flipping bits; such a list gives the edges of a spanning forest, not its pairs. Components of all edges are
the groups of near copies.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm._rows import least_row, only_kept, raw_hash
from strandwork.operators.components import connected_components
from strandwork.session import settled

SEED = 42
MAX_BITS = 2
COUNT = 8 - MAX_BITS
FEW = 16


def fingerprint(text: bytes, width: int = 3, seed: int = SEED, block: int = 1 << 16) -> int:
    """Majority bits of the XXH64 of all ``width``-word shingles of a text, as unsigned integer; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - width] + 1])
    ends = ends[width - 1 :]
    digest, n, ones = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for at in range(0, n, block):
        spans = zip(starts[at : at + block].tolist(), ends[at : at + block].tolist(), strict=True)
        hashes = np.array([digest(flat[a:b], seed) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, raw, fp`` (hash of the text, and the fingerprint as signed long); null text has no words."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fps = np.array([fingerprint(t.as_py() or b"", width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "raw", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), raw_hash(F.col(text)), F.col(text).cast("string")).mapInArrow(run, "doc_id long, raw long, fp long")


PARTS = list(combinations(range(4), 2))
PAIRS = list(combinations(range(8), 2))
_NEAR = np.array(sorted(sum(1 << b for b in bits) for k in (1, MAX_BITS) for bits in combinations(range(16), k)), np.int64)


def postings(fps: DataFrame) -> DataFrame:
    """``list_id, fp``: the six lists of each fingerprint, named by four byte positions (two pairs of neighbours) and the
    bytes in them."""
    part = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)
    lists = [F.shiftleft(part(a), 16).bitwiseOR(part(b)).bitwiseOR(F.lit(i << 32)) for i, (a, b) in enumerate(PARTS)]
    return fps.select(F.explode(F.array(*lists)).alias("list_id"), "fp")


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tally of pairs: in how many positions their bytes are the same."""
    differ = (a ^ b).view(np.uint8).reshape(len(a), 8)
    return (differ == 0).sum(axis=1)


def _forest(fps: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member of a long list to the smallest member that it reaches within the list."""
    free = ((fps >> 8 * low) & 255 | ((fps >> 8 * high) & 255) << 8).astype(np.int64)
    at = np.full(1 << 16, -1, np.int64)
    at[free] = np.arange(len(fps))
    label = np.arange(len(fps))
    while True:
        before = label.copy()
        for flip in _NEAR:
            other = at[free ^ flip]
            hit = other >= 0
            np.minimum.at(label, np.flatnonzero(hit), label[other[hit]])
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(fps))
    return fps[moved], fps[label[moved]]


def _counted(heads: np.ndarray, sizes: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the members of short lists: their shared positional bytes are tallied, pairs that reach the count are
    retained, and these are verified by the bits in which they differ."""
    at = np.repeat(heads, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    last = np.repeat(heads + sizes, sizes)
    out = [(fps[:0], fps[:0])]
    for d in range(1, int(sizes.max(initial=1))):
        near = at[at + d < last]
        a, b = fps[near], fps[near + d]
        kept = shared_bytes(a, b) >= COUNT
        a, b = a[kept], b[kept]
        verified = np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_BITS
        out.append((a[verified], b[verified]))
        at, last = at[at + d < last], last[at + d < last]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sub_lists(members: np.ndarray, i: int):
    """The lists of two more positions each that pairs with the count have in common, given a list's own four."""
    left = [p for k in range(4) if k not in PARTS[i] for p in (2 * k, 2 * k + 1)]
    for low, high in combinations(left, 2):  # the positions that may differ
        own = [p for p in left if p not in (low, high)]
        key = members >> 8 * own[0] & 255 | (members >> 8 * own[1] & 255) << 8
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        yield low, high, members[order], cuts, np.diff(np.append(cuts, len(members)))


def _edges(ids: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what whole lists have within ``MAX_BITS``; ``ids`` are sorted."""
    heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    sizes = np.diff(np.append(heads, len(ids)))
    few = sizes <= FEW
    out = [_counted(heads[few], sizes[few], fps)]
    for k in np.flatnonzero(~few):
        members = np.unique(fps[heads[k] : heads[k] + sizes[k]])
        for low, high, some, cuts, counts in _sub_lists(members, int(ids[heads[k]]) >> 32):
            short = counts <= FEW
            out.append(_counted(cuts[short], counts[short], some))
            out += [_forest(np.sort(some[c : c + n]), low, high) for c, n in zip(cuts[~short], counts[~short], strict=True)]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges from each end to the smallest that it reaches: they join what the edges ``a, b`` join, in fewer and shorter steps."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["a", "b"])


def _links(batches, most: int = 1 << 18):
    """Edges of the lists of a partition, which arrive sorted by list; carries the last list from batch to batch."""
    ids, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in chain(batches, [None]):
        if batch is not None:
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy()])
        cut = len(ids) if batch is None or not len(ids) else int(np.searchsorted(ids, ids[-1]))
        if cut:
            held.append(_edges(ids[:cut], fps[:cut]))
            size += len(held[-1][0])
        ids, fps = ids[cut:], fps[cut:]
        if size > most or batch is None and held:
            yield _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0


def links(fps: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints (distinct ``fp``) at ``MAX_BITS`` or fewer differing bits."""
    lists = postings(fps)
    return lists.repartition("list_id").sortWithinPartitions("list_id").mapInArrow(_links, "a long, b long")


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """As ``near_groups``, with ``raw`` (hash of the text as it is) and ``kept``, true for the smallest row of a group."""
    slots = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = settled(fingerprints(docs, doc_id, text, width).withColumn("slot", F.pmod(F.xxhash64("doc_id", "raw"), F.lit(slots))))
    runs = settled(rows.groupBy("slot", "fp").agg(F.min(least_row(F.col("doc_id"), F.col("raw"))).alias("least")))
    fps = settled(runs.groupBy("fp").agg(F.min("least").alias("least")))
    roots = connected_components(links(fps.select("fp")))
    joined = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = settled(joined)
    inside = joined.groupBy("root").agg(F.min("least").alias("of_all"), F.count("*").alias("n")).where("n > 1")
    named = joined.join(inside, "root", "left").select("fp", F.coalesce("of_all", "least").alias("least"))
    back = runs.select("slot", "fp").join(named, "fp")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("raw") == F.col("least.raw"))
    return rows.join(back, ["slot", "fp"]).select("doc_id", "raw", "fp", F.col("least.doc_id").alias("component_id"), kept.alias("kept"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``, the smallest id of all documents it is linked to.

    Null and empty texts have fingerprint 0 and link like any other; a long text is one task's work, shingle by shingle.
    Rows that repeat an id have fingerprints of their own; null ids come last, so that a group is named by one only if it
    has no other. Copies of a fingerprint meet as one entry per slot of rows, so a text that a third of all rows share
    loads no single task. An empty table gives an empty result; other columns are not read.
    """
    return judged(docs, doc_id, text, width).drop("raw", "kept")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of near copies the row with the smallest id (null last, then the smallest hash of its text), and of
    rows that repeat id and text one; all columns stay. A row that repeats an id has a fate of its own."""
    return only_kept(docs, settled(judged(docs, doc_id, text)), doc_id, text)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all ``documents``, see ``near_groups``."""
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
