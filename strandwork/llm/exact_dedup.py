"""Exact deduplication by a tree-merge of sorted digest runs.

The documents of each partition give one sorted run with an entry per digest: smallest row and number of copies. Runs then
meet in binomial rounds: in round r the slots i and i XOR 2**r exchange halves of their runs, each keeping the entries
whose digest agrees with its own number in bit r, and merge what they have kept with what came. After the last round all
entries of a digest have met in the slot that its bits name. A digest that a third of all documents share is one entry of
each run from the start, so no slot is hot.

Runs travel packed, a row each, and stay sorted, so that a merge is a merge: nothing is sorted again. On the way back,
first the entries of the starting slots and then the documents of each slot meet the merged entries: a document joins on
(starting slot, digest), which spreads the copies of a hot text over all slots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm._rows import only_kept, raw_hash
from strandwork.session import settled

SPACES = r"[\x20\x09-\x0D]+"
#: An entry: the digest as four numbers, a second check of the text (length and an unrelated hash), the smallest row with
#: it (whether it has no id, id and hash of the text as it is) and the number of rows.
ENTRY = np.dtype([("d0", "<u8"), ("d1", "<u8"), ("d2", "<u8"), ("d3", "<u8"), ("n_bytes", "<i8"), ("second", "<i8"), ("no_id", "u1"), ("keep_id", "<i8"), ("keep_raw", "<i8"), ("group_size", "<i8")])
EQUAL = ("d0", "d1", "d2", "d3", "n_bytes", "second")
MOST = np.iinfo(np.int64).max
RUN = "slot int, run binary"
#: A slot's run is held whole by a task.
ENTRIES_A_SLOT = 1 << 20


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``raw`` (hash of the text as it is), digest of the normalised text, and a second check of it."""
    norm = docs.select(F.col(doc_id).cast("long").alias("doc_id"), raw_hash(F.col(text)).alias("raw"), normalised(F.col(text)).alias("norm"))
    return norm.select("doc_id", "raw", F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").cast("long").alias("n_bytes"), F.xxhash64("norm").alias("second"))


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of several sorted ones. Entries that agree in digest, length and second hash become one, with the
    smallest row and all copies."""
    every = np.concatenate(runs) if len(runs) > 1 else runs[0]
    order = np.argsort(every["d0"], kind="stable")  # finds the runs that are there and merges them
    first = every["d0"][order]
    unlike = np.logical_or.reduce([every[c][order][1:] != every[c][order][:-1] for c in EQUAL[1:]]) if len(every) > 1 else np.zeros(0, bool)
    if (unlike & (first[1:] == first[:-1])).any():  # digests that only begin alike
        order = np.lexsort([every[c] for c in reversed(EQUAL)])
    every = every[order]
    if not len(every):
        return every
    new = np.concatenate([[True], np.logical_or.reduce([every[c][1:] != every[c][:-1] for c in EQUAL])])
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(every))
    out = every[heads].copy()
    out["group_size"] = np.add.reduceat(every["group_size"], heads)
    # The smallest row: one with an id before one without, then by id, then by the hash; places that are out of it count most.
    in_it = np.ones(len(every), bool)
    for c in ("no_id", "keep_id", "keep_raw"):
        out[c] = np.minimum.reduceat(np.where(in_it, every[c], MOST), heads)
        in_it &= every[c] == np.repeat(out[c], ends - heads)
    return out


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    """A sorted run of the rows of one batch: ``doc_id, raw, digest, n_bytes, second``."""
    out = np.empty(batch.num_rows, ENTRY)
    out["d0"], out["d1"], out["d2"], out["d3"] = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, 4).T
    out["n_bytes"], out["second"] = batch.column(3).to_numpy(), batch.column(4).to_numpy()
    out["no_id"] = batch.column(0).is_null().to_numpy(zero_copy_only=False)
    out["keep_id"], out["keep_raw"], out["group_size"] = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy(), 1
    return merged([out[np.argsort(out["d0"], kind="stable")]])


def _rows_of(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([r.tobytes() for _, r in found], pa.binary())], ["slot", "run"])


def local_runs(rows: DataFrame, fold: int = 1 << 20) -> DataFrame:
    """``slot, run``: one sorted run for the rows of each slot in a partition."""

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        sizes: dict[int, int] = {}
        for batch in batches:
            slots = batch.column(5).to_numpy()
            for slot in np.unique(slots).tolist():
                held.setdefault(slot, []).append(_entries(batch.filter(pa.array(slots == slot))))
                sizes[slot] = sizes.get(slot, 0) + len(held[slot][-1])
                if sizes[slot] > fold:
                    held[slot] = [merged(held[slot])]
                    sizes[slot] = len(held[slot][0]) // 2
        if held:
            yield _rows_of([(slot, merged(runs)) for slot, runs in held.items()])

    return rows.select("doc_id", "raw", "digest", "n_bytes", "second", "slot").mapInArrow(run, RUN)


def tree_merge(runs: DataFrame, rounds: int, least: int) -> DataFrame:
    """Merges the runs of ``2 ** rounds`` slots: the entries of ``least`` or more copies as rows of ``ENTRIES``."""

    def met(level: int | None):
        """Merges the runs that have met in a slot, and sends away the half that belongs to its partner of ``level``; after
        the last level, gives rows."""

        def run(batches):
            held: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for slot, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held.setdefault(slot, []).append(np.frombuffer(body, ENTRY))
            for slot, some in held.items():
                one = merged(some)
                if level is None:
                    yield _as_rows(slot, one, least)
                    continue
                mine = (one["d0"] >> np.uint64(level) & np.uint64(1)) == (slot >> level & 1)
                yield _rows_of([(slot, one[mine]), (slot ^ 1 << level, one[~mine])])

        return run

    for level in [*range(rounds), None]:
        runs = runs.repartitionById(1 << rounds, F.col("slot")).mapInArrow(met(level), ENTRIES if level is None else RUN)
    return runs


ENTRIES = "slot int, digest binary, n_bytes long, second long, keep_id long, keep_raw long, group_size long"


def _as_rows(slot: int, run: np.ndarray, least: int) -> pa.RecordBatch:
    """The entries of a run that have ``least`` or more copies, as rows of ``ENTRIES``."""
    some = run[run["group_size"] >= least]
    digest = np.stack([some[d] for d in EQUAL[:4]], axis=1).tobytes()
    columns = [pa.array(np.full(len(some), slot, np.int32)), pa.array([digest[i : i + 32] for i in range(0, len(digest), 32)], pa.binary())]
    names = ["n_bytes", "second", "keep_id", "keep_raw", "group_size"]
    kept = [pa.array(np.ascontiguousarray(some[n]), mask=some["no_id"].astype(bool) if n == "keep_id" else None) for n in names]
    return pa.RecordBatch.from_arrays(columns + kept, ["slot", "digest", *names])


def _unpacked(batches):
    for batch in batches:
        for slot, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield _as_rows(slot, np.frombuffer(body, ENTRY), 1)


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``exact_groups``, with ``raw``, the hash of the text as it is."""
    parts = settled(digests(docs, doc_id, text).withColumn("slot", F.spark_partition_id()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = (max(least, parts.count() // ENTRIES_A_SLOT) - 1).bit_length()
    rows = parts.withColumn("slot", F.pmod("slot", F.lit(1 << rounds)).cast("int"))
    runs = settled(local_runs(rows))
    key = ["digest", "n_bytes", "second"]
    groups = tree_merge(runs, rounds, 2).drop("slot")
    back = runs.mapInArrow(_unpacked, ENTRIES).select("slot", *key).join(groups, key).distinct()
    found = rows.join(back, ["slot", *key], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        "raw",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(keep) & (F.col("raw") == F.col("keep_raw")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty, and a text of any length is one digest. Null ids sort last and are kept only where a group
    has no other. Where several rows of a group have its smallest id, that with the smallest hash of the text as it is is
    kept, and rows that repeat both alike. An empty table gives an empty result; other columns are not read.
    """
    return judged(docs, doc_id, text).drop("raw")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, and of rows that repeat id and text one; all columns stay.

    A row goes only by what its own text is: one that repeats an id has a fate of its own, and copies without id go.
    """
    return only_kept(docs, settled(judged(docs, doc_id, text)), doc_id, text)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Which of equal ``documents`` stays, for all of them, see ``exact_groups``."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
