"""Exact removal of byte strings that also start in an earlier document, by suffix arrays over shards.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document of smaller id. The corpus is far
too large for one suffix array, so strings that can be equal are brought to the same shard first:

* Every window of ``LENGTH`` bytes has an anchor, the smallest hash of the ``GRAM``-byte strings in it. Equal windows have
  equal anchors. Neighbouring windows with the same anchor are one run, and its bytes its context.
* Anchors are counted over all documents, 8 bytes for each that a block of documents has. Most occur in one document
  only; no window of theirs can be anywhere else.
* Runs of the other anchors go to their anchor's shard with their contexts. Where contexts are equal, byte for byte, those
  of later documents are covered as a whole. Where an anchor has different contexts, the shard's contexts get a suffix
  array; common prefixes of ``LENGTH`` bytes make groups of equal windows, and all but the smallest document's are covered.

Equal contexts meet as one for each block, and shards fold them as they come, so a passage that everybody quotes is no
hot spot inside; at its ends, where contexts differ by what stands around it, an anchor with more than ``CROWDED`` of
them is split into its windows, each dealt by its own hash and then compared like any other context. Documents that are
whole copies of earlier ones are found by their SHA-256 before all this, one digest for each block that has it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm import _spans
from strandwork.llm._sample import byte_spans
from strandwork.llm._spans import SPAN, Texts, cut_out, dealt, groups, joined_spans
from strandwork.llm.suffix_array import permuted_lcp, suffix_array

LENGTH, GRAM = 50, 20
CROWDED = 2000
BLOCK_BITS = 20
STRIP = 1 << 15

RUN = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("key", "<i8"), ("start", "<u4"), ("windows", "<u2")])
_ODD = np.random.default_rng(9).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = np.random.default_rng(8).integers(0, 1 << 63, 256, dtype=np.uint64)


def _stirred(h: np.ndarray) -> np.ndarray:
    """``h`` mixed, in place."""
    h ^= h >> np.uint64(31)
    h *= _ODD[6]
    h ^= h >> np.uint64(29)
    h *= _ODD[7]
    h ^= h >> np.uint64(32)
    return h


def _hashes_of(data: np.ndarray, *totals: int) -> list[np.ndarray]:
    """Hashes of the strings of so many bytes at every position where they fit."""
    h = {1: _BYTE[data]}
    for level, width in enumerate((1, 2, 4, 8, 16)):
        h[2 * width] = h[width][:-width] * _ODD[level]
        h[2 * width] += h[width][width:]
    out = []
    for total in totals:
        n, at = len(data) - total + 1, 0
        some = np.full(n, total, np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            if total - at >= width:
                some *= _ODD[5]
                some += h[width][at : at + n]
                at += width
        out.append(_stirred(some))
    return out


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the strings of ``GRAM`` bytes at every position; for every window of ``LENGTH`` bytes the least of those in
    it, with its place in the low bits; and the window's own hash. In strips that a processor's cache holds."""
    low, span = np.uint64((1 << BLOCK_BITS) - 1), LENGTH - GRAM + 1
    gram = np.empty(len(data) - GRAM + 1, np.uint64)
    window = np.empty(len(data) - LENGTH + 1, np.uint64)
    anchor = np.empty(len(window), np.uint64)
    for at in range(0, len(window), STRIP):
        some, own = _hashes_of(data[at : at + STRIP + LENGTH - 1], GRAM, LENGTH)
        gram[at : at + len(some)], window[at : at + len(own)] = some, own
        least = some & ~low
        least |= np.arange(at, at + len(some), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = span - width
        anchor[at : at + len(own)] = np.minimum(least[: len(least) - rest], least[rest:])
    return gram, anchor, window


def runs_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows in the texts laid end to end in ``data``: start, number of windows, 48-bit anchor, hash of the
    context, and the index of the text. Also every window's hash."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none, none.astype(np.uint64)
    gram, least, window = _hashes(data)
    fits = np.ones(len(window), bool)
    across = (starts[1:, None] - np.arange(1, LENGTH)).ravel()  # what begins so near to an end goes beyond it
    fits[across[(across >= 0) & (across < len(window))]] = False
    new = fits.copy()
    new[1:] &= ~fits[:-1] | (least[1:] != least[:-1])
    bounds = np.append(np.flatnonzero(new | ~fits), len(window))
    start, count = bounds[:-1], np.diff(bounds)
    start, count = start[new[start]], count[new[start]]
    anchor = gram[(least[start] & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)] >> np.uint64(16)
    context = _stirred(window[start] * _ODD[0] + window[start + count - 1] * _ODD[1] + count.astype(np.uint64))
    return start, count, anchor, context, np.searchsorted(starts, start, side="right") - 1, window


def _blocks(texts: pa.Array):
    """As ``byte_spans``, but pieces of a long text overlap so that every window is in one; with the piece's place."""
    most, step = 1 << BLOCK_BITS, (1 << BLOCK_BITS) - LENGTH + 1
    texts = texts.cast(pa.binary())
    sizes = np.array([0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()], np.int64)
    long = np.flatnonzero(sizes > most)
    short = pa.compute.if_else(pa.array(sizes <= most), texts, pa.scalar(b"", pa.binary())) if len(long) else texts
    for data, starts, rows, *_ in byte_spans(short, most):
        yield data, starts, rows, 0
    for row in long.tolist():
        data = np.frombuffer(texts[row].as_py(), np.uint8)
        for at in range(0, len(data) - LENGTH + 1, step):
            yield data[at : at + most], np.zeros(1, np.int64), np.array([row]), at


def _framed(shard: np.ndarray, records: np.ndarray, block: int) -> pa.Table:
    """Records of one block for their shards, each payload with the block's number and how many it has."""
    order = np.argsort(shard, kind="stable")
    shard, records = shard[order], records[order]
    cuts, ends = groups(shard)
    bodies = [np.array([block, b - a], "<u4").tobytes() + records[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
    return _spans.packed_bodies(shard[cuts], bodies, _spans.RECORDS)


def _unframed(bodies: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Records of the payloads of a shard, and the block of each."""
    heads = [np.frombuffer(b, "<u4", 2).tolist() for b in bodies]
    return np.concatenate([np.frombuffer(b, kind, n, 8) for b, (_, n) in zip(bodies, heads, strict=True)]), np.repeat(np.array([b for b, _ in heads], np.int32), [n for _, n in heads])


def _answers(records: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    """Records as rows of ``OF_BLOCK``, one for each block."""
    order = np.argsort(block, kind="stable")
    records, block = records[order], block[order]
    cuts, ends = groups(block)
    return pa.RecordBatch.from_arrays([pa.array(block[cuts], pa.int32()), pa.array([records[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], ["block", "payload"])


#: A digest and the smallest document with it, of those that a block knows.
FIRST = np.dtype([("digest", "S32"), ("key", "<i8")])


def _firsts(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The first document of each digest in a block, and the digest of each document; of texts under ``LENGTH`` bytes, which
    lose nothing, none."""
    # a byte in front, as trailing zeros fall off what numpy takes for a string
    raw = [b"" if len(t) < LENGTH else b"=" + hashlib.sha256(t).digest()[:30] + b"." for t in docs.column("text").cast(pa.binary()).to_pylist()]
    digests, key = np.array(raw, "S32"), docs.column("key").to_numpy()
    order = np.lexsort((key, digests))
    heads, _ = groups(digests[order])
    out = np.empty(len(heads), FIRST)
    out["digest"], out["key"] = digests[order[heads]], key[order[heads]]
    return out[out["digest"] != b""], digests


def first_documents(texts: Texts) -> DataFrame:
    """``block, payload``: for each block the digests it has in common with others, and the smallest document with each."""
    shards = texts.shards

    def digested(docs: pa.Table) -> pa.Table:
        first, _ = _firsts(docs)
        shard = np.frombuffer(first["digest"].astype("S5").tobytes(), np.uint8).reshape(-1, 5)[:, 1:].copy().view("<u4").ravel() % shards
        return _framed(shard.astype(np.int64), first, docs.column("block")[0].as_py())

    def answers(bodies: list[bytes]):
        first, block = _unframed(bodies, FIRST)
        order = np.lexsort((first["key"], first["digest"]))
        first, block = first[order], block[order]
        heads, ends = groups(first["digest"])
        several = np.repeat(ends - heads > 1, ends - heads)
        first["key"] = np.repeat(first["key"][heads], ends - heads)
        yield _answers(first[several], block[several])

    def shared(batches):
        return _spans.shard_by_shard(batches, None, answers, 1 << 62)  # a record for each block that has a digest

    return _spans.sharded(texts.each(digested, _spans.PACKED), texts).mapInArrow(shared, _spans.OF_BLOCK)


def _whole_copies(docs: pa.Table, known: list[bytes]) -> np.ndarray:
    """Which documents of a block are whole copies of smaller ones, there or elsewhere."""
    first, digests = _firsts(docs)
    elsewhere = np.frombuffer(b"".join(known), FIRST)
    every = np.concatenate([first, elsewhere])
    every = every[np.lexsort((every["key"], every["digest"]))]
    every = every[groups(every["digest"])[0]]
    if not len(every):
        return np.zeros(len(digests), bool)
    at = np.minimum(np.searchsorted(every["digest"], digests), len(every) - 1)
    return (every["digest"][at] == digests) & (docs.column("key").to_numpy() > every["key"][at])


def shared_anchors(texts: Texts, firsts: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``block, payload``: for each block its anchors that occur in more than one document, whole copies left aside.

    A record is an anchor's 48 bits above one that says whether the block has it in several documents and 15 for the
    number of different contexts there. What comes back has the lowest bit set where an anchor is crowded: where it has
    more than ``crowded`` contexts, each counted once a block.
    """
    shards, most = texts.shards, (1 << 15) - 1

    def tally(docs: pa.Table, known: pa.Table) -> pa.Table:
        found, block = [], docs.column("block")[0].as_py()
        docs = docs.filter(pa.array(~_whole_copies(docs, known.column("payload").to_pylist())))
        key = docs.column("key").to_numpy()
        for data, starts, rows, _ in _blocks(docs.column("text").combine_chunks()):
            _, _, anchor, context, text, _ = runs_of(data, starts)
            found.append((anchor, context, key[rows[text]]))
        anchor, context, key = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64),) * 3
        order = np.argsort(anchor)
        heads, ends = groups(anchor[order])
        again = np.repeat(ends - heads > 1, ends - heads)  # only these have contexts to put in order
        some = order[again]
        order[again] = some[np.lexsort((context[some], anchor[some]))]
        anchor, context, key = anchor[order], context[order], key[order]
        if not len(heads):
            return _framed(np.zeros(0, np.int64), anchor, block)
        new = np.zeros(len(anchor), np.int64)
        new[groups(anchor, context)[0]] = 1
        several = np.minimum.reduceat(key, heads) < np.maximum.reduceat(key, heads)
        contexts = np.minimum(np.add.reduceat(new, heads), most)
        record = anchor[heads] << np.uint64(16) | several.astype(np.uint64) << np.uint64(15) | contexts.astype(np.uint64)
        return _framed((anchor[heads] % np.uint64(shards)).astype(np.int64), record, block)

    def answers(bodies: list[bytes]):
        record, block = _unframed(bodies, np.dtype("<u8"))
        order = np.argsort(record, kind="stable")
        record, block = record[order], block[order]
        anchor = record >> np.uint64(16)
        heads, ends = groups(anchor)
        shared = (ends - heads > 1) | np.logical_or.reduceat((record >> np.uint64(15) & np.uint64(1)).astype(bool), heads)
        contexts = np.add.reduceat((record & np.uint64(most)).astype(np.int64), heads)
        answer = np.repeat(anchor[heads] << np.uint64(16) | (contexts > crowded).astype(np.uint64), ends - heads)
        kept = np.repeat(shared, ends - heads)
        yield _answers(answer[kept], block[kept])

    def shared(batches):
        return _spans.shard_by_shard(batches, None, answers, 1 << 62)  # a record for each block that has an anchor: nothing to fold

    return _spans.sharded(texts.each_with(firsts, tally, _spans.PACKED), texts).mapInArrow(shared, _spans.OF_BLOCK)


def _ragged(data: np.ndarray, start: np.ndarray, size: np.ndarray, step: int = 1 << 13) -> np.ndarray:
    """The pieces of ``data`` at ``start``, end to end; all as short as contexts are, so each is taken at the longest's size."""
    if not len(start):
        return data[:0]
    most = int(size.max())
    pieces = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(most, np.uint8)), most)
    return np.concatenate([pieces[start[at : at + step]][np.arange(most) < size[at : at + step, None]] for at in range(0, len(start), step)])


def _run_bytes(runs: np.ndarray, contexts: np.ndarray) -> bytes:
    """Number of runs, the runs, and their contexts."""
    return np.int64(len(runs)).tobytes() + runs.tobytes() + contexts.tobytes()


def _runs_in(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Runs and contexts of several payloads."""
    found, contexts = [], []
    for body in bodies:
        n = int(np.frombuffer(body, "<i8", 1)[0])
        found.append(np.frombuffer(body, RUN, n, 8))
        contexts.append(np.frombuffer(body, np.uint8, offset=8 + n * RUN.itemsize))
    return np.concatenate(found), np.concatenate(contexts)


def _packed_runs(shard: np.ndarray, runs: np.ndarray, contexts: np.ndarray) -> pa.Table:
    """One row for each shard."""
    width = _width(runs)
    place = np.cumsum(width) - width
    order = np.argsort(shard, kind="stable")
    shard, runs = shard[order], runs[order]
    contexts = _ragged(contexts, place[order], width[order])
    place = np.cumsum(width[order]) - width[order]
    cuts, ends = groups(shard)
    offsets = np.append(place, len(contexts))
    return _spans.packed_bodies(shard[cuts], [_run_bytes(runs[a:b], contexts[offsets[a] : offsets[b]]) for a, b in zip(cuts, ends, strict=True)], _spans.RECORDS)


def _width(runs: np.ndarray) -> np.ndarray:
    """Bytes of the contexts of runs."""
    return runs["windows"].astype(np.int64) + LENGTH - 1


def _covered(runs: np.ndarray) -> np.ndarray:
    """What whole runs cover."""
    out = np.empty(len(runs), SPAN)
    out["key"], out["start"] = runs["key"], runs["start"]
    out["end"] = runs["start"].astype(np.int64) + runs["windows"] + LENGTH - 1
    return out


def _differ(contexts: np.ndarray, a: np.ndarray, b: np.ndarray, width: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Whether the bytes at ``a`` and at ``b`` are different."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), step):
        n = width[at : at + step]
        unlike = _ragged(contexts, a[at : at + step], n) != _ragged(contexts, b[at : at + step], n)
        out[at : at + step] = np.logical_or.reduceat(unlike, np.cumsum(n) - n)
    return out


def _by_context(runs: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by context, document and place; where in it a context begins; and whether a run is of its first document.

    Runs have one context only if its bytes are the same: hashes bring them together, and every one is then compared with
    the first of its group. Where a hash has several contexts, these are told apart by their bytes.
    """
    width = _width(runs)
    place = np.cumsum(width) - width
    which = np.zeros(len(runs), np.int64)
    while True:
        order = np.lexsort((runs["start"], runs["key"], which, runs["windows"], runs["context"], runs["anchor"]))
        r = runs[order]
        heads, ends = groups(r["anchor"], r["context"], r["windows"], which[order])
        leader = order[np.repeat(heads, ends - heads)]
        others = np.flatnonzero(leader != order)
        unlike = others[_differ(contexts, place[order[others]], place[leader[others]], width[order[others]])]
        if not len(unlike):
            break
        for a, b in zip(heads, ends, strict=True):
            if a <= unlike[-1] and b > unlike[0]:
                seen: dict[bytes, int] = {}
                for i in order[a:b]:
                    which[i] = seen.setdefault(contexts[place[i] : place[i] + width[i]].tobytes(), len(seen))
    first = np.repeat(r["key"][heads], ends - heads)
    return order, heads, r["key"] == first


def _folded(runs: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of each context's first document with their contexts, and what the others cover."""
    order, _, first = _by_context(runs, contexts)
    mine, width = order[first], _width(runs)
    return runs[mine], _ragged(contexts, (np.cumsum(width) - width)[mine], width[mine]), joined_spans(_covered(runs[order[~first]]))


def _equal_windows(runs: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Spans covered by windows that also occur in a run of a smaller document; the runs have different contexts."""
    size = _width(runs)
    at = np.cumsum(size + 1) - size - 1
    code = np.zeros(int((size + 1).sum()), np.int64)
    raw = np.zeros(len(code), np.uint8)
    where = np.arange(len(contexts)) + np.repeat(at - (np.cumsum(size) - size), size)
    raw[where] = contexts
    code[where] = contexts.astype(np.int64) + 1
    owner = np.repeat(np.arange(len(runs)), size + 1)
    inside = np.arange(len(code)) - at[owner]
    sa = suffix_array(code)
    sa = sa[(inside < runs["windows"][owner])[sa]]  # windows only: where two are equal, what lies between them has these bytes too
    group = np.cumsum(permuted_lcp(raw, sa, LENGTH)[sa] < LENGTH)
    heads, ends = groups(group)
    key = runs["key"][owner[sa]]
    least = np.repeat(np.minimum.reduceat(key, heads), ends - heads)
    later = sa[key > least]
    out = np.empty(len(later), SPAN)
    out["key"] = owner[later]  # the run for now
    out["start"] = inside[later]
    out["end"] = out["start"] + LENGTH
    return joined_spans(out)


def _by_anchor(chosen: np.ndarray, anchors: np.ndarray, width: np.ndarray, most: int = 1 << 19):
    """``chosen`` in pieces of whole anchors with about ``most`` bytes of contexts, so that a suffix array stays small."""
    if not len(chosen):
        return
    heads, ends = groups(anchors[chosen])
    size = np.add.reduceat(width[chosen], heads)
    piece = np.cumsum(size) // most
    for a, b in zip(*groups(piece), strict=True):
        yield chosen[heads[a] : ends[b - 1]]


def covered_spans(texts: Texts, firsts: DataFrame, shared: DataFrame) -> DataFrame:
    """Spans that windows of smaller documents cover, by block; of whole copies, all of it."""
    shards, blocks = texts.shards, texts.blocks

    def runs(docs: pa.Table, known: pa.Table) -> pa.Table:
        told: tuple[list[bytes], list[bytes]] = ([], [])
        for which, body in zip(known.column("which").to_pylist(), known.column("payload").to_pylist(), strict=True):
            told[which].append(body)
        copies = _whole_copies(docs, told[0])
        whole = np.empty(int(copies.sum()), SPAN)
        whole["key"], whole["start"] = docs.column("key").to_numpy()[copies], 0
        whole["end"] = pa.compute.binary_length(docs.column("text").filter(pa.array(copies)).cast(pa.binary())).to_numpy()
        docs = docs.filter(pa.array(~copies))
        names = np.sort(np.frombuffer(b"".join(told[1]), "<u8"))
        many = (names & np.uint64(1)).astype(bool)
        names = names >> np.uint64(16)
        held = [(np.zeros(0, RUN), np.zeros(0, np.uint8))]
        key = docs.column("key").to_numpy()
        for data, starts, rows, offset in _blocks(docs.column("text").combine_chunks()) if len(names) else []:
            start, count, anchor, context, text, window = runs_of(data, starts)
            at = np.minimum(np.searchsorted(names, anchor), len(names) - 1)
            hit, split = names[at] == anchor, many[at]
            for apart in (False, True):
                on = np.flatnonzero(hit & (split == apart))
                s, n, t = start[on], count[on], text[on]
                out = np.empty(int(n.sum()) if apart else len(on), RUN)
                if apart:  # windows one by one, each its own anchor
                    s, t = np.repeat(s, n) + np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n), np.repeat(t, n)
                    n = np.ones(len(s), np.int64)
                out["anchor"], out["context"] = (window[s], window[s]) if apart else (anchor[on], context[on])
                out["key"], out["start"], out["windows"] = key[rows[t]], s - starts[t] + offset, n
                held.append((out, _ragged(data, s, n + LENGTH - 1)))
        kept, contexts, spans = _folded(*(np.concatenate(x) for x in zip(*held, strict=True)))
        spans = np.concatenate([spans, whole])
        sent = _packed_runs((kept["anchor"] % np.uint64(shards)).astype(np.int32), kept, contexts)
        return pa.concat_tables([sent, _spans.packed((spans["key"] % shards).astype(np.int32), spans, _spans.SPANS)])

    def fold(bodies: list[bytes]) -> tuple[bytes, np.ndarray]:
        kept, contexts, spans = _folded(*_runs_in(bodies))
        return _run_bytes(kept, contexts), spans

    def found(bodies: list[bytes]):
        every, contexts = _runs_in(bodies)
        width = _width(every)
        place = np.cumsum(width) - width
        order, heads, first = _by_context(every, contexts)
        yield _covered(every[order[~first]])
        one = order[heads]  # a run of the first document for each context
        anchors = every["anchor"][one]
        same = anchors[1:] == anchors[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        places = np.add.reduceat(first.astype(np.int64), heads)
        for chosen in _by_anchor(np.flatnonzero(several), anchors, width[one]):
            hits = _equal_windows(every[one[chosen]], _ragged(contexts, place[one[chosen]], width[one[chosen]]))
            # a first document can have its context in several places, the first ones of the context's runs
            context = chosen[hits["key"]]
            times = places[context]
            hits = np.repeat(hits, times)
            nth = np.arange(len(hits)) - np.repeat(np.cumsum(times) - times, times)
            there = every[order[np.repeat(heads[context], times) + nth]]
            hits["key"] = there["key"]
            hits["start"] += there["start"]
            hits["end"] += there["start"]
            yield hits

    def covered(batches):
        return _spans.spans_of_blocks(_spans.shard_by_shard(batches, fold, found), blocks)

    known = firsts.withColumn("which", F.lit(0)).unionByName(shared.withColumn("which", F.lit(1)))
    return _spans.sharded(texts.each_with(known, runs, _spans.PACKED), texts).mapInArrow(covered, _spans.OF_BLOCK)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: bool = True, crowded: int = CROWDED) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``texts``, the bytes ``kept``.

    Null text counts as empty; texts of under ``LENGTH`` bytes lose nothing, and a long text is looked at in overlapping
    pieces. Rows that repeat an id, or have none, are taken in the order of their texts' hashes, null ids last. An empty
    table gives an empty result. Other columns are not read.
    """
    rows = dealt(docs, doc_id, text)
    firsts = first_documents(rows)
    return cut_out(rows, covered_spans(rows, firsts, shared_anchors(rows, firsts, crowded)), 1, texts)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What all ``documents`` lose to passages of smaller ones, see ``deduplicated``."""
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), texts=False)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS s FROM (SELECT doc_id, h, unnest(range(greatest(n - 49, 0))) AS p FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
c AS (SELECT w.doc_id, p, lag(p) OVER (PARTITION BY w.doc_id ORDER BY p) AS q FROM w JOIN m USING (s) WHERE m.first < w.doc_id),
g AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM r),
t AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, CAST(2 * after + 1 AS BIGINT), CAST(2 * (a - after) AS BIGINT)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(concat(coalesce(kept, ''), substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT))))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
