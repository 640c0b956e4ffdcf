"""The pipeline's stages against brute force, each on what the one before kept."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from strandwork.llm import chunk_dedup, language_id, mixing, packing, quality_model, simhash

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(grams)) if grams else 0


def near_roots(fps):
    """For every place in ``fps`` the least of its component."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    arr = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 2).tolist():
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def least_of(groups):
    """(id, text) of the row of each group that stays: the smallest id, null last, then the smallest hash of the text."""
    raw = lambda t: int(np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).astype(np.int64))
    return Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0, raw(r[1])))[:2] for g in groups.values())


def prose_of(seed):
    r = np.random.default_rng(seed)
    return " ".join(str(r.choice(["the river", "a house", "and then", "it was", "green", "of stone"])) + str(r.integers(99)) for _ in range(80))


@pytest.fixture(scope="module")
def stages(spark, odd_docs, tmp_path_factory):
    """Input and output of every stage, over odd rows with ids and, where there are any, the small documents."""
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    more = [(50, prose_of(7), "en", "a", 1), (50, prose_of(8), "en", "a", 1), (49, prose_of(7), "en", "b", 1), (None, prose_of(7), None, None, 1), (None, prose_of(9), "en", None, 1)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    if os.path.isdir(DATA):
        more = spark.read.parquet(f"{DATA}/documents.parquet")
        docs = docs.unionByName(more.selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars"))
    place, out = tmp_path_factory.mktemp("pipeline"), {}
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, DATA).write.parquet(str(place / str(k)))
        after = spark.read.parquet(str(place / str(k)))
        out[name] = (now, after)
        now = after
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "mixing", "packing"]


def test_language_stage(stages):
    before, after = stages["language ID"]
    assert after.columns == before.columns
    kept = Counter(rows(after))
    assert not kept - Counter(rows(before))
    letters = [r for r in rows(before) if r[1] and any(map(str.isalpha, r[1]))]
    assert not [r for r in kept if not r[1] or not any(map(str.isalpha, r[1]))]
    assert sum(kept.values()) >= 0.97 * len(letters)


def test_exact_stage(stages):
    before, after = stages["exact dedup"]
    same = {}
    for r in rows(before):
        same.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r)
    assert Counter(r[:2] for r in rows(after)) == least_of(same)
    assert not Counter(rows(after)) - Counter(rows(before))
    assert {(50, prose_of(8)), (49, prose_of(7)), (None, prose_of(9))} <= {r[:2] for r in rows(after)}


def test_near_stage(stages):
    before, after = stages["SimHash near-dedup"]
    every, near = rows(before), {}
    for r, root in zip(every, near_roots([fingerprint(r[1]) for r in every]), strict=True):
        near.setdefault(root, []).append(r)
    assert Counter(r[:2] for r in rows(after)) == least_of(near)
    assert not Counter(rows(after)) - Counter(every)


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    size = lambda r: len(WORD.findall(r[1] or ""))
    totals = Counter()
    for r in rows(before):
        totals[r[3]] += size(r)
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHT_CYCLE[k % 3] for k, s in enumerate(order)}
    full: set = set()
    while True:
        rest = sum(totals.values()) - sum(3 * totals[s] for s in full)
        share = {s: 3 * totals[s] if s in full else rest * weight[s] / max(1e-9, sum(weight[x] for x in order if x not in full)) for s in order}
        more = {s for s in order if s not in full and share[s] > 3 * totals[s]}
        if not more:
            break
        full |= more
    taken, copies, largest = Counter(), Counter(rows(after)), Counter()
    for r, n in copies.items():
        taken[r[3]] += n * size(r)
        assert n <= 3
    for r in rows(before):
        largest[r[3]] = max(largest[r[3]], size(r))
    assert all(abs(taken[s] - share[s]) <= largest[s] for s in order)


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    exact = Tokenizer.from_file(packing.public_vocabulary()[0])
    want = Counter()
    for r, n in Counter(rows(before)).items():
        ids, at = [*exact.encode(r[1] or "", add_special_tokens=False).ids, 1], 0
        for size in packing.piece_lengths(len(ids)):
            want[(r[0], at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()), len(ids))] += n
            at += size
    got = after.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
def test_held_out(spark):
    """Accuracy on documents that training does not see."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    found = language_id.op10_language_id(spark, DATA).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    scored = quality_model.op1_quality_model(spark, DATA).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.8


def test_empty_pipeline(spark, no_docs, tmp_path):
    """An empty table goes through all stages."""
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and "ids_crc32" in out.columns


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
def test_query_columns(spark):
    """What the queries of operators without SQL return, on whole tables, against brute force."""
    from tokenizers import Tokenizer

    from test_edges import chunk_brute, ordered_texts

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    every = {r.doc_id: r.text for r in docs.collect()}
    got = lambda f, *c: Counter(tuple(r) for r in f(spark, DATA).select(*c).collect())

    want = Counter((i, int(n), int(cut), int(spans), sha) for i, n, cut, spans, sha in chunk_brute(ordered_texts(docs)))
    assert got(chunk_dedup.op4_chunk_dedup, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want

    exact, want = Tokenizer.from_file(packing.public_vocabulary()[0]), Counter()
    for i, t in every.items():
        ids, at = [*exact.encode(t or "", add_special_tokens=False).ids, 1], 0
        for size in packing.piece_lengths(len(ids)):
            want[(i, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()), len(ids), 0)] += 1
            at += size
    assert got(packing.op5_packing, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset") == want
    assert set(packing.op5_packing(spark, DATA).select("sequence_id").toPandas()["sequence_id"]) == set(range(sum(want.values())))

    ids = sorted(every)
    fps = [fingerprint(every[i]) for i in ids]
    want = Counter((i, f"{fp:016x}", ids[root]) for i, fp, root in zip(ids, fps, near_roots(fps), strict=True))
    assert got(simhash.op7_simhash, "doc_id", "fingerprint", "component_id") == want
