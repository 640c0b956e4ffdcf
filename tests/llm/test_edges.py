"""Nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables, for every operator."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandwork.llm import chunk_dedup, exact_dedup, language_id, mixing, packing, quality_model, quality_rules, simhash, substring_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_exact_groups(odd_docs, no_docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in texts(odd_docs):
        groups.setdefault(norm(t), []).append(i)
    got = rows_of(exact_dedup.exact_groups(odd_docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, keep, len(ids), i == keep, sha) for i in ids]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert exact_dedup.exact_groups(no_docs).collect() == []
    kept = exact_dedup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    by_text = {}
    for i, t in texts(odd_docs):
        by_text.setdefault(norm(t), []).append((i is None, i))
    assert sorted(map(repr, texts(kept.drop("x")))) == sorted(repr((min(ids)[1], t)) for n, ids in by_text.items() for t in {t for i, t in texts(odd_docs) if norm(t) == n and i == min(ids)[1]})


def test_dedup_of_repeated_ids(spark, no_docs):
    """A row that repeats an id goes only by its own text; copies without id go; of whole repeats one stays."""
    rows = [(1, "aaa bbb"), (5, "aaa bbb"), (5, "only here"), (None, "aaa  bbb"), (7, "twice"), (7, "twice"), (None, "x"), (None, "x"), (9, "q  r"), (9, "q r")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_dropped", F.lit(1)).withColumn("_x_id", F.lit(2))
    got = texts(exact_dedup.deduplicated(df))
    assert Counter((i, " ".join(t.split())) for i, t in got) == Counter([(1, "aaa bbb"), (5, "only here"), (7, "twice"), (None, "x"), (9, "q r")])
    near = simhash.deduplicated(df)
    assert near.columns == df.columns
    assert Counter((i, " ".join(t.split())) for i, t in texts(near)) == Counter([(1, "aaa bbb"), (5, "only here"), (7, "twice"), (None, "x"), (9, "q r")])
    assert exact_dedup.deduplicated(no_docs).collect() == [] and simhash.deduplicated(no_docs).collect() == []


def test_largest_id(spark):
    """The largest number is an id like any other, and smaller than none."""
    most = 2**63 - 1
    df = spark.createDataFrame([(most, "same"), (most, "same"), (None, "same"), (None, "b"), (None, "b"), (most - 1, "c"), (most, "c")], "doc_id long, text string")
    got = Counter(rows_of(exact_dedup.exact_groups(df), "doc_id", "keep_id", "group_size", "kept"))
    assert got == {(most, most, 3, True): 2, (None, most, 3, False): 1, (None, None, 2, True): 2, (most - 1, most - 1, 2, True): 1, (most, most - 1, 2, False): 1}
    assert Counter(texts(exact_dedup.deduplicated(df))) == {(most, "same"): 1, (None, "b"): 1, (most - 1, "c"): 1}


def test_sessions_stay(spark, odd_docs):
    """No operator changes what the session is set to."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    packing.packed_digests(odd_docs, *packing.public_vocabulary()).count()
    quality_model.with_quality(odd_docs, quality_model.fit([])).count()
    assert spark.conf.get(key) == before


def test_ids_of_unbroken_texts(spark):
    """Very long runs of one kind give the ids of the vocabulary's own library."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.public_vocabulary()[0])
    said = [" " * 1_000_000 + "x", "a" * 5_000_000, "\n" * 5_000_000, "ab " * 100_000 + "\t" * 20_000 + "end", "7" * 16_384, "word" + " " * 16_383 + "word"]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").repartition(3)
    pieces = packing.pieces(df, *packing.public_vocabulary()).orderBy("doc_id", "start").collect()
    for i, text in enumerate(said):
        ids = np.frombuffer(b"".join(r.token_ids for r in pieces if r.doc_id == i), "<u4")
        assert ids.tolist() == [*exact.encode(text, add_special_tokens=False).ids, 1]


def test_runs_merge():
    """Sorted runs become one, with the smallest row and all copies; digests that only begin alike stay apart."""
    r = np.random.default_rng(1)

    def run(n):
        out = np.zeros(n, exact_dedup.ENTRY)
        out["d0"], out["d1"] = r.integers(0, 5, n), r.integers(0, 3, n)
        out["keep_id"], out["keep_raw"], out["group_size"] = r.integers(0, 9, n), r.integers(0, 9, n), 1
        return out

    every = [run(n) for n in (1, 40, 7, 0)]
    got = exact_dedup.merged([exact_dedup.merged([e]) for e in every])
    want = {}
    for e in np.concatenate(every).tolist():
        row, n = want.get(e[:2], ((99, 99), 0))
        want[e[:2]] = (min(row, e[7:9]), n + 1)
    assert {e[:2]: (e[7:9], e[9]) for e in got.tolist()} == want and len(got) == len(want)
    assert (np.diff(got["d0"].astype(np.int64)) >= 0).all()


def test_mixing(odd_docs, no_docs):
    mix = mixing.with_copies(odd_docs, mixing.cycle_weights)
    got = rows_of(mix, "doc_id", "source", "size", "source_size", "target", "copies")
    sizes = Counter()
    for (_, t), s in zip(texts(odd_docs), [r.source for r in odd_docs.select("source").collect()], strict=True):
        sizes[s] += len(WORD.findall(t or ""))
    assert {s: n for _, s, _, n, _, _ in got} == dict(sizes)
    targets = {s: x for _, s, _, _, x, _ in got}
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    assert all(x <= 3 * sizes[s] + 1e-6 for s, x in targets.items())
    assert all(0 <= c <= 3 for *_, c in got)
    assert mixing.with_copies(no_docs, mixing.cycle_weights).collect() == []
    assert sorted(map(repr, got)) == sorted(map(repr, rows_of(mixing.with_copies(odd_docs, mixing.cycle_weights), "doc_id", "source", "size", "source_size", "target", "copies")))
    taken = mixing.mixed(odd_docs, mixing.cycle_weights)
    assert taken.columns == odd_docs.columns and taken.count() == sum(c for *_, c in got)


def test_water_fill(spark):
    rows = [("a", 10, 5.0), ("b", 1000, 2.0), ("c", 1, 1.0), ("d", 0, 5.0), ("e", 500, 2.0)]
    df = spark.createDataFrame(rows, "s string, source_size long, weight double")
    got = {r.s: r.target for r in mixing.water_fill(df, 3.0).collect()}
    total = sum(n for _, n, _ in rows)
    assert sum(got.values()) == pytest.approx(total)
    assert got["a"] == 30 and got["c"] == 3 and got["d"] == 0 and got["b"] == pytest.approx(got["e"])


def test_quality_rules(odd_docs, no_docs):
    got = rows_of(quality_rules.judged(odd_docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior")
    want = []
    for i, t in texts(odd_docs):
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed))
    assert sorted(repr(g[:-1]) for g in got) == sorted(map(repr, want))
    assert all(0 <= g[-1] <= 1 for g in got)
    assert quality_rules.judged(no_docs).collect() == []


def test_one_defect_is_enough(spark):
    """Of a corpus of prose, texts whose only defect is one of word length, symbols or repeated lines go."""
    r = np.random.default_rng(8)
    word = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    prose = [" ".join(word(int(r.integers(2, 9))) for _ in range(120)) for _ in range(300)]
    junk = [" ".join(word(40) for _ in range(60)) for _ in range(3)]
    junk += [" ".join(word(5) + "#$" for _ in range(80)) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(prose + junk)), "doc_id long, text string")
    kept = {x.doc_id: x.kept for x in quality_rules.judged(df).select("doc_id", "kept").collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in range(300, 306))


def test_label_model():
    names = ["a", "b", "c"]
    patterns = [((1, 1, None), 800), ((0, 0, 1), 100), ((0, 1, 1), 20), ((None, None, None), 5)]
    model = quality_rules.fit(patterns, names)
    assert 0.5 < model.prior < 1 and all(0.5 < a < 1 for a in model.accuracy.values())
    assert model.accuracy["a"] > model.accuracy["c"]
    assert quality_rules.fit([], names).prior == 0.8


def test_packing(odd_docs, no_docs):
    from tokenizers import Tokenizer

    files = packing.public_vocabulary()
    exact = Tokenizer.from_file(files[0])
    got = rows_of(packing.packed(odd_docs, *files), "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "token_ids")
    want = Counter()
    for i, t in texts(odd_docs):
        ids, at = [*exact.encode(t or "", add_special_tokens=False).ids, 1], 0
        for n in packing.piece_lengths(len(ids)):
            want[(i, at, n, len(ids), np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at += n
        assert at == len(ids)
    assert Counter((*g[:4], bytes(g[6])) for g in got) == want
    assert sorted(g[4] for g in got) == list(range(len(got))) and all(g[5] == 0 and g[2] & (g[2] - 1) == 0 for g in got)
    lengths = [g[2] for g in sorted(got, key=lambda g: g[4])]
    assert lengths == sorted(lengths)
    digests = rows_of(packing.packed_digests(odd_docs, *files), "doc_id", "start", "ids_crc32")
    assert Counter(digests) == Counter((k[0], k[1], zlib.crc32(k[4])) for k in want.elements())
    assert packing.packed(no_docs, *files).collect() == []


def test_simhash_fingerprints(odd_docs, no_docs):
    got = Counter(rows_of(simhash.near_groups(odd_docs), "doc_id", "fp"))
    want = Counter()
    for i, t in texts(odd_docs):
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        bits = np.zeros(64, int)
        for g in grams:
            h = xxhash.xxh64_intdigest(g, 42)
            bits += [h >> b & 1 for b in range(64)]
        fp = sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))
        want[(i, fp - (1 << 64) if fp >> 63 else fp)] += 1
    assert got == want
    assert simhash.near_groups(no_docs).collect() == []


def test_simhash_components(spark):
    """Chains of flips, a crowd of neighbours in one list, and lone fingerprints, against all pairs."""
    r = np.random.default_rng(1)
    fps = [int(x) for x in r.integers(0, 1 << 64, 60, dtype=np.uint64)]
    chain = [fps[0]]
    for _ in range(40):
        chain.append(chain[-1] ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(64))))
    crowd = [fps[1] ^ int(x) for x in r.integers(0, 1 << 16, 400)]
    every = sorted({*fps, *chain, *crowd})
    arr = np.array(every, np.uint64)
    parent = list(range(len(arr)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(arr)):
        for b in np.flatnonzero(np.bitwise_count(arr ^ arr[a]) <= 2):
            x, y = find(a), find(int(b))
            parent[max(x, y)] = min(x, y)
    want = {frozenset(np.flatnonzero([find(i) == root for i in range(len(arr))]).tolist()) for root in {find(i) for i in range(len(arr))}}
    from strandwork.operators.components import connected_components

    df = spark.createDataFrame([(int(np.int64(np.uint64(x))) if x < 1 << 63 else x - (1 << 64),) for x in every], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(df)).collect()}
    signed = arr.view(np.int64).tolist()
    found = {}
    for i, fp in enumerate(signed):
        found.setdefault(roots.get(fp, fp), set()).add(i)
    assert {frozenset(g) for g in found.values()} == want


def test_language(odd_docs, no_docs):
    model = language_id.trained_on(odd_docs)
    got = rows_of(language_id.identified(odd_docs, model), "doc_id", "text", "lang_pred", "score", "rejected")
    for _, t, lang, score, rejected in got:
        if not t or not any(map(str.isalpha, t)):
            assert (lang, score, rejected) == ("und", 0.0, True)
        else:
            assert lang in model.labels and 0 <= score <= 1
    empty = language_id.trained_on(no_docs)
    assert language_id.identified(no_docs, empty).collect() == []
    assert {r.lang_pred for r in language_id.identified(odd_docs, empty).select("lang_pred").collect()} == {"und"}


def test_language_learns():
    r = np.random.default_rng(0)
    make = lambda syllables: " ".join("".join(r.choice(syllables, 3)) for _ in range(40)).encode()
    sample = [(make(["ka", "to", "mi"]), "x") for _ in range(60)] + [(make(["sch", "ei", "lig"]), "y") for _ in range(60)]
    model = language_id.fit(sample)
    import pyarrow as pa

    p, _ = model.probabilities(pa.array([make(["ka", "to", "mi"]).decode(), make(["sch", "ei", "lig"]).decode(), "", None]))
    assert p[:2].argmax(axis=1).tolist() == [0, 1] and np.isfinite(p).all()


def test_quality_model(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(16)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    net = quality_model.trained_on(odd_docs, labels)
    got = rows_of(quality_model.with_quality(odd_docs, net), "doc_id", "text", "score", "predicted")
    assert all(0 <= s <= 1 and p == (s >= 0.5) for *_, s, p in got)
    assert len({s for _, t, s, _ in got if not t}) == 1
    assert quality_model.with_quality(no_docs, quality_model.trained_on(no_docs, labels)).collect() == []


def test_network_gradients():
    """The analytic gradient of the loss against a numerical one."""
    rng = np.random.default_rng(2)
    net = quality_model.Network.fresh(rng)
    for name, value in vars(net).items():
        setattr(net, name, value.astype(np.float64))
    bodies = [rng.integers(0, 256, n).astype(np.uint8) for n in (5, 40, 90)]
    data, starts = np.concatenate(bodies), np.cumsum([0, 5, 40])
    y, w = np.array([1, 0, 1], np.float32), np.ones(3, np.float32)
    grads = quality_model._gradients(net, data, starts, y, w)

    def loss():
        z = net.combined(net.responses(data, starts)[0])[0].astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    for name in ("filters", "hidden", "out", "bias"):
        value, grad = getattr(net, name), grads[name]
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old = value[at]
        value[at] = old + 1e-6
        up = loss()
        value[at] = old - 1e-6
        down = loss()
        value[at] = old
        assert (up - down) / 2e-6 == pytest.approx(grad[at], rel=1e-3, abs=1e-6)


def test_long_texts_in_blocks():
    """A text longer than a block scores as it does in one piece, also with a passage on the cut."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    net = quality_model.Network.fresh(rng)
    n = quality_model.BLOCK
    body = rng.integers(97, 123, 2 * n + 500).astype(np.uint8)
    wide = quality_model.STEP * quality_model.BLOCKS
    for cut in (n - 8, n, 2 * n - 16, 2 * n - 8):
        trial = rng.integers(0, 128, (400, wide)).astype(np.uint8)
        strength = np.concatenate([net.responses(t, np.zeros(1, np.int64))[0] for t in trial]).max(axis=1)
        body[cut - 8 : cut + 8] = trial[strength.argmax()]
    text = body.tobytes().decode()
    raw = np.frombuffer(text.encode(), np.uint8)
    whole = net.combined(net.responses(raw, np.zeros(1, np.int64))[0])[0]
    assert net.logits(pa.array([None, text, "x"]))[1] == pytest.approx(whole[0], abs=1e-5)


def slow_logit(net, data):
    """The network by its definition, chunk by chunk."""
    pad = max(-(-len(data) // quality_model.STEP), quality_model.BLOCKS) * quality_model.STEP
    code = [*data, *[quality_model.PAD] * (pad - len(data))]
    wide = quality_model.STEP * quality_model.BLOCKS
    best = np.full(quality_model.FILTERS, -np.inf)
    for at in range(0, pad - wide + 1, quality_model.STEP):
        chunk = net.emb[code[at : at + wide]].reshape(quality_model.BLOCKS, -1).astype(float)
        parts = net.filters.reshape(-1, quality_model.BLOCKS, quality_model.FILTERS).astype(float)
        best = np.maximum(best, sum(chunk[j] @ parts[:, j] for j in range(quality_model.BLOCKS)))
    deep = np.tanh(np.maximum(best + net.bias, 0) @ net.hidden + net.hidden_bias)
    return float(deep @ net.out + net.out_bias[0])


def test_scores_by_definition():
    """Scores of the network and of the language model against loops over chunks and n-grams."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    net = quality_model.Network.fresh(rng)
    texts = ["", "a", "sixteen bytes..!", "é" * 33, "The quick brown fox jumps over the lazy dog. " * 9]
    got = net.logits(pa.array(texts))
    assert [slow_logit(net, t.encode()) for t in texts[1:]] == pytest.approx(got[1:].tolist(), abs=1e-4)

    model = language_id.LanguageModel(("x", "y", "z"), rng.normal(0, 1, (1 << language_id.BUCKET_BITS, 3)).astype(np.float32), rng.normal(0, 1, 3), 1.3, 0.0)

    def probabilities(text):
        buckets = []
        for word in re.findall(rb"[a-z\x80-\xff]+", text.encode().lower()):
            code = [32, *word, 32]
            for n in language_id.SIZES:
                for i in range(len(code) - n + 1):
                    if code[i] == code[i + n - 1] == 32:
                        continue
                    h = code[i]
                    for c in code[i + 1 : i + n]:
                        h = (h * 0x01000193 + c) & 0xFFFFFFFF
                    h = ((h * 0x9E3779B1 + n) & 0xFFFFFFFF) * 0x85EBCA6B & 0xFFFFFFFF
                    buckets.append(h >> 32 - language_id.BUCKET_BITS)
        z = (sum(model.weights[b].astype(float) for b in buckets) / max(1, len(buckets)) + model.bias) / model.temperature
        return np.exp(z) / np.exp(z).sum()

    p, _ = model.probabilities(pa.array(texts))
    for row, text in zip(p, texts, strict=True):
        assert row.tolist() == pytest.approx(probabilities(text).tolist(), abs=1e-6)


def test_language_of_long_texts():
    """A text in pieces gives the n-grams of the whole text, also where a cut is within a word or letters never end."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    model = language_id.LanguageModel(("x", "y"), rng.normal(0, 1, (1 << language_id.BUCKET_BITS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.0)
    words = ["ab", "cde", "fghijk", "é", "l" * 40]
    texts = [" ".join(rng.choice(words, 200_000)), "".join(map(chr, rng.integers(0x4E00, 0x9000, 400_000)))]
    p, counts = model.probabilities(pa.array(texts))
    for text, row, n in zip(texts, p, counts, strict=True):
        bucket, _ = language_id.subwords(np.frombuffer(text.encode(), np.uint8), np.zeros(1, np.int64))
        assert len(text.encode()) > language_id.BLOCK
        assert n == len(bucket)
        z = model.weights[bucket].sum(axis=0, dtype=float) / n
        assert row.tolist() == pytest.approx((np.exp(z) / np.exp(z).sum()).tolist(), abs=1e-9)


def ordered_texts(df):
    """As the span operators number rows: by id, nulls last, then by hash of the text."""
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    return [(r.doc_id, r.text.encode()) for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))]


def cut_result(i, data, spans):
    kept, at = b"", 0
    for a, b in spans:
        kept += data[at:a]
        at = b
    kept += data[at:]
    return i, len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()


def plain_ends(data):
    """Ends of chunks byte by byte: a hash that forgets after 32 bytes, a cut where its top bits are zero or the chunk is
    as long as it may be, none in a chunk that is too short."""
    table = [int(x) for x in chunk_dedup.gear()]
    ends, last, h = [], 0, 0
    for i, b in enumerate(data, 1):
        h = ((h << 1) + table[b]) % (1 << 32)
        size = i - last
        if size == chunk_dedup.MAX_CHUNK or (size >= chunk_dedup.MIN_CHUNK and h >> (32 - chunk_dedup.MASK_BITS) == 0):
            ends.append(i)
            last = i
    return ends + [len(data)] * (last < len(data))


def test_chunk_ends():
    rng = np.random.default_rng(2)
    table = chunk_dedup.gear()
    for n in (1, 5, 15, 16, 17, 255, 256, 257, 600, 5000, 40_000):
        for data in (rng.integers(0, 256, n).astype(np.uint8), rng.integers(97, 100, n).astype(np.uint8), np.full(n, 97, np.uint8)):
            assert chunk_dedup.chunk_ends(data, table) == plain_ends(data.tolist())


def chunk_brute(docs):
    seen, out = set(), []
    for i, data in docs:
        spans, start = [], 0
        for end in plain_ends(data):
            if data[start:end] in seen:
                if spans and spans[-1][1] == start:
                    spans[-1][1] = end
                else:
                    spans.append([start, end])
            seen.add(data[start:end])
            start = end
        out.append(cut_result(i, data, [s for s in spans if s[1] - s[0] >= chunk_dedup.MIN_RUN]))
    return out


CUT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_chunk_dedup(odd_docs, no_docs):
    got = rows_of(chunk_dedup.deduplicated(odd_docs), *CUT)
    assert sorted(map(repr, got)) == sorted(map(repr, chunk_brute(ordered_texts(odd_docs))))
    assert chunk_dedup.deduplicated(no_docs).collect() == []


def test_chunks_resist_shifts():
    rng = np.random.default_rng(0)
    body = rng.integers(97, 123, 5000).astype(np.uint8)
    moved = np.concatenate([body[:2500], rng.integers(97, 123, 7).astype(np.uint8), body[2500:]])
    table = chunk_dedup.gear()

    def chunks(x):
        ends = chunk_dedup.chunk_ends(x, table)
        return {x[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)}

    assert len(chunks(body) & chunks(moved)) > 0.9 * len(chunks(body))


def substring_brute(docs, length=substring_dedup.LENGTH):
    first, out = {}, []
    for n, (_, data) in enumerate(docs):
        for p in range(len(data) - length + 1):
            first.setdefault(data[p : p + length], n)
    for n, (i, data) in enumerate(docs):
        covered = np.zeros(len(data) + 1, int)
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < n:
                covered[p] += 1
                covered[p + length] -= 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(covered)[:-1] > 0).astype(int), [0]])))
        out.append(cut_result(i, data, list(zip(edges[::2], edges[1::2], strict=True))))
    return out


@pytest.mark.parametrize("crowded", [0, substring_dedup.CROWDED])
def test_substring_dedup(odd_docs, no_docs, crowded):
    got = rows_of(substring_dedup.deduplicated(odd_docs, crowded=crowded), *CUT)
    want = [(i, int(a), int(b), int(c), d) for i, a, b, c, d in substring_brute(ordered_texts(odd_docs))]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert substring_dedup.deduplicated(no_docs).collect() == []


def test_joined_spans_of_many_keys():
    """Past 2 ** 23 keys in one call, overlapping spans still become one."""
    from strandwork.llm._spans import SPAN, joined_spans

    n = (1 << 23) + 40
    spans = np.zeros(2 * n, SPAN)
    spans["key"] = np.repeat(np.arange(n), 2)
    spans["start"], spans["end"] = np.tile([0, 5], n), np.tile([9, 7], n)
    got = joined_spans(spans)
    assert len(got) == n and (got["start"] == 0).all() and (got["end"] == 9).all()


def test_blocks_of_keys(spark):
    """Blocks computed from keys in a task are those that the texts are dealt by."""
    from strandwork.llm._spans import block_of

    keys = [0, 1, -1, 7, 1 << 40, -(1 << 62), (1 << 63) - 1]
    df = spark.createDataFrame([(k,) for k in keys], "key long").select("key", F.pmod(F.xxhash64("key"), F.lit(37)).alias("block"))
    want = {r.key: r.block for r in df.collect()}
    assert block_of(np.array(keys), 37).tolist() == [want[k] for k in keys]


def test_shards_fold_as_they_come():
    """What is held of a shard is folded, and nothing is lost or told twice."""
    import pyarrow as pa

    from strandwork.llm._spans import PACKED, RECORDS, shard_by_shard

    rows = [(0, b"ab"), (0, b"bc"), (0, b"cd"), (2, b"x"), (2, b"x")]
    batch = pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows]), pa.array([RECORDS] * 5), pa.array([b for _, b in rows])], [c.split()[0] for c in PACKED.split(", ")])
    fold = lambda bodies: (bytes(sorted(set(b"".join(bodies)))), len(b"".join(bodies)))
    got = list(shard_by_shard([batch], fold, lambda bodies: [bytes(sorted(set(b"".join(bodies))))], 3))
    assert got == [4, b"abcd", b"x"]


def test_contexts_are_compared_by_bytes():
    """Contexts whose hashes are equal are told apart by their bytes."""
    r = np.random.default_rng(3)
    stock = [r.integers(0, 3, substring_dedup.LENGTH + 1).astype(np.uint8).tobytes() for _ in range(5)]
    chosen = r.integers(0, 5, 60)
    runs = np.zeros(60, substring_dedup.RUN)
    runs["key"], runs["windows"] = r.integers(0, 9, 60), 2
    runs["context"] = chosen % 2
    order, heads, first = substring_dedup._by_context(runs, np.frombuffer(b"".join(stock[c] for c in chosen), np.uint8))
    found = np.split(order, heads[1:])
    assert sorted(len({chosen[i] for i in g}) for g in found) == [1] * len(set(chosen.tolist())) == [1] * len(found)
    for g, f in zip(found, np.split(first, heads[1:]), strict=True):
        assert f.tolist() == (runs["key"][g] == runs["key"][g].min()).tolist()


def test_suffix_array():
    from strandwork.llm.suffix_array import permuted_lcp, suffix_array

    r = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 30, 120, 900):
        for k in (1, 2, 4, 26):
            for _ in range(10):
                t = r.integers(0, k, n)
                if r.random() < 0.4:
                    t = np.tile(t[: max(1, n // 3)], 4)
                s = bytes(t.tolist())
                want = sorted(range(len(s)), key=lambda i: s[i:])
                sa = suffix_array(t)
                assert sa.tolist() == want
                p = permuted_lcp(t.astype(np.uint8), sa, 50)
                for a, b in zip(want, want[1:]):
                    q = 0
                    while q < 50 and max(a, b) + q < len(s) and s[a + q] == s[b + q]:
                        q += 1
                    assert p[b] == q
    assert suffix_array(np.zeros(0, np.int64)).tolist() == []


def test_suffix_array_induces_once_a_level(monkeypatch):
    """LMS suffixes are at most half of a level, so passes over fewer than twice the text's characters are one a level."""
    from strandwork.llm import suffix_array as module

    r = np.random.default_rng(4)
    phrases = [r.integers(1, 27, r.integers(3, 40)) for _ in range(60)]
    far = np.array(([1] + [9] * 300 + [3]) * 3 + [1] + [9] * 300 + [2, 1])  # substrings that a word does not hold
    texts = [np.concatenate([phrases[i] for i in r.integers(0, 60, 300)]), np.tile([1, 2, 1, 3], 500), far, far * 1_000_003]
    passed, induced = [], module._induced
    monkeypatch.setattr(module, "_induced", lambda text, *rest: passed.append(len(text)) or induced(text, *rest))
    for t in texts:
        passed.clear()
        s = t.tolist()
        assert module.suffix_array(t).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        assert 0 < sum(passed) < 2 * (len(t) + 1)


def test_hashes_in_strips():
    """What is found about windows does not depend on the strips that they are looked at in."""
    length, gram, strip = substring_dedup.LENGTH, substring_dedup.GRAM, substring_dedup.STRIP
    r = np.random.default_rng(5)
    for n in (length, length + 1, strip, strip + length - 1, strip + length, 2 * strip + 7):
        data = r.integers(97, 101, n).astype(np.uint8)
        grams, least, windows = substring_dedup._hashes(data)
        whole = substring_dedup._hashes_of(data, gram, length)
        assert (grams == whole[0]).all() and (windows == whole[1]).all()
        low = np.uint64((1 << substring_dedup.BLOCK_BITS) - 1)
        named = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        assert (least == np.lib.stride_tricks.sliding_window_view(named, length - gram + 1).min(axis=1)).all()
        ends = np.sort(r.integers(0, n, 40))
        starts = np.concatenate([[0], ends])
        start, count, _, _, text, _ = substring_dedup.runs_of(data, starts)
        got = sorted((t, s + i) for s, c, t in zip(start.tolist(), count.tolist(), text.tolist(), strict=True) for i in range(c))
        borders = [*starts.tolist(), n]
        assert got == [(k, p) for k in range(41) for p in range(borders[k], borders[k + 1] - length + 1)]


def test_windows_across_blocks():
    """Runs of a text that is longer than a block cover every window once."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    n = (1 << substring_dedup.BLOCK_BITS) + 5000
    body = rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    seen = np.zeros(n, int)
    for data, starts, _, at in substring_dedup._blocks(pa.array(["short", None, body])):
        start, count, _, _, text, _ = substring_dedup.runs_of(data, starts)
        for s, c, t in zip(start, count, text, strict=True):
            if len(data) > 100:
                seen[at + s - starts[t] : at + s - starts[t] + c] += 1
    assert (seen[: n - substring_dedup.LENGTH + 1] == 1).all() and not seen[n - substring_dedup.LENGTH + 1 :].any()


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/x y\r\n", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "é" * 2_500_000), (7, "http://e", "alone"), (7, "http://e", "alone"), (None, "http://f", "no id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [tuple(r) for r in warc.round_trip(pages, str(tmp_path / "w")).collect()]
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        keep = max(same, default=None)
        revisit = keep is not None and i != keep and sum((h or "") == (html or "") for _, _, h in rows) > 1
        want.append((i, len(body), warc.base32_sha1(body), "revisit" if revisit else "response", keep if revisit else None))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert warc.round_trip(pages.limit(0), str(tmp_path / "e")).collect() == []


def test_warc_normaliser(spark, tmp_path):
    """One member per record, an index that finds each, and payloads as they were."""
    import gzip
    import json

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<html>{i}" * (i * 50)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    folder = str(tmp_path / "w")
    raw = warc.write_monolithic(warc.with_revisits(pages), f"{folder}/raw").cache()
    assert sum(r.records for r in raw.collect()) == 40
    warc.normalise(raw, f"{folder}/raw", f"{folder}/normalised").collect()
    seen = 0
    for index in (tmp_path / "w" / "normalised").glob("*.idx"):
        archive = index.with_suffix("")
        data = archive.read_bytes()
        for line in map(json.loads, index.read_text().splitlines()):
            member = gzip.decompress(data[line["offset"] : line["offset"] + line["length"]])
            assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n") and line["record_id"].encode() in member
            seen += 1
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == gzip.decompress((tmp_path / "w" / "raw" / archive.name).read_bytes()).count(b"WARC/1.1\r\n")
    assert seen == 40
    back = warc.read_records(warc.read_index(spark, f"{folder}/normalised"), f"{folder}/normalised", payloads=True)
    assert {r.page_id: bytes(r.payload).decode() for r in back.collect()} == {i: f"<html>{i}" * (i * 50) for i in range(40)}
