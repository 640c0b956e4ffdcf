"""The prefix trie and the repair of conversations against brute force, over odd rows and over many partitions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from strandwork.llm import conversation_repair, prefix_trie

TURNS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda b: hashlib.sha256(b).hexdigest()


def key_of(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def ordered(rows, empty):
    """Turns of each conversation in order, nulls as ``empty``."""
    found = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = (empty if x is None else x for x in (role, text))
        found[c].append(((turn is not None, turn or 0), role, key_of(role, text), text))
    return {c: [(r, t, when[1] if when[0] else None) for when, r, _, t in sorted(v)] for c, v in found.items()}


def odd_turns():
    r = random.Random(11)
    said = ["Hello.", "hello", "", None, "  \t", "What now?", "So be it!\n", "Ünïcode words here.", "no end", "x\x00y."]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = []
    for c in [*range(0, 70), -3, -20, -21, 400, 419]:
        if c in (40, 60):
            continue
        for turn in range(r.randrange(0, 9) if c != 5 else 0):
            rows.append((c, r.choice([turn, turn, turn, turn, None, 0]), r.choice(roles), r.choice(said)))
    rows += [(81, k, ("user", "assistant")[k % 2], f"Line {k}.") for k in range(6)] * 1
    rows += [(c, k, ("user", "assistant")[k % 2], f"Line {k}.") for c in range(100, 115) for k in range(6)]  # copies
    rows += [(200 + k, j, "user", f"step {j}." if j < k else "off.") for k in range(20) for j in range(k + 1)]  # a staircase
    rows += [(300, k, r.choice(roles), r.choice([*said, f"word {k}."])) for k in range(1500)]  # crosses partitions
    rows += [(301, 7, "user", "same.")] * 300
    rows += [(None, 1, "user", "nobody's."), (None, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("turns")
    df = spark.createDataFrame(odd_turns(), TURNS)
    clash = ["a", "b", "pa", "path", "depth", "key", "_p", "nth", "none", "conv", "fault", "n", "at", "part", "Top", "_P"]
    df = df.select("*", *[F.lit(f"clash {c}").alias(c) for c in clash if c != "_P"])
    df.repartition(5).write.parquet(str(place / "conversations.parquet"))
    return str(place)


def trie_brute(rows, rebuild=True):
    turns = {c: [(r, t) for r, t, _ in v] for c, v in ordered([x for x in rows if x[0] is not None], "").items()}
    base_of = lambda c: c - (c % 20 if c >= 0 else -((-c) % 20))
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(base_of(c), [])[:h] + own[h:] if rebuild else own
    members, ends = defaultdict(list), defaultdict(list)
    for c, said in built.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
        ends[tuple(said)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    total = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(node[-1][1])) if node else 0
        below = [total[x] for x in children[node]]
        total[node] = (sum(x[0] for x in below) or 1, sum(x[1] for x in below) + (len(members[node]) - 1) * words)
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -(10**9), len(m), len(children[n]), *total[n], sha(",".join(map(str, sorted(ends[n]))).encode())) for n, m in members.items())


def nodes_of(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-(10**9) if x is None else x for x in r) for r in df.select(*names).collect())


def test_trie(spark, folder):
    rows = odd_turns()
    assert nodes_of(prefix_trie.op11_prefix_trie(spark, folder)) == trie_brute(rows)
    assert nodes_of(prefix_trie.prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet"))) == trie_brute(rows, False)


def test_trie_of_little(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(empty).collect() == []
    rows = [(5, 1, "user", "hi there")]
    assert nodes_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS))) == trie_brute(rows, False)
    # All turns of 21 go: 20 is absent, so it has none, and the root is its end.
    rows = next([(c, 1, "user", "hi")] for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    light = prefix_trie.numbered(spark.createDataFrame(rows, TURNS))
    assert nodes_of(prefix_trie.trie(prefix_trie.on_shared_starts(light), light.select("conv_id").distinct())) == trie_brute(rows)


def hurt_brute(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            out += [(c, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (2 if k == 3 else 1)
    return out


def cheapest(faults, roles):
    """(cost, edits, roles and turns that stay) by all ways from each place, no more than three inserts in a row."""

    @lru_cache(maxsize=None)
    def least(i, state, inserts):
        """(cost, letters, lines as (role, turn or None)): least by cost, then by letters."""
        found = []
        if i == len(faults) and state in ("", "a"):
            found.append((0, "", ()))
        follow = "a" if state == "u" else "u"
        if inserts < 3:
            cost, more, lines = least(i, follow, inserts + 1)
            found.append((cost + 2, "I" + more, ((follow, None), *lines)))
        if i < len(faults):
            cost, more, lines = least(i + 1, state, 0)
            found.append((cost + 3, "D" + more, lines))
            if faults[i] in ("truncated", ""):
                extra = 1 if faults[i] else 0
                cost, more, lines = least(i + 1, follow, 0)
                found.append((cost + 2 + extra, "R" + more, ((follow, i), *lines)))
                first = roles[i][:1]
                if (first == "s" and not state) or (first == "u" and state != "u") or (first == "a" and state == "u"):
                    cost, more, lines = least(i + 1, first, 0)
                    found.append((cost + extra, "K" + more, ((None, i), *lines)))
        return min(found, key=lambda x: x[:2]) if found else (10**9, "", ())

    for i in range(len(faults), -1, -50):  # not too deep at once
        for state in ("", "s", "u", "a"):
            for n in (3, 0):
                least(i, state, n)
    return least(0, "", 0)


def audit_brute(rows):
    every, turns, out = {c for c, *_ in rows}, ordered(hurt_brute(rows), " "), []
    for c in every:
        said = turns.get(c, [])
        faults, seen = [], set()
        for role, text, _ in said:
            w = WORD.findall(text)
            faults.append("blank" if not w else "duplicate" if (role, text) in seen else "truncated" if w[-1][-1] not in ".!?" else "")
            seen.add((role, text))
        cost, letters, lines = cheapest(tuple(faults), tuple(r for r, _, _ in said))
        spoken = [f"{'user' if r == 'u' else 'assistant' if r == 'a' else said[i][0]}:{'' if i is None else said[i][1]}" for r, i in lines]
        when = [w for _, _, w in said if w is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:], strict=False)]
        gaps = max(when) - min(when) + 1 - len(set(when)) if when else 0
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, sha("\n".join(spoken).encode())))
    return sorted(out, key=repr)


def test_repair(spark, folder):
    got = conversation_repair.op13_conversation_repair(spark, folder)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == audit_brute(odd_turns())


def test_repaired_turns_are_right(spark, folder):
    """The turns that come out read as the grammar has it, whatever came in."""
    turns = conversation_repair.damaged(spark.read.parquet(f"{folder}/conversations.parquet"))
    found = defaultdict(list)
    for r in conversation_repair.Repair(turns).repaired().collect():
        found[(r["none"], r["conv"])].append(((r["p"], r["at"], r["part"]), r["role"]))
    assert found and all(re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role in sorted(v))) for v in found.values())


def test_repair_of_nothing(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    assert conversation_repair.op13_conversation_repair(spark, str(tmp_path)).collect() == []
