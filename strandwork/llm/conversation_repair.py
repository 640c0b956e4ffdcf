"""Repair of conversations to the turns that a model can learn from, by the cheapest edits.

A conversation is right if its roles' initials read ``(s?(ua)+)?``. Turns may be kept, get another role, be deleted or be
inserted; blank and repeated ones must go. A dynamic programme goes backward over the turns and the state of that grammar
and says what each place still costs at least; a walk goes forward from the start and takes at each place the edit with the
least letter among those that lose nothing, so that of all cheapest edits the ASCII-least come out.

Turns are sorted over all partitions, and a conversation may span any number of them. The programme's step over some turns
is a 4 x 4 matrix of costs, and the walk's a map of states: of the conversation that crosses a border, each partition gives
these to the driver, which chains them, so that every partition knows the costs behind it and the state before it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm._ordered import in_ranges, ordered_digests
from strandwork.llm.prefix_trie import CRC32_SQL, EMPTY_SHA256, turn_key
from strandwork.session import settled

#: States of the grammar: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted turn, or one with another role, leads: to a user turn, or after one to an assistant turn.
NEXT = (USER, USER, ASSISTANT, USER)
#: What it costs to get from each state to an end: of nothing, or of an assistant turn.
END = (0, 4, 2, 0)
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
NEVER = 1 << 40
#: Faults of a turn, by the first that it has; the first two must be deleted.
BLANK, DUPLICATE, CUT, FINE = range(4)
INITIALS = "sua"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
NAMES = {USER: "user", ASSISTANT: "assistant"}


def kept_state(state: int, initial: int) -> int | None:
    """The state after a kept turn whose role begins with that of ``INITIALS``; none if it cannot stand there."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return None if state == USER else USER
    return ASSISTANT if initial == 2 and state == USER else None


def _choices(fault: int, initial: int, state: int) -> list[tuple[str, int, int]]:
    """Edits that take a turn: letter, cost, state after it; by letter."""
    found = [("D", DELETE, state)]
    if fault in (CUT, FINE):
        more = TRUNCATED if fault == CUT else 0
        after = kept_state(state, initial)
        if after is not None:
            found.append(("K", more, after))
        found.append(("R", REROLE + more, NEXT[state]))
    return found


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    user, assistant = min(costs[USER], INSERT + costs[ASSISTANT]), min(costs[ASSISTANT], INSERT + costs[USER])
    return min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant


@lru_cache(maxsize=1 << 16)
def before(fault: int, initial: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go from before a turn, by state, from those behind it."""
    return _with_inserts([min(cost + after[then] for _, cost, then in _choices(fault, initial, s)) for s in range(4)])


@lru_cache(maxsize=1 << 16)
def taken(fault: int, initial: int, after: tuple[int, ...], state: int) -> tuple[str, int, int, int, int | None]:
    """The walk over a turn: letters, what they cost, the state behind it, how many are inserted, and the state that the
    turn itself leads to if it stays."""
    costs, inserted = before(fault, initial, after), 0
    while True:
        left = costs[state]
        options = [(letter, cost, then, cost + after[then]) for letter, cost, then in _choices(fault, initial, state)]
        options.append(("I", INSERT, NEXT[state], INSERT + costs[NEXT[state]]))
        letter, cost, then, _ = min(o for o in options if o[3] == left)
        if letter != "I":
            return "I" * inserted + letter, INSERT * inserted + cost, then, inserted, None if letter == "D" else then
        state, inserted = then, inserted + 1


def _level(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs above their least, of which there are few, and the least."""
    least = min(costs)
    return tuple(min(c - least, NEVER) for c in costs), least


def _back(faults: list[int], initials: list[int], copies: list[int], end: tuple[int, ...]) -> tuple[list[tuple[int, ...]], tuple[int, ...]]:
    """Levelled costs behind each turn, and the whole costs before all. A turn's further copies are deleted."""
    now, total = _level(end)
    found = []
    for fault, initial, n in zip(reversed(faults), reversed(initials), reversed(copies), strict=True):
        found.append(now)
        now, least = _level(before(fault, initial, now))
        total += least + DELETE * (n - 1)
    return found[::-1], tuple(min(c + total, NEVER) for c in now)


class Range:
    """The turns of one partition and where its conversations begin."""

    def __init__(self, batches):
        table = pa.Table.from_batches([b for b in batches if b.num_rows])
        self.table, self.n = table, table.num_rows
        none, conv = table.column("none").to_numpy(), table.column("conv").to_numpy()
        self.heads = np.flatnonzero(np.concatenate([[True], (none[1:] != none[:-1]) | (conv[1:] != conv[:-1])])).tolist()
        self.ends = [*self.heads[1:], self.n]
        self.names = [(int(none[i]), int(conv[i])) for i in self.heads]
        self.p = table.column("_p")[0].as_py()
        self.faults, self.initials, self.copies = (table.column(c).to_pylist() for c in ("fault", "initial", "n"))

    def part(self, k: int) -> tuple[list[int], list[int], list[int]]:
        a, b = self.heads[k], self.ends[k]
        return self.faults[a:b], self.initials[a:b], self.copies[a:b]

    def walked(self, k: int, end: tuple[int, ...], state: int) -> tuple[list[tuple], int]:
        """What ``taken`` says of each turn of a conversation here, and the state behind them."""
        faults, initials, copies = self.part(k)
        behind, found = _back(faults, initials, copies, end)[0], []
        for fault, initial, after in zip(faults, initials, behind, strict=True):
            found.append(taken(fault, initial, after, state))
            state = found[-1][2]
        return found, state


def _ranges(batches):
    held = [b for b in batches if b.num_rows]
    if held:
        yield Range(held)


BORDER = pa.schema([("p", pa.int32()), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("one", pa.bool_()), ("steps", pa.list_(pa.int64())), ("initial", pa.int32())])
BORDER_SQL = "p int, first array<long>, last array<long>, one boolean, steps array<long>, initial int"
WALK_SQL = "p int, states array<long>"
WALK = pa.schema([("p", pa.int32()), ("states", pa.list_(pa.int64()))])


def _borders(rows: DataFrame) -> tuple[dict, dict, dict, dict]:
    """For each partition: costs behind its last conversation, the state before its first one, the initial of the turn
    before it, and whether its last conversation goes on."""

    def matrices(batches):
        for here in _ranges(batches):
            part = here.part(0)
            steps = [c for t in range(4) for c in _back(*part, tuple(0 if s == t else NEVER for s in range(4)))[1]]
            yield pa.RecordBatch.from_pylist([{"p": here.p, "first": list(here.names[0]), "last": list(here.names[-1]), "one": len(here.heads) == 1, "steps": steps, "initial": here.initials[-1]}], BORDER)

    found = sorted(rows.mapInArrow(matrices, BORDER_SQL).collect())
    ends, starts, goes_on = {}, {}, {}
    for r, then in zip(reversed(found), [None, *reversed(found)], strict=False):
        goes_on[r.p] = then is not None and then.first == r.last
        ends[r.p] = starts[then.p] if goes_on[r.p] else END
        end = ends[r.p] if r.one else END
        starts[r.p] = tuple(min(r.steps[4 * t + s] + end[t] for t in range(4)) for s in range(4))

    def walks(batches):
        for here in _ranges(batches):
            yield pa.RecordBatch.from_pylist([{"p": here.p, "states": [here.walked(len(here.heads) - 1, ends[here.p], s)[1] for s in range(4)]}], WALK)

    crossing = {r.p: r.states for r in rows.mapInArrow(walks, WALK_SQL).collect()} if any(goes_on.values()) else {}
    states, initials = {}, {}
    for r, was in zip(found, [None, *found], strict=False):
        inside = was is not None and goes_on[was.p]
        states[r.p] = crossing[was.p][states[was.p] if was.one else START] if inside else START
        initials[r.p] = was.initial if inside else None
    return ends, states, initials, goes_on


def faulty(turns: DataFrame) -> DataFrame:
    """``none, conv, turn, role, key, n, initial, fault``: a row for equal turns of a conversation, with how many there are
    and the first one's fault; sorted over ranges. ``turns`` has ``none, conv`` (a conversation), ``turn, role, text``."""
    body = F.col("text")
    blank = ~body.rlike(r"[^\x20\x09-\x0D]")
    ended = body.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    light = turns.select("none", "conv", "turn", "role", turn_key(F.col("role"), body).alias("key"), F.when(blank, BLANK).when(~ended, CUT).otherwise(FINE).alias("fault"))
    one = light.groupBy("none", "conv", "turn", "role", "key").agg(F.count("*").alias("n"), F.first("fault").alias("fault"))
    when = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    first = one.groupBy("none", "conv", "key").agg(F.min(when).alias("first"))
    fault = F.when((F.col("fault") != BLANK) & (when > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    known = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(INITIALS) for x in (c, i)]), F.substring("role", 1, 1))
    told = one.join(first, ["none", "conv", "key"]).select("none", "conv", "turn", "role", "key", F.col("n"), F.coalesce(known, F.lit(len(INITIALS))).alias("initial"), fault.cast("int").alias("fault"))
    return in_ranges(told, "none", "conv", "turn", "role", "key")


SUMMARY = pa.schema([("none", pa.int32()), ("conv", pa.int64()), ("p", pa.int32()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
SUMMARY_SQL = "none int, conv long, p int, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
EDITS_SQL = "none int, conv long, turn long, role string, key binary, at long, p int, letters string, inserted_before string, new_role string, inserted_after string"


def _last_inserts(state: int) -> list[int]:
    """States that inserted turns lead to at the end of a conversation."""
    return {SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT]}.get(state, [])


def _illegal(initials: list[int], copies: list[int], was: int | None) -> int:
    names = [INITIALS[i] if i < len(INITIALS) else "" for i in initials]
    earlier = [None if was is None else INITIALS[was] if was < len(INITIALS) else "", *names]
    return sum(n - 1 for n in copies) + sum(a is not None and (a, b) not in LEGAL for a, b in zip(earlier, names, strict=False))


def _conversations(here: Range, borders: tuple):
    """For each conversation of a range: its place, the walk over its turns, the states of what is inserted at its end, and
    the initial before it."""
    ends, states, initials, goes_on = borders
    for k in range(len(here.heads)):
        last = k == len(here.heads) - 1
        open_end = last and goes_on[here.p]
        walk, state = here.walked(k, ends[here.p] if last else END, states[here.p] if k == 0 else START)
        yield k, walk, [] if open_end else _last_inserts(state), initials[here.p] if k == 0 else None


def summaries(rows: DataFrame, borders: tuple) -> DataFrame:
    """What the turns of each conversation come to in each partition, rows of ``SUMMARY``."""

    def run(batches):
        for here in _ranges(batches):
            out = []
            for k, walk, more, was in _conversations(here, borders):
                faults, initials, copies = here.part(k)
                extra = [n - 1 for n in copies]
                blank = sum(n for f, n in zip(faults, copies, strict=True) if f == BLANK)
                repeated = sum(n if f == DUPLICATE else n - 1 for f, n in zip(faults, copies, strict=True) if f != BLANK)
                audit = "".join(w[0] + "D" * e for w, e in zip(walk, extra, strict=True)) + "I" * len(more)
                cost = sum(w[1] for w in walk) + DELETE * sum(extra) + INSERT * len(more)
                none, conv = here.names[k]
                out.append({"none": none, "conv": conv, "p": here.p, "blank": blank, "duplicate": repeated, "truncated": faults.count(CUT), "illegal": _illegal(initials, copies, was), "cost": cost, "audit": audit})
            yield pa.RecordBatch.from_pylist(out, SUMMARY)

    return rows.mapInArrow(run, SUMMARY_SQL)


def _edits(rows: DataFrame, borders: tuple) -> DataFrame:
    """The edits of each row of ``faulty``: letters, roles of what is inserted around it, and its own role if it stays."""

    def roles(state: int, n: int) -> str:
        said = []
        for _ in range(n):
            state = NEXT[state]
            said.append(NAMES[state])
        return ",".join(said)

    def run(batches):
        for here in _ranges(batches):
            letters, ahead, own, behind = [], [], [], []
            said = here.table.column("role").to_pylist()
            for k, walk, more, _ in _conversations(here, borders):
                state = borders[1][here.p] if k == 0 else START
                for i, (edit, _, then, inserted, stays) in enumerate(walk):
                    at = here.heads[k] + i
                    letters.append(edit + "D" * (here.copies[at] - 1))
                    ahead.append(roles(state, inserted))
                    own.append(None if stays is None else said[at] if edit[-1] == "K" else NAMES[stays])
                    behind.append("")
                    state = then
                behind[-1] = ",".join(NAMES[s] for s in more)
                letters[-1] += "I" * len(more)
            table = here.table.combine_chunks()
            columns = [table.column(c).combine_chunks() for c in ("none", "conv", "turn", "role", "key")]
            more = [pa.array(np.arange(here.n), pa.int64()), pa.array([here.p] * here.n, pa.int32()), *(pa.array(x, pa.string()) for x in (letters, ahead, own, behind))]
            yield pa.RecordBatch.from_arrays([*columns, *more], ["none", "conv", "turn", "role", "key", "at", "p", "letters", "inserted_before", "new_role", "inserted_after"])

    return rows.mapInArrow(run, EDITS_SQL)


def _named(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``none, conv, turn, role, text``; null role or text is one space."""
    c = F.col(conv_id).cast("long")
    return turns.select(c.isNull().cast("int").alias("none"), F.coalesce(c, F.lit(0)).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))


class Repair:
    """The audit and the repair of ``turns``.

    Rows without a conversation are one of their own; turns go by ``turn``, null first, and of equal ones by role and a
    digest of the text; repeated rows are duplicates; texts may be empty or of any length; an empty table gives empty
    results; other columns are not read.
    """

    def __init__(self, turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.turns = _named(turns, conv_id, turn, role, text)
        self.rows = faulty(self.turns)
        self.borders = _borders(self.rows)

    def audits(self) -> DataFrame:
        """``none, conv, blank, duplicate, truncated, illegal, cost, audit`` of each conversation."""
        parts = summaries(self.rows, self.borders).groupBy("none", "conv")
        sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        pieces = F.array_sort(F.collect_list(F.struct("p", "audit")))
        return parts.agg(*sums, F.array_join(F.transform(pieces, lambda x: x["audit"]), "").alias("audit"))

    def repaired(self) -> DataFrame:
        """``none, conv, p, at, part, role, text``: the turns of the repaired conversations, in the order of the numbers."""
        key = ["none", "conv", "turn", "role", "key"]
        edits = _edits(self.rows, self.borders).where("new_role is not null or inserted_before <> '' or inserted_after <> ''")
        keyed = self.turns.select("none", "conv", "turn", "role", turn_key(F.col("role"), F.col("text")).alias("key"), "text")
        texts = keyed.groupBy(*key).agg(F.first("text").alias("text"))
        same = [F.col(f"e.{c}").eqNullSafe(F.col(f"t.{c}")) if c == "turn" else F.col(f"e.{c}") == F.col(f"t.{c}") for c in key]
        both = edits.alias("e").join(texts.alias("t"), same).select("e.*", "t.text")

        def inserted(names: Column) -> Column:
            said = F.when(names == "", F.array().cast("array<string>")).otherwise(F.split(names, ","))
            return F.transform(said, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))

        own = F.when(F.col("new_role").isNotNull(), F.array(F.struct(F.col("new_role").alias("role"), "text"))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
        lines = F.concat(inserted(F.col("inserted_before")), own, inserted(F.col("inserted_after")))
        return both.select("none", "conv", "p", "at", F.posexplode(lines).alias("part", "line")).select("none", "conv", "p", "at", "part", "line.role", "line.text")


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of ``turns``, damaged by a hash of conversation and turn; nulls are one space in it."""
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), again.alias("again")).drop("again")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Audits and digests of the repaired ``conversations`` after damage; rows without a conversation are one of their own."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hurt = damaged(turns)
    repair = Repair(hurt)
    line = F.concat("role", F.lit(":"), "text").cast("binary").alias("line")
    digests = ordered_digests(repair.repaired().select("none", "conv", "p", "at", "part", line), ["none", "conv"], ["p", "at", "part"], "line", b"\n")
    gap = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    c = F.col("conv_id").cast("long")
    name = [c.isNull().cast("int").alias("none"), F.coalesce(c, F.lit(0)).alias("conv")]
    gaps = hurt.groupBy(*name).agg(F.coalesce(gap, F.lit(0)).cast("long").alias("gaps"))
    found = turns.select(*name).distinct()
    for more in (gaps, settled(repair.audits()), digests.withColumn("none", F.col("none").cast("int"))):
        found = found.join(more, ["none", "conv"], "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.when(F.col("none") == 0, F.col("conv")).alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32_SQL.format("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations),
h AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS again FROM d WHERE k <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(concat(strlen(role), ':', role, text))) AS i,
  NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen FROM o),
f AS (SELECT *, CASE WHEN blank THEN 'blank' WHEN seen THEN 'duplicate' WHEN cut THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS initial, concat(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i), left(role, 1)) NOT IN ('su', 'ua', 'au') AND i > 1 AS illegal FROM n),
t AS (SELECT conv_id, i, role, text, initial, NOT (blank OR seen) AS live, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS more FROM f),
b AS (SELECT conv_id, CAST(max(i) + 1 AS BIGINT) AS i, 0 AS c0, 4 AS cs, 2 AS cu, 0 AS ca FROM t GROUP BY conv_id
  UNION ALL SELECT conv_id, i, least(x0, 2 + xu, 4 + xa), least(xs, 2 + xu, 4 + xa), least(xu, 2 + xa), least(xa, 2 + xu) FROM (
    SELECT t.conv_id, t.i, least(3 + c0, CASE WHEN live THEN more + CASE initial WHEN 's' THEN cs WHEN 'u' THEN cu ELSE 1000000 END END, CASE WHEN live THEN 2 + more + cu END) AS x0,
      least(3 + cs, CASE WHEN live AND initial = 'u' THEN more + cu END, CASE WHEN live THEN 2 + more + cu END) AS xs, least(3 + cu, CASE WHEN live AND initial = 'a' THEN more + ca END, CASE WHEN live THEN 2 + more + ca END) AS xu,
      least(3 + ca, CASE WHEN live AND initial = 'u' THEN more + cu END, CASE WHEN live THEN 2 + more + cu END) AS xa
    FROM b JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i - 1) x),
s AS (SELECT b.*, n.c0 AS n0, n.cs AS ns, n.cu AS nu, n.ca AS na, role, text, initial, live, more FROM b LEFT JOIN b n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.i = b.i + 1 LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i),
q AS (SELECT s.*, st, CASE st WHEN '0' THEN c0 WHEN 's' THEN cs WHEN 'u' THEN cu ELSE ca END AS c, 3 + CASE st WHEN '0' THEN n0 WHEN 's' THEN ns WHEN 'u' THEN nu ELSE na END AS del, 2 + CASE st WHEN 'u' THEN ca ELSE cu END AS ins,
  CASE WHEN live AND ((initial = 's' AND st = '0') OR (initial = 'u' AND st <> 'u') OR (initial = 'a' AND st = 'u')) THEN more + CASE initial WHEN 's' THEN ns WHEN 'u' THEN nu ELSE na END END AS keep, CASE st WHEN 'u' THEN 'a' ELSE 'u' END AS other FROM s, (SELECT unnest(['0', 's', 'u', 'a']) AS st)),
e AS (SELECT conv_id, i, st, c, edit, CASE edit WHEN 'D' THEN st WHEN 'K' THEN initial ELSE other END AS then_st, CASE edit WHEN 'I' THEN i ELSE i + 1 END AS then_i,
    CASE edit WHEN 'K' THEN concat(role, ':', text) WHEN 'D' THEN NULL ELSE concat(CASE other WHEN 'u' THEN 'user' ELSE 'assistant' END, ':', CASE edit WHEN 'R' THEN text ELSE '' END) END AS line
  FROM (SELECT *, CASE WHEN del = c THEN 'D' WHEN ins = c THEN 'I' WHEN keep = c THEN 'K' WHEN role IS NOT NULL THEN 'R' END AS edit FROM q) WHERE edit IS NOT NULL),
w AS (SELECT DISTINCT conv_id, CAST(1 AS BIGINT) AS i, '0' AS st, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM t
  UNION ALL SELECT w.conv_id, e.then_i, e.then_st, concat(audit, edit), CASE WHEN line IS NULL THEN lines ELSE list_append(lines, line) END FROM w JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i AND e.st = w.st),
g AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM f GROUP BY conv_id),
r AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM w GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = 1
"""
