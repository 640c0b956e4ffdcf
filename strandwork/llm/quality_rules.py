"""Quality rules as weak supervision: rules vote or abstain, EM estimates how far each is to be trusted.

Everything per document is a column expression. The corpus is reduced to one count per pattern of votes (at most
3 to the number of rules, whatever the corpus holds); expectation-maximisation runs on these counts, and the posterior
of each document is again a column expression, so nothing but the pattern counts leaves the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm._rows import spare
from strandwork.session import settled

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def with_base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` (long); null text counts as empty.

    Repeated three-word windows are found by their 64-bit hashes within the document: hashes with their positions are
    sorted, equal neighbours mark the repeated windows, and the positions, sorted again, give the words they cover.
    Documents whose hashes are all distinct skip that.
    """
    p = spare(docs)
    w, h, s, eq, at, lines = (f"{p}{x}" for x in ("w", "h", "s", "eq", "at", "lines"))
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.size(w)
    thirds = [F.slice(w, k + 1, F.greatest(n - 2, F.lit(0))) for k in range(3)]
    pairs = F.zip_with(thirds[0], thirds[1], lambda a, b: F.xxhash64(a, b))
    step = docs.withColumn(w, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    step = step.withColumn("n_words", n.cast("long")).withColumn(h, F.zip_with(pairs, thirds[2], lambda a, c: F.xxhash64(a, c))).drop(w)
    repeats = F.size(F.array_distinct(h)) < F.size(h)
    step = step.withColumn(s, F.when(repeats, F.sort_array(F.transform(h, lambda a, i: F.struct(a.alias("h"), i.alias("i")))))).drop(h)
    same = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))  # last: no neighbour
    step = step.withColumn(eq, same)
    back = F.slice(F.concat(F.array(F.lit(False)), F.col(eq)), 1, F.size(eq))
    starts = F.zip_with(s, F.zip_with(eq, back, lambda a, b: a | b), lambda a, e: F.when(e, a["i"]))
    step = step.withColumn(at, F.sort_array(F.filter(starts, lambda i: i.isNotNull()))).drop(s, eq)
    gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g)
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(at)
    step = step.withColumn("word_chars", (F.length(t) - F.regexp_count(t, F.lit(SPACE))).cast("long"))
    step = step.withColumn("n_symbols", F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"))
    step = step.withColumn(lines, F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)))
    return step.withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")).withColumn("n_lines", F.size(lines).cast("long")).drop(lines)


@dataclass(frozen=True)
class Rule:
    """Votes 1 (good) or 0 (bad) where its condition holds, abstains (null) elsewhere."""

    name: str
    good: Column = field(repr=False)
    bad: Column = field(repr=False)

    def vote(self) -> Column:
        return F.when(self.bad, 0).when(self.good, 1)


def default_rules() -> list[Rule]:
    """Defects come in families, each with rules that see it from several sides, so that a document with one kind of
    defect is not outvoted: a rule for a defect abstains where it sees none. One rule vouches for ordinary prose, and
    for none that has any of the defects."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    mean, symbols = F.col("word_chars") / words, F.col("n_symbols") / words
    dup, repeat = F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words
    never = F.lit(False)
    return [
        Rule("mean_word", never, ~mean.between(2.0, 14.0)),
        Rule("far_mean_word", never, ~mean.between(1.5, 20.0)),
        Rule("unbroken", never, F.col("word_chars") > 25 * words),
        Rule("prose", mean.between(2.0, 14.0) & (symbols <= 0.02) & (dup <= 0.10) & (repeat <= 0.15), never),
        Rule("symbols_per_word", never, symbols > 0.10),
        Rule("symbol_share", never, F.col("n_symbols") > 0.02 * F.col("word_chars")),
        Rule("symbols_per_line", never, F.col("n_symbols") > 3 * lines),
        Rule("dup_lines", never, dup > 0.30),
        Rule("repeats", never, repeat > 0.40),
        Rule("repeated_lines", never, (dup > 0.20) & (repeat > 0.20)),
    ]


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents and accuracy of each rule, given that it votes."""

    prior: float
    accuracy: dict[str, float]

    def posterior(self, votes: dict[str, Column]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, vote in votes.items():
            weight = math.log(self.accuracy[name] / (1 - self.accuracy[name]))
            odds = odds + F.when(vote == 1, weight).when(vote == 0, -weight).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(patterns: list[tuple[tuple[int | None, ...], int]], names: list[str], rounds: int = 50, start: float = 0.8, weight: float = 0.01, bounds: tuple[float, float] = (0.55, 0.98)) -> LabelModel:
    """Expectation-maximisation over counts of vote patterns. No votes at all: the starting model.

    ``start`` is the first guess of the share of good documents and of each accuracy, and as a prior it counts like
    votes of that accuracy from ``weight`` of all documents.
    """
    prior, acc = start, [start] * len(names)
    total = sum(n for _, n in patterns)
    lo, hi = bounds
    for _ in range(rounds if total else 0):
        mass, right, voted = 0.0, [start * weight * total] * len(names), [weight * total] * len(names)
        for votes, n in sorted(patterns, key=lambda p: tuple(-1 if v is None else v for v in p[0])):
            odds = math.log(prior / (1 - prior)) + sum(math.log(a / (1 - a)) * (1 if v else -1) for v, a in zip(votes, acc, strict=True) if v is not None)
            good = 1 / (1 + math.exp(-odds))
            mass += n * good
            for j, v in enumerate(votes):
                if v is not None:
                    right[j] += n * (good if v else 1 - good)
                    voted[j] += n
        prior = min(0.95, max(0.05, mass / total))
        acc = [min(hi, max(lo, r / v)) for r, v in zip(right, voted, strict=True)]
    return LabelModel(prior, dict(zip(names, acc, strict=True)))


def judged(docs: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """Adds the base counts, one ``vote_<rule>`` each, ``posterior`` and ``kept``.

    ``base_failed`` (under 50 words, or over half of the words in repeated three-word windows) drops a document
    outright; all others are kept when the posterior reaches ``threshold``. Null and empty texts fail the base, texts of
    any length are counted whole, rows of equal texts are judged alike and repeated ids stay. An empty table gives an
    empty result. All columns but the text stay; those that clash with added ones are replaced.
    """
    rules = default_rules() if rules is None else rules
    counted = with_base_counts(docs, text).drop(text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = settled(counted.withColumn("base_failed", failed).withColumns({f"vote_{r.name}": r.vote() for r in rules}))
    votes = {r.name: F.col(f"vote_{r.name}") for r in rules}
    counts = counted.groupBy(*votes.values()).count().collect()  # at most 3 ** rules rows
    model = fit([(tuple(row[:-1]), row[-1]) for row in counts], list(votes))
    scored = counted.withColumn("posterior", model.posterior(votes))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the rules for all ``documents``, see ``judged``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


ORACLE_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM x),
z AS (SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS gap FROM y WHERE n > 1),
rep AS (SELECT doc_id, CAST(sum(gap) AS BIGINT) AS n_repeat_words FROM z GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM w),
b AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, greatest(len(ws), 1) AS words, greatest(len(ls), 1) AS lines
  FROM w JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [
    CASE WHEN NOT word_chars / words BETWEEN 2.0 AND 14.0 THEN 0 END, CASE WHEN NOT word_chars / words BETWEEN 1.5 AND 20.0 THEN 0 END,
    CASE WHEN word_chars > 25 * words THEN 0 END,
    CASE WHEN word_chars / words BETWEEN 2.0 AND 14.0 AND n_symbols / words <= 0.02 AND n_dup_lines / lines <= 0.10 AND n_repeat_words / words <= 0.15 THEN 1 END,
    CASE WHEN n_symbols / words > 0.10 THEN 0 END, CASE WHEN n_symbols > 0.02 * word_chars THEN 0 END, CASE WHEN n_symbols > 3 * lines THEN 0 END,
    CASE WHEN n_dup_lines / lines > 0.30 THEN 0 END, CASE WHEN n_repeat_words / words > 0.40 THEN 0 END,
    CASE WHEN n_dup_lines / lines > 0.20 AND n_repeat_words / words > 0.20 THEN 0 END] AS votes FROM b),
p AS (SELECT list({'v': votes, 'n': n} ORDER BY votes) AS ps, CAST(sum(n) AS DOUBLE) AS total FROM (SELECT votes, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY votes)),
em AS (
  SELECT 0 AS step, 0.8::DOUBLE AS prior, list_transform(range(10), lambda j: 0.8::DOUBLE) AS acc
  UNION ALL
  SELECT step + 1, least(0.95, greatest(0.05, list_sum(list_transform(range(1, len(ps) + 1), lambda k: ps[k].n * good[k])) / total)),
         list_transform(range(1, 11), lambda j: least(0.98, greatest(0.55,
           (0.8 * 0.01 * total + list_sum(list_transform(range(1, len(ps) + 1), lambda k: CASE ps[k].v[j] WHEN 1 THEN ps[k].n * good[k] WHEN 0 THEN ps[k].n * (1 - good[k]) ELSE 0 END)))
           / (0.01 * total + list_sum(list_transform(range(1, len(ps) + 1), lambda k: CASE WHEN ps[k].v[j] IS NULL THEN 0 ELSE ps[k].n END))))))
  FROM (SELECT step, ps, total, list_transform(ps, lambda q: 1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(range(1, 11), lambda j:
          CASE q.v[j] WHEN 1 THEN ln(acc[j] / (1 - acc[j])) WHEN 0 THEN -ln(acc[j] / (1 - acc[j])) ELSE 0 END)))))) AS good FROM em, p WHERE step < 50)),
m AS (SELECT prior, acc FROM em WHERE step = 50)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND s >= 0.5 AS kept, round(s, 6) AS posterior
FROM (SELECT v.*, 1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(range(1, 11), lambda j:
        CASE votes[j] WHEN 1 THEN ln(acc[j] / (1 - acc[j])) WHEN 0 THEN -ln(acc[j] / (1 - acc[j])) ELSE 0 END))))) AS s FROM v, m)
"""
