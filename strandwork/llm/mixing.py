"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

The split of the corpus into a mix needs three small tables only: words per source, words per (source, slice of a
seeded hash), and the rows of one slice per source. Each row then meets its source's plan in a join on the source: the
plan is broadcast if a count finds it small, and the documents are not shuffled; with very many sources it is a
sort-merge join whose hot source AQE can split. The number of copies is an expression of the plan and the row's hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.llm._rows import spare
from strandwork.session import broadcast_if_small, settled

WORD = r"[^\x20\x09-\x0D]+"
#: Slices of the hash: so many that one has about ``ROWS_A_SLICE`` rows, within bounds.
SLICE_BITS, MOST_SLICE_BITS, ROWS_A_SLICE = 12, 22, 20_000
HASH_BITS = 60


def n_words(text: Column) -> Column:
    """Number of maximal runs without white space; null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def seeded_hash(seed: int, *keys: Column) -> Column:
    """A uniform 60-bit number of the seed and the keys: the head of an MD5, which any SQL engine can recompute."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def ranked_weights(sources: DataFrame, source: str, cycle: tuple[float, ...]) -> DataFrame:
    """Weights dealt in turn to the sources in code-point order, null last. One row per source comes in and goes out."""
    order = Window.orderBy(F.col(source).asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(cycle)
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), place + 1))


def water_fill(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Adds ``target`` to one row per source (``source_size`` long, ``weight`` double).

    Every source gets its weight's share of the total; a share above ``max_epochs`` times the source's size is clamped
    there and the excess goes to the others by weight. Each round is one aggregate over the sources, and clamps at
    least one more source, so the rounds end. Sources without weight or rows get 0; an empty table stays empty.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = None, -1
    while True:
        full = F.lit(False) if level is None else (cap < F.col("weight") * level[0] / level[1])
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.count(F.when(full, 1)).alias("clamped"),
        ).first()
        if not row.weight or row.clamped == clamped:
            break
        clamped, level = row.clamped, (F.lit(float(row.total - row.held)), F.lit(float(row.weight)))
    share = F.lit(0.0) if level is None else F.col("weight") * level[0] / level[1]
    return sources.withColumn("target", F.coalesce(F.least(cap, share), F.lit(0.0)))


def mix_plan(sized: DataFrame, weights, source: str = "source", max_epochs: float = 3.0) -> DataFrame:
    """One row per source: ``source_size, target, repeats`` and the last (hash, id) that gets one copy more.

    ``sized`` has the source, ``mix_id``, ``mix_hash`` and ``size``. ``weights`` maps the table of sources to the same
    with a ``weight`` column. The words wanted beyond whole repetitions are filled in order of the hash: whole slices
    of the hash by their sums, then documents inside the one slice where the sum is reached, to the nearest document.
    """
    bits = min(MOST_SLICE_BITS, max(SLICE_BITS, (sized.count() // ROWS_A_SLICE).bit_length()))
    part = F.shiftright("mix_hash", HASH_BITS - bits)
    slices = settled(sized.groupBy(source, part.alias("part")).agg(F.sum("size").alias("words")))
    totals = weights(slices.groupBy(source).agg(F.sum("words").alias("source_size")))
    plan = water_fill(settled(totals), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("repeats", whole).withColumn("wanted", F.col("target") - F.col("repeats") * F.col("source_size"))
    plan = settled(plan)

    before = F.sum("words").over(Window.partitionBy(source).orderBy("part")) - F.col("words")
    ends = (
        slices.withColumn("before", before)
        .join(plan.select(F.col(source).alias("_s"), "wanted"), F.col(source).eqNullSafe(F.col("_s")))
        .where((F.col("wanted") > 0) & (F.col("before") <= F.col("wanted")) & (F.col("wanted") < F.col("before") + F.col("words")))
        .select("_s", F.col("part").alias("_part"), (F.col("wanted") - F.col("before")).alias("rest"))
    )
    rows = (
        sized.join(ends, F.col(source).eqNullSafe(F.col("_s")) & (part == F.col("_part")))
        .groupBy("_s", "mix_hash", "mix_id")
        .agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    )
    upto = F.sum("size").over(Window.partitionBy("_s").orderBy("mix_hash", "mix_id"))
    last = (
        rows.withColumn("upto", upto)
        .where(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"))
        .groupBy("_s")
        .agg(F.max(F.struct("mix_hash", "mix_id")).alias("last"))
    )
    cut = ends.select("_s", "_part").join(last.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t")), "left")
    start = F.struct(F.shiftleft("_part", HASH_BITS - bits).alias("mix_hash"), F.lit("").alias("mix_id"))
    cut = cut.select("_s", F.coalesce("last", start).alias("last"))
    return plan.join(cut, F.col(source).eqNullSafe(F.col("_s")), "left").select(F.col(source).alias("_source"), "source_size", "target", "repeats", "last")


ADDED = ("size", "source_size", "target", "copies")


def with_copies(docs: DataFrame, weights, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """All columns of ``docs`` with ``size, source_size, target, copies``: how often the mix takes each row.

    Null text has size 0, and a text of any length is counted whole; a null source is a source of its own; rows of equal
    id and source are taken alike; an empty table gives an empty result. Columns of ``docs`` with the added names, in any
    case, are replaced; all others stay as they are.
    """
    base = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    p = spare(base)
    own = F.struct(n_words(F.col(text)).alias("size"), seeded_hash(seed, F.col(doc_id)).alias("mix_hash"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("mix_id"))
    keyed = base.withColumn(f"{p}own", own)
    sized = settled(keyed.select(F.col(source).alias("_source_of"), f"{p}own.*"))
    plan = mix_plan(sized, weights, "_source_of", max_epochs)
    plan = broadcast_if_small(plan.select(*[F.col(c).alias(f"{p}{c}") for c in plan.columns]))  # a row for each source
    row, last = F.col(f"{p}own"), F.col(f"{p}last")
    first = last.isNotNull() & (F.struct(row["mix_hash"].alias("mix_hash"), row["mix_id"].alias("mix_id")) <= last)
    copies = (F.col(f"{p}repeats") + F.when(first, 1).otherwise(0)).cast("long")
    joined = keyed.join(plan, F.col(source).eqNullSafe(F.col(f"{p}_source")), "left")
    return joined.select(*base.columns, row["size"].alias("size"), F.col(f"{p}source_size").alias("source_size"), F.col(f"{p}target").alias("target"), copies.alias("copies"))


def mixed(docs: DataFrame, weights, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as its source's plan takes it; all columns stay as they are."""
    p = spare(docs)
    kept = docs.withColumns({f"{p}row": F.struct(*docs.columns)}) if any(c.lower() in ADDED for c in docs.columns) else docs
    plan = with_copies(kept, weights, **options)
    taken = plan.withColumn(f"{p}copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*docs.columns) if kept is docs else taken.select(f"{p}row.*")


WEIGHT_CYCLE = (5.0, 2.0, 1.0)


def cycle_weights(sources: DataFrame) -> DataFrame:
    return ranked_weights(sources, "_source_of", WEIGHT_CYCLE)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of each of all ``documents``, see ``with_copies``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mix = with_copies(docs, cycle_weights)
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17/' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         sum(source_size) OVER ()::DOUBLE AS total
  FROM per),
filled AS (
  SELECT *, total - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0) AS free, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT free, open FROM filled WHERE 3.0::DOUBLE * source_size >= weight * free / open ORDER BY source_size / weight, source LIMIT 1),
plan AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * lvl.free / lvl.open) AS target FROM weighed, lvl),
run AS (
  SELECT s.*, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 0 END::BIGINT AS repeats,
         sum(size) OVER (PARTITION BY s.source ORDER BY h, CAST(doc_id AS VARCHAR))::BIGINT AS upto
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       size * (repeats + CASE WHEN 2 * upto - size <= 2 * (target - repeats * source_size) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM run
"""
