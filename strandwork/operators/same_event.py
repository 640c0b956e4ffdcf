"""Events that report an earlier one again, within a window of days, and how they follow it.

Two events are the same if they share entities and most of the words that tell them from others; which words those are is
said by how rare they are. Equal events of a window are one class. Classes meet in an index of (window, entity, word): of the
entities all but the most frequent, one less than must be shared, and of the words on one side all, on the other the rarest,
one more than may be missing. So neither an entity of every event nor a phrase that every headline has brings together
events that differ in the other. Days are looked at afterwards: an event is linked to the last one before it in the classes
that are alike, one row for each event however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.session import broadcast_if_small, settled

# Scales of amounts as headlines write them.
SCALES = {"thousand": 10**3, "k": 10**3, "million": 10**6, "m": 10**6, "mn": 10**6, "billion": 10**9, "b": 10**9, "bn": 10**9}
# End of fixed values.
AMOUNT = r"(?i)([$€£])\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s?(thousand|million|billion|mn|bn|k|m|b)?(?![a-z0-9])"


def amount(text: Column) -> Column:
    """The first amount of money in a text, as its currency sign and whole units: ``$400 Million`` is ``$400000000``."""
    number = F.try_to_number(F.replace(F.regexp_extract(text, AMOUNT, 2), F.lit(","), F.lit("")), F.lit("9999999999999.999999")).cast("double")
    scale = F.element_at(F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair]), F.lower(F.regexp_extract(text, AMOUNT, 3)))
    return F.concat(F.regexp_extract(text, AMOUNT, 1), F.round(number * F.coalesce(scale, F.lit(1))).cast("decimal(20,0)").cast("string"))


def event_key(primary: Column, event_type: Column, text: Column) -> Column:
    """Primary entity, type and amount; null where one of them is."""
    return F.concat(primary.cast("string"), F.lit(":"), event_type, F.lit(":"), amount(text))


def by_rarity(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``key`` and its distinct elements of ``column``, from the rarest to the most frequent."""
    each = rows.select(key, F.explode(F.array_distinct(column)).alias("x"))
    n = each.groupBy("x").agg(F.count("*").alias("n"))
    return each.join(n, "x").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda e: e["x"]).alias(column))


def classes_of(events: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """``event_id, day, key, class`` of each event, and ``class, bucket, ids, words`` of each class, from the rarest on. A
    bucket is a window of days; events without entities or words are the same as no other and left out."""
    events = settled(events.select("event_id", "day", "key", "ids", "words"))
    sets = by_rarity(events, "event_id", "ids").join(by_rarity(events, "event_id", "words"), "event_id")
    whole = events.select("event_id", "day", "key", F.floor(F.col("day") / days).alias("bucket")).join(sets, "event_id")
    # Of one number of events the order is by value, so equal sets are equal arrays.
    found = whole.groupBy("bucket", "ids", "words").agg(F.min("event_id").alias("class"))
    members = whole.join(found, ["bucket", "ids", "words"]).select("event_id", "day", "key", "class")
    return settled(members), settled(found)


def alike(classes: DataFrame, least_shared: int, overlap: float, buckets: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """``a, b``: classes of buckets that far apart (the same or neighbouring ones) that share enough entities and words, each way and with itself.

    Most entries of the index meet no other class. Which ones do is told first by a hash of each key and the classes at it
    alone, the first and the last of a key; only these entries are dealt with their entities and words.

    Words of both sides go from the rarest on. As many are shared as the class of the fewest words must share at least, so
    of those shared the rarest is not among the last of a class, one less than that; these are in no key.
    """
    entity = F.explode(F.slice("ids", 1, F.greatest(F.size("ids") - (least_shared - 1), F.lit(0)))).alias("entity")
    rarest = F.size("words") - F.ceil(F.lit(overlap) * F.size("words") - 1e-9).cast("int") + 1
    each = classes.select("class", "words", "bucket", entity)
    key = F.xxhash64("bucket", "entity", "word").alias("key")
    least = classes.agg(F.min(F.ceil(F.lit(overlap) * F.size("words") - 1e-9))).first()[0] or 1
    early = F.slice("words", F.lit(1), F.greatest(F.size("words") - (max(int(least), 1) - 1), F.lit(0)))
    found_by = each.select("class", "bucket", "entity", F.explode(early).alias("word")).select(key, "class")
    looks_for = each.select("class", F.explode(F.array(*[F.col("bucket") + k for k in buckets])).alias("bucket"), "entity", F.explode(F.slice("words", F.lit(1), rarest)).alias("word")).select(key, "class")
    at = found_by.groupBy("key").agg(F.min("class").alias("first"), F.max("class").alias("last"))
    live = settled(looks_for.join(at, "key").where("class <> first or class <> last").select("key", "class"))
    found_by = found_by.join(broadcast_if_small(live.select("key").distinct()), "key", "left_semi")
    whole = classes.select("class", "bucket", "ids", "words")
    left, right = live.join(whole, "class").alias("l"), found_by.join(whole, "class").alias("r")
    # Keys of other entries can have the same hash; what is asked of two classes is asked of them themselves.
    near = (F.col("r.bucket") - F.col("l.bucket")).isin(*buckets)
    both = F.size(F.array_intersect("l.words", "r.words")) >= overlap * F.least(F.size("l.words"), F.size("r.words")) - 1e-9
    enough = F.size(F.array_intersect("l.ids", "r.ids")) >= least_shared
    met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.class") != F.col("r.class"))).where(near & both & enough).select(F.col("l.class").alias("a"), F.col("r.class").alias("b"))
    itself = classes.where(F.size("ids") >= least_shared).select(F.col("class").alias("a"), F.col("class").alias("b"))
    return met.union(met.select("b", "a")).distinct().union(itself)


def reported_again(events: DataFrame, days: int = 45, least_shared: int = 2, overlap: float = 0.7) -> DataFrame:
    """``event_id, earlier, link``: each event that reports one of the ``days`` before it again, with the last such one.

    ``events`` has ``event_id, day`` (a number), ``ids, words`` and ``key``. The link is ``supersedes`` where the keys are
    equal, so that it is the very event, else ``follows_from``. Events of one day go by their ids.
    """
    members, classes = classes_of(events, days)
    near = settled(alike(classes, least_shared, overlap))
    marks = members.select(F.col("class").alias("other"), "day", "event_id", F.lit(1).alias("mark"))
    asks = members.join(near, F.col("class") == F.col("a")).select(F.col("b").alias("other"), "day", "event_id", F.lit(0).alias("mark"))
    before = Window.partitionBy("other").orderBy("day", "event_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("mark") == 1, F.struct("day", "event_id")), ignorenulls=True).over(before)
    seen = marks.unionByName(asks).withColumn("last", last).where((F.col("mark") == 0) & (F.col("day") - F.col("last.day") <= days))
    links = seen.groupBy("event_id").agg(F.max("last").alias("last")).select("event_id", F.col("last.event_id").alias("earlier"))
    keyed = links.join(members.select("event_id", "key"), "event_id").join(members.select(F.col("event_id").alias("earlier"), F.col("key").alias("was")), "earlier")
    return keyed.select("event_id", "earlier", F.when(F.col("key") == F.col("was"), "supersedes").otherwise("follows_from").alias("link"))
