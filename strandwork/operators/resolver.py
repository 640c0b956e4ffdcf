"""Resolution of mentions to entities: exact by name or alias, then similar names, then new entities.

Similar names are looked for among all pairs of names that the exact pass leaves, see ``operators.similar``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.operators.components import connected_components
from strandwork.operators.similar import links, nearest
from strandwork.session import settled, shuffled


def exact(mentions: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``mentions`` (``mention, resolved``) with ``entity_id`` by resolved name, else its alias, else the mention, and
    ``matched_by``, which of the two it was."""
    known = entities.select(F.lower("name").alias("k"), "entity_id", F.lit(0).alias("p")).unionByName(aliases.select(F.lower("alias").alias("k"), "entity_id", F.lit(1).alias("p")))
    known = known.groupBy("k").agg(F.min_by("entity_id", F.struct("p", "entity_id")).alias("entity_id"))
    by = lambda c, out: known.select(F.col("k").alias(c), F.col("entity_id").alias(out))
    keyed = mentions.withColumn("_r", F.lower("resolved")).withColumn("_m", F.lower("mention"))
    found = keyed.join(shuffled(by("_r", "_a")), "_r", "left").join(shuffled(by("_m", "_b")), "_m", "left")
    by_which = F.when(F.col("_a").isNotNull(), "resolved").when(F.col("_b").isNotNull(), "mention")
    return found.withColumn("entity_id", F.coalesce("_a", "_b")).withColumn("matched_by", by_which).drop("_r", "_m", "_a", "_b")


def resolved(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, threshold: float = 88.0, scorer: str = "weighted") -> DataFrame:
    """``mention, resolved, tier, entity_id, matched_name, matched_by``.

    Tier 1 is exact, tier 2 the best similar name of ``threshold`` or more, tier 3 new. New names that are similar to one
    another become one entity, named by the smallest of them; resolving one after the other would name it by the first.
    """
    first = exact(mentions, entities, aliases)
    hit = first.where("entity_id is not null").join(shuffled(entities.select("entity_id", "name")), "entity_id")
    done = hit.select("mention", "resolved", F.lit(1).alias("tier"), "entity_id", F.col("name").alias("matched_name"), "matched_by")
    rest = first.where("entity_id is null").drop("entity_id", "matched_by")
    names = settled(rest.select("resolved").distinct())
    known = entities.groupBy("name").agg(F.min("entity_id").alias("entity_id"))
    found = nearest(names, known.select("name"), threshold, scorer).select(F.col("name").alias("resolved"), F.col("found").alias("name"))
    best = settled(found.join(shuffled(known), "name"))
    near = rest.join(shuffled(best.select("resolved", "entity_id", "name")), "resolved")
    near = near.select("mention", "resolved", F.lit(2).alias("tier"), "entity_id", F.col("name").alias("matched_name"), F.lit("similar").alias("matched_by"))
    new = settled(names.join(shuffled(best.select("resolved")), "resolved", "left_anti"))
    roots = connected_components(links(new, threshold, scorer))
    named = new.join(shuffled(roots), F.col("resolved") == F.col("node"), "left").select("resolved", F.coalesce("root", "resolved").alias("matched_name"))
    fresh = rest.join(shuffled(named), "resolved").select("mention", "resolved", F.lit(3).alias("tier"), F.lit(None).cast("long").alias("entity_id"), "matched_name", F.lit("new").alias("matched_by"))
    return done.unionByName(near).unionByName(fresh)


def learned(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """``alias, entity_id``: what ``resolved`` teaches, for the next run to find exactly, without aliases that are there.

    Where a resolved name was found, the mention is an alias if it is another name; where a similar one was, both are. A
    mention that was found by itself teaches nothing. An alias that several entities could have goes to the smallest.
    """
    apart = F.lower("mention") != F.lower("resolved")
    names = F.when(F.col("matched_by") == "similar", F.array("resolved", "mention")).when((F.col("matched_by") == "resolved") & apart, F.array("mention"))
    rows = found.where("entity_id is not null").select(F.explode(names).alias("alias"), "entity_id").where("alias is not null")
    fresh = rows.withColumn("_k", F.lower("alias")).join(shuffled(aliases.select(F.lower("alias").alias("_k"))), "_k", "left_anti")
    return fresh.groupBy("alias").agg(F.min("entity_id").alias("entity_id"))


def unresolved(found: DataFrame) -> DataFrame:
    """``mention, suggested_name`` of new entities, for review; the mention is the name where there is none."""
    return found.where("tier = 3").select(F.coalesce("mention", "resolved").alias("mention"), F.col("resolved").alias("suggested_name"))
