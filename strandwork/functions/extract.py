"""A rule-based extractor: what a finding says about entities, as edges. It stands where a language model would."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwork.schema import REL_TYPES

NAME = r"[A-Z][\w&-]*(?:#\d+)?(?: [A-Z][\w&-]*(?:#\d+)?)*"
#: Words between two names that stand for a relationship: its name with spaces, as people write it.
VERBS = "|".join(sorted((r.replace("_", " ") for r in REL_TYPES), key=len, reverse=True))


def stated_edges(finding: Column) -> Column:
    """``array<struct<entity_a, rel_type, entity_b, evidence_type>>``: a sentence "A verb B" is a direct edge, and one that
    hedges ("may", "could") speculation. Null and texts that say nothing give no edges."""
    pattern = rf"({NAME}) (may |could )?({VERBS}) ({NAME})"
    parts = [F.regexp_extract_all(F.coalesce(finding, F.lit("")), F.lit(pattern), F.lit(k)) for k in range(1, 5)]
    evidence = F.transform(parts[1], lambda hedge: F.when(hedge == "", "direct").otherwise("speculative"))
    rel = F.transform(parts[2], lambda verb: F.replace(verb, F.lit(" "), F.lit("_")))
    rows = F.arrays_zip(parts[0].alias("entity_a"), rel.alias("rel_type"), parts[3].alias("entity_b"), evidence.alias("evidence_type"))
    return F.transform(rows, lambda r: F.struct(r["entity_a"].alias("entity_a"), r["rel_type"].alias("rel_type"), r["entity_b"].alias("entity_b"), r["evidence_type"].alias("evidence_type")))
