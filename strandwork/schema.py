"""Types, vocabularies and defaults of the graph side."""

from __future__ import annotations

from pyspark.sql import types as T

# The closed vocabularies, which results are compared on.
REL_TYPES = [
    "partners_with", "acquires", "invests_in", "supplies", "integrates_with", "competes_with", "displaces", "deploys",
    "pilots", "hires_from", "spins_out_from", "built_on", "benchmarks_against", "regulates", "litigates_against",
]
SYMMETRIC = ["partners_with", "competes_with", "benchmarks_against"]
EVIDENCE = ["direct", "inferred", "web_grounded", "speculative"]
ENTITY_TYPES = ["public_company", "private_company", "government", "organization"]
SENTIMENTS = ["Very Bullish", "Bullish", "Neutral", "Bearish", "Very Bearish"]
STATUSES = ["active", "materialized", "invalidated", "stale"]
HANDLE_SOURCES = ["linkedin_verified", "linkedin_serp_verified", "x_serp_verified", "human", "abstain", "blocked"]
SECTORS = {"Robotics": "ROB", "Crypto": "CRY", "AI Stack": "AIS", "Space & Defense": "SPD", "Power & Energy": "PWE", "Strategic Minerals": "STM"}
CARD_BUCKETS = {
    "partners_with": "partnership", "integrates_with": "partnership", "pilots": "partnership", "deploys": "partnership",
    "acquires": "deal", "invests_in": "deal", "supplies": "deal",
    "competes_with": "competitive", "displaces": "competitive", "benchmarks_against": "competitive",
    "regulates": "regulatory", "litigates_against": "regulatory",
    "hires_from": "talent", "spins_out_from": "talent",
    "built_on": "technical",
}
FINDING_FIELDS = "entry_id timestamp category finding sentiment_takeaways guidance_play price_levels source_url".split()
EXTRACTION = """struct<reasoning: string, significance_score: double, headline: string, sentiment_label: string,
entities: array<struct<mention: string, resolved: string, ticker: string, type: string>>,
relationships: array<struct<entity_a: string, rel_type: string, entity_b: string, evidence_type: string, mechanism: string,
mechanism_strength: double, impact_magnitude: double, source_refs: array<int>>>, research_sources: array<string>>"""
# End of fixed values.

FINDING = T.StructType([T.StructField(n, T.StringType()) for n in FINDING_FIELDS])
