"""A corpus from raw documents in five stages, each written as Parquet and read again as the next one's documents.

Language identification drops what the model rejects (no text, no letter, or a calibrated score below its limit); exact
dedup keeps the smallest id of equal texts; SimHash keeps the smallest id of each group of near copies; mixing repeats
or leaves out documents until each source has its target weight; packing cuts the mix into power-of-two sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandwork.llm import exact_dedup, language_id, mixing, packing, simhash
from strandwork.session import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns languages from the labelled documents and drops those that the model rejects: no text, no letter, or a score
    below the calibrated limit. Each is judged by its whole text; repeated rows and ids stay; an empty table stays empty."""
    model = language_id.trained_on(docs)
    return language_id.identified(docs, model).where("not rejected").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest row of equal texts (by id, null last, then by text), and one of rows that repeat id and text. A row
    that repeats an id has a fate of its own; null text counts as empty; an empty table stays empty."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest row of each group of near copies, as ``drop_exact_copies`` has it. Texts without a word are near
    copies of one another."""
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until each source, null being one, has its target of words. Documents without words
    go with the whole repetitions of their source; equal ids are taken alike; an empty table stays empty."""
    return mixing.mixed(docs, mixing.cycle_weights)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts each document into power-of-two pieces of ids, a sequence each; null text is the end id alone. Copies that the
    mix has made are pieces of their own; an empty table stays empty."""
    return packing.packed_digests(docs, *packing.public_vocabulary())


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # a trained model and a tokenizer decide; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what each writes lies under the shared folder of the session."""
    at = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
