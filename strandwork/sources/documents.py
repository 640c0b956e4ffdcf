"""Reading and writing of documents: findings as JSON, payloads, partitions, and all tables for ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.schema import FINDING
from strandwork.sources.graph_tables import GraphTables


def read_findings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Findings of a JSON array, or of JSON lines; bookkeeping fields are not in the schema and so fall away."""
    return spark.read.schema(FINDING).option("multiLine", not lines).json(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON document a line; a reader sees the folder only once the write is committed."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json_array(rows: DataFrame, path: str) -> None:
    """All rows as one pretty array of documents: for what fits in one, as the newest entries of a log do."""
    whole = rows.agg(F.to_json(F.collect_list(F.struct("*")), {"pretty": "true"}).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def write_payload(payload: DataFrame, path: str) -> None:
    """A document of one row as JSON text."""
    payload.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def overwrite_sectors(rows: DataFrame, path: str, by: str = "sector") -> None:
    """Replaces the partitions that ``rows`` has, and leaves the others as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def content_hashes(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """Key and MD5 of the files in a folder, recursively."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("key"), F.md5("content").alias("md5"), "content")


def register_views(spark: SparkSession, folder: str, raw: tuple[str, ...] = ()) -> None:
    """The graph tables, and raw ones by name, as views for ``spark.sql``."""
    tables = GraphTables(spark, folder)
    for name in ("entities", "catalysts", "relationships", "handles"):
        getattr(tables, name).createOrReplaceTempView("entity_handles" if name == "handles" else name)
    for name in raw:
        tables.raw(name).createOrReplaceTempView(name)
