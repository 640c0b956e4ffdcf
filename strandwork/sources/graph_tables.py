"""The graph model's tables, projected from order data: suppliers and customers are entities, orders events, lines edges."""

from __future__ import annotations

import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwork.schema import REL_TYPES

#: Tables of more lines than the first are dealt to tasks of so many as the second says.
FEW_LINES, TASK_LINES = 1 << 22, 1 << 19
AS_OF = datetime.date(2001, 8, 1)
CUSTOMER_OFFSET = 10_000_000


def nth(values: list[str], place: Column) -> Column:
    """The element of a fixed list at a 0-based place."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), place + 1)


class GraphTables:
    """Lazy tables of one data folder. Nothing is read until a query uses it, and only the columns that it needs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """A table as it is; its footers are read once."""
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._raw[name]

    @cached_property
    def tasks(self) -> int:
        """How many tasks edges are dealt to, from their number; 0 where they are few, or a stream, and Spark deals them."""
        lines = self.raw("lineitem")
        n = 0 if lines.isStreaming else lines.count()
        return -(-n // TASK_LINES) if n > FEW_LINES else 0

    def dealt(self, edges: DataFrame, *by: str) -> DataFrame:
        """``edges``, or what there is about as much of, dealt by key for the step that follows, so that what a task holds
        does not grow with the tables. Spark joins small partitions until they come to so many compressed bytes, and edges
        are few of these and much memory."""
        return edges.repartition(self.tasks, *by) if self.tasks else edges

    @cached_property
    def entities(self) -> DataFrame:
        s, c = self.raw("supplier"), self.raw("customer")
        key = F.col("c_custkey")
        suppliers = s.select(
            F.col("s_suppkey").alias("entity_id"),
            F.col("s_name").alias("name"),
            F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).alias("ticker"),
            F.when(F.col("s_suppkey") % 2 == 0, "public_company").otherwise("private_company").alias("type"),
        )
        customers = c.select(
            (key + CUSTOMER_OFFSET).alias("entity_id"),
            F.col("c_name").alias("name"),
            F.when(key % 3 == 0, F.concat(F.lit("C"), key.cast("string"))).alias("ticker"),
            nth(["public_company", "private_company", "government", "organization"], (key % 4).cast("int")).alias("type"),
        )
        return suppliers.unionByName(customers)

    @cached_property
    def catalysts(self) -> DataFrame:
        joined = self.dealt(self.raw("orders"), "o_custkey").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
        day = F.col("o_orderdate").cast("date")
        number = F.row_number().over(Window.partitionBy("c_mktsegment", day).orderBy("o_orderkey"))
        return joined.select(
            F.col("o_orderkey").alias("catalyst_id"),
            F.col("c_mktsegment").alias("sector"),
            day.alias("ts"),
            F.concat(F.substring("c_mktsegment", 1, 3), F.lit("-"), F.date_format(day, "MMddyy"), F.lit("-"), F.format_string("%03d", number)).alias("entry_id"),
            F.concat("c_name", F.lit(" order "), F.col("o_orderkey").cast("string")).alias("headline"),
            nth(["Very Bullish", "Bullish", "Neutral", "Bearish", "Very Bearish"], F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("sentiment_label"),
            F.concat(F.lit("Direct: "), "c_name", F.lit(" places "), "o_orderpriority", F.lit("\nIndirect: status "), "o_orderstatus").alias("sentiment_takeaways"),
            F.least(F.lit(1.0), F.col("o_totalprice") / 400000).alias("significance_score"),
            F.col("c_name").alias("subject"),
        )

    @cached_property
    def relationships(self) -> DataFrame:
        lines, orders = self.dealt(self.raw("lineitem"), "l_orderkey"), self.raw("orders").select("o_orderkey", "o_custkey")
        joined = lines.join(self.dealt(orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        strength, impact = 1 - F.col("l_discount") * 5, F.col("l_quantity") / 50
        flag, line = F.col("l_returnflag"), F.col("l_linestatus")
        return joined.select(
            F.col("l_orderkey").alias("catalyst_id"),
            F.col("l_suppkey").alias("entity_a_id"),
            nth(REL_TYPES, ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 15).cast("int")).alias("rel_type"),
            (F.col("o_custkey") + CUSTOMER_OFFSET).alias("entity_b_id"),
            strength.alias("mechanism_strength"),
            impact.alias("impact_magnitude"),
            F.sqrt(strength * impact).alias("confidence"),
            nth(["direct", "inferred", "web_grounded", "speculative"], (F.col("l_partkey") % 4).cast("int")).alias("evidence_type"),
            F.when(flag == "R", "invalidated").when((flag == "A") & (line == "F"), "materialized").when(flag == "A", "stale").otherwise("active").alias("status"),
            F.col("l_shipdate").cast("date").alias("ship_date"),
            "l_linenumber",
            "l_partkey",
        )

    @cached_property
    def handles(self) -> DataFrame:
        k = (F.col("c_custkey") % 6).cast("int")
        return (
            self.raw("customer")
            .where(F.col("c_custkey") % 7 != 0)
            .select(
                F.lower("c_name").alias("name_key"),
                F.lit("linkedin").alias("channel"),
                F.when(k < 3, F.concat(F.lit("@c"), F.col("c_custkey").cast("string"))).alias("handle"),
                F.when(k == 0, 1.0).when(k == 1, 0.75).when(k == 2, 0.95).otherwise(0.0).alias("confidence"),
                nth(["human", "linkedin_serp_verified", "linkedin_verified", "abstain", "blocked", "blocked"], k).alias("source"),
                F.date_sub(F.lit(AS_OF), (F.col("c_custkey") % 30).cast("int")).alias("resolved_on"),
            )
        )


#: The same projection in the other engine's SQL; queries are compared on it.
BASE_SQL = """
entities AS (
  SELECT CAST(s_suppkey AS BIGINT) AS entity_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN concat('S', CAST(s_suppkey AS VARCHAR)) END AS ticker,
         CASE WHEN s_suppkey % 2 = 0 THEN 'public_company' ELSE 'private_company' END AS type FROM supplier
  UNION ALL
  SELECT CAST(10000000 + c_custkey AS BIGINT), c_name, CASE WHEN c_custkey % 3 = 0 THEN concat('C', CAST(c_custkey AS VARCHAR)) END,
         CASE c_custkey % 4 WHEN 0 THEN 'public_company' WHEN 1 THEN 'private_company' WHEN 2 THEN 'government' ELSE 'organization' END FROM customer),
catalysts AS (
  SELECT o_orderkey AS catalyst_id, c_mktsegment AS sector, CAST(o_orderdate AS DATE) AS ts,
         concat(substring(c_mktsegment, 1, 3), '-', strftime(o_orderdate, '%m%d%y'), '-',
                lpad(CAST(row_number() OVER (PARTITION BY c_mktsegment, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS VARCHAR), 3, '0')) AS entry_id,
         concat(c_name, ' order ', CAST(o_orderkey AS VARCHAR)) AS headline,
         CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Very Bullish' WHEN '2' THEN 'Bullish' WHEN '3' THEN 'Neutral' WHEN '4' THEN 'Bearish' ELSE 'Very Bearish' END AS sentiment_label,
         concat('Direct: ', c_name, ' places ', o_orderpriority, chr(10), 'Indirect: status ', o_orderstatus) AS sentiment_takeaways,
         least(1.0, o_totalprice / 400000) AS significance_score, c_name AS subject
  FROM orders JOIN customer ON o_custkey = c_custkey),
relationships AS (
  SELECT l_orderkey AS catalyst_id, CAST(l_suppkey AS BIGINT) AS entity_a_id,
         (['partners_with', 'acquires', 'invests_in', 'supplies', 'integrates_with', 'competes_with', 'displaces', 'deploys', 'pilots', 'hires_from',
           'spins_out_from', 'built_on', 'benchmarks_against', 'regulates', 'litigates_against'])[CAST((l_suppkey * 7 + l_linenumber) % 15 AS INT) + 1] AS rel_type,
         CAST(10000000 + o_custkey AS BIGINT) AS entity_b_id, 1 - l_discount * 5 AS mechanism_strength, l_quantity / 50 AS impact_magnitude,
         sqrt((1 - l_discount * 5) * (l_quantity / 50)) AS confidence,
         CASE l_partkey % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'inferred' WHEN 2 THEN 'web_grounded' ELSE 'speculative' END AS evidence_type,
         CASE WHEN l_returnflag = 'R' THEN 'invalidated' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'materialized'
              WHEN l_returnflag = 'A' THEN 'stale' ELSE 'active' END AS status,
         CAST(l_shipdate AS DATE) AS ship_date, l_linenumber, l_partkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
handles AS (
  SELECT lower(c_name) AS name_key, 'linkedin' AS channel, CASE WHEN c_custkey % 6 IN (0, 1, 2) THEN concat('@c', CAST(c_custkey AS VARCHAR)) END AS handle,
         CAST(CASE c_custkey % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.95 ELSE 0.0 END AS DOUBLE) AS confidence,
         CASE c_custkey % 6 WHEN 0 THEN 'human' WHEN 1 THEN 'linkedin_serp_verified' WHEN 2 THEN 'linkedin_verified' WHEN 3 THEN 'abstain' ELSE 'blocked' END AS source,
         CAST(DATE '2001-08-01' - CAST(c_custkey % 30 AS INT) AS DATE) AS resolved_on
  FROM customer WHERE c_custkey % 7 <> 0)
"""
