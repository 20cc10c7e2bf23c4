"""The engine's tables, read from stand-ins: orders are evidence, customers tracks, nations systems.

Decisions come from line items (an order's first line decides: R excludes, A accepts, N leaves it),
provenance is one row per line item, and events are the signals of playback sessions.  The SQL texts define
the same tables for comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.projection import with_catalog, with_effective_status

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and SQL that gives the same rows."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "P", "needs_attention").otherwise("pending")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "").otherwise(F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", "")))
    return o.select(
        F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").cast("timestamp").alias("played_at"), F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("track_id"),
        F.col("o_custkey").cast("string").alias("external_id"), F.lit("tpch").alias("record_system"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("video_name"),
        status.alias("default_status"), kind.alias("request_type"), F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, "vrc_log_live").otherwise("import").alias("evidence_source"),
    )


RECORDS = """records AS (
  SELECT o_orderkey AS record_id, o_orderdate AS played_at, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS track_id, o_custkey::VARCHAR AS external_id,
         'tpch' AS record_system, 'order ' || o_orderkey AS video_name,
         CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'P' THEN 'needs_attention' ELSE 'pending' END AS default_status,
         CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) END AS request_type,
         CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'vrc_log_live' ELSE 'import' END AS evidence_source
  FROM orders
)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    first = lines.groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("flag"))
    decided = F.when(F.col("flag") == "R", "excluded").when(F.col("flag") == "A", "accepted")
    return first.select(F.col("l_orderkey").alias("record_id"), decided.alias("decision")).filter("decision is not null")


DECISIONS = """decisions AS (
  SELECT l_orderkey AS record_id, CASE flag WHEN 'R' THEN 'excluded' WHEN 'A' THEN 'accepted' END AS decision FROM (
    SELECT l_orderkey, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem
  ) WHERE k = 1 AND flag IN ('R', 'A')
)"""


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_effective_status(records(spark, sf_dir), decisions(spark, sf_dir))


PROJECTED = f"""{RECORDS}, {DECISIONS}, projected AS (
  SELECT r.*, d.decision AS manual_decision, coalesce(d.decision, r.default_status) AS effective_status
  FROM records r LEFT JOIN decisions d USING (record_id)
)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track_id"), F.col("c_nationkey").alias("system_id"), F.col("c_name").alias("title"), F.lower("c_mktsegment").alias("artist"))


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("system_id"), F.lower("n_name").alias("system_key"), F.col("n_name").alias("system_name"))


CATALOG = """tracks AS (SELECT c_custkey AS track_id, c_nationkey AS system_id, c_name AS title, lower(c_mktsegment) AS artist FROM customer),
systems AS (SELECT n_nationkey AS system_id, lower(n_name) AS system_key, n_name AS system_name FROM nation)"""


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.select(F.col("l_orderkey").alias("record_id"), key.alias("origin_key"), F.when(F.col("l_returnflag") == "N", "watcher_playback_events").otherwise("dance_events").alias("origin_table"), F.col("l_suppkey").alias("requester_user_id"))


ORIGINS = """origins AS (
  SELECT l_orderkey AS record_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS origin_key,
         CASE l_returnflag WHEN 'N' THEN 'watcher_playback_events' ELSE 'dance_events' END AS origin_table, l_suppkey AS requester_user_id FROM lineitem
)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_catalog(projected(spark, sf_dir), tracks(spark, sf_dir), systems(spark, sf_dir))

