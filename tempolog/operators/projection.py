"""Effective status: manual decisions laid over evidence, without changing it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCEPTED, NEEDS_ATTENTION, EXCLUDED, PENDING = "accepted", "needs_attention", "excluded", "pending"
DECISIONS = (ACCEPTED, NEEDS_ATTENTION, EXCLUDED)
LIVE_SOURCE = "vrc_log_live"


def active_decisions(log: DataFrame) -> DataFrame:
    """record_id, decision: the last entry of each record's log, unless it clears (null decision)."""
    last = log.groupBy("record_id").agg(F.max_by("decision", F.struct("decided_at", "decision_id")).alias("decision"))
    return last.filter(F.col("decision").isNotNull())


def with_effective_status(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """``records`` with manual_decision and effective_status; decisions are one per record."""
    chosen = decisions.select(F.col("record_id").alias("__record"), F.col("decision").alias("manual_decision"))
    joined = records.join(chosen, F.col("record_id") == F.col("__record"), "left").drop("__record")
    return joined.withColumn("effective_status", F.coalesce("manual_decision", "default_status"))


def accepted(projected: DataFrame) -> DataFrame:
    return projected.filter(F.col("effective_status") == ACCEPTED)


def source_label(request_type: str = "request_type", evidence_source: str = "evidence_source") -> Column:
    return F.coalesce(F.nullif(F.col(request_type), F.lit("")), F.nullif(F.col(evidence_source), F.lit("")), F.lit("unknown"))


def with_catalog(records: DataFrame, tracks: DataFrame, systems: DataFrame) -> DataFrame:
    """Records with their track and its system, where there are any; dimensions join left."""
    return records.join(tracks, "track_id", "left").join(systems, "system_id", "left")


def decide(log: DataFrame, new: DataFrame) -> DataFrame:
    """The decision log with new entries; a status outside of the known three, or a bad id, is an error."""
    fine = (F.col("record_id") > 0) & (F.col("decision").isNull() | F.col("decision").isin(*DECISIONS))
    checked = new.withColumn("decision", F.when(fine, F.col("decision")).otherwise(F.raise_error(F.lit("unknown decision or record"))))
    return log.unionByName(checked)


def review(records: DataFrame, log: DataFrame, new: DataFrame) -> DataFrame:
    """The projected state of the records that ``new`` decides on, after it."""
    after = with_effective_status(records, active_decisions(decide(log, new)))
    return after.join(new.select("record_id").distinct(), "record_id", "left_semi")


def latest_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the order, which must be total."""
    return rows.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__row = 1").drop("__row")
