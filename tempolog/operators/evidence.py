"""Evidence out of what was folded: records with their provenance, and the promotion of completed plays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import hash_key
from .merges import merge_evidence, promotable
from .projection import ACCEPTED, LIVE_SOURCE, NEEDS_ATTENTION, PENDING

# Parts of keys, and what an observation is called that has not ended.
WATCHER_TABLE, LIVE_TABLE, ROOT = "watcher_playback_events", "live_playback_events", "project"
WATCHER_KEY, EVIDENCE_KEY, ORIGIN_KEY = "watcher-playback-event", "legacy-playback-cleanup", "playback-origin-v1"
PENDING_REASON = "live_observation_pending"


def _key(kind: str, table: str, event: Column) -> Column:
    return hash_key(F.lit(kind), F.lit(ROOT), F.lit(table), F.lit(0), event)


def evidence_records(occurrences: DataFrame, tracks: DataFrame | None = None, table: str = WATCHER_TABLE) -> DataFrame:
    """Evidence records of folded occurrences, for :func:`merges.merge_evidence`.

    A completed occurrence is accepted, an interrupted one needs attention, any other is pending.  It was played
    when its play began, else when it was first seen, else when it was last seen; without a time, or without a
    song, there is no record.  ``tracks``: track_id, system_key, external_id.
    """
    blank = F.lit("")
    event = hash_key(F.lit(WATCHER_KEY), F.col("session"), F.col("event_key"))
    ended = F.col("completion_status")
    status = F.when(ended == "completed", ACCEPTED).when(ended == "interrupted", NEEDS_ATTENTION).otherwise(PENDING)
    named = occurrences.withColumns({"system_key": F.lower(F.trim(F.coalesce("system_key", blank))), "external_id": F.trim(F.coalesce("external_id", blank)), "played_at": F.coalesce("actual_play_at", "first_seen_at", "last_seen_at")})
    kept = named.filter("system_key <> '' and external_id <> '' and played_at is not null")
    if tracks is not None:
        kept = kept.drop("track_id").join(tracks.select("track_id", "system_key", "external_id"), ["system_key", "external_id"], "left")
    else:
        kept = kept.withColumn("track_id", F.lit(None).cast("long"))
    return kept.select(
        _key(EVIDENCE_KEY, table, event).alias("evidence_key"), F.lit(LIVE_SOURCE).alias("evidence_source"), "played_at", "track_id", "system_key", "external_id", F.col("source_type").alias("request_type"),
        status.alias("default_status"), F.when(status == PENDING, PENDING_REASON).otherwise(F.col("completion_reason")).alias("status_reason"),
        F.coalesce("source_display_name", "display_name").alias("requester_display_name"), "requester_user_id", ended.alias("observation_status"), F.col("completion_reason").alias("observation_reason"),
        F.col("settled_at").alias("observed_end_at"), F.coalesce("video_url", "resolved_url", "routed_url").alias("video_url"), "video_name", _key(ORIGIN_KEY, table, event).alias("origin_key"), event.alias("origin_event_key"),
    )


def origins_of(records: DataFrame, table: str = WATCHER_TABLE) -> DataFrame:
    """Provenance rows of :func:`evidence_records`, for :func:`merges.merge_origins`."""
    return records.select("origin_key", "evidence_key", F.lit("vrchat_log").alias("origin_source"), F.lit(table).alias("origin_table"), "origin_event_key", "requester_user_id")


def promote(evidence: DataFrame, occurrences: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """``evidence`` (columns of :func:`evidence_records`) with the promotable occurrences merged in, and the action taken.

    Promoting again changes nothing, for the key is that of the occurrence.
    """
    return merge_evidence(evidence, evidence_records(promotable(occurrences), tracks, LIVE_TABLE))
