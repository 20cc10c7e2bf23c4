"""Whole operations over the engine's tables: import of another application's history, catalog sync, rebuild."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timestamps, urls
from ..functions.keys import REQUEST_RANKS, hash_key, request_source
from . import merges
from .staging import staged

# What keys of imported rows begin with.
IMPORT_KEY, IMPORT_SOURCE = "legacy-playback-cleanup", "import"


@dataclass
class Imported:
    """Result of an import: staged rows, evidence (each with the action taken) and one row of counts."""

    staging: DataFrame
    evidence: DataFrame
    counts: DataFrame


def staged_rows(history: DataFrame, own_id: str, zone: str = "UTC", root: str = "vrcx", blank_is_random: bool = True) -> DataFrame:
    """One staging row per supported row of a foreign history: song, time, requester and its type with a confidence.

    Of rows with the same time and song the better known requester counts, then the greater confidence, then the lower id.
    """
    known = urls.classify_url(F.col("video_url"))
    source = request_source(F.col("display_name"), F.col("user_id"), F.lit(own_id), blank_is_random)
    named = history.withColumns({"__k": known, "__s": source, "played_at": timestamps.parse_instant(F.col("created_at"), zone)}).filter("__k.external_id is not null and played_at is not null")
    event = hash_key(F.col("played_at").cast("string"), F.col("__k.system"), F.col("__k.external_id"))
    rows = named.select(
        hash_key(F.lit(IMPORT_KEY), F.lit(root), event).alias("evidence_key"), "played_at", F.col("__k.system").alias("system_key"), F.col("__k.external_id").alias("external_id"), "video_url", "video_name",
        F.nullif(F.col("user_id"), F.lit("")).alias("requester_user_id"), F.nullif(F.col("display_name"), F.lit("")).alias("requester_display_name"), F.col("__s.source").alias("request_type"), F.col("__s.confidence").alias("confidence"), F.col("id").alias("source_row_id"),
    )
    best = F.struct(merges.rank_of(F.col("request_type"), REQUEST_RANKS), "confidence", -F.col("source_row_id"))
    names = [c for c in rows.columns if c != "evidence_key"]
    return rows.groupBy("evidence_key").agg(F.max_by(F.struct(*names), best).alias("r")).select("evidence_key", "r.*")


def import_history(history: DataFrame, staging: DataFrame | None, evidence: DataFrame | None, own_id: str, zone: str = "UTC", dry_run: bool = False) -> Imported:
    """History to staging to evidence: rows are classified and keyed, staged by precedence, and merged as accepted evidence.

    Importing again changes nothing.  What several results read is staged in the shared folder.  With ``dry_run`` the counts are told and the tables stay as they are.
    """
    new = staged(staged_rows(history, own_id, zone), "new-rows")  # classified and hashed once, whatever reads them
    both = new if staging is None else merges.merge_staged(staging.select(*new.columns), new, "evidence_key", REQUEST_RANKS).select(*new.columns)
    records = both.select("evidence_key", F.lit(IMPORT_SOURCE).alias("evidence_source"), "played_at", "system_key", "external_id", "request_type", F.lit("accepted").alias("default_status"), "requester_user_id", "requester_display_name", "video_url", "video_name")
    old = records.limit(0) if evidence is None else evidence.select(*records.columns)
    merged = staged(merges.merge_evidence(old, records), "merged")
    supported = F.coalesce(urls.classify_url(F.col("video_url"))["external_id"], F.lit("")) != ""
    scanned = history.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(~supported).alias("skipped_unsupported"))
    changed = merged.agg(F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action") == "updated").alias("updated"))
    counts = scanned.crossJoin(changed)  # one row each
    return Imported(staging if dry_run and staging is not None else both, old.withColumn("action", F.lit("kept")) if dry_run else merged, counts)


def sync_catalog(catalog: DataFrame, songs: DataFrame, plain: tuple[str, ...] = ()) -> DataFrame:
    """The catalog with a downloaded list of songs merged in by ``song_key``; blanks never overwrite, songs that are gone stay."""
    return merges.merge_catalog(catalog, songs.select(*catalog.columns), "song_key", plain)


def rebuild(sources: list[DataFrame]) -> DataFrame:
    """Evidence built anew from all sources of records, in their order: later ones win as in a merge, requester ids stay."""
    built = sources[0].limit(0)
    for source in sources:
        built = merges.merge_evidence(built, source.select(*built.columns)).drop("action")
    return built
