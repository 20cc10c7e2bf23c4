"""Hash keys, JSON text and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u001f"


def hash_key(*parts: Column) -> Column:
    """SHA-256 of the parts with a separator between them; a null part is empty but stays a part."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), SEPARATOR), 256)


def sorted_json(**fields: Column) -> Column:
    """JSON text with its keys in order and its nulls written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


#: Which request type outranks which, and which source of a duration.
REQUEST_RANKS = {"queued_self": 6, "recommend": 5, "self": 4, "other": 3, "random": 2, "unknown": 1}
DURATION_RANKS = {"wanna_queue_json": 10, "dudu_queue_json": 10, "dudu_song_json": 20, "vrcx_payload": 20, "wanna_video_duration": 30}


def rank_of(value: Column, ranks: dict[str, int]) -> Column:
    """The rank of a value, 0 for any that has none."""
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(value, F.lit(""))), F.lit(0))


def request_source(name: Column, user: Column, own_id: Column, blank_is_random: bool = True) -> Column:
    """struct(source, confidence) that the requester's fields suggest, conservatively."""
    name, user, own_id = (F.lower(F.trim(F.coalesce(c, F.lit("")))) if k == 0 else F.trim(F.coalesce(c, F.lit(""))) for k, c in enumerate((name, user, own_id)))
    known = own_id != ""

    def pair(source: str, confidence: float) -> Column:
        return F.struct(F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))

    chain = F.when(name == "random", pair("random", 0.8)).when(known & (user == own_id), pair("self", 0.95)).when(known & (user != ""), pair("other", 0.9))
    if blank_is_random:
        chain = chain.when((name == "") & (user == ""), pair("random", 0.7))
    return chain.otherwise(pair("unknown", 0.5))


def number_prefix(value: Column) -> Column:
    """The whole number that a text begins with, as SQLite's cast has it: 0 if none, bounded to a long."""
    digits = F.regexp_extract(value, r"^\s*([+-]?\d+)", 1)
    wide = F.nullif(digits, F.lit("")).try_cast("decimal(38,0)")
    bounded = F.least(F.greatest(wide, F.lit(-(2**63)).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)"))
    return F.when(wide.isNotNull(), bounded.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
