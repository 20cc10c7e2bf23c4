"""The fold of sessions as a composition of DataFrame operations: signals to occurrences, with requesters, settled.

Boundaries, names and settlement are modules of their own (:mod:`boundaries`, :mod:`identity`, :mod:`settlement`); here their rows are brought
together and each occurrence's fields are aggregated.  No task holds a session of more rows than a slice, or more than KEY_ROWS rows of a song or a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import DURATION_RANKS, rank_of
from ..operators.staging import staged
from . import boundaries, identity, settlement, slices
from .boundaries import SESSION, SONG, later, seconds
from .slices import SLICE_ROWS, Run, scan, sliced, small

ORDER = ["source_file", "line_number", "stage", "ordinal"]
#: A field takes the first value that is not blank; links take the last that a signal has, else the first of metadata.
FIRST = ("source_file", "system_key", "external_id", "url_kind", "world_parser", "video_id", "video_name", "display_name", "requester_marker", "source_hint")
LINKS = ("video_url", "routed_url", "resolved_url")
#: Kinds whose first stamp is a field of its own, and the method that a start of the video replaces.
FIRST_STAMPS = {
    "request": "request_at", "load-start": "load_started_at", "resolve-attempt": "resolve_attempt_at", "resolve-complete": "resolved_at", "video-loaded": "video_loaded_at", "playback-sync": "synced_play_at",
}
REPLACED_METHOD, TOLERANCE = "usharp_delayed_video_ready", 0.001
EVENT = ["session", "event_key"]
#: Occurrences, so that rows which lie together by song need no shuffle.
SONG_EVENT = [*SONG, "event_key"]
STAMPS = (
    "first_seen_at", "last_seen_at", "request_at", "load_started_at", "resolve_attempt_at", "resolved_at", "video_loaded_at", "expected_ready_at", "synced_play_at", "on_video_start_at",
    "actual_play_at", "actual_play_signal_at", "settled_at",
)
_TEXTS = (
    "event_key", "canonical_key", "system_key", "external_id", "url_kind", "world_parser", *LINKS, "video_id", "video_name", "display_name", "requester_marker",
    "requester_user_id", "requester_user_id_source", "source_hint", "source_type", "source_display_name", "actual_play_method", "duration_source", "source_file", "completion_status", "completion_reason",
)
_NUMBERS = (
    "actual_play_offset_seconds", "duration_seconds", "load_seconds", "wait_seconds", "elapsed_at_first_seen_seconds", "delay_to_actual_seconds", "load_to_actual_seconds",
    "request_to_resolve_seconds", "played_seconds", "required_seconds",
)
#: Columns of an occurrence and their types.
COLUMNS = {
    "session": "string", **dict.fromkeys(_TEXTS, "string"), **dict.fromkeys(STAMPS, "timestamp_ntz"), **dict.fromkeys(_NUMBERS, "double"),
    **dict.fromkeys(("first_line_number", "last_line_number", "signal_count"), "bigint"), "observed_mid_play": "boolean", "parser_names": "array<string>", "raw_event_types": "array<string>",
    "duration_conflicts": "array<struct<kept_seconds:double,kept_source:string,other_seconds:double,other_source:string>>",
}
OCCURRENCES = ", ".join(f"{n} {kind}" for n, kind in COLUMNS.items())


def _kept(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _length() -> Column:
    """A row's duration so that the greatest is the best: by rank of its source, then the earliest."""
    rank = rank_of(F.col("duration_source"), DURATION_RANKS)
    return F.when(F.col("duration_seconds").isNotNull(), F.struct(rank.alias("rank"), (-F.col("place")).alias("before"), F.col("duration_seconds").alias("seconds"), F.col("duration_source").alias("source")))


def with_metadata(signals: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows of occurrences: signals, and the metadata that come while their song's occurrence is open; ``known`` is what had been told of the song before.

    Metadata alone make no occurrence; what they tell is remembered for all later occurrences of the song in the session.
    """
    runs = {f"known_{n}": Run("first", _kept(n)) for n in (*FIRST, "video_url", "parser_name")}
    runs |= {"known_who": Run("first", F.when(F.col("user").isNotNull(), F.struct("place", F.lit(0).cast("long").alias("turn"), "user", "user_source"))), "known_length": Run("max", _length())}
    by_song, by_here = small(signals.select(*boundaries.HERE, "slice").unionByName(metadata.select(*boundaries.HERE, "slice")), SONG, boundaries.HERE)
    # What metadata tell is brought together among themselves; other rows look up the last of them only.
    told = scan(metadata, SONG, runs, whole=by_song).select(*metadata.columns, F.struct(*runs).alias("__told"))
    both = signals.unionByName(told, allowMissingColumns=True)
    known = scan(both, SONG, {"__known": Run("last", F.col("__told"), own=False)}, whole=by_song)
    placed = scan(known, boundaries.HERE, {"__open": Run("last", F.col("event_key"))}, whole=by_here)
    kept = placed.withColumn("event_key", F.coalesce("event_key", F.when(F.col("event_type") == "metadata", F.col("__open")))).filter("event_key is not null")
    begins = F.coalesce("begins", F.lit(False))
    return kept.withColumns({n: F.when(begins, F.col(f"__known.{n}")) for n in runs}).withColumn("begins", begins).drop("__open", "__told", "__known")


def with_plays(rows: DataFrame, whole: bool = False) -> DataFrame:
    """Rows of occurrences with ``play``, the time that they make the actual play's, ``heard``, that they make its signal's, and ``method``.

    An actual play counts; a start of the video counts if nothing was played before or the last play was only a delayed one;
    progress counts if nothing was played before.  ``whole``, of occurrences, as in :func:`slices.scan`.
    """
    kind = F.col("event_type")
    actual, starts, progress = kind == "actual-play", kind == "on-video-start", kind == "playback-progress"
    value = F.when(actual | starts, F.col("at")).when(progress, F.coalesce("actual_play_at", "at"))
    own_method = F.when(actual, F.coalesce(_kept("actual_play_method"), F.col("parser_name"))).when(starts, F.col("parser_name")).when(progress, _kept("actual_play_method"))
    runs = {
        "__played": Run("sum", value.isNotNull().cast("long"), own=False), "__heard": Run("sum", ((actual | starts | progress) & F.col("at").isNotNull()).cast("long"), own=False),
        "__before": Run("last", F.when(actual | starts, F.struct(actual.alias("actual"), own_method.alias("method"))), own=False),
    }
    found = scan(rows, SONG_EVENT, runs, whole=whole)
    replaces = F.coalesce(F.col("__before.actual") & (F.col("__before.method") == REPLACED_METHOD), F.lit(False))
    first = F.col("__played") == 0
    sets = actual | starts & (first | replaces)
    return found.withColumns({
        "play": F.when(sets | progress & first, value), "heard": F.when(actual | starts | progress & (F.col("__heard") == 0), F.col("at")),
        "method": F.struct(sets.cast("int").alias("sets"), own_method.alias("name")),
    }).drop(*runs)


def versions(rows: DataFrame, whole: bool = False) -> DataFrame:
    """Updates for :func:`settlement.settled`: what is known of an occurrence after each of its rows."""
    signal = F.col("event_type") != "metadata"
    runs = {
        "actual": Run("max", F.col("play")), "first_seen": Run("min", F.when(signal, F.col("at"))), "last_seen": Run("max", F.when(signal, F.col("at"))),
        "__length": Run("max", F.greatest(_length(), F.col("known_length"))), "__system": Run("sum", F.coalesce(_kept("system_key"), "known_system_key").isNotNull().cast("long")),
        "__song": Run("sum", F.coalesce(_kept("external_id"), "known_external_id").isNotNull().cast("long")),
    }
    plain = rows.select("session", "event_key", "place", "slice", "clock", "event_type", "at", "play", "known_length", "duration_seconds", "duration_source", "system_key", "external_id", "known_system_key", "known_external_id")
    found = scan(plain, EVENT, runs, whole=whole)
    return found.select("session", "event_key", "place", "slice", "clock", "actual", "first_seen", "last_seen", F.col("__length.seconds").alias("length"), ((F.col("__system") > 0) & (F.col("__song") > 0)).alias("has_song"))


def due_plays(rows: DataFrame, orphans: DataFrame) -> DataFrame:
    """``orphans``, plays that nothing active explains, with the event_key of the unplayed occurrence that was due nearest, within 3 seconds.

    Each occurrence is due by its last load before the play, and is played once: of several plays the earliest takes it, and the others look again.
    Candidates meet plays by their session and their time in steps of 3 seconds.
    """
    step = boundaries.READY_SECONDS

    def cell(at: Column) -> Column:
        return F.floor(F.unix_timestamp(at.cast("timestamp")) / step)

    loads = rows.filter((F.col("event_type") == "video-loaded") & F.col("at").isNotNull() & F.col("wait_seconds").isNotNull()).select("session", "event_key", "place", later(F.col("at"), F.col("wait_seconds")).alias("ready"))
    due = staged(loads.withColumn("cell", F.explode(F.array(*[cell(F.col("ready")) + k for k in (-1, 0, 1)]))), "due")
    played = rows.filter(F.col("play").isNotNull()).groupBy(*EVENT).agg(F.min("place").alias("played"))
    open_ = orphans.select("session", F.col("place").alias("orphan"), "at", cell(F.col("at")).alias("cell"))
    near = open_.join(due, ["session", "cell"]).filter("place < orphan").groupBy("session", "orphan", "at", "event_key").agg(F.max_by("ready", "place").alias("ready"))
    near = near.join(played, EVENT, "left").filter("played is null or played > orphan")
    far = F.abs(F.timestamp_diff("MICROSECOND", F.col("ready"), F.col("at")))
    begun = rows.groupBy(*EVENT).agg(F.min(F.when(F.col("event_type") == "video-loaded", F.col("place"))).alias("loaded"))
    pairs = staged(near.withColumn("far", far).filter(F.col("far") <= step * 1_000_000).join(begun, EVENT), "near")
    given = None
    while not pairs.isEmpty():
        best = pairs.groupBy("session", "orphan").agg(F.min_by("event_key", F.struct("far", "loaded")).alias("event_key"))
        won = staged(best.groupBy(*EVENT).agg(F.min("orphan").alias("orphan")), "won")
        given = won if given is None else given.unionByName(won)
        left = pairs.join(won.select("session", "orphan"), ["session", "orphan"], "left_anti").join(won.select(*EVENT, F.col("orphan").alias("taken")), EVENT, "left")
        pairs = staged(left.filter("taken is null or taken > orphan").drop("taken"), "near")
    if given is None:
        return orphans.limit(0).withColumn("event_key", F.lit(None).cast("string"))
    return orphans.join(given.withColumnRenamed("orphan", "place"), ["session", "place"])


def _fields() -> list[Column]:
    """Aggregates of an occurrence's rows."""
    kind, signal, place = F.col("event_type"), F.col("event_type") != "metadata", F.col("place")

    def first(value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), place))

    def last(value: Column, when: Column | None = None) -> Column:
        return F.max_by(value, F.when(value.isNotNull() if when is None else when, place))

    loaded = kind == "video-loaded"
    found = {n: F.coalesce(first(F.col(f"known_{n}")), first(_kept(n))) for n in FIRST}
    found |= {n: F.coalesce(last(F.when(signal, _kept(n))), *([first(F.col("known_video_url"))] if n == "video_url" else []), first(F.when(~signal, _kept(n)))) for n in LINKS}
    found |= {n: first(F.when(kind == k, F.col("at"))) for k, n in FIRST_STAMPS.items()}
    at, line = F.when(signal, F.col("at")), F.when(signal, F.col("line_number"))
    found |= {
        "canonical_key": F.max("canonical_key"), "first_seen_at": F.min(at), "last_seen_at": F.max(at), "signal_count": F.sum(signal.cast("long")), "first_line_number": F.min(line), "last_line_number": F.max(line),
        "load_seconds": last(F.col("load_seconds"), loaded), "wait_seconds": last(F.col("wait_seconds"), loaded), "expected_ready_at": last(F.when(loaded, later(F.col("at"), F.col("wait_seconds")))),
        "on_video_start_at": F.max(F.when(kind == "on-video-start", F.col("at"))), "actual_play_at": F.max("play"), "actual_play_signal_at": F.max("heard"),
        "actual_play_offset_seconds": F.min_by("video_offset_seconds", F.when(kind == "playback-progress", place)),
        "actual_play_method": F.coalesce(last(F.when(F.col("method.sets") == 1, F.col("method.name"))), first(F.col("method.name"))),
        "length": F.max(F.greatest(_length(), F.col("known_length"))), "who": F.min(F.least(F.col("known_who"), F.when(F.col("user").isNotNull(), F.struct("place", F.lit(0).cast("long").alias("turn"), "user", "user_source")))),
        "parser_names": F.array_sort(F.collect_set(F.col("parser_name"))), "known_parser": first(F.col("known_parser_name")), "raw_event_types": F.array_sort(F.collect_set(kind)),
    }
    return [value.alias(name) for name, value in found.items()]


def _conflicts(rows: DataFrame, whole: bool = False) -> DataFrame:
    """event_key, duration_conflicts: durations that a row told and the occurrence held another one, each once, in order."""
    told = rows.filter(F.col("duration_seconds").isNotNull() | F.col("known_length").isNotNull()).select(*EVENT, "place", "slice", "duration_seconds", "duration_source", "known_length")
    before = scan(told, EVENT, {"held": Run("max", F.greatest(_length(), F.col("known_length")), own=False)}, whole=whole)
    held = F.greatest("held", "known_length")
    differs = F.abs(held["seconds"] - F.col("duration_seconds")) > TOLERANCE
    pair = F.struct(held["seconds"].alias("kept_seconds"), held["source"].alias("kept_source"), F.col("duration_seconds").alias("other_seconds"), F.col("duration_source").alias("other_source"))
    once = before.filter(differs).groupBy(*EVENT, pair.alias("pair")).agg(F.min("place").alias("place"))
    return once.groupBy(*EVENT).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "pair"))), lambda x: x["pair"]).alias("duration_conflicts"))


def fold(rows: DataFrame, finish: bool = True, strict_boundary: bool = False, slice_rows: int = SLICE_ROWS, unit: int = 1, at_zero: bool = False) -> DataFrame:
    """Occurrences of all sessions out of their rows (``parse.session_rows``); with ``finish`` sessions end normally, ``unit`` and ``at_zero`` as in :func:`settlement.settled`.

    Rows are cut into slices of the order of all rows, so sessions of any length, and any number of them, are spread alike.
    Nobody's name that is told later settles anything by itself.
    """
    placed = sliced(rows.withColumn("session", F.coalesce("session", F.lit(""))), ["session", *ORDER], slice_rows)
    (by_session,), (by_name,) = small(placed, SESSION, most=min(slice_rows, slices.KEY_ROWS)), small(placed.filter("display_name <> ''"), identity.NAME)
    whole = staged(identity.named(identity.in_rooms(boundaries.in_segments(placed, by_session), by_session), by_name), "named-rows")
    heard = staged(boundaries.signals_of(whole), "heard")
    attributed = staged(boundaries.attributed(heard.filter("event_type <> 'metadata'")), "attributed")
    signals = boundaries.occurrences_of(attributed, strict_boundary)
    metadata = heard.filter("event_type = 'metadata'")
    # No occurrence has more rows than its song has in a segment.
    (by_event,) = small(signals.select(*boundaries.HERE, "slice").unionByName(metadata.select(*boundaries.HERE, "slice")), boundaries.HERE)
    own = staged(with_plays(with_metadata(signals, metadata), by_event), "occurrence-rows")
    orphans = attributed.filter("canonical_key is null and event_type = 'actual-play' and at is not null")
    if not orphans.isEmpty():
        due = due_plays(own, orphans).withColumn("canonical_key", F.regexp_extract("event_key", "^(.*)#[0-9]+$", 1))
        more = own.drop("play", "heard", "method").unionByName(due, allowMissingColumns=True).withColumn("begins", F.coalesce("begins", F.lit(False)))
        (by_event,) = small(more, EVENT)
        own = staged(with_plays(more, by_event), "occurrence-rows")
    ends = settlement.settled(whole, versions(own, by_event), finish, unit, at_zero, whole=by_event)
    told = identity.released(whole, own, finish)
    later_who = told.groupBy(*EVENT).agg(F.min(F.struct("place", "turn", "user", "user_source")).alias("later_who"))
    one = own.groupBy(*EVENT).agg(*_fields()).join(later_who, EVENT, "left").join(_conflicts(own, by_event), EVENT, "left").join(ends, EVENT, "left")
    return _shown(one)


def _shown(one: DataFrame) -> DataFrame:
    """The columns of an occurrence."""
    hint, marker, name = F.lower(F.coalesce("source_hint", F.lit(""))), F.col("requester_marker"), F.col("display_name")
    is_random = (hint == "random") | F.coalesce(F.lower(marker) == "random", F.lit(False))
    by_marker = (hint == "requester_marker") & marker.isNotNull()
    by_name = name.isNotNull() & (F.lower(name) != "random")
    mid_play = F.coalesce(F.col("actual_play_at") < F.col("first_seen_at"), F.lit(False))
    delay, who = seconds(F.col("first_seen_at"), F.col("actual_play_at")), F.least("who", "later_who")
    added = F.when(F.col("known_parser").isNotNull(), F.array("known_parser")).otherwise(F.array().cast("array<string>"))
    meta = F.when(F.col("known_parser").isNotNull(), F.array(F.lit("metadata"))).otherwise(F.array().cast("array<string>"))
    shown = {
        "requester_user_id": who["user"], "requester_user_id_source": who["user_source"], "duration_seconds": F.col("length.seconds"), "duration_source": F.col("length.source"),
        "source_type": F.when(is_random, "random").when(by_marker | by_name, "player").otherwise("unknown"), "source_display_name": F.when(~is_random, F.when(by_marker, marker).when(by_name, name)),
        "observed_mid_play": mid_play, "elapsed_at_first_seen_seconds": F.when(mid_play, F.abs(delay)), "delay_to_actual_seconds": F.when(~mid_play, delay),
        "load_to_actual_seconds": seconds(F.col("video_loaded_at"), F.col("actual_play_at")), "request_to_resolve_seconds": seconds(F.col("first_seen_at"), F.col("resolved_at")),
        "completion_status": F.coalesce("status", F.lit("pending")), "completion_reason": F.col("reason"), "parser_names": F.array_sort(F.array_union("parser_names", added)),
        "raw_event_types": F.array_sort(F.array_union("raw_event_types", meta)), "duration_conflicts": F.coalesce("duration_conflicts", F.array().cast(one.schema["duration_conflicts"].dataType)),
    }
    return one.withColumns(shown).select(*[F.col(n).cast(kind).alias(n) for n, kind in COLUMNS.items()])
