"""Where occurrences begin: mutes, what lines without link belong to, and the number of each signal's occurrence.

All of it is running values along a session (:func:`slices.scan`), by song where that is possible.  That a signal
begins an occurrence hangs on what the last one of its song has seen, so it looks like a state machine; but

* only plays, requests and starts of loading, and late routes and resolves decide;
* after each play of a song, the first request, start of loading or late route or resolve begins the next occurrence,
  and the others up to the next play do not;
* so counting plays parts the signals of a song into stretches, and in each of them one signal is looked for.

What is late is measured from the latest stamp that the occurrence has seen.  Where stamps of a song never turn back that is
the stamp before; where they do, occurrences are numbered again with the stamps that they have really seen until nothing
changes.  Each round settles at least one occurrence more of each song, in order, so this ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import staged
from .slices import Run, scan, small

#: Kinds of signals, and parsers of lines that lift a mute.
OPENING, REOPENING, PLAYING = ("request", "load-start"), ("route", "resolve-attempt", "resolve-complete"), ("actual-play", "playback-progress", "on-video-start")
WITHOUT_LINK, LIFTING = ("video-loaded", "actual-play"), ("user_added_url", "vrcx_video_play")
#: Kinds that end what is playing, and the reason they give.
ENDINGS = {"room-left": "room_left", "application-quit": "application_quit", "video-shutdown": "video_shutdown"}
#: Kinds of rows that are no signals.
OTHER = ("clock", "room-entering", *ENDINGS, "player-joined", "player-left", "user-authenticated")
PREVIEW_SECONDS, RETRY_SECONDS, READY_SECONDS = 90, 30, 3
SESSION, SONG, HERE = ["session"], ["session", "canonical_key"], ["session", "canonical_key", "segment"]


def seconds(a: Column, b: Column) -> Column:
    """Seconds from one wall-clock time to another, to the millisecond."""
    return F.round(F.timestamp_diff("MICROSECOND", a, b) / 1e6, 3)


def later(at: Column, by: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.round(by * 1_000_000).cast("int") if isinstance(by, Column) else F.lit(by * 1_000_000), at)


def in_segments(rows: DataFrame, whole: bool = False) -> DataFrame:
    """``rows`` with ``segment``, the number of endings so far, and ``clock``, the latest stamp of a line so far.

    ``whole`` as in :func:`slices.scan`.
    """
    kind = F.col("event_type")
    return scan(rows, SESSION, {"segment": Run("sum", kind.isin(*ENDINGS).cast("long")), "clock": Run("max", F.when(kind == "clock", F.col("at")))}, whole=whole)


def signals_of(rows: DataFrame) -> DataFrame:
    """The rows that can belong to an occurrence: signals of a song that is not muted, and plays and loads without link.

    A preview mutes its song for 90 seconds, or for good if it has no stamp; a signal that is later, or that only people cause,
    lifts the mute.  Metadata are never muted and are kept here too.
    """
    kind = F.col("event_type")
    songs = rows.filter(F.col("canonical_key").isNotNull() & ~kind.isin(*OTHER))
    (whole,) = small(songs, SONG)
    preview, lifts = kind == "preview", ~kind.isin("metadata", "preview") & F.col("parser_name").isin(*LIFTING)
    until = F.when(preview, later(F.col("at"), PREVIEW_SECONDS))
    marked = scan(songs, SONG, {
        "mark": Run("sum", (preview | lifts).cast("long")),
        "mute": Run("last", F.when(preview | lifts, F.struct(preview.alias("on"), until.alias("until")))),
    }, whole=whole)
    heard = scan(marked, [*SONG, "mark"], {"latest": Run("max", F.when(~kind.isin("metadata", "preview"), F.col("at")))}, whole=whole)
    over = F.coalesce(F.col("latest") > F.col("mute.until"), F.lit(False))
    muted = F.coalesce(F.col("mute.on"), F.lit(False)) & ~over & (kind != "metadata")
    kept = heard.filter(~muted & ~preview).drop("mark", "mute", "latest")
    return kept.unionByName(rows.filter(F.col("canonical_key").isNull() & kind.isin(*WITHOUT_LINK)))


def attributed(signals: DataFrame) -> DataFrame:
    """Signals of a song, those without link taking the song of the last one with a link since the last ending.

    What has no link and nothing before it is left out here; see :func:`due_plays`.
    """
    own, linked = F.col("canonical_key").isNotNull(), F.coalesce(F.col("video_url"), F.lit("")) != ""
    # Segments only grow along a session, so what is last in a segment is last in the session.
    last = scan(signals, SESSION, {"active": Run("last", F.when(own & linked & (F.col("event_type") != "metadata"), F.struct("segment", "canonical_key")))})
    active = F.when(F.col("active.segment") == F.col("segment"), F.col("active.canonical_key"))
    return last.withColumns({"has_link": own, "canonical_key": F.coalesce("canonical_key", F.when(~own, active))}).drop("active")


def _plays() -> Column:
    return F.col("event_type").isin(*PLAYING) & F.coalesce("at", "actual_play_at").isNotNull()


def _begins(signals: DataFrame, strict: bool, whole: bool) -> DataFrame:
    """``signals`` with ``begins``: whether one begins an occurrence, ``seen`` being the latest stamp of the occurrence before it.

    In a stretch, the places after a play up to the next one, the first signal that decides is the one with no other since the play.
    """
    kind, place = F.col("event_type"), F.col("place")
    since = seconds(F.col("seen"), F.col("at"))
    recent = F.coalesce((since >= 0) & (since <= RETRY_SECONDS), F.lit(False))
    decides = F.col("has_link") & (kind.isin(*OPENING) | kind.isin(*REOPENING) & ~recent)
    runs = {"__earlier": Run("max", place, own=False), "__played": Run("max", F.when(_plays(), place), own=False), "__decided": Run("max", F.when(F.col("__decides"), place), own=False)}
    before = scan(signals.withColumn("__decides", decides), HERE, runs, whole=whole)
    begins = F.col("__earlier").isNull() | F.col("__decides") & F.coalesce(F.col("__played") > F.coalesce("__decided", F.lit(0)), F.lit(False))
    if strict:
        begins = begins | F.col("has_link") & kind.isin(*OPENING) & ~recent
    return before.withColumn("begins", begins).drop("__decides", *runs)


def occurrences_of(signals: DataFrame, strict_boundary: bool = False) -> DataFrame:
    """``signals`` of songs (:func:`attributed`, without metadata) with ``begins``, ``number`` and ``event_key`` of their occurrence.

    A request or a start of loading begins an occurrence if the song's last one has been played or ended; a route or resolve
    only if it was played and last seen over 30 seconds ago, or later than now; any other signal only if there is none.
    With ``strict_boundary`` a request more than 30 seconds after the last signal begins one even if none was played.
    Numbers count the occurrences of a song in the session from 1.
    """
    songs = signals.filter(F.col("canonical_key").isNotNull())
    by_song, by_here = small(songs, SONG, HERE)

    def counted_of(seen: DataFrame) -> DataFrame:
        return staged(scan(_begins(seen, strict_boundary, by_here), SONG, {"number": Run("sum", F.col("begins").cast("long"))}, whole=by_song), "numbered")

    counted = counted_of(scan(songs, HERE, {"__latest": Run("max", F.col("at"), own=False), "seen": Run("last", F.col("at"), own=False)}, whole=by_here))
    turns_back = not counted.filter(F.col("at").isNull() | (F.col("at") < F.col("__latest"))).isEmpty()
    counted = counted.drop("__latest")
    while turns_back:
        upto = scan(counted, [*SONG, "number"], {"__upto": Run("max", F.col("at"))}, whole=by_here)
        again = scan(upto, HERE, {"__before": Run("last", F.struct(F.col("__upto").alias("at")), own=False)}, whole=by_here).withColumn("__changed", ~F.col("__before.at").eqNullSafe(F.col("seen")))
        counted = counted_of(again.withColumn("seen", F.col("__before.at")).drop("begins", "number", "__upto", "__before"))
        turns_back = not counted.filter("__changed").isEmpty()
        counted = counted.drop("__changed")
    return counted.drop("seen").withColumn("event_key", F.concat("canonical_key", F.lit("#"), F.col("number").cast("string")))
