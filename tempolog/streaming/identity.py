"""Who a display name is at a place of a session: validity intervals of names, joined as of that place.

A name holds from one row that tells of it to the next.  Rooms bound what that means: a name told in this room is
active, one told in an earlier room is expired, and endings of the application forget all names.  So the last row that
told of a name, with the room it was told in, says everything; both are running values along the session.

What could not be named when it was seen waits for its name until the room is left for another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import staged
from .boundaries import SESSION
from .slices import Run, scan, small

#: Names of earlier rooms count some seconds after entering this one; what the sources of a name are called.
GRACE_SECONDS = 60
ACTIVE, EXPIRED, PAYLOAD = "active", "expired", "payload"
CLEARING = ("application-quit", "video-shutdown")
NAME = ["session", "display_name"]


def in_rooms(rows: DataFrame, whole: bool = False) -> DataFrame:
    """``rows`` with ``room``: state (active, closing or cleared), changes, entered, number and era, as they are after the row.

    Entering a room and somebody's joining make it active, leaving it closing, quitting clears it.  ``changes`` counts
    enterings and leavings, ``number`` enterings only, ``era`` what clears; ``entered`` is when this room was entered.
    ``whole`` as in :func:`slices.scan`.
    """
    kind = F.col("event_type")
    enters, leaves, clears, joins = kind == "room-entering", kind == "room-left", kind.isin(*CLEARING), kind == "player-joined"
    state = F.when(enters | joins, "active").when(leaves, "closing").when(clears, "cleared")
    runs = {
        "__state": Run("last", state), "__changes": Run("sum", (enters | leaves).cast("long")), "__number": Run("sum", enters.cast("long")), "__era": Run("sum", clears.cast("long")),
        "__entered": Run("last", F.when(enters | leaves | clears, F.struct(F.when(enters, F.col("at")).alias("at")))),
    }
    found = scan(rows, SESSION, runs, whole=whole)
    room = F.struct(F.coalesce("__state", F.lit("cleared")).alias("state"), F.col("__changes").alias("changes"), F.col("__number").alias("number"), F.col("__era").alias("era"), F.col("__entered.at").alias("entered"))
    return found.withColumn("room", room).drop(*runs)


def _graced(at: Column) -> Column:
    """Whether names of earlier rooms count at a time in the row's room."""
    return F.coalesce(F.timestamp_diff("MICROSECOND", F.col("room.entered"), at) >= GRACE_SECONDS * 1_000_000, F.lit(False))


def _tells() -> Column:
    """Whether the row tells of a name: joining always, being authenticated in an active room, leaving unless all is cleared."""
    kind, state = F.col("event_type"), F.col("room.state")
    return (kind == "player-joined") | (kind == "user-authenticated") & (state == "active") | (kind == "player-left") & (state != "cleared")


def named(rows: DataFrame, whole: bool = False) -> DataFrame:
    """``rows`` (:func:`in_rooms`) with ``user``, ``user_source`` of what has a name, and ``candidate``, an expired user that may not be given yet.

    A user that the row holds itself goes first; else, in an active room, the user that the name last had: at once if that was told in
    this room, 60 seconds after entering it if it was told in an earlier one.
    ``whole``, of names, as in :func:`slices.scan`.
    """
    told = F.when(_tells(), F.struct(F.col("requester_user_id").alias("user"), (F.col("event_type") == "player-left").alias("left"), F.col("room.changes").alias("changes"), F.col("room.era").alias("era")))
    blank = F.coalesce(F.col("display_name"), F.lit("")) == ""
    known = scan(rows.filter(~blank), NAME, {"told": Run("last", told, own=False)}, whole=whole)
    both = known.unionByName(rows.filter(blank), allowMissingColumns=True)
    valid = (F.col("told.era") == F.col("room.era")) & (F.col("told.user") != "")
    here = valid & ~F.col("told.left") & (F.col("told.changes") == F.col("room.changes"))
    gone = valid & ~here
    in_room, own = F.col("room.state") == "active", F.coalesce(F.col("requester_user_id"), F.lit("")) != ""
    may = F.coalesce(in_room & (here | gone & _graced(F.col("at"))), F.lit(False))
    user = F.when(own, F.col("requester_user_id")).when(may, F.col("told.user"))
    source = F.when(own, F.coalesce(F.nullif("requester_user_id_source", F.lit("")), F.lit(PAYLOAD))).when(may, F.when(here, ACTIVE).otherwise(EXPIRED))
    candidate = F.when(~own & in_room & gone & ~_graced(F.col("at")), F.col("told.user"))
    return both.withColumns({"user": user, "user_source": source, "candidate": candidate}).drop("told")


def released(rows: DataFrame, seen: DataFrame, finish: bool = True) -> DataFrame:
    """session, event_key, place, turn (at one place, those who waited longest first), user, user_source: names that become known
    for occurrences that wait for them.

    ``rows`` are those of :func:`in_rooms`; ``seen`` the rows of occurrences (:func:`named`, with event_key).  An occurrence waits for a name from
    its first row in a room that has the name and no user.  It gets the user that the next row of the name in that room tells; or its
    candidate at the end of the first line whose stamp is 60 seconds after entering, or, with ``finish``, at the session's end.
    """
    waiting = seen.filter(F.col("user").isNull() & (F.coalesce(F.col("display_name"), F.lit("")) != "") & (F.col("room.state") == "active"))
    waits = waiting.groupBy("session", "display_name", "event_key", F.col("room.number").alias("number"), F.col("room.era").alias("era")).agg(
        F.min("place").alias("since"), F.min_by(F.struct("candidate", "slice"), "place").alias("first")
    )
    marks = staged(waits.select("session", "display_name", F.col("since").alias("place"), F.col("first.slice").alias("slice"), F.struct("event_key", "number", "era", "since", F.col("first.candidate").alias("candidate")).alias("wait")), "waits")

    tells = rows.filter(_tells() & (F.coalesce(F.col("requester_user_id"), F.lit("")) != ""))
    told = F.struct("place", F.col("requester_user_id").alias("user"), F.when(F.col("event_type") == "player-left", EXPIRED).otherwise(ACTIVE).alias("source"), F.col("room.number").alias("number"), F.col("room.era").alias("era"))
    nothing = F.lit(None).cast(marks.schema["wait"].dataType)
    told_rows = tells.select("session", "display_name", "place", "slice", nothing.alias("wait"), told.alias("told"))
    both = marks.withColumn("told", F.lit(None).cast(told_rows.schema["told"].dataType)).unionByName(told_rows)
    known = scan(both, NAME, {"next": Run("last", F.col("told"), own=False)}, backward=True, whole=small(both, NAME)[0]).filter("wait is not null")
    in_time = (F.col("next.number") == F.col("wait.number")) & (F.col("next.era") == F.col("wait.era"))
    by_name = known.filter(in_time).select("session", F.col("wait.event_key").alias("event_key"), F.col("next.place").alias("place"), F.lit(0).cast("long").alias("turn"), F.col("next.user").alias("user"), F.col("next.source").alias("user_source"))

    # The last row of a line before its signals; a line counts if its stamp is not before the clock.
    line = ["session", "source_file", "line_number"]
    ends = rows.filter("stage < 3").groupBy(*line).agg(F.max_by(F.struct("place", "slice", "room", "clock"), "place").alias("end"), F.max(F.when(F.col("event_type") == "clock", F.col("at"))).alias("at"))
    ends = ends.filter(F.col("at") >= F.col("end.clock")).select("session", "end.place", "end.slice", "end.room", "at").filter((F.col("room.state") == "active") & _graced(F.col("at")))
    hopes = marks.filter("wait.candidate is not null").select("session", "place", "slice", "wait")
    graced = F.struct("place", F.col("room.number").alias("number"), F.col("room.era").alias("era"))
    end_rows = ends.select("session", "place", "slice", F.lit(None).cast(marks.schema["wait"].dataType).alias("wait"), graced.alias("graced"))
    after = scan(hopes.withColumn("graced", F.lit(None).cast(end_rows.schema["graced"].dataType)).unionByName(end_rows), SESSION, {"next": Run("last", F.col("graced"), own=False)}, backward=True).filter("wait is not null")
    by_grace = after.filter(in_time).select("session", F.col("wait.event_key").alias("event_key"), F.col("next.place").alias("place"), F.col("wait.since").alias("turn"), F.col("wait.candidate").alias("user"), F.lit(EXPIRED).alias("user_source"))
    found = by_name.unionByName(by_grace)
    if finish:
        # Who still waits at the end is in the session's last room.
        last = rows.groupBy("session").agg(F.max("place").alias("place"), F.max(F.struct("room.era", "room.number")).alias("last"))
        left = hopes.join(last.select("session", F.col("place").alias("end"), "last"), "session").filter((F.col("wait.number") == F.col("last.number")) & (F.col("wait.era") == F.col("last.era")))
        found = found.unionByName(left.select("session", F.col("wait.event_key").alias("event_key"), F.col("end").alias("place"), F.col("wait.since").alias("turn"), F.col("wait.candidate").alias("user"), F.lit(EXPIRED).alias("user_source")))
    return found
