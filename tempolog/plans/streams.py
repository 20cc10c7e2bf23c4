"""Settlement and folding over stand-in sessions, and log lines made from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import evidence, merges
from ..operators.staging import staged
from ..sources import parse
from ..streaming import boundaries, identity, occurrences, settle, settlement, slices
from .tables import events, query


@query("t6_settlement", """WITH e AS (SELECT user_id % 10 AS session, epoch_us(ts) AS at_us, event_id, user_id, value, event_type FROM events),
s AS (SELECT *, value * 60 AS seconds FROM e WHERE event_type = 'purchase'),
f AS (SELECT s.*, (SELECT min(at_us) FROM e x WHERE x.session = s.session AND x.event_type = 'purchase' AND x.user_id <> s.user_id AND (x.at_us, x.event_id) > (s.at_us, s.event_id)) AS other_us,
  (SELECT min(at_us) FROM e x WHERE x.session = s.session AND x.event_type = 'error' AND (x.at_us, x.event_id) > (s.at_us, s.event_id)) AS end_us,
  (SELECT min(at_us) FROM e x WHERE x.session = s.session AND s.seconds > 0 AND x.at_us >= greatest(s.at_us, s.at_us + ceil((s.seconds * 0.8 - 0.001) * 1e6)::BIGINT)) AS done_us FROM s),
g AS (SELECT *, least(other_us, end_us) AS force_us FROM f), h AS (SELECT *, done_us IS NOT NULL AND (force_us IS NULL OR done_us <= force_us) AS complete FROM g)
SELECT event_id, CASE WHEN complete THEN 'completed' WHEN force_us IS NOT NULL THEN 'interrupted' ELSE 'pending' END AS status, CASE WHEN complete THEN done_us ELSE force_us END AS settled_us,
  CASE WHEN complete THEN 'observed_completion_threshold' WHEN force_us IS NOT NULL THEN CASE WHEN other_us <= coalesce(end_us, other_us) THEN 'superseded_before_completion' ELSE 'room_left' END END AS reason FROM h""")  # fmt: skip
def t6(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "start").when(F.col("event_type") == "error", "end").otherwise("clock")
    rows = events(spark, d).select((F.col("user_id") % 10).alias("session"), F.unix_micros("ts").alias("at_us"), F.col("event_id").alias("row_id"), kind.alias("kind"), F.col("user_id").alias("item"), (F.col("value") * 60).alias("seconds"))
    return settle.settle(rows).select(F.col("row_id").alias("event_id"), "status", "settled_us", "reason")


LIFECYCLE_LINES = (" Log - [Behaviour] OnLeftRoom", " Log - [Behaviour] Entering Room: The Hall ", " Log - VRCApplication: HandleApplicationQuit at 1", " Log - [AVProVideo] Shutdown")
IDENTITY_LINES = (" Log - [Behaviour] OnPlayerJoined ", " Log - [Behaviour] OnPlayerLeft ", " Log - User Authenticated: ")


def _nth(values: tuple[str, ...]) -> Column:
    """One of the values, by the event's number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values) + 1).cast("int"))


def _dealt(e: DataFrame) -> DataFrame:
    """Events in some tasks for each core: a stand-in is a few row groups, and matching patterns on a row costs far more than its size tells."""
    return e.repartition(4 * e.sparkSession.sparkContext.defaultParallelism, "event_id")


def made_lines(spark: SparkSession, d: str, every_kind: bool = False) -> DataFrame:
    """Log lines of playback sessions, one per event: requests, starts, people who join and rooms that are left.

    With ``every_kind`` people and rooms have lines of all their kinds.  The stand-in is one small file, so its rows are dealt out before patterns are tried on them.
    """
    e = _dealt(events(spark, d))
    stamp = F.date_format("ts", "yyyy.MM.dd HH:mm:ss.SSS")
    song, user = F.concat(F.lit("http://api.udon.dance/Api/Songs/play?id="), (F.col("user_id") + 1).cast("string")), F.concat(F.lit("P"), (F.col("user_id") % 7).cast("string"))
    said = (
        F.when(F.col("event_type") == "click", F.concat(F.lit(" Log - User "), user, F.lit(" added URL "), song)).when(F.col("event_type") == "purchase", F.concat(F.lit(" Log - [USharpVideo] OnVideoStart: Started video: "), song))
        .when(F.col("event_type") == "view", F.concat(F.lit(' Log - [VRCX] VideoPlay(W) "'), song, F.lit('",0,'), F.round(F.col("value") * 10, 1).cast("string"), F.lit(',"'), (F.col("user_id") + 1).cast("string"), F.lit(" : Song ("), user, F.lit(')"')))
        .when(F.col("event_type") == "signup", F.concat(_nth(IDENTITY_LINES) if every_kind else F.lit(IDENTITY_LINES[0]), user, F.lit(" (usr_"), user, F.lit(")"))).otherwise(_nth(LIFECYCLE_LINES) if every_kind else F.lit(LIFECYCLE_LINES[0]))
    )
    return e.select(F.date_format("ts", "'log-'yyyy-MM-dd").alias("source_file"), F.col("event_id").alias("line_number"), F.lit(0).cast("long").alias("byte_offset"), F.concat(stamp, said).alias("value"))


@query("r_parse_signals", """SELECT event_id AS line_number, CASE event_type WHEN 'click' THEN 'user_added_url' WHEN 'purchase' THEN 'usharp_on_video_start' ELSE 'vrcx_video_play' END AS parser_name,
  CASE event_type WHEN 'purchase' THEN 'on-video-start' ELSE 'request' END AS event_type, 'wannadance:' || (user_id + 1) AS canonical_key, CASE WHEN event_type <> 'purchase' THEN 'P' || (user_id % 7) END AS display_name FROM events WHERE event_type IN ('click', 'purchase', 'view')""")  # fmt: skip
def r_signals(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_signals(made_lines(spark, d)).select("line_number", "parser_name", "event_type", "canonical_key", "display_name")


@query("r20_lifecycle", """SELECT event_id AS line_number, ['room-left', 'room-entering', 'application-quit', 'video-shutdown'][event_id % 4 + 1] AS event_type,
  CASE WHEN event_id % 4 = 1 THEN 'The Hall' END AS room_name FROM events WHERE event_type = 'error'""")  # fmt: skip
def r20(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_lifecycle(made_lines(spark, d, every_kind=True)).select("line_number", "event_type", "room_name")


@query("r21_identity", "SELECT event_id AS line_number, ['player-joined', 'player-left', 'user-authenticated'][event_id % 3 + 1] AS event_type, 'P' || (user_id % 7) AS display_name, 'usr_P' || (user_id % 7) AS user_id FROM events WHERE event_type = 'signup'")
def r21(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_identity(made_lines(spark, d, every_kind=True)).select("line_number", "event_type", "display_name", "user_id")


@query("p7_candidates", "SELECT count(*) FILTER (event_type IN ('click', 'purchase', 'view')) AS video, count(*) FILTER (event_type = 'error') AS lifecycle, count(*) FILTER (event_type = 'signup') AS identity FROM events")
def p7(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return made_lines(spark, d).agg(*[F.count_if(parse.holds_any(v, t)).alias(n) for n, t in (("video", parse.VIDEO_TOKENS), ("lifecycle", parse.LIFECYCLE_TOKENS), ("identity", parse.IDENTITY_TOKENS))])


#: A line of each form that reads a signal, '#' being the song's number: what is said, and what is to be read:
#: parser, kind, URL, other URL, name, load and wait, duration, title.  A form may give two signals.
FORM_LINES = (
    (f"[VideoListManager] PreviewVideo: # {urls.WANNA_URL}#", [("wannadance_preview", "preview", urls.WANNA_URL + "#", None, None, None, None, None)]),
    ("[VideoQueueHandler.OnVideoPlay] VizVid callback: video playback started", [("dudu_on_video_play", "actual-play", None, None, None, None, None, None)]),
    ("[Video Playback] Attempting to resolve URL 'https://youtu.be/#'", [("video_playback_resolve", "resolve-attempt", "https://youtu.be/#", None, None, None, None, None)]),
    ("[Video Playback] URL 'https://youtu.be/#' resolved to 'https://cdn/x#.mp4'", [("video_playback_resolved", "resolve-complete", "https://youtu.be/#", "https://cdn/x#.mp4", None, None, None, None)]),
    (f"[USharpVideo (1)] PlayVideoInternal: Playing video {urls.WANNA_URL}#", [("usharp_play_internal", "request", urls.WANNA_URL + "#", None, None, None, None, None)]),
    (f"<color=#fff>[USharpVideo]</color> Started video load for URL: {urls.WANNA_URL}#, requested by Ann B", [("usharp_video_load", "load-start", urls.WANNA_URL + "#", None, "Ann B", None, None, None)]),
    (f"[USharpVideo] LoadRoutedURL: {urls.WANNA_URL}# routed to https://r/#", [("usharp_load_routed_url", "route", urls.WANNA_URL + "#", "https://r/#", None, None, None, None)]),
    ("[USharpVideo] Video loaded (2.5 seconds), but let's wait for 6 seconds before playing it", [("usharp_video_loaded", "video-loaded", None, None, None, 2.5, None, None)]),
    ("[USharpVideo] DelayedVideoReady: Time's up, let's play", [("usharp_delayed_video_ready", "actual-play", None, None, None, None, None, None)]),
    (f"[USharpVideo] Playing synced {urls.WANNA_URL}#", [("usharp_playing_synced", "playback-sync", urls.WANNA_URL + "#", None, None, None, None, None)]),
    ('[VideoQueueManager] q: OnPreSerialization: queue info serialized: [{"songId":#,"title":"1. A","playerNames":["Ann","Bob"]},{"songId":7,"isRandom":true,"playerNames":["R"]}]',
     [("wannadance_queue_info", "metadata", urls.WANNA_URL + "#", None, "Ann / Bob", None, None, "A"), ("wannadance_queue_info", "metadata", urls.WANNA_URL + "7", None, None, None, None, None)]),
    ('[VideoQueueManager] q: DeserializeVideoUserData: userData = {"songId":#,"title":"#. Song","playerName":"Ann","duration":90}', [("wannadance_user_data", "metadata", urls.WANNA_URL + "#", None, "Ann", None, 90.0, "Song")]),
    ('[VideoQueueManager] q: PlayQueueVideo: a userData = {"songId":#}, videoDuration = 180.5', [("wannadance_play_video", "metadata", urls.WANNA_URL + "#", None, None, None, 180.5, None)]),
    ('[VideoQueueHandler.OnDeserialization] Queue data = [{"id":#,"title":"T","playerName":"C"}]', [("dudu_queue_info", "metadata", urls.DUDU_URL + "#", None, "C", None, None, "T")]),
    ('[VideoQueueHandler.DeserializeVideoSongData] deserialize video data: {"id":#,"title":"T","artist":"Q","duration":9}', [("dudu_song_data", "metadata", urls.DUDU_URL + "#", None, None, None, 9.0, "T - Q")]),
    ('[VRCX] LSMedia {"url": "https://a/#b.", "Display-Name": "Zed", "deep": {"userId": "usr_z"}}', [("vrcx_lsmedia", "request", "https://a/#b", None, "Zed", None, None, None)]),
    ("[Video] playing synced nothing of note", []),
)
_FIELDS = ("parser_name", "event_type", "video_url", "other_url", "display_name", "load_seconds", "duration_seconds", "video_name")


def _literal(value: str | float | None) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, float) else f"replace('{value}', '#', (event_id + 1)::VARCHAR)"


FORMS_SQL = "\nUNION ALL ".join(
    f"SELECT event_id AS line_number, {', '.join(f'{_literal(v)} AS {n}' for n, v in zip(_FIELDS, row, strict=True))} FROM events WHERE event_id % {len(FORM_LINES)} = {k}" for k, (_, rows) in enumerate(FORM_LINES) for row in rows
)


@query("r_line_forms", FORMS_SQL)
def r_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every form of line, read field by field."""
    said = F.replace(_nth(tuple(line for line, _ in FORM_LINES)), F.lit("#"), (F.col("event_id") + 1).cast("string"))
    said = F.when(said.startswith("<color="), F.concat(F.lit("<color=#fff>"), F.substring_index(said, ">", -2))).otherwise(said)
    value = F.concat(F.date_format("ts", "yyyy.MM.dd HH:mm:ss"), F.lit(" Log        -  "), said)
    lines = _dealt(events(spark, d)).select(F.lit("a").alias("source_file"), F.col("event_id").alias("line_number"), F.lit(0).cast("long").alias("byte_offset"), value.alias("value"))
    return parse.parse_signals(lines).withColumn("other_url", F.coalesce("routed_url", "resolved_url")).select("line_number", *_FIELDS)


#: The lines' sessions told row by row: a request opens an occurrence unless an unplayed one is open, a start plays, leaving the room closes all.
FOLD_SQL = """WITH RECURSIVE e AS (SELECT ts::DATE AS day, event_id, epoch_us(ts) // 1000 AS at_ms, event_type, user_id FROM events), s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY event_id) AS segment FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY day, user_id ORDER BY event_id) AS k FROM s WHERE event_type IN ('click', 'view', 'purchase')),
told AS (SELECT day, user_id, k, event_id, at_ms, event_type, segment, 1 AS number, event_type = 'purchase' AS played FROM r WHERE k = 1
  UNION ALL SELECT r.day, r.user_id, r.k, r.event_id, r.at_ms, r.event_type, r.segment, t.number + CASE WHEN r.segment <> t.segment OR (r.event_type <> 'purchase' AND t.played) THEN 1 ELSE 0 END,
    r.event_type = 'purchase' OR (t.played AND r.segment = t.segment AND r.event_type = 'purchase') FROM told t JOIN r ON r.day = t.day AND r.user_id = t.user_id AND r.k = t.k + 1)
SELECT 'log-' || day AS session, 'wannadance:' || (user_id + 1) || '#' || number AS event_key, count(*) AS signal_count, min(at_ms) AS first_seen_ms, max(at_ms) AS last_seen_ms, min(CASE WHEN event_type = 'purchase' THEN at_ms END) AS actual_play_ms,
  string_agg(DISTINCT CASE event_type WHEN 'purchase' THEN 'on-video-start' ELSE 'request' END, ',' ORDER BY CASE event_type WHEN 'purchase' THEN 'on-video-start' ELSE 'request' END) AS kinds, arg_min('P' || (user_id % 7), event_id) FILTER (event_type <> 'purchase') AS display_name FROM told GROUP BY day, user_id, number"""  # fmt: skip


@query("t1_fold", FOLD_SQL)
def t1(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of a session per day, folded out of log lines."""
    o = occurrences.fold(parse.session_rows(made_lines(spark, d), F.col("source_file")))

    def ms(name: str) -> Column:
        return F.unix_millis(F.col(name).cast("timestamp"))

    return o.select(
        "session", "event_key", "signal_count", ms("first_seen_at").alias("first_seen_ms"), ms("last_seen_at").alias("last_seen_ms"), ms("actual_play_at").alias("actual_play_ms"),
        F.array_join("raw_event_types", ",").alias("kinds"), "display_name",
    )


def session_signals(spark: SparkSession, d: str, clocks: bool = True) -> DataFrame:
    """Rows of ten sessions straight from events, in place and slices: each event is a stamp (with ``clocks``), and some are signals, rooms or people.

    A song has the number of the user modulo 40; every sixteenth event is of its own kind.
    """
    e, n = events(spark, d), F.col("event_id") % 16
    kind = F.when(n < 4, "request").when(n < 6, "on-video-start").when(n == 6, "route").when(n == 7, "playback-sync").when(n == 8, "room-left").when(n == 9, "room-entering").when(n < 12, "player-joined").when(n == 12, "player-left")
    is_signal, people = n < 8, n.isin(10, 11, 12)
    song, name = F.concat(F.lit("k:"), (F.col("user_id") % 40).cast("string")), F.concat(F.lit("N"), (F.col("user_id") % 25).cast("string"))
    base = e.select((F.col("user_id") % 10).cast("string").alias("session"), F.lit("a").alias("source_file"), F.col("event_id").alias("line_number"), F.col("ts").cast("timestamp_ntz").alias("at"), "event_id", "user_id", "value")
    stamps = base.withColumns({"stage": F.lit(0), "event_type": F.lit("clock")})
    told = base.withColumns({
        "stage": F.when(is_signal, 3).when(people, 2).otherwise(1), "event_type": kind, "parser_name": F.when(is_signal, "p"), "canonical_key": F.when(is_signal, song), "video_url": F.when(is_signal, song),
        "display_name": F.when((n < 4) | people, name), "requester_user_id": F.when(people, F.concat(F.lit("usr"), (F.col("user_id") % 75).cast("string"))), "requester_user_id_source": F.lit(None).cast("string"), "actual_play_at": F.lit(None).cast("timestamp_ntz"),
    }).filter("event_type is not null")
    return slices.sliced(stamps.unionByName(told, allowMissingColumns=True) if clocks else told, ["session", "line_number", "stage"])


SESSION_ROWS = """e AS (SELECT user_id % 10 AS session, event_id, ts, event_id % 16 AS n, 'k:' || (user_id % 40) AS song, 'N' || (user_id % 25) AS name, 'usr' || (user_id % 75) AS usr FROM events)"""


@query("t2_boundaries", f"""WITH RECURSIVE {SESSION_ROWS}, s AS (SELECT *, sum(CASE WHEN n = 8 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY event_id) AS segment FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY session, song ORDER BY event_id) AS k FROM s WHERE n < 8),
told AS (SELECT session, song, k, event_id, ts, segment, 1 AS number, n IN (4, 5) AS played, ts AS seen FROM r WHERE k = 1
  UNION ALL SELECT session, song, k, event_id, ts, segment, number + fresh, n IN (4, 5) OR (played AND fresh = 0), CASE WHEN fresh = 1 THEN ts ELSE greatest(ts, seen) END FROM (
    SELECT r.*, t.number, t.played, t.seen, CASE WHEN r.segment <> t.segment OR (r.n < 4 AND t.played) OR (r.n = 6 AND t.played AND NOT (r.ts - t.seen BETWEEN INTERVAL 0 SECOND AND INTERVAL 30 SECOND)) THEN 1 ELSE 0 END AS fresh
    FROM told t JOIN r ON r.session = t.session AND r.song = t.song AND r.k = t.k + 1))
SELECT event_id, session::VARCHAR AS session, song || '#' || number AS event_key FROM told""")  # fmt: skip
def t2(spark: SparkSession, d: str) -> DataFrame:
    """The occurrence that each signal belongs to; boundaries do not ask for the stamps of other lines."""
    rows = session_signals(spark, d, clocks=False).select("session", "place", "slice", "event_id", "at", "event_type", "parser_name", "canonical_key", "video_url", "actual_play_at")
    whole = staged(boundaries.in_segments(rows), "segments")
    return boundaries.occurrences_of(staged(boundaries.attributed(boundaries.signals_of(whole)), "attributed")).select("event_id", "session", "event_key")


@query("t5_identity", f"""WITH {SESSION_ROWS}, rooms AS (SELECT session, event_id, n, sum(CASE WHEN n IN (8, 9) THEN 1 ELSE 0 END) OVER w AS changes, last_value(CASE WHEN n = 8 THEN 'closing' WHEN n IN (9, 10, 11) THEN 'active' END IGNORE NULLS) OVER w AS state,
  last_value(CASE WHEN n IN (8, 9) THEN {{'at': CASE WHEN n = 9 THEN ts END}} END IGNORE NULLS) OVER w AS entered FROM e WINDOW w AS (PARTITION BY session ORDER BY event_id)),
tells AS (SELECT e.session, e.event_id, name, usr, e.n = 12 AS has_left, changes FROM e JOIN rooms USING (session, event_id) WHERE e.n IN (10, 11) OR (e.n = 12 AND state IS NOT NULL)),
asked AS (SELECT e.session, e.event_id, e.ts, name, changes, state, entered.at AS entered,
  (SELECT arg_max({{'usr': t.usr, 'has_left': t.has_left, 'changes': t.changes}}, t.event_id) FROM tells t WHERE t.session = e.session AND t.name = e.name AND t.event_id < e.event_id) AS t FROM e JOIN rooms USING (session, event_id) WHERE e.n < 4),
judged AS (SELECT *, NOT t.has_left AND t.changes = changes AS here, coalesce(epoch_us(ts) - epoch_us(entered) >= 60000000, false) AS graced FROM asked)
SELECT event_id, CASE WHEN state = 'active' AND t IS NOT NULL AND (here OR graced) THEN t.usr END AS user_id, CASE WHEN state = 'active' AND t IS NOT NULL AND (here OR graced) THEN CASE WHEN here THEN 'active' ELSE 'expired' END END AS source,
  CASE WHEN state = 'active' AND t IS NOT NULL AND NOT here AND NOT graced THEN t.usr END AS candidate FROM judged""")  # fmt: skip
def t5(spark: SparkSession, d: str) -> DataFrame:
    """Who asked, as of each request: from this room, from an earlier one, or not yet to be told."""
    asked = identity.named(identity.in_rooms(session_signals(spark, d))).filter("event_type = 'request'")
    return asked.select("event_id", F.col("user").alias("user_id"), F.col("user_source").alias("source"), "candidate")


@query("t7_supersession", """WITH e AS (SELECT user_id % 10 AS session, ts, event_id, event_type, round(value * 20, 1) AS len, event_id % 3 = 0 AS plays FROM events),
o AS (SELECT * FROM e WHERE event_type IN ('click', 'purchase')),
f AS (SELECT o.*, (SELECT arg_min({'ts': x.ts, 'id': x.event_id, 'kind': x.event_type}, x.event_id) FROM e x WHERE x.session = o.session AND x.event_id > o.event_id AND (x.event_type = 'error' OR (x.event_type IN ('click', 'purchase') AND (o.plays OR x.plays)))) AS f,
  (SELECT arg_min({'ts': x.ts, 'id': x.event_id}, x.event_id) FROM e x WHERE x.session = o.session AND x.event_id > o.event_id AND o.plays AND o.len > 0 AND epoch_us(x.ts) >= epoch_us(o.ts) + ceil((o.len * 0.8 - 0.001) * 1e6)) AS c FROM o),
g AS (SELECT *, c IS NOT NULL AND (f IS NULL OR c.id <= f.id) AS done FROM f)
SELECT event_id, CASE WHEN done THEN 'completed' ELSE 'interrupted' END AS status, CASE WHEN done THEN 'observed_completion_threshold' WHEN f.kind = 'error' THEN 'room_left' WHEN plays AND len <= 0 THEN 'unknown_duration_before_superseded' ELSE 'superseded_before_completion' END AS reason,
  epoch_us(CASE WHEN done THEN c.ts ELSE f.ts END) AS settled_us FROM g WHERE done OR f IS NOT NULL""")  # fmt: skip
def t7(spark: SparkSession, d: str) -> DataFrame:
    """How occurrences of one signal each end: those that play are interrupted by any other, the rest by plays only, all by leaving."""
    e = events(spark, d).select((F.col("user_id") % 10).cast("string").alias("session"), F.col("ts").cast("timestamp_ntz").alias("at"), "event_id", "event_type", F.round(F.col("value") * 20, 1).alias("length"))
    rows = e.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("stage")).filter("stage = 0 or event_type in ('click', 'purchase', 'error')")
    kind = F.when(F.col("stage") == 0, "clock").when(F.col("event_type") == "error", "room-left").otherwise("signal")
    placed = slices.sliced(rows.withColumn("event_type", kind), ["session", "event_id", "stage"])
    whole = staged(boundaries.in_segments(placed), "segments")
    plays = F.when(F.col("event_id") % 3 == 0, F.col("at"))
    updates = whole.filter("event_type = 'signal'").select("session", F.col("event_id").cast("string").alias("event_key"), "place", "slice", "clock", plays.alias("actual"), F.col("at").alias("first_seen"), F.col("at").alias("last_seen"), "length", F.lit(True).alias("has_song"))
    ends = settlement.settled(whole, updates, finish=False, whole=slices.small(updates, occurrences.EVENT)[0])
    return ends.select(F.col("event_key").cast("long").alias("event_id"), "status", "reason", F.unix_micros(F.col("settled_at").cast("timestamp")).alias("settled_us"))


def folded(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of sessions that SQL can fold too: each purchase requests and starts a song of its own, errors leave
    the room, and all other events are lines that only tell the time, in milliseconds.  A length of 0 is known, as in the SQL."""
    e = events(spark, d)
    song, number = F.concat(F.lit(urls.WANNA_URL), (F.col("event_id") + 1).cast("string")), (F.col("event_id") + 1).cast("string")
    asked = F.concat(F.lit('[VRCX] VideoPlay(W) "'), song, F.lit('",0,'), F.round(F.col("value") * 60, 1).cast("string"), F.lit(',"'), number, F.lit(" : Song (P"), (F.col("user_id") % 7).cast("string"), F.lit(')"'))
    said = F.when(F.col("event_type") == "purchase", F.array(asked, F.concat(F.lit("[USharpVideo] OnVideoStart: Started video: "), song))).when(F.col("event_type") == "error", F.array(F.lit("[Behaviour] OnLeftRoom"))).otherwise(F.array(F.lit("tick")))
    day, stamp = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy.MM.dd HH:mm:ss.SSS")
    lines = e.select(day.alias("source_file"), "event_id", stamp.alias("stamp"), F.posexplode(said).alias("k", "said"))
    lines = lines.select("source_file", (F.col("event_id") * 2 + F.col("k")).alias("line_number"), F.lit(0).cast("long").alias("byte_offset"), F.concat("stamp", F.lit(" Log        -  "), "said").alias("value"))
    return occurrences.fold(parse.session_rows(lines, F.col("source_file")), unit=1000, at_zero=True)


FOLDED = """e AS (SELECT ts::DATE AS day, epoch_us(ts) // 1000 AS at_ms, event_id, user_id, event_type, round(value * 60, 1) AS len FROM events), s AS (SELECT * FROM e WHERE event_type = 'purchase'),
f AS (SELECT s.*, (SELECT min(at_ms) FROM e x WHERE x.day = s.day AND x.event_type IN ('purchase', 'error') AND x.event_id > s.event_id) AS force_at,
  (SELECT arg_min(event_type, event_id) FROM e x WHERE x.day = s.day AND x.event_type IN ('purchase', 'error') AND x.event_id > s.event_id) AS force_by,
  (SELECT min(at_ms) FROM e x WHERE x.day = s.day AND x.event_id > s.event_id AND x.at_ms >= s.at_ms + ceil((s.len * 0.8 - 0.001) * 1000)) AS done_at, (SELECT max(at_ms) FROM e x WHERE x.day = s.day) AS last_at FROM s),
g AS (SELECT *, done_at IS NOT NULL AND (force_at IS NULL OR done_at <= force_at) AS complete FROM f),
folded AS (SELECT event_id, user_id, day, at_ms, len, CASE WHEN complete THEN 'completed' ELSE 'interrupted' END AS status, CASE WHEN complete THEN done_at ELSE coalesce(force_at, last_at) END AS settled_ms,
  CASE WHEN complete THEN 'observed_completion_threshold' ELSE CASE force_by WHEN 'purchase' THEN 'superseded_before_completion' WHEN 'error' THEN 'room_left' ELSE 'watcher_stopped' END END AS reason FROM g)"""


@query("t1_settled_fold", f"""WITH {FOLDED} SELECT 'wannadance:' || (event_id + 1) || '#1' AS event_key, 2::BIGINT AS signal_count, len AS duration_seconds, status, reason, settled_ms, round((settled_ms - at_ms) / 1000.0, 3)::DOUBLE AS played_seconds, 0.0::DOUBLE AS delay FROM folded""")
def t1_settled(spark: SparkSession, d: str) -> DataFrame:
    o = folded(spark, d)
    return o.select("event_key", "signal_count", "duration_seconds", F.col("completion_status").alias("status"), F.col("completion_reason").alias("reason"), F.unix_millis(F.col("settled_at").cast("timestamp")).alias("settled_ms"), "played_seconds", F.col("delay_to_actual_seconds").alias("delay"))


KEYS = "sha256('watcher-playback-event' || chr(31) || day || chr(31) || 'wannadance:' || (event_id + 1) || '#1')"
EVIDENCE_SQL = "sha256('legacy-playback-cleanup' || chr(31) || 'project' || chr(31) || '{table}' || chr(31) || '0' || chr(31) || " + KEYS + ")"


@query("t16_records", f"""WITH {FOLDED} SELECT {EVIDENCE_SQL.format(table=evidence.WATCHER_TABLE)} AS evidence_key, (event_id + 1)::VARCHAR AS external_id, CASE WHEN (event_id + 1) % 5 <> 0 THEN event_id + 1 END AS track_id, at_ms AS played_ms, 'player' AS request_type,
  CASE status WHEN 'completed' THEN 'accepted' ELSE 'needs_attention' END AS default_status, reason AS status_reason, settled_ms AS end_ms, 'P' || (user_id % 7) AS requester_display_name, 'Song' AS video_name FROM folded""")  # fmt: skip
def t16(spark: SparkSession, d: str) -> DataFrame:
    """Evidence records of folded occurrences; the catalog lacks every fifth song."""
    songs = events(spark, d).filter("(event_id + 1) % 5 <> 0").select((F.col("event_id") + 1).alias("track_id"), F.lit("wannadance").alias("system_key"), (F.col("event_id") + 1).cast("string").alias("external_id"))
    r = evidence.evidence_records(folded(spark, d), songs)
    return r.select("evidence_key", "external_id", "track_id", F.unix_millis(F.col("played_at").cast("timestamp")).alias("played_ms"), "request_type", "default_status", "status_reason", F.unix_millis(F.col("observed_end_at").cast("timestamp")).alias("end_ms"), "requester_display_name", "video_name")


@query("k11_promotion", f"WITH {FOLDED} SELECT {EVIDENCE_SQL.format(table=evidence.LIVE_TABLE)} AS evidence_key, 'accepted' AS default_status, CASE WHEN event_id % 2 = 0 THEN 'unchanged' ELSE 'inserted' END AS action FROM folded WHERE status = 'completed'")
def k11(spark: SparkSession, d: str) -> DataFrame:
    """Completed plays promoted into evidence that has every other one already."""
    o = folded(spark, d)
    before = evidence.evidence_records(merges.promotable(o.filter("external_id % 2 = 1")), None, evidence.LIVE_TABLE)
    return evidence.promote(before, o).select("evidence_key", "default_status", "action")
