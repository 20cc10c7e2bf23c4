"""Log lines to signals: every known form of line as a row of a table of patterns, in column expressions.

A cheap token filter keeps most lines away, and a plain search for a form's hint keeps its pattern off other lines.
A line gives a row per form that it has, and each row is read by its own form's pattern alone.  Only the payload of two forms, whose JSON may
nest anywhere and whose fields vary in number, needs a small Arrow function.
"""

from __future__ import annotations

import csv
import json
import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, timestamps, urls
from ..functions.binding import once
from ..functions.timestamps import blank_to_null

# What lines of interest contain.
VIDEO_TOKENS = (
    "video playback", "usharpvideo", "videoplay", "lsmedia", "previewvideo", "playqueuevideo", "playrandomvideo", "videoduration", "queue info serialized", "syncedqueuedinfojson",
    "deserializevideouserdata", "added url", "resolving url", "resolve url", "resolved to", "playvideointernal", "loadroutedurl", "video loaded", "delayedvideoready", "onvideostart",
    "playing synced", "videoqueuehandler", "dudufit.dance",
)
LIFECYCLE_TOKENS = ("onleftroom", "entering room:", "handleapplicationquit", "[avprovideo] shutdown")
IDENTITY_TOKENS = ("onplayerjoined", "onplayerleft", "user authenticated:")

_PLAYER = r"\[USharpVideo(?:\s*\([^)]+\))?\]\s+"
_LINK = r"(https?://\S+)"
#: Text fields of a signal, then its numbers.
TEXTS = (
    "event_type", "parser_name", "world_parser", "video_url", "routed_url", "resolved_url", "display_name", "video_name", "video_id", "requester_marker", "requester_user_id",
    "requester_user_id_source", "source_hint", "actual_play_method", "duration_source",
)
NUMBERS = ("video_offset_seconds", "duration_seconds", "load_seconds", "wait_seconds")


@dataclass(frozen=True)
class Form:
    """A form of line that gives one signal: a pattern, and which group holds which field, in what manner."""

    parser: str
    event: str
    pattern: str
    groups: dict[str, tuple[int, str]] = field(default_factory=dict)
    fixed: dict[str, str] = field(default_factory=dict)


# The forms of lines, with the names of their parsers.
FORMS = (
    Form("wannadance_preview", "preview", r"\[VideoListManager\]\s+PreviewVideo:\s+(\d+)\s+" + _LINK, {"video_id": (1, "text"), "video_url": (2, "url")}, {"source_hint": "preview"}),
    Form("dudu_on_video_play", "actual-play", r"\[VideoQueueHandler\.OnVideoPlay\]\s+VizVid callback:\s+video playback started()", fixed={"actual_play_method": "dudu_on_video_play"}),
    Form("video_playback_resolve", "resolve-attempt", r"\[Video Playback\]\s+(?:Attempting to resolve URL|Resolving URL)\s+'([^']+)'", {"video_url": (1, "url")}),
    Form("video_playback_resolved", "resolve-complete", r"\[Video Playback\]\s+URL\s+'([^']+)'\s+resolved to\s+'([^']+)'", {"video_url": (1, "url"), "resolved_url": (2, "url")}),
    Form("user_added_url", "request", r"\bUser\s+(.+?)\s+added URL\s+" + _LINK, {"display_name": (1, "name"), "video_url": (2, "url")}),
    Form("usharp_play_internal", "request", _PLAYER + r"PlayVideoInternal:\s+Playing video\s+" + _LINK, {"video_url": (1, "url")}),
    Form("usharp_video_load", "load-start", _PLAYER + r"Started video load for URL:\s*(https?://\S+?)(?:,\s*requested by\s*(.*?))?\s*$", {"video_url": (1, "url"), "display_name": (2, "name")}),
    Form("usharp_load_routed_url", "route", _PLAYER + r"LoadRoutedURL:\s+" + _LINK + r"\s+routed to\s+" + _LINK, {"video_url": (1, "url"), "routed_url": (2, "url")}),
    Form("usharp_video_loaded", "video-loaded", _PLAYER + r"Video loaded\s+\(([\d.]+)\s+seconds\),\s+but let's wait for\s+([\d.]+)\s+seconds before playing it", {"load_seconds": (1, "number"), "wait_seconds": (2, "number")}),
    Form("usharp_delayed_video_ready", "actual-play", _PLAYER + r"DelayedVideoReady:\s+Time's up,\s+let's play()"),
    Form("usharp_on_video_start", "on-video-start", _PLAYER + r"OnVideoStart:\s+Started video:\s+" + _LINK, {"video_url": (1, "url")}),
    Form("usharp_playing_synced", "playback-sync", _PLAYER + r"Playing synced\s+" + _LINK, {"video_url": (1, "url")}),
)


@dataclass(frozen=True)
class JsonForm:
    """A form of line that carries one JSON object or a list of them, each a signal of metadata."""

    parser: str
    pattern: str
    many: bool
    system: str
    duration_source: str
    ids: tuple[str, ...]
    links: tuple[str, ...]
    titles: tuple[str, ...]
    names: tuple[str, ...]
    random: tuple[str, ...]
    #: Group of the line that holds the duration, if the object does not.
    duration_group: int = 0


# Forms of lines with JSON, and the names of its fields.
_QUEUE = r"\[VideoQueueManager\].*?:\s+"
JSON_FORMS = (
    JsonForm("wannadance_queue_info", _QUEUE + r"(?:OnPreSerialization:\s+queue info serialized:\s*|OnDeserialization:\s+syncedQueuedInfoJson\s*=\s*)(\[.*\])", True, urls.WANNA, "wanna_queue_json",
             ("songId", "song_id", "id"), ("videoUrl", "video_url"), ("title", "videoTitle"), ("playerNames", "player_names"), ("isRandom",)),
    JsonForm("wannadance_user_data", _QUEUE + r"DeserializeVideoUserData:\s+userData\s*=\s*(\{.*\})", False, urls.WANNA, "wanna_queue_json",
             ("songId", "song_id", "id"), ("videoUrl", "video_url"), ("videoTitle", "title", "name"), ("playerName", "displayName"), ("isRandom",)),
    JsonForm("wannadance_play_video", _QUEUE + r"(?:PlayQueueVideo|PlayRandomVideo):\s+.*?\buserData\s*=\s*(\{.*\})\s*,\s*videoDuration\s*=\s*([\d.]+)", False, urls.WANNA, "wanna_video_duration",
             ("songId", "song_id", "id"), ("videoUrl", "video_url"), ("videoTitle", "title", "infoString"), ("playerName", "displayName"), ("isRandom",), 2),
    JsonForm("dudu_queue_info", r"\[VideoQueueHandler\.OnDeserialization\]\s+Queue data\s*=\s*(\[.*\])", True, urls.DUDU, "dudu_queue_json",
             ("songId", "song_id", "id"), ("url", "videoUrl", "video_url"), ("title", "info", "name"), ("playerName", "player_name", "user"), ("shuffle", "isRandom")),
    JsonForm("dudu_song_data", r"\[VideoQueueHandler\.DeserializeVideoSongData\]\s+deserialize video data:\s*(\{.*\})", False, urls.DUDU, "dudu_song_json",
             ("id", "songId", "song_id"), ("url", "videoUrl", "video_url"), ("info", "title", "name"), ("user", "playerName", "displayName"), ("shuffle", "isRandom")),
)


@dataclass(frozen=True)
class PayloadForm:
    """A form of line with a payload of free structure in its second group."""

    parser: str
    pattern: str


# Forms of lines, and what a line must hold in lower case to be of a form.
PAYLOAD_FORMS = (PayloadForm("vrcx_video_play", r"\[VRCX\]\s+VideoPlay\(([^)]+)\)\s*(.*)"), PayloadForm("vrcx_lsmedia", r"\[VRCX\]\s+LSMedia()\s*(.*)"))
HINTS = {
    "wannadance_preview": "previewvideo:", "dudu_on_video_play": "onvideoplay]", "video_playback_resolve": "resolv", "video_playback_resolved": "resolved to", "user_added_url": "added url",
    "usharp_play_internal": "playvideointernal:", "usharp_video_load": "started video load for url:", "usharp_load_routed_url": "loadroutedurl:", "usharp_video_loaded": "but let's wait for",
    "usharp_delayed_video_ready": "delayedvideoready:", "usharp_on_video_start": "onvideostart:", "usharp_playing_synced": "playing synced", "wannadance_queue_info": "[videoqueuemanager]",
    "wannadance_user_data": "deserializevideouserdata:", "wannadance_play_video": "videoduration", "dudu_queue_info": "queue data", "dudu_song_data": "deserialize video data:", "vrcx_video_play": "videoplay(",
    "vrcx_lsmedia": "lsmedia",
}


def holds_any(line: Column, tokens: tuple[str, ...]) -> Column:
    return once(F.lower(line), lambda low: reduce(or_, [low.contains(t) for t in tokens]))


def _signal(**fields: Column) -> Column:
    null = F.lit(None)
    return F.struct(*[fields.get(n, null).cast("string").alias(n) for n in TEXTS], *[fields.get(n, null).cast("double").alias(n) for n in NUMBERS])


def _of_form(make) -> Column:
    """A constant of each JSON form, looked up by the row's parser."""
    return F.try_element_at(F.create_map(*[c for form in JSON_FORMS for c in (F.lit(form.parser), make(form))]), F.col("__parser"))


def _names(said: Column) -> Column:
    """A display name, or several of a JSON list with strokes between them."""
    several = F.filter(F.transform(F.from_json(F.when(said.startswith("["), said), "array<string>"), text.clean_name), lambda n: n.isNotNull())
    return F.when(said.startswith("["), blank_to_null(F.array_join(several, " / "))).otherwise(text.clean_name(said))


def _first(e: Column, keys: Column, zero_counts: Column | None = None) -> Column:
    """The first value of a map under these keys that is neither missing, empty nor zero (zero may count)."""
    def fine(v: Column) -> Column:
        real = ~v.isin("", "0", "false", "[]", "{}")
        return v.isNotNull() & (real if zero_counts is None else zero_counts | real)

    return F.try_element_at(F.filter(F.transform(keys, lambda k: F.try_element_at(e, k)), fine), F.lit(1))


def _keys(name: str) -> Column:
    return _of_form(lambda f: F.array(*[F.lit(k) for k in getattr(f, name)]))


def _entry(e: Column) -> dict[str, Column]:
    """Number, link, name and randomness of one JSON object (a map of texts)."""
    is_dudu = _of_form(lambda f: F.lit(f.system == urls.DUDU))
    is_random = text.truthy(_first(e, _keys("random")))
    name = _names(_first(e, _keys("names")))
    return {"number": F.coalesce(text.strip(_first(e, _keys("ids"), is_dudu)), F.lit("")), "link": _first(e, _keys("links")), "name": F.when(is_dudu | ~is_random, name), "random": is_random}


# --- payloads with free structure ----------------------------------------------------------------------

_URL = re.compile(r"https?://[^\s\"'<>]+", re.IGNORECASE)
PAYLOAD_SCHEMA = T.StructType(
    [T.StructField("urls", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("display_name", "video_id", "title", "user_id")]
    + [T.StructField(n, T.DoubleType()) for n in ("video_offset", "duration")]
    + [T.StructField(n, T.StringType()) for n in ("structured_name", "structured_id")]
)


def nested(tree: object, wanted: frozenset[str]) -> object:
    """The value of the first key of that name, level by level from the outside; keys compare without case, '-' and ' '."""
    children = list(tree.values()) if isinstance(tree, dict) else tree if isinstance(tree, list) else []
    if isinstance(tree, dict):
        for key, value in tree.items():
            if re.sub("[- ]", "_", str(key)).lower() in wanted:
                return value
    return next((v for v in (nested(c, wanted) for c in children) if v is not None), None)


def _number(value: str) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def read_payload(payload: str) -> dict:
    """Fields of one payload: a quoted CSV record with a URL, its offset, duration and title, or JSON."""
    try:
        record = next(csv.reader([payload], skipinitialspace=True), [])
    except csv.Error:
        record = []
    try:
        tree = json.loads(payload) if payload.strip()[:1] in ("{", "[") else None
    except ValueError:
        tree = None
    link, name = nested(tree, frozenset({"url", "videourl", "video_url"})), nested(tree, frozenset({"displayname", "display_name", "requester", "user"}))
    found = [link] if isinstance(link, str) else []
    found += [u for part in record for u in _URL.findall(part)]
    at = next((k for k, part in enumerate(record) if _URL.search(part)), None)
    after = record[at + 1 :] if at is not None else []
    if not isinstance(name, str):
        name = next((p for p in after if p.strip() and not _URL.search(p)), None)
    offset = _number(after[0]) if after else None
    user = nested(tree, frozenset({"userid", "user_id", "requesterid", "requester_id", "playerid", "player_id", "vrchatuserid", "vrchat_user_id"}))
    label, number = nested(tree, frozenset({"name", "title", "videoname", "video_name"})), nested(tree, frozenset({"id", "videoid", "video_id"}))
    return {
        "urls": found or _URL.findall(payload), "display_name": None if offset is not None else name, "video_id": None, "title": after[2] if len(after) > 2 else None,
        "user_id": str(user).strip() if user is not None and str(user).strip().startswith("usr_") else None, "video_offset": offset, "duration": _number(after[1]) if len(after) > 1 else None,
        "structured_name": label if isinstance(label, str) else None, "structured_id": None if number is None else str(number),
    }


@F.pandas_udf(PAYLOAD_SCHEMA)
def payload_fields(payloads: pd.Series) -> pd.DataFrame:
    nothing = read_payload("")  # most rows have no such payload
    return pd.DataFrame([read_payload(p) if p else nothing for p in payloads], columns=PAYLOAD_SCHEMA.names)


#: Forms by the rank that orders the signals of a line: the preview, then JSON, then other patterns, then payloads.
RANKED = {
    **{k if k == 0 else 10 + k: form for k, form in enumerate(FORMS)},
    **dict(enumerate(JSON_FORMS, 1)),
    **dict(enumerate(PAYLOAD_FORMS, 30)),
}
_DIRECT = [k for k, form in RANKED.items() if isinstance(form, Form)]
_PLAYING = min(k for k, form in RANKED.items() if isinstance(form, PayloadForm))


def _constant(values: dict[int, str]) -> Column:
    """A constant of the row's form; null for a form without one."""
    return F.try_element_at(F.create_map(*[F.lit(c) for pair in values.items() for c in pair]), F.col("rank"))


def _by_rank(values: dict[int, Column]) -> Column:
    """The value of the row's form; null for a form without one."""
    chain = None
    for rank, value in values.items():
        chain = (F if chain is None else chain).when(F.col("rank") == rank, value)
    return chain


def _forms_in(line: Column, low: Column) -> Column:
    """Ranks of the forms that a line has; a plain search for the form's hint comes before its pattern."""
    return F.array_compact(F.array(*[F.when(low.contains(HINTS[form.parser]) & line.rlike("(?i)" + form.pattern), F.lit(rank)) for rank, form in RANKED.items()]))


def _group(line: Column, number: int) -> Column:
    """A group of the pattern of the row's own form."""
    return _by_rank({rank: F.regexp_extract(line, "(?i)" + form.pattern, number) for rank, form in RANKED.items() if re.compile(form.pattern).groups >= number})


def _direct_signal() -> Column:
    """The signal of a form whose groups are its fields."""
    forms = {rank: RANKED[rank] for rank in _DIRECT}
    fields = {"event_type": _constant({k: f.event for k, f in forms.items()}), "parser_name": _constant({k: f.parser for k, f in forms.items()})}
    for name in {n for f in forms.values() for n in f.groups}:
        manner = next(f.groups[name][1] for f in forms.values() if name in f.groups)
        found = _by_rank({k: F.col(f"__g{f.groups[name][0]}") for k, f in forms.items() if name in f.groups})
        fields[name] = {"url": text.clean_url, "name": text.clean_name, "text": blank_to_null, "number": lambda c: c.try_cast("double")}[manner](found)
    for name in {n for f in forms.values() for n in f.fixed}:
        fields[name] = _constant({k: f.fixed[name] for k, f in forms.items() if name in f.fixed})
    return F.when(F.col("rank").isin(_DIRECT), _signal(**fields))


def parse_signals(lines: DataFrame) -> DataFrame:
    """Signals of lines (source_file, line_number, byte_offset, value), with at (wall clock) and ordinal in the line."""
    at = timestamps.wall_clock(timestamps.line_stamp(F.col("value")))
    kept = lines.filter(holds_any(F.col("value"), VIDEO_TOKENS)).withColumns({"at": at, "__line": text.without_colour_tags(F.col("value"))})
    base = ("source_file", "line_number", "byte_offset", "at")
    held = kept.select(*base, F.col("value").alias("raw_line"), "__line", F.explode(once(F.lower("__line"), lambda low: _forms_in(F.col("__line"), low))).alias("rank"))
    held = held.select(*base, "raw_line", "rank", *[once(F.col("__line"), lambda line, n=n: _group(line, n)).alias(f"__g{n}") for n in (1, 2)])
    others = {k: f for k, f in RANKED.items() if k not in _DIRECT}
    raw = held.select(
        *base, "raw_line", "rank", once(F.col("rank"), lambda _: _direct_signal()).alias("direct"), _constant({k: f.parser for k, f in others.items()}).alias("__parser"),
        _by_rank({k: F.col("__g1" if isinstance(f, JsonForm) else "__g2") for k, f in others.items()}).alias("payload"),
        F.when(F.col("rank") == _PLAYING, blank_to_null(F.trim("__g1"))).when(F.col("rank") > _PLAYING, "LSMedia").alias("world"),
        _by_rank({k: F.col(f"__g{f.duration_group}").try_cast("double") for k, f in others.items() if isinstance(f, JsonForm) and f.duration_group}).alias("seconds"),
    )

    is_free = F.coalesce(F.col("__parser").isin(*[f.parser for f in PAYLOAD_FORMS]), F.lit(False))
    # JSON objects, of equal link and name in a line the first; other rows pass through with none.
    is_json = F.coalesce(F.col("__parser").isin(*[f.parser for f in JSON_FORMS]), F.lit(False))
    listed = F.when(is_json, F.from_json(F.when(F.col("payload").startswith("["), F.col("payload")).otherwise(F.concat(F.lit("["), "payload", F.lit("]"))), "array<map<string, string>>"))
    with_entries = raw.withColumn("__entries", listed)

    def name_of(e: Column) -> Column:
        one = _entry(e)
        return F.concat_ws("\u001f", F.coalesce(one["link"], F.lit("")), one["number"], F.coalesce(one["name"], F.lit("\u0000")))

    keyed = with_entries.withColumn("__keys", F.transform("__entries", name_of))
    distinct = F.filter("__entries", lambda e, k: F.array_position(F.col("__keys"), F.element_at(F.col("__keys"), k + 1)) == k + 1)
    spread = keyed.select(*base, "raw_line", "rank", "direct", "__parser", "payload", "world", "seconds", F.posexplode_outer(distinct).alias("__k", "__e"))
    spread = spread.filter(~is_json | F.col("__e").isNotNull())
    e = F.col("__e")
    one = spread.withColumns({f"__{k}": v for k, v in _entry(e).items()})
    title = _first(e, _keys("titles"))
    song = F.coalesce(text.strip(_first(e, F.array(F.lit("title"), F.lit("name")))), F.lit(""))
    artist = F.coalesce(text.strip(F.try_element_at(e, F.lit("artist"))), F.lit(""))
    both = F.when((song != "") & (artist != "") & ~F.lower(song).contains(F.lower(artist)), F.concat(song, F.lit(" - "), artist)).otherwise(F.coalesce(blank_to_null(song), artist))
    info = blank_to_null(text.strip(F.try_element_at(e, F.lit("info"))))
    one = one.withColumn("__title", F.when(F.col("__parser") == "dudu_song_data", F.coalesce(info, both)).otherwise(title))

    # Payloads of free structure, a row per URL; the Arrow function also parts the generated code in two.
    one = one.withColumn("__p", payload_fields(F.when(is_free, F.col("payload")).otherwise("")))
    links = F.when(is_free, F.array_distinct(F.filter(F.transform(F.col("__p")["urls"], text.clean_url), lambda u: u != "")))
    one = one.withColumn("__links", links).select("*", F.posexplode_outer("__links").alias("__j", "__u")).filter(~is_free | F.col("__u").isNotNull())
    one = one.withColumn("__parts", text.title_parts(F.coalesce(F.when(is_free, F.col("__p")["title"]).otherwise(F.col("__title")), F.lit(""))))
    p, parts, number = F.col("__p"), F.col("__parts"), F.col("__number")

    seconds = F.coalesce(F.col("seconds"), F.try_element_at(e, F.lit("duration")).try_cast("double"))
    stub = F.concat(_of_form(lambda f: F.lit(urls.WANNA_URL if f.system == urls.WANNA else urls.DUDU_URL)), number)
    read = {
        "event_type": F.lit("metadata"), "parser_name": F.col("__parser"), "video_url": F.coalesce(text.clean_url(F.col("__link")), stub), "display_name": F.col("__name"), "video_name": parts["name"],
        "video_id": F.coalesce(blank_to_null(number), parts["id"]), "requester_marker": parts["marker"], "source_hint": F.when(F.col("__random"), "random"), "duration_seconds": seconds,
        "duration_source": F.when(seconds.isNotNull(), _of_form(lambda f: F.lit(f.duration_source))),
    }
    marker, running, length = parts["marker"], p["video_offset"] > 0, text.real_duration(p["duration"])
    is_random = F.lower(marker) == "random"
    free = {
        "event_type": F.when(running, "playback-progress").otherwise("request"), "parser_name": F.col("__parser"), "world_parser": F.col("world"), "video_url": F.col("__u"),
        "display_name": F.when(marker.isNotNull() & ~is_random, marker).otherwise(text.clean_name(p["display_name"])), "video_name": F.coalesce(parts["name"], text.clean_name(p["structured_name"])),
        "video_id": F.coalesce(parts["id"], p["structured_id"]), "requester_marker": marker, "requester_user_id": p["user_id"], "requester_user_id_source": F.when(p["user_id"].isNotNull(), "payload"),
        "source_hint": F.when(is_random, "random").when(marker.isNotNull(), "requester_marker"), "actual_play_method": F.when(running, "vrcx_progress_offset"),
        "video_offset_seconds": p["video_offset"], "duration_seconds": length, "duration_source": F.when(length.isNotNull(), "vrcx_payload"),
    }
    fine = F.when(is_json, (number != "") | F.col("__link").isNotNull()).otherwise(is_free | F.col("direct").isNotNull())
    place = (F.col("rank") * 1_000_000 + F.coalesce("__k", F.lit(0)) * 1_000 + F.coalesce("__j", F.lit(0))).cast("int")

    # Each kind of form in its own way; the struct is a lambda's, so Spark does not repeat it for each of its fields.
    told = once(is_free, lambda is_payload: F.when(is_json, _signal(**read)).when(is_payload, _signal(**free)).otherwise(F.col("direct")))
    found = one.filter(fine).select(*base, place.alias("ordinal"), told.alias("__told"), "raw_line").select(*base, "ordinal", "__told.*", "raw_line")
    link = F.coalesce(blank_to_null(F.col("video_url")), F.col("routed_url"))
    named = found.withColumn("__known", urls.classify_url(link))
    progress, known = F.col("event_type") == "playback-progress", F.col("__known")
    return named.withColumns({
        "canonical_key": urls.key_of(link, known), "system_key": known["system"], "external_id": known["external_id"], "url_kind": known["url_kind"],
        "actual_play_at": F.when(progress, timestamps.back_dated(F.col("at"), F.col("video_offset_seconds"))),
    }).drop("__known")


def parse_lifecycle(lines: DataFrame) -> DataFrame:
    """Room and application events: source_file, line_number, byte_offset, at, event_type, room_name."""
    plain = text.without_colour_tags(F.col("value"))
    # Forms of lines.
    room = r"(?i)\[Behaviour\]\s+Entering Room:\s*(.+?)\s*$"
    kind = (
        F.when(plain.rlike(r"(?i)\[Behaviour\]\s+OnLeftRoom\b"), "room-left").when(plain.rlike(room), "room-entering")
        .when(plain.rlike(r"(?i)\bVRCApplication:\s+HandleApplicationQuit\b"), "application-quit").when(plain.rlike(r"(?i)\[AVProVideo\]\s+Shutdown\b"), "video-shutdown")
    )
    at = timestamps.wall_clock(timestamps.line_stamp(F.col("value")))
    kept = lines.filter(holds_any(plain, LIFECYCLE_TOKENS))
    found = kept.select("source_file", "line_number", "byte_offset", at.alias("at"), kind.alias("event_type"), F.when(kind == "room-entering", text.clean_name(F.regexp_extract(plain, room, 1))).alias("room_name"))
    return found.filter("event_type is not null")


def parse_identity(lines: DataFrame) -> DataFrame:
    """Who is who: source_file, line_number, byte_offset, at, event_type, display_name, user_id."""
    plain = text.without_colour_tags(F.col("value"))
    # Fixed value: forms of lines.
    who = r"(?i)(?:\[Behaviour\]\s+OnPlayer(Joined|Left)|User Authenticated:)\s+(.+?)\s+\((usr_[^)]+)\)"
    action = F.lower(F.regexp_extract(plain, who, 1))
    kind = F.when(action == "joined", "player-joined").when(action == "left", "player-left").otherwise("user-authenticated")
    at = timestamps.wall_clock(timestamps.line_stamp(F.col("value")))
    kept = lines.filter(holds_any(plain, IDENTITY_TOKENS)).filter(plain.rlike(who))
    found = kept.select("source_file", "line_number", "byte_offset", at.alias("at"), kind.alias("event_type"), text.clean_name(F.regexp_extract(plain, who, 2)).alias("display_name"), F.trim(F.regexp_extract(plain, who, 3)).alias("user_id"))
    return found.filter("display_name is not null and user_id <> ''")


def session_rows(lines: DataFrame, session: Column) -> DataFrame:
    """All that the fold reads, in one schema: per line its stamp, then lifecycle, identity and signals.

    ``stage`` and ``ordinal`` order the rows of a line.
    """
    def shaped(frame: DataFrame, stage: int) -> DataFrame:
        return frame.withColumn("stage", F.lit(stage))

    stamped = lines.select("source_file", "line_number", timestamps.wall_clock(timestamps.line_stamp(F.col("value"))).alias("at")).filter("at is not null")
    both = shaped(stamped.withColumn("event_type", F.lit("clock")), 0)
    for stage, frame in ((1, parse_lifecycle(lines)), (2, parse_identity(lines).withColumnRenamed("user_id", "requester_user_id")), (3, parse_signals(lines).drop("raw_line"))):
        both = both.unionByName(shaped(frame, stage), allowMissingColumns=True)
    return both.withColumns({"session": session, "ordinal": F.coalesce("ordinal", F.lit(0))})
