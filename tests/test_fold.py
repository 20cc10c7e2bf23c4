import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tempolog.operators import staging
from tempolog.sources import logs, parse
from fold_by_hand import Session
from tempolog.streaming import boundaries, identity, occurrences, sessions, slices

SONG = "http://api.udon.dance/Api/Songs/play?id="
BASE = dt.datetime(2024, 1, 1, 15, 30)


def line(second, said):
    stamp = (BASE + dt.timedelta(seconds=second)).strftime("%Y.%m.%d %H:%M:%S")
    return f"{stamp} Log        -  {said}"


def queue(song, user, seconds):
    return f'[VideoQueueManager] x: DeserializeVideoUserData: userData = {{"songId": {song}, "title": "{song}. Song", "playerName": "{user}", "duration": {seconds}}}'


def start(song):
    return f"[USharpVideo] OnVideoStart: Started video: {SONG}{song}"


def frame(spark, said, name="a.txt"):
    return spark.createDataFrame([(name, k + 1, 0, v) for k, v in enumerate(said)], logs.LINES)


Q, U, S = queue, "User {} added URL " + SONG + "{}", start
ROOM, JOINED, LEFT = "[Behaviour] Entering Room: X", "[Behaviour] OnPlayerJoined {0} (usr_{0})", "[Behaviour] OnLeftRoom"
PLAYED = [(0, Q(7, "Ann", 100)), (1, U.format("Ann", 7)), (2, S(7))]
EARLIER = [(0, ROOM), (1, JOINED.format("Ann")), (5, LEFT), (10, ROOM), (12, U.format("Ann", 7))]
PREVIEW = f"[VideoListManager] PreviewVideo: 7 {SONG}7"
ENDINGS = {"room_left": LEFT, "application_quit": "VRCApplication: HandleApplicationQuit", "video_shutdown": "[AVProVideo] Shutdown", "superseded_before_completion": S(8)}
#: Sessions by name; those whose name begins with "open" are looked at before their end.
SESSIONS = {
    "open delay": [(0, Q(3114, "Ann", 200)), (1, U.format("Ann", 3114)), (11, S(3114))],
    "open short": [*PLAYED, (81, "tick")],
    "open enough": [*PLAYED, (82, "tick")],
    **{f"open {reason}": [*PLAYED, (30, said)] for reason, said in ENDINGS.items()},
    "again": [(0, U.format("Ann", 7)), (2, S(7)), (60, U.format("Bob", 7))],
    "absorbed": [(0, U.format("Ann", 7)), (600, U.format("Bob", 7))],
    "muted": [(0, PREVIEW), (5, S(7))],
    "unmuted": [(0, PREVIEW), (5, U.format("Ann", 7)), (9, S(7))],
    "mute over": [(0, PREVIEW), (91, S(7))],
    "mid-play": [(100, f'[VRCX] VideoPlay(W) "{SONG}7",40,200,"7 : Song (Ann)"')],
    "room": [(0, ROOM), (1, JOINED.format("Ann")), (2, U.format("Ann", 7)), (3, U.format("Bob", 8)), (9, JOINED.format("Bob"))],
    "open too early": [*EARLIER, (69, "tick")],
    "open graced": [*EARLIER, (70, "tick"), (71, "tick")],
    "due": [(0, U.format("Ann", 7)), (4, "[USharpVideo] Video loaded (2.5 seconds), but let's wait for 6 seconds before playing it"), (10, "[USharpVideo] DelayedVideoReady: Time's up, let's play")],
    "better": [(0, Q(7, "Ann", 200)), (1, U.format("Ann", 7)), (2, '[VideoQueueManager] x: PlayQueueVideo: a userData = {"songId": 7}, videoDuration = 180.5')],
    "open stream": [*PLAYED, (40, U.format("Bob", 8)), (90, S(8)), (95, LEFT)],
    "open busy": [(k * 3, S(k % 4) if k % 2 else U.format(f"P{k % 5}", k % 4)) for k in range(60)],
}


@pytest.fixture(scope="module")
def signals(spark, tmp_path_factory):
    lines = [(name, k + 1, 0, line(t, said)) for name, rows in SESSIONS.items() for k, (t, said) in enumerate(rows)]
    path = str(tmp_path_factory.mktemp("rows"))
    parse.session_rows(spark.createDataFrame(lines, logs.LINES), F.col("source_file")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def folded(signals):
    found: dict[str, list[dict]] = {name: [] for name in SESSIONS}
    for begins, finish in ((F.col("session").startswith("open"), False), (~F.col("session").startswith("open"), True)):
        for r in occurrences.fold(signals.filter(begins), finish=finish).collect():
            found[r["session"]].append(r.asDict())
    return {name: sorted(rows, key=lambda o: o["event_key"]) for name, rows in found.items()}


def test_one_occurrence_with_its_delay(folded):
    (o,) = folded["open delay"]
    assert (o["event_key"], o["delay_to_actual_seconds"], o["completion_status"]) == ("wannadance:3114#1", 10.0, "pending")
    assert (o["source_type"], o["source_display_name"], o["duration_seconds"]) == ("player", "Ann", 200.0)


def test_completion_needs_most_of_the_song(folded):
    assert folded["open short"][0]["completion_status"] == "pending"
    (o,) = folded["open enough"]
    assert (o["completion_status"], o["played_seconds"], o["required_seconds"]) == ("completed", 80.0, 80.0)


@pytest.mark.parametrize("reason", ENDINGS)
def test_what_ends_a_song(folded, reason):
    first = next(o for o in folded[f"open {reason}"] if o["canonical_key"] == "wannadance:7")
    assert (first["completion_status"], first["completion_reason"], first["played_seconds"]) == ("interrupted", reason, 28.0)


def test_a_played_song_requested_again_is_a_new_occurrence(folded):
    assert [o["event_key"] for o in folded["again"]] == ["wannadance:7#1", "wannadance:7#2"]


def test_an_unplayed_request_absorbs_a_later_one_unless_strict(folded, signals):
    assert len(folded["absorbed"]) == 1
    assert occurrences.fold(signals.filter("session = 'absorbed'"), strict_boundary=True).count() == 2


def test_previews_mute_a_song(folded):
    assert [len(folded[n]) for n in ("muted", "unmuted", "mute over")] == [0, 1, 1]


def test_progress_begun_before_it_was_seen_is_mid_play(folded):
    (o,) = folded["mid-play"]
    assert (o["observed_mid_play"], o["elapsed_at_first_seen_seconds"], o["delay_to_actual_seconds"], o["completion_reason"]) == (True, 40.0, None, "observed_mid_play")


def test_a_requester_is_known_from_the_room(folded):
    found = {o["external_id"]: (o["requester_user_id"], o["requester_user_id_source"]) for o in folded["room"]}
    assert found == {"7": ("usr_Ann", "active"), "8": ("usr_Bob", "active")}


def test_names_of_an_earlier_room_count_after_a_while(folded):
    assert folded["open too early"][0]["requester_user_id"] is None
    (o,) = folded["open graced"]
    assert (o["requester_user_id"], o["requester_user_id_source"]) == ("usr_Ann", "expired")


def test_a_start_without_url_goes_to_what_was_due(folded):
    (o,) = folded["due"]
    assert (o["load_to_actual_seconds"], o["wait_seconds"], o["actual_play_method"]) == (6.0, 6.0, "usharp_delayed_video_ready")


def test_better_sources_of_a_duration_win_and_conflicts_are_kept(folded):
    (o,) = folded["better"]
    assert (o["duration_seconds"], o["duration_source"], len(o["duration_conflicts"])) == (180.5, "wanna_video_duration", 1)


def test_a_stream_ends_as_the_table_does(spark, signals, folded, tmp_path):
    """Each micro-batch tells what it changes; one that is run again changes nothing, and one after a restart goes on."""
    rows = signals.filter("session = 'open stream'")
    last, told = {}, []

    def write(changed, number):
        for r in changed.collect():
            told.append((number, r["event_key"]))
            last[r["event_key"]] = r

    for k in range(3):
        rows.filter(F.col("line_number").isin(2 * k + 1, 2 * k + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        assert sessions.fold_stream(stream, str(tmp_path / "kept"), write, str(tmp_path / "ck")).awaitTermination(180)
    assert {k: r["completion_status"] for k, r in last.items()} == {o["event_key"]: o["completion_status"] for o in folded["open stream"]} == {"wannadance:7#1": "interrupted", "wannadance:8#1": "interrupted"}
    assert {k: r.asDict() for k, r in last.items()} == {o["event_key"]: o for o in folded["open stream"]}
    kept, before = sessions.Kept(spark, str(tmp_path / "kept"), rows.schema), len(told)
    kept.add(rows.limit(1), 2, write)
    assert len(told) == before == len(set(told))
    kept.compact()
    kept.add(rows.limit(0), 7, write)
    assert len(told) == before and len(kept.table.version().parts["rows"]) == 2
    stop = rows.limit(1).withColumns({"event_type": F.lit("stop"), "line_number": F.lit(99).cast("long")})
    kept.add(stop, 8, write)
    kept.compact()
    assert kept.table.read("rows", rows.schema).count() == 0


def test_partitioning_changes_nothing(signals):
    rows = signals.filter("session = 'open busy'")
    one, many = (sorted(map(repr, occurrences.fold(r).collect())) for r in (rows.coalesce(1), rows.repartition(13, "line_number")))
    assert one == many


def test_every_form_of_line(spark):
    said = [
        "[Video Playback] Attempting to resolve URL 'https://youtu.be/a'", "[Video Playback] URL 'https://youtu.be/a' resolved to 'https://cdn/x.mp4'", f"[USharpVideo (1)] PlayVideoInternal: Playing video {SONG}1",
        f"<color=#fff>[USharpVideo]</color> Started video load for URL: {SONG}1, requested by Ann", f"[USharpVideo] LoadRoutedURL: {SONG}1 routed to https://r/1", f"[USharpVideo] Playing synced {SONG}1",
        '[VideoQueueManager] q: OnPreSerialization: queue info serialized: [{"songId":1,"title":"1. A","playerNames":["Ann","Bob"]},{"songId":2,"isRandom":true,"playerNames":["R"]}]',
        '[VideoQueueHandler.OnDeserialization] Queue data = [{"id":0,"title":"T","playerName":"C"}]', '[VideoQueueHandler.DeserializeVideoSongData] deserialize video data: {"id":5,"title":"T","artist":"Q","duration":9}',
        "[VideoQueueHandler.OnVideoPlay] VizVid callback: video playback started", '[VRCX] LSMedia {"url": "https://a/b.", "Display-Name": "Zed", "deep": {"userId": "usr_z"}}', "[Video] nothing of note",
    ]
    found = parse.parse_signals(frame(spark, [line(k, s) for k, s in enumerate(said)])).collect()
    assert [(r["line_number"], r["parser_name"]) for r in sorted(found, key=lambda r: (r["line_number"], r["ordinal"]))] == [
        (1, "video_playback_resolve"), (2, "video_playback_resolved"), (3, "usharp_play_internal"), (4, "usharp_video_load"), (5, "usharp_load_routed_url"), (6, "usharp_playing_synced"), (7, "wannadance_queue_info"),
        (7, "wannadance_queue_info"), (8, "dudu_queue_info"), (9, "dudu_song_data"), (10, "dudu_on_video_play"), (11, "vrcx_lsmedia"),
    ]
    by, places = {}, {}
    for r in sorted(found, key=lambda r: (r["line_number"], r["ordinal"])):
        by[r["line_number"], places.setdefault(r["line_number"], 0)] = r
        places[r["line_number"]] += 1
    assert (by[7, 0]["display_name"], by[7, 1]["display_name"], by[7, 1]["source_hint"]) == ("Ann / Bob", None, "random")
    assert (by[8, 0]["video_id"], by[9, 0]["video_name"], by[9, 0]["duration_seconds"]) == ("0", "T - Q", 9.0)
    assert (by[11, 0]["video_url"], by[11, 0]["display_name"], by[11, 0]["requester_user_id"]) == ("https://a/b", "Zed", "usr_z")
    assert by[4, 0]["display_name"] == "Ann"


def test_a_settled_occurrence_stays_settled():
    state = Session()
    at = BASE
    row = {"source_file": "a", "line_number": 1, "event_type": "on-video-start", "parser_name": "p", "canonical_key": "k:1", "system_key": "k", "external_id": "1", "video_url": "u", "duration_seconds": 10.0, "at": at}
    state.feed({"event_type": "clock", "at": at, "source_file": "a", "line_number": 1})
    state.feed(row)
    state.feed({"event_type": "clock", "at": at + dt.timedelta(seconds=9), "source_file": "a", "line_number": 2})
    state.feed({"event_type": "room-left", "at": at + dt.timedelta(seconds=9), "source_file": "a", "line_number": 2})
    assert [o["completion_status"] for o in state.rows()] == ["completed"]


def test_windows_settle_as_the_fold_does(spark):
    """Sessions of starts with a song of their own, stamps in order: the two ways agree."""
    from tempolog.streaming.settle import settle

    draw = random.Random(4)
    rows, expected = [], {}
    for session in range(12):
        state, second = Session(), 0
        for line_number in range(80):
            second += draw.choice([0, 1, 5, 20])
            at, kind = BASE + dt.timedelta(seconds=second), draw.choice(["start", "clock", "clock", "end"])
            length = draw.choice([0.0, 10.0, 25.0, 60.0])
            number = session * 1000 + line_number
            rows.append((session, int(at.replace(tzinfo=dt.UTC).timestamp() * 1e6), number, kind, number, length))
            place = {"source_file": "a", "line_number": line_number, "at": at}
            state.feed({"event_type": "clock", **place})
            if kind == "start":
                state.feed({"event_type": "on-video-start", "parser_name": "p", "canonical_key": f"k:{number}", "system_key": "k", "external_id": str(number), "video_url": "u", "duration_seconds": length, **place})
            elif kind == "end":
                state.feed({"event_type": "room-left", **place})
        for o in state.rows():
            settled = o.get("settled_at")
            expected[int(o["external_id"])] = (o["completion_status"], settled and int(settled.replace(tzinfo=dt.UTC).timestamp() * 1e6))
    df = spark.createDataFrame(rows, "session long, at_us long, row_id long, kind string, item long, seconds double")
    assert {r["item"]: (r["status"], r["settled_us"]) for r in settle(df).collect()} == expected


ROW = (
    "session string, source_file string, line_number long, stage int, ordinal int, event_type string, parser_name string, at timestamp_ntz, actual_play_at timestamp_ntz, canonical_key string, system_key string, external_id string, "
    "url_kind string, world_parser string, video_url string, routed_url string, resolved_url string, video_id string, video_name string, display_name string, requester_marker string, requester_user_id string, "
    "requester_user_id_source string, source_hint string, actual_play_method string, duration_source string, duration_seconds double, load_seconds double, wait_seconds double, video_offset_seconds double"
)
NAMES = [c.split()[0] for c in ROW.split(", ")]
SIGNALS = (
    ("request", "user_added_url"), ("request", "usharp_play_internal"), ("load-start", "usharp_video_load"), ("resolve-attempt", "video_playback_resolve"), ("resolve-complete", "video_playback_resolved"),
    ("route", "usharp_load_routed_url"), ("on-video-start", "usharp_on_video_start"), ("playback-sync", "usharp_playing_synced"), ("preview", "wannadance_preview"), ("metadata", "wannadance_queue_info"),
    ("metadata", "wannadance_play_video"), ("playback-progress", "vrcx_video_play"), ("actual-play", "dudu_on_video_play"), ("actual-play", "usharp_delayed_video_ready"), ("video-loaded", "usharp_video_loaded"),
)


def random_session(seed, n, in_order):
    """Rows of all kinds of three songs, of which one is of no known system, three people and their rooms."""
    draw, t, rows = random.Random(seed), 0, []
    for k in range(n):
        t += draw.choice([0, 0, 1, 5, 20, 31, 60]) if in_order or draw.random() < 0.8 else -draw.choice([1, 10, 40])
        place = {"source_file": "a", "line_number": k, "at": BASE + dt.timedelta(seconds=t), "session": str(seed), "ordinal": 0}
        rows.append(place | {"event_type": "clock", "stage": 0})
        kind = draw.random()
        if kind < 0.2:
            rows.append(place | {"stage": 1, "event_type": draw.choice(["room-left", "room-left", "application-quit", "video-shutdown"] if kind < 0.08 else ["room-entering"])})
        elif kind < 0.35:
            who = draw.choice("ABC")
            rows.append(place | {"stage": 2, "event_type": draw.choice(["player-joined", "player-joined", "player-left", "user-authenticated"]), "display_name": who, "requester_user_id": "usr_" + who + draw.choice("12")})
        else:
            song, (event, parser) = draw.randrange(3), draw.choice(SIGNALS)
            row = place | {"stage": 3, "event_type": event, "parser_name": parser}
            if event == "video-loaded":
                row |= {"load_seconds": 1.5, "wait_seconds": draw.choice([None, 2.0, 6.0])}
            elif event != "actual-play":
                row |= {"canonical_key": f"k:{song}", "video_url": f"u{song}{draw.choice('xyz')}"} | ({"system_key": "k", "external_id": str(song)} if song != 2 else {})
            if event == "playback-progress":
                offset = draw.choice([1.0, 30.0])
                row |= {"actual_play_at": place["at"] - dt.timedelta(seconds=offset), "video_offset_seconds": offset, "actual_play_method": "vrcx_progress_offset"}
            if event in ("request", "metadata", "load-start", "playback-progress") and draw.random() < 0.6:
                row["display_name"] = draw.choice(["A", "B", "C", "random"])
            if (event == "metadata" or parser == "vrcx_video_play") and draw.random() < 0.7:
                row |= {"duration_seconds": draw.choice([0.0, 5.0, 20.0, 60.0]), "duration_source": draw.choice(["wanna_queue_json", "wanna_video_duration", "vrcx_payload"]), "video_name": draw.choice([None, "N1", "N2"])}
                if draw.random() < 0.3:
                    row |= {"requester_user_id": "usr_p", "requester_user_id_source": "payload"}
            rows.append(row)
    return rows


@pytest.mark.parametrize(("in_order", "strict", "finish", "slice_rows"), [(True, False, True, 10**6), (False, True, False, 10**6), (False, False, True, 300)])
def test_random_sessions_fold_as_told_row_by_row(spark, in_order, strict, finish, slice_rows):
    """One long session and many short ones, whole and cut into slices, with stamps in order and not."""
    rows, expected = [], {}
    for seed in range(16):
        own = random_session(seed, 120 if seed == 0 else 40, in_order)
        rows += own
        state = Session(strict)
        for row in own:
            state.feed(dict.fromkeys(NAMES) | row)
        if finish:
            state.finish()
        expected |= {(str(seed), o["event_key"]): o for o in state.rows()}
    table = spark.createDataFrame([tuple(r.get(c) for c in NAMES) for r in rows], ROW).repartition(4)
    found = {(r["session"], r["event_key"]): r.asDict(recursive=True) for r in occurrences.fold(table, finish, strict, slice_rows).collect()}
    assert found.keys() == expected.keys() and len(found) > 100
    for key, o in found.items():
        for name in occurrences.COLUMNS:
            if name not in ("session", "duration_conflicts"):
                assert o[name] == (pytest.approx(expected[key].get(name)) if isinstance(o[name], float) else expected[key].get(name)), (key, name)


def test_a_session_is_not_one_task(spark):
    """All rows of one session: the running values of its slices are made in as many tasks."""
    rows = spark.createDataFrame([tuple(r.get(c) for c in NAMES) for r in random_session(1, 2000, True)], ROW)
    placed = slices.sliced(rows, ["session", "source_file", "line_number", "stage", "ordinal"], slice_rows=200)
    held = [r["count"] for r in placed.groupBy("slice").count().collect()]
    assert len(held) > 10 and max(held) < placed.count() / 5
    ran = slices.scan(placed, ["session"], {"n": slices.Run("sum", F.lit(1)), "last": slices.Run("last", F.col("canonical_key"), own=False), "next": slices.Run("first", F.col("place"))})
    seen = None
    for r in ran.orderBy("place").collect():
        assert (r["n"], r["last"], r["next"]) == (r["place"], seen, 1)
        seen = r["canonical_key"] or seen


def test_finer_keys_need_no_other_shuffle(spark, rows, monkeypatch):
    """Where no key is large, running values by song and by parts of it are one shuffle and no join, and the same as in slices."""
    told = spark.createDataFrame([tuple(r.get(c) for c in NAMES) for r in random_session(1, 2000, True)], ROW).filter("canonical_key is not null")
    placed = slices.sliced(told, ["session", "source_file", "line_number", "stage", "ordinal"], slice_rows=200)

    def ran(whole):
        first = slices.scan(placed, boundaries.SONG, {"part": slices.Run("sum", (F.col("event_type") == "request").cast("long"))}, whole=whole)
        return slices.scan(first, [*boundaries.SONG, "part"], {"before": slices.Run("last", F.col("at"), own=False), "latest": slices.Run("max", F.col("at"))}, whole=whole)

    assert rows(ran(True)) == rows(ran(False))
    plan = ran(True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert slices.small(placed, boundaries.SONG, ["session", "line_number"]) == [True, True]
    monkeypatch.setattr(slices, "KEY_ROWS", 100)
    assert slices.small(placed, boundaries.SONG, ["session", "line_number"]) == [False, True]


def test_rows_of_occurrences_need_no_join(spark):
    """From signals and metadata to plays, rows of songs that are not large meet their earlier ones in one shuffle, without slices to put together."""
    told = spark.createDataFrame([tuple(r.get(c) for c in NAMES) for r in random_session(1, 2000, True)], ROW)
    placed = slices.sliced(told, ["session", "source_file", "line_number", "stage", "ordinal"], slice_rows=200)
    heard = boundaries.signals_of(identity.named(identity.in_rooms(boundaries.in_segments(placed))))
    signals = boundaries.occurrences_of(boundaries.attributed(heard.filter("event_type <> 'metadata'")))
    metadata = staging.staged(heard.filter("event_type = 'metadata'"), "metadata")
    own = occurrences.with_plays(occurrences.with_metadata(signals, metadata), True)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert own.count() > 100 and "Join" not in plan and plan.count("Exchange hashpartitioning") <= 2


@pytest.mark.parametrize("in_order", [True, False])
def test_large_keys_fold_in_slices(spark, monkeypatch, in_order):
    """With every key taken for a large one, nothing is run through whole and the fold is the same."""
    monkeypatch.setattr(slices, "KEY_ROWS", 0)
    test_random_sessions_fold_as_told_row_by_row(spark, in_order, False, True, 300)


def test_steps_take_tables_without_rows(spark):
    empty = spark.createDataFrame([], ROW)
    assert occurrences.fold(empty).collect() == []
    assert boundaries.occurrences_of(boundaries.attributed(boundaries.signals_of(boundaries.in_segments(slices.sliced(empty, ["session"]))))).collect() == []
    assert identity.named(identity.in_rooms(slices.sliced(empty, ["session"]))).collect() == []


def test_occurrences_become_records(spark, signals, rows):
    """Times come in their order, songs without key and occurrences without time give none, promotion is idempotent."""
    from tempolog.operators import evidence

    kinds = occurrences.OCCURRENCES
    base = dict.fromkeys(list(occurrences.COLUMNS)) | {"session": "s", "system_key": " Wanna ", "external_id": "7", "completion_status": "pending", "observed_mid_play": False}
    at = {n: BASE + dt.timedelta(seconds=k) for k, n in enumerate(("actual_play_at", "first_seen_at", "last_seen_at"))}
    made = [
        base | at | {"event_key": "a", "completion_status": "completed", "completion_reason": "r", "duration_seconds": 9.0}, base | {"event_key": "b", "first_seen_at": at["first_seen_at"], "last_seen_at": at["last_seen_at"], "completion_status": "interrupted", "completion_reason": "q"},
        base | {"event_key": "c", "last_seen_at": at["last_seen_at"], "display_name": "D"}, base | {"event_key": "d"}, base | at | {"event_key": "e", "external_id": " "},
    ]
    o = spark.createDataFrame([tuple(m[n] for n in list(occurrences.COLUMNS)) for m in made], kinds)
    found = evidence.evidence_records(o)
    assert sorted((r["default_status"], r["status_reason"], r["played_at"], r["system_key"]) for r in found.collect()) == [
        ("accepted", "r", at["actual_play_at"], "wanna"), ("needs_attention", "q", at["first_seen_at"], "wanna"), ("pending", "live_observation_pending", at["last_seen_at"], "wanna"),
    ]
    once = evidence.promote(found.limit(0), o)
    assert [r["action"] for r in once.collect()] == ["inserted"]
    assert [r["action"] for r in evidence.promote(once.drop("action"), o).collect()] == ["unchanged"]
    assert evidence.origins_of(found).select("origin_key").distinct().count() == 3
