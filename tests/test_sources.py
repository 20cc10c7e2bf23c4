import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tempolog.operators import merges
from tempolog.sources import documents, foreign, logs
from tempolog import sinks


def test_replay_numbers_lines(spark, tmp_path):
    (tmp_path / "output_log_1.txt").write_bytes("one\r\ntwo ü\n\xff".encode("latin-1"))
    found = [(r["line_number"], r["byte_offset"], r["value"]) for r in logs.replay(spark, str(tmp_path)).orderBy("line_number").collect()]
    assert found == [(1, 0, "one"), (2, 5, "two �"), (3, 11, "�")]


def test_tail_follows_growth_rotation_and_truncation(tmp_path):
    first = tmp_path / "output_log_1.txt"
    first.write_text("old\n")
    reader = logs.TailReader(str(tmp_path), False, "output_log_", 1 << 20)
    at = reader.initialOffset()
    assert list(reader.read(at)[0]) == []
    with first.open("a") as f:
        f.write("new\nhalf")
    got, at = reader.read(at)
    assert [(r[1], r[3]) for r in got] == [(2, "new")]
    second = tmp_path / "output_log_2.txt"
    second.write_text("next\n")
    got, at = reader.read(at)
    assert [(r[1], r[3]) for r in got] == [(1, "next")]
    again = list(reader.readBetweenOffsets({"file": str(first), "byte": 8, "line": 2}, at))
    assert [r[3] for r in again] == ["next"]
    second.write_text("x\n")
    assert [r[3] for r in reader.read(at)[0]] == ["x"]


def test_tail_reads_long_and_last_lines(tmp_path):
    first, second = tmp_path / "output_log_1.txt", tmp_path / "output_log_2.txt"
    first.write_text("a" * 50 + "\nb\n" + "c" * 30)
    reader = logs.LogTail({"path": str(tmp_path), "from_start": "true", "most_bytes": "8"}).simpleStreamReader(None)
    at, found = reader.initialOffset(), []

    def drain():
        nonlocal at
        while True:
            got, end = reader.read(at)
            got = list(got)
            assert list(reader.readBetweenOffsets(at, end)) == got if got else True
            at = end
            if not got:
                return
            found.extend((r[1], r[3]) for r in got)

    drain()
    assert found == [(1, "a" * 50), (2, "b")]
    second.write_text("next\n")
    drain()
    assert found[2:] == [(3, "c" * 30), (1, "next")]


def test_tail_as_a_stream(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "output_log_1.txt").write_text("a\nb\n")
    spark.dataSource.register(logs.LogTail)
    stream = spark.readStream.format("log_tail").option("path", str(tmp_path / "logs")).option("from_start", "true").load()
    query = stream.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        assert sorted(r["value"] for r in spark.table("tailed").collect()) == ["a", "b"]
    finally:
        query.stop()


def test_history_is_read_in_ranges(spark, tmp_path):
    path = str(tmp_path / "h.sqlite")
    base = sqlite3.connect(path)
    base.execute("CREATE TABLE gamelog_video_play (id INTEGER PRIMARY KEY, created_at TEXT, video_url TEXT, video_name TEXT, video_id TEXT, location TEXT, display_name TEXT, user_id TEXT)")
    base.executemany("INSERT INTO gamelog_video_play (created_at, video_url) VALUES (?, ?)", [(f"2024-01-0{9 - k}", "" if k == 3 else f"u{k}") for k in range(8)])
    base.commit()
    base.close()
    found = foreign.read_history(spark, path, limit=3).collect()
    assert [r["video_url"] for r in found] == ["u7", "u6", "u5"]
    united = foreign.union_roots({"a": foreign.read_history(spark, path), "b": foreign.read_history(spark, path)})
    assert united.groupBy("root").count().count() == 2


def test_catalog_document(spark):
    entries = [{"id": 2, "name": "B", "playerCount": "3"}, {"id": "1", "name": "A"}, {"id": 3, "disablePublic": True}, {"id": None}]
    doc = {"data": {"groups": [{"title": "g", "major": "m", "entries": entries}, {"title": "h", "entries": [{"id": 2, "name": "later"}]}]}}
    df = spark.createDataFrame([(json.dumps(doc),), ("broken",), (None,)], "value string")
    assert [(r["id"], r["name"], r["player_count"], r["song_group"]) for r in documents.flatten_catalog(df).collect()] == [(1, "A", 0, "g"), (2, "B", 3, "g")]


def test_cache_folders(spark, tmp_path):
    for name, body in (("11", '{"title": "T", "volume": "0.5", "flip": true}'), ("x", '{"id": 12}'), ("13", "no json")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text(body)
    found = {r["id"]: (r["title"], r["volume"], r["flip"]) for r in documents.read_cache(spark, str(tmp_path)).collect()}
    assert found == {11: ("T", 0.5, True), 12: ("", None, False)}


@pytest.mark.parametrize("body", ["7\n8\n7\n", "WannaFavorite:7, 8,7"])
def test_favorites(spark, tmp_path, body, rows):
    (tmp_path / "f.txt").write_text(body)
    assert rows(documents.read_favorites(spark, str(tmp_path / "f.txt"))) == [("7", 2), ("8", 1)]


def test_bad_favorites_are_errors(spark, tmp_path):
    (tmp_path / "f.txt").write_text("7\n\n8\n")
    with pytest.raises(Exception, match="not one track id"):
        documents.read_favorites(spark, str(tmp_path / "f.txt")).collect()


def test_unknown_favorites_abort(spark):
    tracks = spark.createDataFrame([("w", "1", False)], "system_key string, external_id string, favorite boolean")
    with pytest.raises(ValueError, match="lacks"):
        merges.set_favorites(tracks, spark.createDataFrame([("9",)], "external_id string"), "w")


def test_planned_lists(spark):
    said = ["intro", "# 2024-01-02", "wanna:12 First wanna:13 Second", "- 14 Third", "15. Fourth", "just words", "2024-01-03", "16 Fifth"]
    df = spark.createDataFrame([("p.md", k, v) for k, v in enumerate(said)], "source_file string, line_number long, value string")
    found = [(str(r["played_date"]), r["system_key"], r["external_id"], r["label"], r["ordinal"]) for r in documents.planned_entries(df, " Dudu ").orderBy("played_date", "ordinal").collect()]
    assert found == [
        ("2024-01-02", "wanna", "12", "First", 1), ("2024-01-02", "wanna", "13", "Second", 2), ("2024-01-02", "dudu", "14", "Third", 3), ("2024-01-02", "dudu", "15", "Fourth", 4),
        ("2024-01-02", None, None, "just words", 5), ("2024-01-03", "dudu", "16", "Fifth", 1),
    ]


def test_previews_and_ground_truth(spark, tmp_path, rows):
    (tmp_path / "a.md").write_text("\n".join(["", *map(str, range(9))]))
    (tmp_path / "b.bin").write_text("x")
    (r,) = documents.previews(spark, str(tmp_path)).collect()
    assert (r["name"], r["lines"]) == ("a.md", list("012345"))
    df = spark.createDataFrame([("9:05 12 (late)",), ("23:10 13",), ("none",)], "value string")
    assert rows(documents.ground_truth(df)) == [("09:05", "12", "late"), ("23:10", "13", None)]


def test_context_before_the_end(spark, rows):
    said = ["[Behaviour] Entering Room: A", "x", "[Behaviour] Entering Room: B", "y", "z"]
    df = spark.createDataFrame([("f", k + 1, 10 * k, v) for k, v in enumerate(said)], logs.LINES)
    assert [r[1] for r in rows(logs.context_lines(df, 40))] == [3, 4]


def test_tables_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in (3, 5):
        assert merges.replace_table(spark.range(n), path).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_merging_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "u")], "evidence_key long, status string, requester_user_id string")
    new = spark.createDataFrame([(2, "c", "v"), (3, "d", None)], "evidence_key long, status string, requester_user_id string")
    once = merges.merge_evidence(old, new)
    assert {r["evidence_key"]: (r["status"], r["requester_user_id"], r["action"]) for r in once.collect()} == {1: ("a", None, "kept"), 2: ("c", "u", "updated"), 3: ("d", None, "inserted")}
    assert {r["action"] for r in merges.merge_evidence(once.drop("action"), new).collect()} == {"kept", "unchanged"}


def test_stream_sinks(spark, tmp_path):
    spark.range(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    told = []
    sinks.newest(stream, "id", 2, told.append, str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(60)
    assert [r["id"] for r in told[-1]] == [5, 4]
    sinks.append_jsonl(stream, str(tmp_path / "out"), str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 6
    df, seen = sinks.counted(spark.range(4), even=F.count_if(F.col("id") % 2 == 0))
    df.write.mode("overwrite").parquet(str(tmp_path / "x"))
    assert seen.get == {"rows": 4, "even": 2}
