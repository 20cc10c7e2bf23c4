import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tempolog import sinks
from tempolog.operators import diffs, operations, order
from tempolog.sources import foreign, logs


def test_nested_volatile_fields_go(spark):
    kind = "id long, at string, e struct<at: string, v: long, list: array<struct<at: string, w: long>>, m: map<string, struct<at: string, x: long>>, only: struct<at: string>>"
    rows = [(1, "a", ("b", 2, [("c", 3), None], {"at": ("d", 4), "k": ("e", 5)}, ("f",))), (2, None, None)]
    found = diffs.stable(spark.createDataFrame(rows, kind), ("at",))
    one, two = found.orderBy("id").collect()
    assert one.asDict(recursive=True) == {"id": 1, "e": {"v": 2, "list": [{"w": 3}, None], "m": {"k": {"x": 5}}, "only": None}}
    assert two.asDict(recursive=True) == {"id": 2, "e": None}
    other = [(1, "z", ("z", 2, [("z", 3), None], {"at": None, "k": ("z", 5)}, None)), (2, "z", None)]
    assert [r.asDict(recursive=True) for r in diffs.stable(spark.createDataFrame(other, kind), ("at",)).orderBy("id").collect()] == [r.asDict(recursive=True) for r in (one, two)]


def test_tables_are_looked_for(spark, tmp_path):
    path = str(tmp_path / "h.sqlite")
    base = sqlite3.connect(path)
    base.execute("CREATE TABLE other (id INTEGER)")
    base.commit()
    base.close()
    assert foreign.has_tables(path) and foreign.has_tables(path, "other") and not foreign.has_tables(path, "other", foreign.TABLE)
    assert not foreign.has_tables(str(tmp_path / "none.sqlite"), "other")
    (tmp_path / "text").write_text("no database at all, but long enough to be read as one" * 20)
    assert not foreign.has_tables(str(tmp_path / "text"), "other")
    with pytest.raises(ValueError, match="no table"):
        foreign.read_history(spark, path)


def test_json_lines(spark, tmp_path, rows):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2, "b": "x"}\n')
    assert rows(logs.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a long, b string")) == [(1, None), (2, "x")]
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nbroken\n')
    with pytest.raises(Exception, match="alformed"):
        logs.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a long").collect()


@pytest.mark.parametrize("most", ["37", "1000000"])
def test_files_are_read_in_ranges(spark, tmp_path, most):
    """Numbers and offsets are those of the whole file, however it is cut."""
    bodies = {"output_log_1.txt": b"".join(b"line %d %s\r\n" % (k, b"x" * (k % 23)) for k in range(60)) + b"last", "output_log_2.txt": b"\n\nbad \xff end\n", "output_log_3.txt": b"", "other.txt": b"no\n"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = sorted((r["source_file"].rsplit("/", 1)[1], r["line_number"], r["byte_offset"], r["value"]) for r in logs.replay(spark, str(tmp_path)).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    expected = []
    for name in sorted(bodies)[1:]:
        at = 0
        for number, line in enumerate(bodies[name].splitlines(keepends=True), 1):
            expected.append((name, number, at, line.rstrip(b"\r\n").decode("utf-8", errors="replace")))
            at += len(line)
    assert found == expected


def test_a_stream_stops_when_idle_or_full(spark, tmp_path):
    for k in range(4):
        spark.range(5 * k, 5 * k + 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def started(name):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        counted = stream.observe("seen", F.count(F.lit(1)).alias("rows"), F.count_if(F.col("id") % 2 == 0).alias("even"))
        return counted.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()

    idle = logs.run_until(started("idle"), idle_seconds=4)
    assert (idle["rows"], idle["batches"], idle["observed"]) == (20, 4, {"rows": 20, "even": 10})
    assert json.loads(logs.summary(idle))["rows"] == 20
    full = started("full")
    assert logs.run_until(full, most_rows=5)["rows"] >= 5 and not full.isActive


def test_the_newest_rows_outlive_a_restart(spark, tmp_path):
    told = []

    def run():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        sinks.newest(stream, "id", 3, told.append, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)

    spark.range(10, 14).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    spark.range(3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert [[r["id"] for r in rows] for rows in told] == [[13, 12, 11], [13, 12, 11]]


def test_csv_begins_with_a_mark(spark, tmp_path):
    sinks.write_catalog(spark.createDataFrame([(1, "Ü")], "id long, title string").coalesce(1), str(tmp_path))
    (part,) = (tmp_path / "csv").glob("part-*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,title")
    assert spark.read.json(str(tmp_path / "json")).columns == ["id", "title"]


HISTORY = [
    (1, "2024-01-01T00:00:00Z", "http://api.udon.dance/Api/Songs/play?id=7", "7 : Song", "", "", "Ann", "usr_a"), (2, "2024-01-01T00:00:00Z", "http://api.udon.dance/Api/Songs/play?id=7", "7 : Song", "", "", "", ""),
    (3, "2024-01-01T00:05:00Z", "https://example.org/x", "x", "", "", "Ann", "usr_a"), (4, "2024-01-01T00:06:00Z", "http://api.udon.dance/Api/Songs/play?id=8", "8 : Other", "", "", "Me", "usr_me"),
]


def test_imports_are_idempotent_and_can_be_dry(spark):
    history = spark.createDataFrame(HISTORY, foreign.HISTORY)
    dry = operations.import_history(history, None, None, "usr_me", dry_run=True)
    assert dry.evidence.count() == 0 and dry.counts.first().asDict() == {"scanned": 4, "skipped_unsupported": 1, "inserted": 2, "updated": 0}
    once = operations.import_history(history, None, None, "usr_me")
    assert {(r["external_id"], r["request_type"], r["requester_user_id"], r["action"]) for r in once.evidence.collect()} == {("7", "other", "usr_a", "inserted"), ("8", "self", "usr_me", "inserted")}
    again = operations.import_history(history, once.staging, once.evidence, "usr_me")
    assert {r["action"] for r in again.evidence.collect()} == {"unchanged"}
    empty = operations.import_history(history.limit(0), once.staging, once.evidence, "usr_me")
    assert empty.evidence.count() == 2 and empty.counts.first()["scanned"] == 0


def test_rebuild_and_sync(spark, rows):
    kind = "evidence_key long, status string, requester_user_id string"
    a, b = spark.createDataFrame([(1, "x", "u"), (2, "x", None)], kind), spark.createDataFrame([(1, "y", "v"), (3, "y", None)], kind)
    assert rows(operations.rebuild([a, b])) == [(1, "y", "u"), (2, "x", None), (3, "y", None)]
    catalog, songs = (spark.createDataFrame(r, "song_key string, title string, players int") for r in ([("a", "A", 1), ("b", "B", 2)], [("a", "", 0), ("c", "C", None)]))
    assert rows(operations.sync_catalog(catalog, songs, ("players",)).drop("action")) == [("a", "A", 0), ("b", "B", 2), ("c", "C", None)]


def test_places_in_parts_are_those_of_one_order(spark, rows):
    """Nulls, ties, a key that a third of the rows hold, columns with clashing names, more parts than rows, and no rows."""
    values = [(None if k % 10 == 0 else "hot" if k % 3 == 0 else f"v{k * 7 % 50}", k, k % 4) for k in range(3000)]
    table = spark.createDataFrame(values, "name string, id long, `k0` long").repartition(5)
    expected = sorted(values, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    for parts in (1, 7, 40):
        found = order.numbered(table, ["name", F.col("id")], parts=parts)
        assert found.columns == [*table.columns, "place"]
        assert [tuple(r) for r in found.orderBy("place").collect()] == [(*r, k + 1) for k, r in enumerate(expected)]
    few = order.numbered(table.filter("id < 3"), ["id"])
    assert rows(few.select("id", "place")) == [(0, 1), (1, 2), (2, 3)]
    assert rows(order.numbered(table.filter("id < 0"), ["id"])) == []
    ties = order.numbered(table.select(F.lit("same").alias("name")), ["name"])
    assert [r["place"] for r in ties.orderBy("place").collect()] == list(range(1, 3001))


def test_numbering_uses_many_parts(spark):
    table = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("id"))
    assert order.numbered(table, ["id"]).filter("place <> id + 1").isEmpty()
    plan = order.numbered(table, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(__part" in plan


def test_a_row_is_not_held_against_all_limits(spark):
    """Only the limits themselves are cut out of a list by a lambda, once; rows find theirs by halving."""
    table = spark.range(2000).withColumn("name", F.when(F.col("id") % 7 > 0, (F.col("id") * 31 % 1999).cast("string")))
    wanted = {r["id"]: k + 1 for k, r in enumerate(sorted(table.collect(), key=lambda r: (r["name"] is not None, r["name"] or "", r["id"])))}
    for parts in (1, 2, 3, 40, 256):
        assert {r["id"]: r["place"] for r in order.numbered(table, ["name", "id"], parts=parts).collect()} == wanted
    plan = order.numbered(table, ["name", "id"])._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "lambda" in line and not line.startswith(":") and " : " not in line.split("lambda")[0]]
