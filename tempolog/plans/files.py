"""Sources and sinks that are files: made from tables by Spark, read or mirrored, and compared with what they were made from."""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import sinks
from ..operators.staging import staged_path
from ..operators.versions import VersionedTable
from ..sinks import mirror
from ..sources import foreign, logs, ranges
from .tables import events, query, table

DATABASES = 4


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share, by the path at which all of them see it."""
    place = urlparse(staged_path(spark, name))
    if place.scheme not in ("", "file"):
        raise ValueError(f"files of {name} need a mounted folder, not {place.scheme}")
    return place.path


def _to_end(writer: DataStreamWriter) -> None:
    """Run a stream until nothing is left."""
    running = writer.start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()


def _in_two_parts(spark: SparkSession, d: str, run: Callable[[str], None]) -> None:
    """Write a line per event to text files of a folder, in two parts, and call ``run`` with the folder after each."""
    folder = _folder(spark, "lines")
    line = F.concat_ws(",", "event_id", "event_type", "user_id").alias("value")
    for part in (0, 1):
        events(spark, d).filter(F.col("event_id") % 2 == part).select(line).write.mode("append").text(folder)
        run(folder)


def _parsed(lines: DataFrame) -> DataFrame:
    fields = F.split("value", ",")
    return lines.select(fields[0].cast("long").alias("event_id"), fields[1].alias("event_type"), fields[2].cast("long").alias("user_id"))


@query("s1_log_ranges", "SELECT event_id, event_type, user_id FROM events")
def s1(spark: SparkSession, d: str) -> DataFrame:
    """Lines of growing folders, read by executors in ranges of bytes; the stream stops and goes on in between."""
    spark.dataSource.register(ranges.LogRanges)
    out, checkpoint = staged_path(spark, "ranged-lines"), staged_path(spark, "checkpoint")

    def run(folder: str) -> None:
        read = spark.readStream.format("log_ranges").options(path=folder, prefix="part-", from_start="true").load()
        _to_end(read.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint))

    _in_two_parts(spark, d, run)
    return _parsed(spark.read.schema(logs.LINES).parquet(out))


@query("k3_mirror", "SELECT event_id, event_type, user_id FROM events")
def k3(spark: SparkSession, d: str) -> DataFrame:
    """What comes out of a byte-exact archive of growing files, made by a stream that stops and goes on."""
    archive, checkpoint = _folder(spark, "archive"), staged_path(spark, "checkpoint")
    _in_two_parts(spark, d, lambda folder: _to_end(mirror.mirror(spark, folder, archive, checkpoint, prefix="part-")))
    return _parsed(spark.read.text(archive, pathGlobFilter="part-*"))


@query("s6_history", """SELECT event_id * 1000 AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, 'http://x/' || user_id AS video_url, 'P' || (user_id % 7) AS display_name
FROM events WHERE event_type NOT IN ('error', 'signup')""")  # fmt: skip
def s6(spark: SparkSession, d: str) -> DataFrame:
    """Histories in several databases with sparse row ids; rows whose URL is empty or missing stay there."""
    folder = _folder(spark, "databases")
    url = F.when(F.col("event_type") == "error", "").when(F.col("event_type") != "signup", F.concat(F.lit("http://x/"), F.col("user_id").cast("string")))
    rows = events(spark, d).select(
        (F.col("event_id") * 1000).alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), url.alias("video_url"), F.concat(F.lit("P"), (F.col("user_id") % 7).cast("string")).alias("display_name"),
    )

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A database of the rows; it has its name once it is whole."""
        os.makedirs(folder, exist_ok=True)
        made = os.path.join(folder, uuid.uuid4().hex)
        base = sqlite3.connect(made)
        base.execute(f"CREATE TABLE {foreign.TABLE} (id INTEGER PRIMARY KEY, created_at TEXT, video_url TEXT, display_name TEXT)")
        n = 0
        for batch in batches:
            base.executemany(f"INSERT INTO {foreign.TABLE} VALUES (?, ?, ?, ?)", batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None))
            n += len(batch)
        base.commit()
        base.close()
        if n:
            yield pd.DataFrame({"made": [made]})

    made = [r["made"] for r in rows.repartition(DATABASES, "id").mapInPandas(fill, "made string").collect()]
    frames = {os.path.basename(path): foreign.read_history(spark, path, columns=["id", "created_at", "video_url", "display_name"]) for path in made}
    return foreign.union_roots(frames).drop("root") if frames else rows.limit(0)


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events that arrive in files, a few at a time."""
    folder = staged_path(spark, "arriving")
    rows = events(spark, d).select("event_id", "event_type", "user_id")
    rows.repartition(4, "event_id").write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("k1_json_lines", "SELECT event_id, event_type, user_id FROM events")
def k1(spark: SparkSession, d: str) -> DataFrame:
    """A stream appended to JSON lines, read back."""
    path = staged_path(spark, "json-lines")
    _to_end(sinks.append_jsonl(_event_stream(spark, d), path, staged_path(spark, "checkpoint")))
    return spark.read.schema("event_id long, event_type string, user_id long").json(path)


@query("k20_newest", "SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 50")
def k20(spark: SparkSession, d: str) -> DataFrame:
    """The newest fifty rows that a stream publishes after its last batch."""
    told: list[list[dict]] = []
    _to_end(sinks.newest(_event_stream(spark, d), "event_id", 50, told.append, staged_path(spark, "checkpoint")))
    return spark.createDataFrame([(r["event_id"], r["event_type"], r["user_id"]) for r in told[-1]] if told else [], "event_id long, event_type string, user_id long")


@query("k22_merged_batches", "SELECT user_id, max(event_id) AS last_event, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def k22(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user, merged into a versioned table batch by batch; a batch that comes twice changes nothing."""
    base = VersionedTable(spark, staged_path(spark, "last-events"))
    last = F.max_by(F.struct(F.col("event_id").alias("last_event"), "event_type"), "event_id").alias("s")

    def merge(batch: DataFrame) -> None:
        latest = batch.groupBy("user_id").agg(last).select("user_id", "s.*")
        for _ in range(2):
            now = base.version()
            both = base.read("rows", latest.schema, now).unionByName(latest)
            base.replace("rows", both.groupBy("user_id").agg(F.max_by(F.struct("last_event", "event_type"), "last_event").alias("s")).select("user_id", "s.*"), now)

    _to_end(sinks.merge_batches(_event_stream(spark, d), merge, staged_path(spark, "checkpoint")))
    return base.read("rows", events(spark, d).select("user_id", F.col("event_id").alias("last_event"), "event_type").schema)


@query("k21_versions", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE o_orderpriority END AS state, o_orderkey % 2 AS batch FROM orders""")
def k21(spark: SparkSession, d: str) -> DataFrame:
    """Numbered commits, one of them sent twice, a rewrite of a version while rows are added, a restored and an archived version."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("state"), (F.col("o_orderkey") % 2).alias("batch"), "o_orderstatus")
    base = VersionedTable(spark, staged_path(spark, "orders"))
    rewritten = F.when(F.col("o_orderstatus") == "F", "final").otherwise(F.col("state"))
    even, odd = orders.filter("batch = 0"), orders.filter("batch = 1")
    base.append("rows", even, "loader", 0)
    first = base.append("rows", even, "loader", 0)
    part = base.write("rows", base.read("rows", orders.schema, first).withColumn("state", rewritten))
    base.append("rows", odd.withColumn("state", rewritten), "loader", 1)  # comes in between
    good = base.swap({"rows": part}, first)
    base.replace("rows", orders.limit(0), good)  # a mistake
    base.restore(good.number)
    base.vacuum(keep=2)
    kept = base.archive(staged_path(spark, "orders-archive"))
    return kept.read("rows", orders.schema).select("o_orderkey", "state", "batch")
