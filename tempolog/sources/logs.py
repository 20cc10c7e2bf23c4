"""Log files as lines with their numbers and byte offsets, at rest or as they grow."""

from __future__ import annotations

import datetime as dt
import json
import os
import random
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from ..functions import timestamps

LINES = "source_file string, line_number long, byte_offset long, value string"
#: How much before the end of a growing file is read for the room that it is in.
CONTEXT_BYTES = 4 * 1024 * 1024
PATTERN = "output_log_*.txt"


def replay(spark: SparkSession, paths: str | list[str], pattern: str = PATTERN) -> DataFrame:
    """Lines of finished log files, with their numbers and byte offsets; files are read in ranges, of any size, in parallel.

    Spark cuts files into byte ranges.  Each range numbers its own lines and adds up their bytes as it is read; what
    comes before a range in its file is the sum of the ranges before it, one small row each.
    """
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).text(paths)
    ranges = text.select("value", F.octet_length("value").cast("long").alias("size"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("__block"))
    totals = ranges.groupBy("source_file", "__block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") + 1).alias("bytes"))
    earlier = Window.partitionBy("source_file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("source_file", "__block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}") for c in ("n", "bytes")])
    placed = ranges.mapInArrow(_placed, "source_file string, __block long, line_number long, byte_offset long, value string").join(before, ["source_file", "__block"])
    clean = F.make_valid_utf8(F.regexp_replace("value", "\r+$", ""))
    return placed.select("source_file", (F.col("line_number") + F.col("__n")).alias("line_number"), (F.col("byte_offset") + F.col("__bytes")).alias("byte_offset"), clean.alias("value"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers and offsets of lines within the range of a file that they stand in; a range's lines come in order."""
    here, number, offset = None, 0, 0
    for batch in batches:
        names, starts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        numbers, offsets = [], []
        for size, name, start in zip(batch.column(1).to_pylist(), names, starts, strict=True):
            if (name, start) != here:
                here, number, offset = (name, start), 0, 0
            number += 1
            numbers.append(number)
            offsets.append(offset)
            offset += size + 1
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64()), batch.column(0)], names=["source_file", "__block", "line_number", "byte_offset", "value"])


def _by_newline(raw: bytes) -> list[bytes]:
    parts = raw.split(b"\n")
    lines = [p + b"\n" for p in parts[:-1]]
    return lines + [parts[-1]] if parts[-1] else lines


def read_json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of JSON-lines files; a line that is no JSON object is an error, not a row of nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def in_time_order(lines: DataFrame) -> DataFrame:
    """Lines of all files by stamp, file and line; a line without stamp follows the one before it."""
    at = timestamps.wall_clock(timestamps.line_stamp(F.col("value")))
    carried = F.last(at, ignorenulls=True).over(Window.partitionBy("source_file").orderBy("line_number"))
    return lines.withColumn("at", carried).orderBy("at", "source_file", "line_number")


def sampled_windows(first: dt.datetime, last: dt.datetime, count: int, minutes: int, seed: int) -> list[tuple[dt.datetime, dt.datetime]]:
    """Random stretches of time, the same for a seed; a range join takes their lines."""
    draw = random.Random(seed)
    room = max(0.0, (last - first).total_seconds() - minutes * 60)
    starts = sorted(first + dt.timedelta(seconds=draw.uniform(0, room)) for _ in range(count))
    return [(s, s + dt.timedelta(minutes=minutes)) for s in starts]


def context_lines(lines: DataFrame, before: int, budget: int = CONTEXT_BYTES) -> DataFrame:
    """Lines of each file before an offset that fit the budget, from the last room entry on."""
    tail = lines.filter((F.col("byte_offset") < before) & (F.col("byte_offset") >= before - budget))
    entered = F.max(F.when(F.lower("value").contains("entering room:"), F.col("line_number"))).over(Window.partitionBy("source_file"))
    return tail.withColumn("__entered", entered).filter("line_number >= __entered").drop("__entered")


# --- tailing -------------------------------------------------------------------------------------------


class TailReader(SimpleDataSourceStreamReader):
    """Offsets are a file, a byte position and a line count; only whole lines are handed out, however long.

    The newest file is followed; one that a newer replaces is read to its end first, with ``unfinished`` (as
    the source has it) including a last line without newline.  A file that has become shorter is read anew.
    """

    def __init__(self, folder: str, from_start: bool, prefix: str, most_bytes: int, unfinished: bool = False):
        self.folder, self.from_start, self.prefix, self.most, self.unfinished = folder, from_start, prefix, most_bytes, unfinished

    def _files(self) -> list[str]:
        found = [e for e in os.scandir(self.folder) if e.name.startswith(self.prefix) and e.name.endswith(".txt")]
        return [e.path for e in sorted(found, key=lambda e: (e.stat().st_mtime_ns, e.name))]

    def initialOffset(self) -> dict:
        files = self._files()
        if not files:
            return {"file": "", "byte": 0, "line": 0}
        size = os.path.getsize(files[-1])
        lines = 0
        if not self.from_start:
            with open(files[-1], "rb") as f:
                lines = sum(chunk.count(b"\n") for chunk in iter(lambda: f.read(1 << 20), b""))
        return {"file": files[-1], "byte": 0 if self.from_start else size, "line": 0 if self.from_start else lines}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._take(start)
        if not rows:
            files = self._files()
            later = files[files.index(start["file"]) + 1 :] if start["file"] in files else files[-1:]
            if later:  # what came before the newer file was seen is still to be read
                rows, end = self._take(start, to_end=self.unfinished)
                if not rows:
                    rows, end = self._take({"file": later[0], "byte": 0, "line": 0})
        return iter(rows), end

    def _take(self, at: dict, most: int | None = None, to_end: bool = False) -> tuple[list[tuple], dict]:
        """Lines from an offset on, some ``most`` bytes of them; with ``to_end`` the last may lack its newline if nothing follows."""
        if not at["file"] or not os.path.exists(at["file"]):
            return [], at
        if os.path.getsize(at["file"]) < at["byte"]:
            at = {"file": at["file"], "byte": 0, "line": 0}
        with open(at["file"], "rb") as f:
            f.seek(at["byte"])
            parts = [f.read(most or self.most)]
            while most is None and parts[-1] and b"\n" not in parts[-1]:
                parts.append(f.read(self.most))
        content = b"".join(parts)
        whole = content[: content.rfind(b"\n") + 1]
        content = whole or (content if to_end else b"")
        rows, byte, line = [], at["byte"], at["line"]
        for raw in _by_newline(content):
            line += 1
            rows.append((at["file"], line, byte, raw.rstrip(b"\r\n").decode("utf-8", errors="replace")))
            byte += len(raw)
        return rows, {"file": at["file"], "byte": byte, "line": line}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start if start["file"] == end["file"] and end["byte"] >= start["byte"] else {"file": end["file"], "byte": 0, "line": 0}
        return iter(self._take(at, max(1, end["byte"] - at["byte"]), to_end=self.unfinished)[0])

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """``spark.readStream.format("log_tail").option("path", folder)``; options from_start, prefix, most_bytes."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINES

    def simpleStreamReader(self, schema) -> TailReader:
        o = self.options
        return TailReader(o["path"], str(o.get("from_start", "false")).lower() == "true", o.get("prefix", "output_log_"), int(o.get("most_bytes", CONTEXT_BYTES)), unfinished=True)


def run_until(query: StreamingQuery, idle_seconds: float | None = None, most_rows: int | None = None, poll_seconds: float = 0.2) -> dict:
    """Lets a stream run until nothing has come for a while, or so many rows have, then stops it and tells its summary.

    Rows are those that progress reports tell of; a batch that has begun is finished.  A failed stream raises.
    """
    rows, last_batch, changed = 0, -1, time.monotonic()
    while query.isActive:
        for p in query.recentProgress:
            if p["batchId"] > last_batch:
                last_batch = p["batchId"]
                rows += p["numInputRows"]
                if p["numInputRows"]:
                    changed = time.monotonic()
        if most_rows is not None and rows >= most_rows or idle_seconds is not None and time.monotonic() - changed >= idle_seconds:
            query.stop()
            break
        time.sleep(poll_seconds)
    if query.exception() is not None:
        raise query.exception()
    return session_summary(query)


def session_summary(query: StreamingQuery) -> dict:
    """What a stream has done so far: batches, rows, first and last time, where each source ends, and observed counts.

    Counts of :func:`sinks.counted` are added up over the batches.
    """
    reports = [p for p in query.recentProgress]
    observed: dict[str, int] = {}
    for p in reports:
        for row in p["observedMetrics"].values():
            for name, value in row.asDict().items():
                observed[name] = observed.get(name, 0) + (value or 0)
    return {
        "batches": len({p["batchId"] for p in reports if p["numInputRows"]}), "rows": sum(p["numInputRows"] for p in reports), "started": reports[0]["timestamp"] if reports else None,
        "ended": reports[-1]["timestamp"] if reports else None, "offsets": [s["endOffset"] for s in reports[-1]["sources"]] if reports else [], "observed": observed,
    }


def summary(progress: dict) -> str:
    """A session summary as JSON text, from :func:`session_summary` or observed counts."""
    return json.dumps(progress, sort_keys=True, default=str)
