"""Growing log files as a stream that executors read: the driver asks for sizes and deals out ranges of bytes.

Any number of files grow at once.  A line belongs to the range that holds its newline, so ranges are cut anywhere and
no line is read twice or lost, whatever was written between two micro-batches; where the line begins is looked for before the range.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .logs import LINES

#: Bytes of a range, and bytes that are looked at together for a line's beginning.
RANGE_BYTES, LOOK_BACK = 32 << 20, 1 << 16


@dataclass
class Range(InputPartition):
    """Bytes ``low`` to ``high`` of a file, whose lines begin at ``floor`` or later; ``tail``: what follows the last newline is a line too."""

    path: str
    low: int
    high: int
    floor: int = 0
    tail: bool = False


def _line_start(f, at: int, floor: int) -> int:
    """Where the line begins that holds the byte before ``at``, at ``floor`` at the earliest."""
    while at > floor:
        begin = max(floor, at - LOOK_BACK)
        f.seek(begin)
        cut = f.read(at - begin).rfind(b"\n")
        if cut >= 0:
            return begin + cut + 1
        at = begin
    return floor


def lines_of(part: Range) -> Iterator[tuple]:
    """source_file, line_number, byte_offset, value of the lines whose newline lies in the range.

    Lines are read one at a time.  line_number is where the line begins, plus one: an order of the file's lines, which no reader has counted.
    """
    if not os.path.exists(part.path):
        return
    with open(part.path, "rb") as f:
        at = _line_start(f, part.low, part.floor)
        f.seek(at)
        while at < part.high:
            raw = f.readline()
            whole = raw.endswith(b"\n") and at + len(raw) <= part.high
            if not whole:  # its newline is another range's, or is still to come
                raw = raw[: part.high - at] if part.tail else b""
            if not raw:
                return
            yield part.path, at + 1, at, raw.rstrip(b"\r\n").decode("utf-8", errors="replace")
            at += len(raw)


class RangeReader(DataSourceStreamReader):
    """Offsets are the size, the identity and the state of each file; a file is closed once there is a newer one.

    A file that has become shorter, or is another one of the same name, is read anew.  The last line of a closed file
    counts without newline; what is written behind it later begins a line.
    """

    def __init__(self, folder: str, from_start: bool, prefix: str, range_bytes: int):
        self.folder, self.from_start, self.prefix, self.range_bytes = folder, from_start, prefix, range_bytes

    def latestOffset(self) -> dict:
        found = [(e.path, e.stat()) for e in os.scandir(self.folder) if e.name.startswith(self.prefix) and e.name.endswith(".txt")]
        found.sort(key=lambda x: (x[1].st_mtime_ns, x[0]))
        return {path: {"byte": s.st_size, "inode": s.st_ino, "closed": k < len(found) - 1} for k, (path, s) in enumerate(found)}

    def initialOffset(self) -> dict:
        return {} if self.from_start else self.latestOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        dealt: list[Range] = []
        for path, now in sorted(end.items()):
            was = start.get(path)
            if was is None or was["inode"] != now["inode"] or now["byte"] < was["byte"]:
                was = {"byte": 0, "closed": False}
            floor = was["byte"] if was["closed"] else 0
            low, ends_now = was["byte"], now["closed"] and not was["closed"]
            cuts = [*range(low, now["byte"], self.range_bytes), now["byte"]]
            own = [Range(path, a, b, floor) for a, b in zip(cuts, cuts[1:], strict=False)]
            if now["closed"] and (own or ends_now):
                own = own or [Range(path, low, low, floor)]
                own[-1].tail = True
            dealt += own
        return dealt

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.tail and partition.low == partition.high:  # nothing is new but that the file is closed
            with open(partition.path, "rb") as f:
                begin = _line_start(f, partition.low, partition.floor)
            partition = Range(partition.path, begin, partition.high, begin, True)
        return lines_of(partition)

    def commit(self, end: dict) -> None:
        pass


class LogRanges(DataSource):
    """``spark.readStream.format("log_ranges").option("path", folder)``; options from_start, prefix, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "log_ranges"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> RangeReader:
        o = self.options
        return RangeReader(o["path"], str(o.get("from_start", "false")).lower() == "true", o.get("prefix", "output_log_"), int(o.get("range_bytes", RANGE_BYTES)))
