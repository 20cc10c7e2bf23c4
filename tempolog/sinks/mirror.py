"""Growing files mirrored byte for byte: executors copy ranges of bytes to their places, the driver puts a manifest in place.

A batch has two phases.  Tasks write ranges into the archive's files where they belong and tell what they wrote; then the next
numbered manifest says up to where each file is archived, which only one writer can do.  What lies behind that length is no part
of the archive yet: a batch that failed leaves nothing that counts, one that is repeated copies what is missing.  An archive that is longer
than its source, or whose last range differs from what the source has there, is never appended to.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

COPIED = "source_file string, low long, content binary"
PIECE = "source_file string, low long, high long, sha256 string"
STATE = "source_file string, source_bytes long, archived_bytes long, residue string, complete boolean, refused boolean"
MANIFESTS = "_mirror"

#: Bytes of a range that one task copies, and of a row.
RANGE_BYTES, ROW_BYTES = 32 << 20, 1 << 20
#: A file's digest is its bytes as one number, modulo this prime: digests of neighbouring ranges combine, however files were cut.
PRIME = (1 << 127) - 1


def combined(left: int, right: int, right_bytes: int) -> int:
    """The digest of two ranges, one behind the other, from theirs."""
    return (left * pow(256, right_bytes, PRIME) + right) % PRIME


@dataclass
class Piece:
    """Bytes low to high of a file that a task has copied, and their digests; a refused piece has no bytes."""

    source_file: str
    low: int
    high: int
    sha256: str
    residue: int
    refused: bool = False


@dataclass
class Copied(WriterCommitMessage):
    pieces: list[Piece]


@dataclass
class Range(InputPartition):
    """Bytes to copy; ``before`` is the archive's last piece (low, high, sha256), which the source must still have."""

    path: str
    low: int
    high: int
    before: tuple[int, int, str] | None = None


def _rows(path: str, low: int, high: int) -> Iterator[bytes]:
    """Bytes low to high in portions, as far as the file has them."""
    with open(path, "rb") as f:
        f.seek(low)
        while low < high and (portion := f.read(min(ROW_BYTES, high - low))):
            yield portion
            low += len(portion)


def _digest(portions: Iterable[bytes]) -> tuple[int, str, int]:
    """How many bytes, their SHA-256 and their residue."""
    sha, residue, size = hashlib.sha256(), 0, 0
    for portion in portions:
        sha.update(portion)
        residue, size = combined(residue, int.from_bytes(portion) % PRIME, len(portion)), size + len(portion)
    return size, sha.hexdigest(), residue


def manifest(archive: str) -> dict:
    """The last manifest: its number, and by file name the bytes that are archived, their residue and the last piece."""
    folder = os.path.join(archive, MANIFESTS)
    names = [n for n in os.listdir(folder) if n.endswith(".json")] if os.path.isdir(folder) else []
    if not names:
        return {"number": 0, "files": {}, "pieces": [], "refused": []}
    with open(os.path.join(folder, max(names)), encoding="utf-8") as f:
        return json.load(f)


class MirrorReader(DataSourceStreamReader):
    """Offsets are sizes; what is copied begins where the archive ends, whatever offsets say."""

    def __init__(self, folder: str, archive: str, prefix: str, suffix: str, range_bytes: int, tick_bytes: int | None):
        self.folder, self.archive, self.prefix, self.suffix, self.range_bytes, self.tick_bytes = folder, archive, prefix, suffix, range_bytes, tick_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        have = manifest(self.archive)["files"] if self.tick_bytes else {}
        sizes = {e.name: e.stat().st_size for e in os.scandir(self.folder) if e.is_file() and e.name.startswith(self.prefix) and e.name.endswith(self.suffix)}
        return {n: min(size, have.get(n, {"bytes": 0})["bytes"] + self.tick_bytes) if self.tick_bytes else size for n, size in sorted(sizes.items())}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        have, dealt = manifest(self.archive)["files"], []
        for name, size in sorted(end.items()):
            known = have.get(name)
            first = known["bytes"] if known else 0
            for low in range(first, size, self.range_bytes):
                dealt.append(Range(os.path.join(self.folder, name), low, min(low + self.range_bytes, size), tuple(known["last"]) if known and low == first else None))
        return dealt

    def read(self, partition: Range) -> Iterator[tuple]:
        name, low = os.path.basename(partition.path), partition.low
        if partition.before:
            begin, end, sha = partition.before
            if _digest(_rows(partition.path, begin, end))[1] != sha:
                yield name, low, None
                return
        for portion in _rows(partition.path, low, partition.high):
            yield name, low, portion
            low += len(portion)

    def commit(self, end: dict) -> None:
        pass


class MirrorWriter(DataSourceStreamWriter):
    """Tasks write bytes where they belong; the commit takes the pieces that continue what is archived, without gaps."""

    def __init__(self, archive: str):
        self.archive = archive

    def write(self, iterator: Iterator[Row]) -> Copied:
        pieces: list[Piece] = []
        out = None
        try:
            for row in iterator:
                name, low, content = row["source_file"], row["low"], row["content"]
                if content is None:
                    pieces.append(Piece(name, low, low, "", 0, True))
                    continue
                content = bytes(content)
                last = pieces[-1] if pieces else None
                if out is None or last is None or last.refused or (last.source_file, last.high) != (name, low):
                    out = self._done(out)
                    os.makedirs(self.archive, exist_ok=True)
                    out = os.open(os.path.join(self.archive, name), os.O_WRONLY | os.O_CREAT, 0o644)
                    sha = hashlib.sha256()
                    pieces.append(last := Piece(name, low, low, "", 0))
                at = low
                while at < low + len(content):
                    at += os.pwrite(out, content[at - low :], at)
                sha.update(content)
                last.high, last.sha256 = at, sha.hexdigest()
                last.residue = combined(last.residue, int.from_bytes(content) % PRIME, len(content))
        finally:
            self._done(out)
        return Copied(pieces)

    @staticmethod
    def _done(out: int | None) -> None:
        if out is not None:
            os.fsync(out)
            os.close(out)

    def commit(self, messages: list[Copied | None], batchId: int) -> None:
        """Put the next manifest in place; if another writer was first, what still continues the archive is taken on top of its."""
        pieces = sorted((p for m in messages if m is not None for p in m.pieces), key=lambda p: (p.source_file, p.low))
        while True:
            now = manifest(self.archive)
            files, taken = dict(now["files"]), []
            refused = sorted({p.source_file for p in pieces if p.refused})
            for p in pieces:
                known = files.get(p.source_file, {"bytes": 0, "residue": "0"})
                if p.source_file in refused or p.low != known["bytes"] or p.high == p.low:
                    continue
                residue = combined(int(known["residue"]), p.residue, p.high - p.low)
                files[p.source_file] = {"bytes": p.high, "residue": str(residue), "last": [p.low, p.high, p.sha256]}
                taken.append({k: v for k, v in asdict(p).items() if k not in ("residue", "refused")})
            if not taken and refused == now["refused"]:
                return
            if self._put({"number": now["number"] + 1, "batch": batchId, "files": files, "pieces": taken, "refused": refused}):
                return

    def _put(self, following: dict) -> bool:
        folder = os.path.join(self.archive, MANIFESTS)
        os.makedirs(folder, exist_ok=True)
        made = os.path.join(folder, f".{uuid.uuid4().hex}")
        try:
            with open(made, "w", encoding="utf-8") as f:
                json.dump(following, f)
                f.flush()
                os.fsync(f.fileno())
            os.link(made, os.path.join(folder, f"{following['number']:012d}.json"))  # fails if the number is taken
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(made)

    def abort(self, messages: list[Copied | None], batchId: int) -> None:
        """Nothing to undo: bytes behind the archived length do not count."""


class ByteMirror(DataSource):
    """``format("byte_mirror")``: reading needs path (the sources' folder) and archive, writing needs archive.

    Options for reading: prefix and suffix of file names, range_bytes (a task's), tick_bytes (the most of a file in one batch).  All
    folders are shared by all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_mirror"

    def schema(self) -> str:
        return COPIED

    def streamReader(self, schema) -> MirrorReader:
        o = self.options
        tick = o.get("tick_bytes")
        return MirrorReader(o["path"], o["archive"], o.get("prefix", ""), o.get("suffix", ".txt"), int(o.get("range_bytes", RANGE_BYTES)), tick and int(tick))

    def streamWriter(self, schema, overwrite: bool) -> MirrorWriter:
        return MirrorWriter(self.options["archive"])


def mirror(spark: SparkSession, folder: str, archive: str, checkpoint: str, **options):
    """A stream that keeps ``archive`` a copy of the files in ``folder``, ready to be started; options as of :class:`ByteMirror`."""
    spark.dataSource.register(ByteMirror)
    read = spark.readStream.format("byte_mirror").options(path=folder, archive=archive, **options).load()
    return read.writeStream.format("byte_mirror").option("archive", archive).option("checkpointLocation", checkpoint)


def state(spark: SparkSession, folder: str, archive: str) -> DataFrame:
    """A row per archived file: sizes on both sides, digest, whether all of the source is archived, and whether it is refused."""
    now, rows = manifest(archive), []
    for name, known in sorted(now["files"].items()):
        path = os.path.join(folder, name)
        size = os.path.getsize(path) if os.path.exists(path) else None
        refused = name in now["refused"] or (size is not None and size < known["bytes"])
        rows.append((name, size, known["bytes"], known["residue"], size == known["bytes"] and not refused, refused))
    return spark.createDataFrame(rows, STATE)


def pieces(spark: SparkSession, archive: str) -> DataFrame:
    """All archived ranges with their digests."""
    manifests = spark.read.schema(f"pieces array<struct<{', '.join(c.replace(' ', ': ') for c in PIECE.split(', '))}>>").json(os.path.join(archive, MANIFESTS))
    return manifests.select(F.inline("pieces"))


def damaged(spark: SparkSession, archive: str, folder: str | None = None) -> DataFrame:
    """Archived ranges whose bytes are not those of their digest, in the archive or, with ``folder``, in the sources; each is read by one task at a time."""
    place = folder or archive

    @F.udf("boolean")
    def differs(name, low, high, sha256):
        path = os.path.join(place, name)
        return not os.path.exists(path) or _digest(_rows(path, low, high))[:2] != (high - low, sha256)

    found: Column = differs("source_file", "low", "high", "sha256")
    listed = pieces(spark, archive)
    return listed.repartition(spark.sparkContext.defaultParallelism, "source_file", "low").filter(found)
