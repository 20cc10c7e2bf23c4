"""Tables in versions: a numbered manifest names the folders of data that a version consists of.

A commit writes its data to new folders first and then puts the next manifest in place, which only one writer can do;
who comes second looks at what the first has done and tries again on top of it.  Readers hold a manifest, so what they read
does not change under them.  Folders go only when no manifest that is kept names them.  A writer's commits are numbered, and a
number is committed once: a commit that is repeated after a crash finds itself done.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass
class Version:
    """A state of the table: folders by kind of data, and the last commit of each writer."""

    number: int = 0
    parts: dict[str, list[str]] = field(default_factory=dict)
    writers: dict[str, int] = field(default_factory=dict)


class Conflict(Exception):
    """What a commit would replace has been replaced by another."""


class VersionedTable:
    """The table in ``folder``, which all executors share: ``_versions/N.json`` and folders of data."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._paths = spark._jvm.org.apache.hadoop.fs

    def _path(self, *names: str):
        return self._paths.Path("/".join([self.folder, *names]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        """Numbers of the versions that are kept, ascending."""
        fs, path = self._fs(), self._path("_versions")
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in found if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version, by default the latest; version 0 is the empty table."""
        numbers = self.numbers()
        number = number if number is not None else numbers[-1] if numbers else 0
        if not number:
            return Version()
        stream = self._fs().open(self._path("_versions", f"{number:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def read(self, kind: str, schema: StructType, version: Version | None = None) -> DataFrame:
        """The rows of a kind in a version."""
        parts = (version or self.version()).parts.get(kind, [])
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in parts])

    def write(self, kind: str, rows: DataFrame, tag: str = "") -> str:
        """Write rows to a new folder, which belongs to no version yet; returns its name, which begins with the kind and the tag."""
        part = f"{kind}-{tag}{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{part}")
        return part

    def _put(self, version: Version) -> bool:
        """Put a manifest in place unless there is one of its number."""
        fs, made = self._fs(), self._path("_versions", f".{uuid.uuid4().hex}")
        stream = fs.create(made, False)
        stream.write(bytearray(json.dumps(version.__dict__).encode()))
        stream.close()
        target = self._path("_versions", f"{version.number:012d}.json")
        try:
            if fs.getScheme() == "file":  # a link fails if its name exists, in one step
                local = urlparse(fs.makeQualified(made).toString()).path
                os.link(local, urlparse(fs.makeQualified(target).toString()).path)
            else:
                rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
                options = self.spark.sparkContext._gateway.new_array(rename, 0)
                self._paths.FileContext.getFileContext(fs.getUri(), self._conf).rename(made, target, options)
            return True
        except Exception:  # another writer was first, or nothing was put in place: the caller sees which
            if fs.exists(target):
                return False
            raise
        finally:
            fs.delete(made, False)

    def commit(self, change: Callable[[Version], dict[str, list[str]]], writer: str | None = None, number: int | None = None) -> Version:
        """Put the next version in place: ``change`` gives its parts from those of the latest one, and is asked again if another writer was first.

        With ``writer`` and ``number`` nothing happens if the writer has committed this number or a later one.
        ``change`` raises :class:`Conflict` if it cannot be made on top of what it is given.
        """
        while True:
            latest = self.version()
            if writer is not None and latest.writers.get(writer, -1) >= number:
                return latest
            writers = latest.writers | ({writer: number} if writer is not None else {})
            following = Version(latest.number + 1, change(latest), writers)
            if self._put(following):
                return following

    def append(self, kind: str, rows: DataFrame, writer: str | None = None, number: int | None = None) -> Version:
        """Add rows; see :meth:`commit`."""
        if writer is not None and self.version().writers.get(writer, -1) >= number:
            return self.version()
        part = self.write(kind, rows)
        return self.commit(lambda v: v.parts | {kind: [*v.parts.get(kind, []), part]}, writer, number)

    def replace(self, kind: str, rows: DataFrame, of: Version) -> Version:
        """Put ``rows``, made from the version ``of``, in place of its rows of that kind; see :meth:`swap`."""
        return self.swap({kind: self.write(kind, rows)}, of)

    def swap(self, parts: dict[str, str], of: Version) -> Version:
        """Put a written part of each kind in place of all parts that ``of`` has of it; parts added since stay beside them.

        If any of those has been replaced meanwhile this is a :class:`Conflict`.
        """
        return self.commit(lambda latest: self.swapped(parts, of, latest))

    @staticmethod
    def swapped(parts: dict[str, str], of: Version, latest: Version) -> dict[str, list[str]]:
        """The parts of ``latest`` after a :meth:`swap`."""
        changed = dict(latest.parts)
        for kind, part in parts.items():
            old, have = set(of.parts.get(kind, [])), latest.parts.get(kind, [])
            if not old <= set(have):
                raise Conflict(kind)
            changed[kind] = [part, *[p for p in have if p not in old]]
        return changed

    def restore(self, number: int) -> Version:
        """Make a version that is kept the latest one again, under a new number; the writers' numbers stay as they are."""
        parts = self.version(number).parts
        return self.commit(lambda _: parts)

    def archive(self, folder: str, number: int | None = None) -> VersionedTable:
        """Copy a version to another folder, as its first version there."""
        version, other = self.version(number), VersionedTable(self.spark, folder)
        util = self.spark._jvm.org.apache.hadoop.fs.FileUtil
        for part in {p for parts in version.parts.values() for p in parts}:
            target = other._path(part)
            util.copy(self._fs(), self._path(part), target.getFileSystem(self._conf), target, False, self._conf)
        other.commit(lambda _: version.parts)
        return other

    def vacuum(self, keep: int = 3) -> list[str]:
        """Delete all but the last ``keep`` versions, and the folders that these alone name; returns their names.

        Folders that no version names may belong to a commit under way, so they stay.
        """
        numbers = self.numbers()
        gone, kept = numbers[:-keep], numbers[-keep:]
        named = [{p for parts in self.version(n).parts.values() for p in parts} for n in (*gone, *kept)]
        left = set().union(*named[: len(gone)]) - set().union(*named[len(gone) :]) if gone else set()
        for n in gone:
            self._fs().delete(self._path("_versions", f"{n:012d}.json"), False)
        for part in left:
            self._fs().delete(self._path(part), True)
        return sorted(left)
