"""Another application's history in an SQLite file, read-only, as a Spark data source."""

from __future__ import annotations

import math
import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, IntegerType, LongType, ShortType, StringType, StructType

HISTORY = "id long, created_at string, video_url string, video_name string, video_id string, location string, display_name string, user_id string"
TABLE = "gamelog_video_play"

#: Spark hands filters to a reader in Python only if this setting is on; :func:`read_history` turns it on.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Row ids that planning looks for in one round, row ids read on at a place to tell how dense it is, and values of a list that SQLite is given.
PROBES, RUN, MOST_VALUES = 1024, 64, 500

_COMPARED = {ds.EqualTo: "=", ds.EqualNullSafe: "IS", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
_WHOLE = (LongType, IntegerType, ShortType)


@dataclass
class Rows(InputPartition):
    """Row ids from low to high, both included; without bounds, all rows."""

    low: int | None
    high: int | None


def ranges_of_ids(base: sqlite3.Connection, table: str, step: int) -> list[Rows]:
    """Ranges that hold all row ids, of about ``step`` rows each by the density at their beginnings.

    Ids may be sparse: pieces of equal width are laid over the ids that are there and not over gaps, which a look-up skips,
    until gaps no longer make up most of what is looked at.  No more than ``PROBES`` pieces or so are looked at in a round, and what they
    span at least halves.  Neighbours are joined up to ``step`` rows.  How even ranges get is an estimate, what they hold is not.
    """
    try:
        low, high = base.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    except sqlite3.OperationalError:  # views and tables without row ids
        return [Rows(None, None)]
    if low is None:
        return []
    pieces, total = [(low, high)], high - low + 1
    while True:
        width, found = max(step, total // PROBES), []
        for at, end in pieces:
            while at is not None:
                found.append((at, min(at + width - 1, end)))
                if found[-1][1] == end:
                    break
                (at,) = base.execute(f'SELECT min(rowid) FROM "{table}" WHERE rowid > ? AND rowid <= ?', (found[-1][1], end)).fetchone()
        pieces, total = found, sum(b - a + 1 for a, b in found)
        if width == step or len(pieces) >= PROBES // 2:
            break
    dealt: list[list] = []
    for a, b in pieces:
        near = [x for (x,) in base.execute(f'SELECT rowid FROM "{table}" WHERE rowid >= ? AND rowid <= ? ORDER BY rowid LIMIT ?', (a, b, RUN))]
        held = len(near) if len(near) < RUN else math.ceil((b - a + 1) * (RUN - 1) / (near[-1] - a))
        if dealt and dealt[-1][2] + held <= step:
            dealt[-1][1:] = [b, dealt[-1][2] + held]
        else:
            dealt.append([a, b, held])
    return [Rows(a, b) for a, b, _ in dealt]


class HistoryReader(DataSourceReader):
    """Cuts the table into ranges of row ids and reads each in a task of its own, with the filters that SQLite can tell as Spark would.

    A column has the type that the schema gives it: text is what SQLite makes of the value, a whole number or a double is null where the
    value is none.  Comparisons are of stored bytes, whatever collation the table declares; bytes that are no UTF-8 are replaced when read.
    """

    def __init__(self, path: str, table: str, schema: StructType, step: int):
        self.path, self.table, self.step = path, table, step
        self.types = {f.name: type(f.dataType) for f in schema.fields}
        self.pushed: list[tuple[str, list]] = []

    def _open(self) -> sqlite3.Connection:
        base = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        base.text_factory = lambda raw: raw.decode("utf-8", errors="replace")
        return base

    def _value(self, name: str) -> str:
        column, kind = '"' + name.replace('"', '""') + '"', self.types[name]
        if kind is StringType:
            return f"CAST({column} AS TEXT)"
        if kind in _WHOLE:
            return f"CASE WHEN typeof({column}) = 'integer' THEN {column} END"
        return f"CASE WHEN typeof({column}) IN ('integer', 'real') THEN CAST({column} AS REAL) END" if kind is DoubleType else column

    def _condition(self, f: ds.Filter) -> tuple[str, list] | None:
        """A filter as SQL with its values, or None if SQLite may decide otherwise than Spark."""
        if isinstance(f, ds.Not):
            inner = self._condition(f.child)
            return inner and (f"NOT ({inner[0]})", inner[1])
        if len(f.attribute) != 1 or self.types.get(f.attribute[0]) not in (StringType, DoubleType, *_WHOLE):
            return None
        kind = self.types[f.attribute[0]]
        value = f"({self._value(f.attribute[0])}) COLLATE BINARY"
        if isinstance(f, ds.IsNull | ds.IsNotNull):
            return f"{value} IS {'NOT ' if isinstance(f, ds.IsNotNull) else ''}NULL", []
        given = list(f.value) if isinstance(f, ds.In) else [f.value]
        fits = str if kind is StringType else float if kind is DoubleType else int
        if len(given) > MOST_VALUES or not all(isinstance(v, fits) and not isinstance(v, bool) and v == v for v in given):
            return None
        if isinstance(f, ds.In):
            return f"{value} IN ({', '.join('?' * len(given))})", given
        if type(f) in _COMPARED:
            ordered = type(f) not in (ds.EqualTo, ds.EqualNullSafe)
            return None if ordered and kind is StringType and not self.utf8 else (f"{value} {_COMPARED[type(f)]} ?", given)
        text = given[0]
        if isinstance(f, ds.StringContains):
            return f"instr({value}, ?) > 0", given
        if not text:
            return f"{value} IS NOT NULL", []
        if isinstance(f, ds.StringStartsWith):
            return f"substr({value}, 1, {len(text)}) = ?", given
        return (f"substr({value}, -{len(text)}) = ?", given) if isinstance(f, ds.StringEndsWith) else None

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        base = self._open()
        try:
            self.utf8 = base.execute("PRAGMA encoding").fetchone()[0] == "UTF-8"  # bytes of UTF-16 have another order
        finally:
            base.close()
        for f in filters:
            condition = self._condition(f)
            if condition is None:
                yield f
            else:
                self.pushed.append(condition)

    def partitions(self) -> list[Rows]:
        base = self._open()
        try:
            return ranges_of_ids(base, self.table, self.step)
        finally:
            base.close()

    def read(self, partition: Rows) -> Iterator[tuple]:
        conditions, given = [sql for sql, _ in self.pushed], [v for _, values in self.pushed for v in values]
        if partition.low is not None:
            conditions, given = ["rowid >= ?", "rowid <= ?", *conditions], [partition.low, partition.high, *given]
        names = ", ".join(self._value(name) for name in self.types) or "1"
        base = self._open()
        try:
            yield from base.execute(f'SELECT {names} FROM "{self.table}" WHERE {" AND ".join(f"({c})" for c in conditions) or "1"}', given)
        finally:
            base.close()


class History(DataSource):
    """``spark.read.format("sqlite_history").option("path", file)``; options table and step (rows per task).

    A schema given to the reader names the columns that are fetched; needs the setting ``PUSHDOWN``.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_history"

    def schema(self) -> str:
        return HISTORY

    def reader(self, schema) -> HistoryReader:
        o = self.options
        return HistoryReader(o["path"], o.get("table", TABLE), schema, int(o.get("step", 100_000)))


def has_tables(path: str, *names: str) -> bool:
    """Whether an SQLite file is there and has all of these tables; a file that is no database has none."""
    try:
        base = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    except sqlite3.Error:
        return False
    try:
        found = {name for (name,) in base.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    except sqlite3.Error:
        return False
    finally:
        base.close()
    return set(names) <= found


def read_history(spark: SparkSession, path: str, limit: int | None = None, table: str = TABLE, columns: list[str] | None = None) -> DataFrame:
    """Rows with a URL in order of time; a limit counts rows before anything tells whether they are supported.

    Rows without a URL stay in SQLite, and so do columns other than ``columns`` (by default all of ``HISTORY``) and those of the order
    and the filter.  A file without the table is an error that says so.
    """
    if not has_tables(path, table):
        raise ValueError(f"{path} has no table {table}")
    spark.dataSource.register(History)
    spark.conf.set(PUSHDOWN, "true")
    kinds = dict(c.split() for c in HISTORY.split(", "))
    wanted = list(kinds) if columns is None else columns
    fetched = ", ".join(f"{name} {kind}" for name, kind in kinds.items() if name in {"id", "created_at", "video_url", *wanted})
    rows = spark.read.format("sqlite_history").schema(fetched).option("path", path).option("table", table).load().filter("video_url <> ''").orderBy("created_at", "id")
    return (rows if limit is None else rows.limit(limit)).select(wanted)


def union_roots(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of several databases, each with the name of its root."""
    from functools import reduce

    from pyspark.sql import functions as F

    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("root", F.lit(name)) for name, df in frames.items()])
