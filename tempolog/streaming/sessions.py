"""The fold over a stream: each micro-batch adds its rows to those kept, and tells the occurrences that it changes.

What is kept is a table of rows by micro-batch, and a table of what has been told; a micro-batch writes its own rows and the
occurrences that it changes, so what it writes does not grow with the past.  It reads the rows of the sessions that it
touches.  Sessions that have ended leave the table when it is compacted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.staging import staged
from ..operators.versions import VersionedTable
from .occurrences import OCCURRENCES, fold

#: The kind of a row that ends a session as a normal stop of its source does.
STOP = "stop"


class Kept:
    """Rows and told occurrences of a stream, in one versioned table: a micro-batch is committed with what it has told, or not at all."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self.table, self.schema = VersionedTable(spark, folder), schema
        self.told = StructType().add("session", "string").add("event_key", "string").add("digest", "long").add("batch", "long")

    def add(self, batch: DataFrame, number: int, write: Callable[[DataFrame, int], None]) -> None:
        """Tell the occurrences that the rows of a micro-batch change, as they are now; a batch that has been committed does nothing."""
        version = self.table.version()
        if version.writers.get("stream", -1) >= number:
            return
        new = staged(batch.select(*self.schema.names), "batch")
        touched = new.select("session").distinct()
        earlier = self.table.read("rows", self.schema, version)
        rows = earlier.join(touched, "session", "left_semi").unionByName(new)
        stops = rows.groupBy("session").agg(F.max((F.col("event_type") == STOP).cast("int")).alias("stopped"))
        rows = staged(rows.join(stops, "session"), "touched")
        going, over = (rows.filter(c).drop("stopped").filter(F.col("event_type") != STOP) for c in ("stopped = 0", "stopped = 1"))
        now = fold(going, finish=False)
        now = staged(now if over.isEmpty() else now.unionByName(fold(over)), "now")
        digest = F.xxhash64(*[c for c in now.columns if c != "duration_conflicts"], F.to_json("duration_conflicts"))
        told = self.table.read("told", self.told, version).join(touched, "session", "left_semi")
        last = told.groupBy("session", "event_key").agg(F.max_by("digest", "batch").alias("last"))
        changed = staged(now.withColumn("digest", digest).join(last, ["session", "event_key"], "left").filter(~F.col("digest").eqNullSafe(F.col("last"))), "changed")
        write(changed.drop("digest", "last"), number)
        added = {"rows": self.table.write("rows", new), "told": self.table.write("told", changed.select("session", "event_key", "digest", F.lit(number).cast("long").alias("batch")))}
        self.table.commit(lambda v: v.parts | {kind: [*v.parts.get(kind, []), part] for kind, part in added.items()}, "stream", number)

    def compact(self) -> None:
        """Put all rows into one folder, without sessions that have stopped; batches that are committed meanwhile stay beside it."""
        version = self.table.version()
        rows = self.table.read("rows", self.schema, version)
        over = rows.filter(F.col("event_type") == STOP).select("session").distinct()
        told = self.table.read("told", self.told, version)
        last = told.join(over, "session", "left_anti").groupBy("session", "event_key").agg(F.max_by("digest", "batch").alias("digest"), F.max("batch").alias("batch"))
        self.table.swap({"rows": self.table.write("rows", rows.join(over, "session", "left_anti")), "told": self.table.write("told", last)}, version)


def fold_stream(rows: DataFrame, folder: str, write: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Start folding a stream of rows (``parse.session_rows``): ``write`` gets the occurrences that each micro-batch changes, and its number.

    ``folder`` is shared by driver and executors and belongs to this stream alone.  A row of kind ``stop`` ends a session.
    ``write`` comes before the commit, so it may be called again with the same rows when a micro-batch is repeated.
    """
    kept = Kept(rows.sparkSession, folder, rows.schema)
    return rows.writeStream.foreachBatch(lambda batch, number: kept.add(batch, number, write)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


__all__ = ["OCCURRENCES", "Kept", "fold", "fold_stream"]
