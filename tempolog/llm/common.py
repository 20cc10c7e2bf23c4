"""Helpers that several operators share: staging tables, guarded broadcasts and salted joins."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

#: What ``[^\x20\x09-\x0D]+`` matches is a word; the same set as ``bytes.split()`` uses.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

#: Largest table, in rows, that :func:`attach` sends to every executor.
BROADCAST_ROWS = 50_000

#: Rows that go to a Python worker at a time, at most: texts may be long, and two workers share an executor.
BATCH_ROWS = 1024

_OWN_FOLDERS: dict[str, str] = {}
_STAGED: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own (as in tests); a cluster
    without it is an error, because a machine-local folder would lose data there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN_FOLDERS:
        _OWN_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN_FOLDERS[context.applicationId]


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to what suits whole texts; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def staged_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at a table that outlives executors."""
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Delete the staging tables of this process; results that still read them become unreadable."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(conf).delete(path, True)


def quoted(name: str) -> str:
    """A column's name as it is referred to, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(columns: list[str]) -> Column:
    """All of these columns as one, so that no helper column can clash with any of them; ``row.*`` takes it apart again."""
    return F.struct(*[F.col(quoted(c)) for c in columns]).alias("row")


def whole_text(column: str = "text") -> Column:
    """The text, a null being the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, evaluated in the JVM."""
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def attach(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame | None = None, salts: int = 64) -> DataFrame:
    """Left join of ``rows`` with the narrower ``table`` (unique in ``keys``, no nulls in them).

    The table is counted first.  Up to :data:`BROADCAST_ROWS` rows are broadcast; a larger one is
    joined by shuffling, where the keys of ``hot`` are dealt over ``salts`` partitions by the row's plain columns.
    """
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys, "left")
    if hot is None:
        return rows.join(table, keys, "left")
    flags = F.broadcast(hot.select(*keys).distinct().withColumn("__hot", F.lit(True)))
    salted_rows = rows.join(flags, keys, "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*[f.name for f in rows.schema if isinstance(f.dataType, AtomicType)]), F.lit(salts))).otherwise(F.lit(0))
    )
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_table = table.join(flags, keys, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    salted_table = salted_table.withColumn("__salt", F.col("__salt").cast("long"))
    return salted_rows.withColumn("__salt", F.col("__salt").cast("long")).join(salted_table, [*keys, "__salt"], "left").drop("__hot", "__salt")


def tree_sum(vectors: DataFrame, length: int) -> np.ndarray:
    """Sum of the binary column's vectors (int64, ``length`` numbers each), added up by a tree of tasks.

    Each task and the driver hold a few vectors at a time, whatever the number of rows.
    """

    def add(a: bytes, b: bytes) -> bytes:
        return (np.frombuffer(a, np.int64) + np.frombuffer(b, np.int64)).tobytes()

    name, zero = vectors.columns[0], bytes(8 * length)
    parts = vectors.rdd.mapPartitions(lambda rows: [reduce(add, (bytes(row[name]) for row in rows), zero)])
    return np.frombuffer(parts.treeReduce(add, depth=3) if parts.getNumPartitions() else zero, np.int64)
