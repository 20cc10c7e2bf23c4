"""Where results go: files that append, catalogs for people, and the newest state of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def append_jsonl(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream's rows as JSON lines, each batch once."""
    return stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def counted(df: DataFrame, **columns) -> tuple[DataFrame, Observation]:
    """The rows, and counts that become known when they are written."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in columns.items()]), seen


def write_catalog(df: DataFrame, folder: str) -> None:
    """The catalog as CSV with a header, and as JSON.  Each CSV file begins with a byte-order mark, on its header's first name."""
    marked = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    marked.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    df.write.mode("overwrite").json(f"{folder}/json")


def newest(stream: DataFrame, order: str, keep: int, publish: Callable[[list[dict]], None], checkpoint: str) -> DataStreamWriter:
    """Hands the newest ``keep`` rows seen so far to ``publish`` after each batch; readers that lag see only the last state.

    What has been published is kept in a folder beside the checkpoint, one small table per batch, of which the last
    two stay: a stream that starts again goes on from it, and a batch that is repeated gives the same rows.
    """
    folder = f"{checkpoint}-newest"

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(conf)
        listed = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        written = sorted(int(name) for name in listed if name.isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")))
        past = [n for n in written if n < batch_id]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{folder}/{past[-1]}")) if past else batch
        rows.distinct().orderBy(F.desc(order)).limit(keep).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{batch_id}")
        newest_rows = spark.read.schema(batch.schema).parquet(f"{folder}/{batch_id}").orderBy(F.desc(order)).collect()
        for old in past[:-1]:
            files.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{old}"), True)
        publish([r.asDict(recursive=True) for r in newest_rows])

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


def merge_batches(stream: DataFrame, merge: Callable[[DataFrame], None], checkpoint: str) -> DataStreamWriter:
    """Applies an idempotent merge to each batch; a batch that is repeated after a failure changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: merge(batch)).option("checkpointLocation", checkpoint).outputMode("update")
