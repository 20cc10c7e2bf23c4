"""Audits of a merge and of duplicates: a kept graph of candidates, and clusters of records that lie close in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.slices import SLICE_ROWS, Run, scan, sliced
from .matching import near_pairs
from .staging import staged
from .versions import Version, VersionedTable


def candidate_graph(left: DataFrame, right: DataFrame, keys: list[str], seconds: float, source: str) -> DataFrame:
    """left_id, right_id, gap_seconds, source: each right row of equal keys at most ``seconds`` before a left row.

    ``left`` has left_id and left_time, ``right`` right_id and right_time, both the keys.
    """
    pairs = near_pairs(left, right, keys, "left_time", "right_time", seconds, after_only=True)
    return staged(pairs.select("left_id", "right_id", "gap_seconds", F.lit(source).alias("source")), "candidates")


def extended(graph: DataFrame, left: DataFrame, right: DataFrame, keys: list[str], seconds: float, source: str) -> DataFrame:
    """The graph with candidates of a further input; those that it has already stay as they are and are not looked for again."""
    more = candidate_graph(left, right, keys, seconds, source)
    return staged(graph.unionByName(more.join(graph.select("left_id", "right_id"), ["left_id", "right_id"], "left_anti")), "candidates")


def with_degrees(graph: DataFrame) -> DataFrame:
    """The graph with left_degree and right_degree, the number of candidates of either end; sums come before the joins."""
    lefts, rights = (graph.groupBy(f"{side}_id").agg(F.count(F.lit(1)).alias(f"{side}_degree")) for side in ("left", "right"))
    return graph.join(lefts, "left_id").join(rights, "right_id")


def merge_audit(graph: DataFrame, truth: DataFrame, windows: tuple[int, ...], stages: dict[str, list[str]]) -> DataFrame:
    """stage, window and counts: how the graph's candidates would merge, and how often the nearest one is right.

    A stage is a set of the graph's sources, so what each further input adds is seen in one pass.  ``truth``: left_id, true_id of rows
    whose partner is known.  Counted are candidates, left and right rows with any, pairs that are each other's only candidate, and of the
    left rows with a known partner: whether it is among the candidates, only one or several are, and whether the nearest (ties to the
    smaller right_id) is the true one.
    """
    spread = F.explode(F.array(*[F.when(F.col("source").isin(sources), F.lit(stage)) for stage, sources in stages.items()])).alias("stage")
    inside = F.explode(F.array(*[F.when(F.col("gap_seconds") <= w, F.lit(w)) for w in windows])).alias("window")
    seen = graph.select("*", spread).filter("stage is not null").select("*", inside).filter("window is not null")
    by = ["stage", "window"]
    lefts = seen.groupBy(*by, "left_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("gap_seconds", "right_id")).alias("nearest"), F.min("right_id").alias("only"))
    rights = seen.groupBy(*by, "right_id").agg(F.count(F.lit(1)).alias("n"))
    unique = lefts.filter("n = 1").select(*by, F.col("only").alias("right_id")).join(rights.filter("n = 1").drop("n"), [*by, "right_id"]).groupBy(*by).agg(F.count(F.lit(1)).alias("unique_pairs"))
    known = seen.join(truth, "left_id").groupBy(*by, "left_id").agg(F.max((F.col("right_id") == F.col("true_id")).cast("int")).alias("found"), F.first("true_id").alias("true_id"))
    judged = lefts.join(known, [*by, "left_id"], "left")
    true = F.col("true_id").isNotNull()
    counts = judged.groupBy(*by).agg(
        F.sum("n").alias("candidates"), F.count(F.lit(1)).alias("left_matched"), F.count_if(true).alias("with_truth"), F.count_if(F.col("found") == 1).alias("truth_in_window"), F.count_if(true & (F.col("n") == 1)).alias("single"),
        F.count_if(true & (F.col("n") > 1)).alias("several"), F.count_if(F.col("nearest.right_id") == F.col("true_id")).alias("nearest_right"), F.count_if(F.col("nearest.right_id") != F.col("true_id")).alias("nearest_wrong"),
    )
    total = rights.groupBy(*by).agg(F.count(F.lit(1)).alias("right_matched"))
    return counts.join(total, by).join(unique, by, "left").withColumn("unique_pairs", F.coalesce("unique_pairs", F.lit(0)))


def interval_clusters(records: DataFrame, seconds: float, precedence: list[Column], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """record_id, cluster, size, survivor_id, action: records of a key that follow one another within ``seconds`` are one playback.

    ``records``: record_id, key, at.  The survivor of a cluster is the least by ``precedence``, then the earliest, then the least id.  Clusters are running sums
    along the order of keys and times, so a key of any number of records is spread over tasks.  Records without key or time are clusters of their own and are kept.
    """
    whole = records.filter(F.col("key").isNotNull() & F.col("at").isNotNull())
    rank = F.struct(*[p.alias(f"p{n}") for n, p in enumerate(precedence)], "at", "record_id")
    placed = sliced(whole.select("record_id", "key", "at", rank.alias("rank")), ["key", "at", "record_id"], slice_rows)
    before = scan(placed, ["key"], {"earlier": Run("last", F.col("at"), own=False)})
    far = F.timestamp_diff("MICROSECOND", F.col("earlier"), F.col("at")) > int(seconds * 1e6)
    begins = F.coalesce(far, F.lit(True))
    numbered = scan(staged(before.withColumn("begins", begins).drop("earlier"), "begins"), ["key"], {"cluster": Run("sum", F.col("begins").cast("long"))})
    groups = numbered.groupBy("key", "cluster").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("rank", "record_id"))["record_id"].alias("survivor_id"))
    found = numbered.join(groups, ["key", "cluster"]).select("record_id", "cluster", "size", "survivor_id")
    alone = records.filter(F.col("key").isNull() | F.col("at").isNull()).select("record_id", F.lit(None).cast("long").alias("cluster"), F.lit(1).cast("long").alias("size"), F.col("record_id").alias("survivor_id"))
    return found.unionByName(alone).withColumn("action", F.when(F.col("record_id") == F.col("survivor_id"), "keep").otherwise("merge"))


def execute_cleanup(table: VersionedTable, kind: str, actions: DataFrame, of: Version, number: int) -> Version:
    """Commit the records of ``of`` without those that ``actions`` merges, and the actions beside them, as one version.

    A cleanup of a number is done once; run again it changes nothing.  If the records have been replaced meanwhile it is a conflict.
    ``actions``: as of :func:`interval_clusters`.
    """
    latest = table.version()
    if latest.writers.get("cleanup", -1) >= number:
        return latest
    parts = [table.spark.read.parquet(f"{table.folder}/{p}") for p in of.parts[kind]]
    records = reduce(DataFrame.unionByName, parts)
    merged = actions.filter("action = 'merge'").select("record_id")
    kept, log = table.write(kind, records.join(merged, "record_id", "left_anti")), table.write("actions", actions)

    def change(now: Version) -> dict[str, list[str]]:
        swapped = table.swapped({kind: kept}, of, now)
        return swapped | {"actions": [*now.parts.get("actions", []), log]}

    return table.commit(change, "cleanup", number)
