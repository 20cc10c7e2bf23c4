"""Matching rows of two sources by key and time: ranges, nearest, as-of, unique pairs.

Every join has an equi-key and a time bucket, so that a hot key's rows spread over many tasks: rows meet only in
their own and the next bucket, and the exact time condition is residual.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(column: str | Column) -> Column:
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, seconds: float, bucket_seconds: int | None = None, after_only: bool = False) -> DataFrame:
    """All pairs of equal keys with |left - right| at most ``seconds``; with ``after_only``, 0 <= left - right.

    The time bucket, of ``bucket_seconds`` (at least ``seconds``; if not given, just that), joins the keys: right rows
    are copied to the neighbouring buckets, so one key's rows spread over many tasks.
    """
    gap = micros(left_time) - micros(right_time)
    near = (gap >= 0) & (gap <= int(seconds * 1e6)) if after_only else F.abs(gap) <= int(seconds * 1e6)
    bucket_seconds = bucket_seconds or max(1, math.ceil(seconds))
    if bucket_seconds < seconds:
        raise ValueError("a bucket must be as wide as the tolerance")
    width = bucket_seconds * 1_000_000
    at = F.floor(micros(left_time) / width)
    home = F.floor(micros(right_time) / width)
    spread = F.array(home, home + 1) if after_only else F.array(home - 1, home, home + 1)
    joined = left.withColumn("__bucket", at).join(right.withColumn("__bucket", F.explode(spread)), [*keys, "__bucket"])
    return joined.drop("__bucket").filter(near).withColumn("gap_seconds", gap / 1e6)


def self_pairs(rows: DataFrame, keys: list[str], id_column: str, time: str, seconds: float, bucket_seconds: int | None = None) -> DataFrame:
    """Unordered pairs of different rows of a key within ``seconds``: left_id < right_id."""
    left = rows.select(*keys, F.col(id_column).alias("left_id"), F.col(time).alias("left_time"))
    right = rows.select(*keys, F.col(id_column).alias("right_id"), F.col(time).alias("right_time"))
    return near_pairs(left, right, keys, "left_time", "right_time", seconds, bucket_seconds).filter("left_id < right_id")


def nearest(pairs: DataFrame, left_id: str, order: list[str], take: list[str]) -> DataFrame:
    """Per left row the pair of the least gap; ties by ``order``."""
    weight = F.struct(F.abs("gap_seconds").alias("g"), *order)
    return pairs.groupBy(left_id).agg(F.min_by(F.struct(*take), weight).alias("__best"), F.min(F.abs("gap_seconds")).alias("best_gap")).select(left_id, "__best.*", "best_gap")


def windows_hit(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, left_id: str, windows: tuple[int, ...]) -> DataFrame:
    """window, rows, matched, unique_matched: for each tolerance, how many left rows have a right row before them."""
    pairs = near_pairs(left, right, keys, left_time, right_time, max(windows), after_only=True)
    counts = pairs.groupBy(left_id).agg(*[F.count_if(F.col("gap_seconds") <= w).alias(f"n{w}") for w in windows])
    total = left.select(left_id).distinct().agg(F.count(F.lit(1)).alias("rows"))
    hits = counts.agg(*[x for w in windows for x in (F.count_if(F.col(f"n{w}") > 0).alias(f"m{w}"), F.count_if(F.col(f"n{w}") == 1).alias(f"u{w}"))])
    stacked = ", ".join(f"{w}, m{w}, u{w}" for w in windows)
    return total.crossJoin(hits).selectExpr("rows", f"stack({len(windows)}, {stacked}) as (window, matched, unique_matched)").select("window", "rows", "matched", "unique_matched")


def last_before(rows: DataFrame, marks: DataFrame, partition: str, order: str, value: str) -> DataFrame:
    """``rows`` with the last mark's value at or before them in the order (as-of join), by one window.

    Marks stand before rows of the same place.  A mark with a null value clears.
    """
    both = rows.withColumns({"__mark": F.lit(0), "__value": F.lit(None).cast("string")}).unionByName(
        marks.select(partition, order, F.struct(F.col(value).cast("string").alias("v")).alias("__set")).withColumns({"__mark": F.lit(-1), "__value": F.col("__set.v")}), allowMissingColumns=True
    )
    past = Window.partitionBy(partition).orderBy(order, "__mark").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__set", ignorenulls=True).over(past)["v"]).filter("__mark = 0").drop("__mark", "__value", "__set")


def next_other(rows: DataFrame, partition: str, order: str, key: str, name: str) -> DataFrame:
    """``rows`` with the order of the next row in the partition that has another key.

    That is the next change of key.  Frames run backward from the end, so each row is met once.
    """
    ahead = Window.partitionBy(partition).orderBy(order)
    change = F.when(F.lead(key).over(ahead) != F.col(key), F.lead(order).over(ahead))
    running = Window.partitionBy(partition).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__change", change).withColumn(name, F.last("__change", ignorenulls=True).over(running)).drop("__change")


def unique_both_ways(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct pairs whose left row has one right row and whose right row has one left row."""
    distinct = pairs.select(left, right).distinct()
    counted = distinct.withColumns({"__l": F.count(F.lit(1)).over(Window.partitionBy(left)), "__r": F.count(F.lit(1)).over(Window.partitionBy(right))})
    return counted.filter("__l = 1 AND __r = 1").drop("__l", "__r")


def exact_anchor(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys where neither side repeats the key."""
    def once(frame: DataFrame) -> DataFrame:
        return frame.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("__n = 1").drop("__n")

    return once(left).join(once(right), keys)


def has_near(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_time: str, right_time: str, seconds: float) -> DataFrame:
    """Left rows with some right row of the key within ``seconds``."""
    hits = near_pairs(left.select(left_id, left_time, *keys), right.select(right_time, *keys), keys, left_time, right_time, seconds)
    return left.join(hits.select(left_id).distinct(), left_id, "left_semi")


def gap_counts(rows: DataFrame, keys: list[str], time: str, tie: str, limits: tuple[int, ...]) -> DataFrame:
    """limit, n: adjacent rows of a key at most so many seconds apart."""
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(time, tie))
    gaps = rows.select(((micros(time) - micros(before)) / 1e6).alias("gap")).filter("gap is not null")
    found = gaps.agg(*[F.count_if(F.col("gap") <= k).alias(f"n{k}") for k in limits])
    return found.selectExpr(f"stack({len(limits)}, " + ", ".join(f"{k}, n{k}" for k in limits) + ") as (limit, n)")


def trace(events: DataFrame, markers: DataFrame) -> DataFrame:
    """Events with the marker of the same file and line, and whether both stand at one location (null-safe)."""
    named = markers.select("file", "line", F.col("location").alias("marker_location"), "marker")
    return events.join(named, ["file", "line"], "left").withColumn("agrees", F.col("marker").isNotNull() & F.col("location").eqNullSafe(F.col("marker_location")))
