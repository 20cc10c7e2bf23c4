"""Places in an order of all rows, numbered in parts of it rather than in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that the order is cut into, and rows per part that are looked at to cut it evenly.
PARTS, LOOKED_AT = 256, 64


def _in_parts(rows: DataFrame, order: list[str | Column], parts: int) -> DataFrame:
    """``rows`` with their ``__key`` in the ascending ``order``, nulls first, and the ``__part`` of the order that it falls into.

    Limits of the parts are every so many of the keys whose hash falls into a small class; the class holds about
    ``parts`` times LOOKED_AT keys whatever the number of rows.  Limits decide how even parts are, nothing else.
    """
    key = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{n}") for n, c in enumerate(order)])
    keyed = rows.withColumn("__key", key)
    one_in = max(1, rows.count() // (parts * LOOKED_AT))
    looked_at = keyed.filter(F.pmod(F.xxhash64("__key"), F.lit(one_in)) == 0)
    listed = looked_at.agg(F.array_sort(F.collect_set("__key")).alias("keys"))
    step = F.greatest(F.lit(1), F.floor(F.size("keys") / parts).cast("int"))
    limits = listed.select(F.filter("keys", lambda _, at: (at + 1) % step == 0)).scalar()  # one array, known before rows are read
    # Halving: a key's part is the number of limits below it, of which there are less than twice the parts.
    found, step = keyed.withColumn("__part", F.lit(0)), 1 << (2 * parts).bit_length() - 1
    while step:
        found = found.withColumn("__part", F.col("__part") + F.when(F.get(limits, F.col("__part") + (step - 1)) < F.col("__key"), step).otherwise(0))
        step //= 2
    return found


def running(rows: DataFrame, order: list[str | Column], sums: dict[str, Column], parts: int = PARTS, part: str | None = None) -> DataFrame:
    """``rows`` with, for each name of ``sums``, the column's sum over all rows before it in the ascending ``order``, nulls first.

    The order should tell all rows apart; rows that tie come one after the other, in any order.  The first row's
    sums are 0 and nulls add nothing.  Sums are made within parts of the order, on top of those of the earlier
    parts, so no task holds all rows.  An empty table gives an empty result.
    ``part`` names a column for the number of the row's part.
    """
    in_part = _in_parts(rows, order, parts)
    past = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = in_part.groupBy("__part").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"__all_{n}") for n, c in sums.items()])
    starts = totals.select("__part", *[F.coalesce(F.sum(f"__all_{n}").over(past), F.lit(0)).alias(f"__earlier_{n}") for n in sums])  # a row per part
    within = Window.partitionBy("__part").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    summed = in_part.withColumns({f"__within_{n}": F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    placed = summed.join(F.broadcast(starts), "__part")
    parted = [] if part is None else [F.col("__part").alias(part)]
    return placed.select(*[f"`{c}`" for c in rows.columns], *parted, *[(F.col(f"__earlier_{n}") + F.col(f"__within_{n}")).alias(n) for n in sums])


def numbered(rows: DataFrame, order: list[str | Column], name: str = "place", parts: int = PARTS, part: str | None = None) -> DataFrame:
    """``rows`` with their place (long, from 1) in the ascending ``order``, nulls first; ties have places in any order.

    Rows are numbered within their part of the order, after as many as the earlier parts hold.  An empty table
    gives an empty result.  ``part`` as in :func:`running`.
    """
    return running(rows, order, {name: F.lit(1)}, parts, part).withColumn(name, F.col(name) + 1)
