"""Running values along the order of a session, in slices of it, so that no task holds a large session.

A running sum, extreme, first or last value is associative: each slice is summed up to one row per key, these few
rows are run through in order, and what came before is added to the running value within the slice.  Keys of which none is large (:func:`small`) need no slices.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType

from ..operators.order import PARTS, numbered
from ..operators.staging import staged

#: Up to this many rows, the whole order is one slice; and a key's rows are run through in one task.
SLICE_ROWS, KEY_ROWS = 1 << 18, 1 << 20


class Run(NamedTuple):
    """A running value: ``how`` (sum, max, min, first or last; nulls do not count) and whether the row's own value counts."""

    how: str
    value: Column
    own: bool = True


def sliced(rows: DataFrame, order: list[str | Column], slice_rows: int = SLICE_ROWS, name: str = "place") -> DataFrame:
    """``rows`` as a staged table with their place in the ``order`` of all rows and the slice of it that they are in.

    slice is an int; a single slice is the byte 0, by which :func:`scan` knows that nothing has to be put together.
    """
    rows = staged(rows, "unsliced")
    parts = min(PARTS, rows.count() // slice_rows + 1)
    placed = numbered(rows, order, name, parts, part="slice")
    return staged(placed.withColumn("slice", F.lit(0).cast("byte")) if parts == 1 else placed, "sliced")


def small(rows: DataFrame, *keys: list[str], most: int | None = None) -> list[bool]:
    """For each of ``keys``, each finer than the one before, whether no key of it has more than ``most`` (KEY_ROWS) ``rows``.

    Finer keys are counted only if coarser ones are too large.  ``rows`` are read for that, so they should be staged.
    """
    found = [_single(rows)]
    for by in keys:
        found.append(found[-1] or rows.groupBy(*by).count().filter(F.col("count") > (KEY_ROWS if most is None else most)).isEmpty())
    return found[1:]


def _single(rows: DataFrame) -> bool:
    return isinstance(rows.schema["slice"].dataType, ByteType)


def scan(rows: DataFrame, by: list[str], runs: dict[str, Run], backward: bool = False, place: str = "place", whole: bool = False) -> DataFrame:
    """``rows`` (with place and slice) with the running values of their key ``by``, in order of place or backward.

    Keys are not null.  A sum is 0 before the first row, other values are null.  With ``whole`` (:func:`small`) a key's rows are
    sorted in one task: nothing has to be put together, and scans by finer keys need no other shuffle.  Slices read ``rows`` twice.
    """
    def along(name: str) -> Column:
        return F.desc(name) if backward else F.col(name)

    def total(run: Run) -> Column:
        if run.how in ("sum", "max", "min"):
            return getattr(F, run.how)(run.value)
        earliest = (run.how == "first") != backward
        return (F.min_by if earliest else F.max_by)(run.value, F.when(run.value.isNotNull(), F.col(place)))

    def over(how: str, value: Column) -> Column:
        return getattr(F, how)(value) if how in ("sum", "max", "min") else getattr(F, how)(value, ignorenulls=True)

    whole = whole or _single(rows)
    within = Window.partitionBy(*by, *([] if whole else ["slice"])).orderBy(along(place))
    ran = rows.withColumns({f"__in_{n}": over(run.how, run.value).over(within.rowsBetween(Window.unboundedPreceding, 0 if run.own else -1)) for n, run in runs.items()})
    if whole:
        return ran.select(*rows.columns, *[(F.coalesce(F.col(f"__in_{n}"), F.lit(0)) if run.how == "sum" else F.col(f"__in_{n}")).alias(n) for n, run in runs.items()])
    before = Window.partitionBy(*by).orderBy(along("slice")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "slice").agg(*[total(run).alias(f"__all_{n}") for n, run in runs.items()])
    earlier = totals.select(*by, "slice", *[over(run.how, F.col(f"__all_{n}")).over(before).alias(f"__before_{n}") for n, run in runs.items()])
    joined = ran.join(earlier, [*by, "slice"], "left")

    def both(name: str, how: str) -> Column:
        own, past = F.col(f"__in_{name}"), F.col(f"__before_{name}")
        if how == "sum":
            return F.coalesce(own, F.lit(0)) + F.coalesce(past, F.lit(0))
        if how in ("max", "min"):
            return (F.greatest if how == "max" else F.least)(own, past)
        return F.coalesce(own, past) if how == "last" else F.coalesce(past, own)

    return joined.select(*[F.col(c) for c in rows.columns], *[both(n, run.how).alias(n) for n, run in runs.items()])
