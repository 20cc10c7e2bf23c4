"""Settlement in windows: for sessions whose stamps never turn back, no state is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .settlement import COMPLETE_SHARE, TOLERANCE


def settle(rows: DataFrame) -> DataFrame:
    """status, settled_us, reason of every start.

    ``rows``: session, at_us, row_id (total order within the session), kind (start, end or clock), item and
    seconds (of starts).  A start is complete at the first stamp of the session at which it has played its
    share; it is interrupted by the next start of another item, or the next end; the earlier counts, and of
    equals completion.  One sort of the session, backward, finds all three, each the last that a running frame has
    seen: the next start of another item is the next change of item, the first stamp after a threshold is the
    next row after the threshold's own.
    """
    share = F.ceil((F.col("seconds") * COMPLETE_SHARE - TOLERANCE) * 1e6).cast("long")
    start = F.col("kind") == "start"
    plain = rows.select("session", "at_us", "row_id", "kind", "item", F.lit(None).cast("long").alias("of"))
    marked = rows.filter(start & (F.col("seconds") > 0))
    marks = marked.select("session", F.greatest(F.col("at_us"), F.col("at_us") + share).alias("at_us"), F.lit(-1).cast("long").alias("row_id"), F.lit("mark").alias("kind"), F.lit(None).cast(rows.schema["item"].dataType).alias("item"), F.col("row_id").alias("of"))
    backward = Window.partitionBy("session").orderBy(F.desc("at_us"), F.desc("row_id"))
    later, from_here = backward.rowsBetween(Window.unboundedPreceding, -1), backward.rowsBetween(Window.unboundedPreceding, 0)

    def next_of(value, frame):
        return F.last(value, ignorenulls=True).over(frame)

    seen = plain.unionByName(marks).withColumns({
        "__next": next_of(F.when(start, F.struct("item", "at_us")), later), "end_us": next_of(F.when(F.col("kind") == "end", F.col("at_us")), later), "done_us": next_of(F.when(F.col("of").isNull(), F.col("at_us")), from_here),
    })
    change = F.when(start & (F.col("__next.item") != F.col("item")), F.col("__next.at_us"))
    ends = seen.withColumn("other_us", next_of(change, from_here)).filter(start | F.col("of").isNotNull())
    # Partitioned by session already, so this moves nothing.
    one = ends.groupBy("session", F.coalesce("of", "row_id").alias("row_id")).agg(F.first(F.when(start, F.struct("item", "other_us", "end_us")), ignorenulls=True).alias("s"), F.max(F.when(F.col("of").isNotNull(), F.col("done_us"))).alias("done_us"))
    joined = one.select("session", "row_id", "s.*", "done_us")
    force = F.least("other_us", "end_us")
    complete = F.col("done_us").isNotNull() & (force.isNull() | (F.col("done_us") <= force))
    status = F.when(complete, "completed").when(force.isNotNull(), "interrupted").otherwise("pending")
    reason = F.when(complete, "observed_completion_threshold").when(force.isNotNull(), F.when(F.col("other_us") <= F.coalesce("end_us", F.col("other_us")), "superseded_before_completion").otherwise("room_left"))
    return joined.select("session", "row_id", "item", status.alias("status"), F.when(complete, F.col("done_us")).otherwise(force).alias("settled_us"), reason.alias("reason"))
