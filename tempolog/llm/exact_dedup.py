"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries, one per partition, find every digest that may cover a set share of the rows.
Those candidates are counted exactly; the verified frequent ones with their winners are few by
construction (at most ``2 / share``) and are broadcast, so their rows never move.  All other digests
go through one ordinary shuffle, in which no group can exceed that share.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .common import quoted, staged, whole_row, whole_text

#: A digest is frequent when it covers at least this share of all rows.
FREQUENT_SHARE = 1 / 512


def misra_gries(values: Iterator[tuple[object, int]], counters: int) -> tuple[dict, int]:
    """Summary of weighted values: lower bounds of counts, and by how much they may be too low."""
    kept: dict = {}
    lost = 0
    for value, weight in values:
        if value in kept:
            kept[value] += weight
        else:
            kept[value] = weight
            if len(kept) > 2 * counters:
                cut = sorted(kept.values(), reverse=True)[counters]
                lost += cut
                kept = {v: n - cut for v, n in kept.items() if n > cut}
    return kept, lost


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for batch in batches:
                counts = batch.column(0).value_counts()
                yield from zip(counts.field(0).to_pylist(), counts.field(1).to_pylist(), strict=True)

        kept, lost = misra_gries(pairs(), counters)
        # The row without a digest carries what this partition's counts may lack.
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array([*kept, None], pa.binary()), "low": pa.array([*kept.values(), lost], pa.int64())}
        )

    return run


def frequent_digests(digests: DataFrame, share: float = FREQUENT_SHARE) -> DataFrame:
    """Verified frequent digests with keep_id and group_size; at most ``1 / share`` rows.

    ``digests`` has doc_id and digest.  The candidates are at most ``2 / share`` rows: each has a lower
    bound of at least half of the threshold.
    """
    counters = int(2 / share)
    summary = digests.select("digest").mapInArrow(_summaries(counters), "digest binary, low long")
    bounds = summary.groupBy("digest").agg(F.sum("low").alias("low")).filter("low > 0")
    total = digests.count()
    lost = bounds.filter("digest is null").agg(F.coalesce(F.max("low"), F.lit(0))).first()[0]
    candidates = bounds.filter(F.col("digest").isNotNull() & (F.col("low") + lost >= share * total) & (F.col("low") >= share * total / 2))
    counted = digests.join(F.broadcast(candidates.select("digest")), "digest").groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return counted.filter(F.col("group_size") >= share * total)


def _digest() -> Column:
    return F.unhex(F.sha2(whole_text(), 256))


def group_equal_texts(docs: DataFrame, share: float = FREQUENT_SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared unchanged; a null counts as empty, so null and empty texts form one group.  The
    largest doc_id of a group stays, a null id being smaller than any other.  Repeated rows of one
    doc_id and text share one decision (:func:`drop_equal_texts` leaves one of them).  An empty table
    gives an empty result.  Other columns are not read.
    """
    digests = staged(docs.select("doc_id", _digest().alias("digest")), "digests")
    heavy = staged(frequent_digests(digests, share), "frequent")
    few = F.broadcast(heavy)
    frequent = digests.join(few, "digest")
    rest = digests.join(few.select("digest"), "digest", "left_anti")
    group = Window.partitionBy("digest")
    ordinary = rest.withColumns({"keep_id": F.max("doc_id").over(group), "group_size": F.count(F.lit(1)).over(group)})
    columns = [
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    ]
    return frequent.select(*columns).unionByName(ordinary.select(*columns))


def drop_equal_texts(docs: DataFrame, share: float = FREQUENT_SHARE) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: one of each group of equal texts.

    Rows of a frequent text that are not its winner go where they are read, by the broadcast winners, and of its
    winner's each task passes on one; all other rows are shuffled once by digest.  Of rows that repeat a
    winner's doc_id and text, one stays: that with the least hash of its other plain columns.  Columns of any
    name pass through; other cases as in :func:`group_equal_texts`.
    """
    digests = staged(docs.select("doc_id", _digest().alias("digest")), "digests")
    heavy = staged(frequent_digests(digests, share), "frequent")
    plain = [F.col(quoted(f.name)) for f in docs.schema if isinstance(f.dataType, AtomicType) and f.name not in ("doc_id", "text")]
    rows = docs.select(whole_row(docs.columns), "doc_id", _digest().alias("digest"), (F.xxhash64(*plain) if plain else F.lit(0).cast("long")).alias("tie"))
    few = F.broadcast(heavy.select("digest", "keep_id"))
    # Copies of a frequent winner's own row may be as many as there are copies: each task passes on one of them.
    winners = rows.join(few, "digest").filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min_by("row", "tie").alias("row"))
    first = Window.partitionBy("digest").orderBy(F.col("doc_id").desc_nulls_last(), "tie")
    rest = rows.join(few, "digest", "left_anti").withColumn("place", F.row_number().over(first)).filter("place = 1")
    return winners.select("row.*").unionByName(rest.select("row.*"))
