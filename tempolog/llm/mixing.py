"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies, target / size of the source.  The
documents of a source are laid end to end in order of (size, doc_id), each as long as its expected copies;
with one random offset per source, a document is emitted once for every integer boundary it crosses.
Ordering by size makes the sample stratified, so the words taken differ from the target by about one
document's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import numbered, running
from .common import staged, whole_row, whole_text, word_count

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_COPIES = 2
#: Documents of one source and size are numbered in one task up to this many, or 1/1024 of all rows.
RUN_ROWS = 512
OFFSET_STEPS = 1 << 20


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_copies: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target of rows source, source_size (one per source).

    Sources in code-point order, null last, take the weights in turn.  Targets are
    ``min(limit, weight * level)`` with the limit ``most_copies * source_size`` and the level at which they
    share ``share_percent`` of all sizes; this is what resharing the excess by weight ends with.  Turns and sums are
    taken in parts of the orders, so sources may be as many as hosts; sizes and the level alone reach the driver.
    """
    name = [F.col("source").isNull(), F.col("source").cast("binary")]
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("__turn") - 1) % len(weights) + 1).cast("int"))
    turned = numbered(staged(sources.select("source", "source_size"), "sources"), name, "__turn")
    weighted = staged(turned.withColumn("__weight", weight.cast("long")).withColumn("__limit", F.lit(most_copies) * F.col("source_size")).drop("__turn"), "weights")
    size, all_weights = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("__weight"), F.lit(0))).first()
    shared = F.lit(share_percent) * F.lit(size).cast("long") / F.lit(100)
    need = F.col("__limit") / F.col("__weight")
    limited = running(weighted, [need, *name], {"__taken": F.col("__limit"), "__lighter": F.col("__weight")})
    # If all sources before this one sit at their limits, the rest would share at this level.
    level = (shared - F.col("__taken")) / (F.lit(all_weights) - F.col("__lighter"))
    # Levels rise until the first that fits, and fall after it.
    final = limited.select(level.alias("__level"), need.alias("__need")).filter("__level <= __need").agg(F.max("__level")).first()[0]
    target = F.least(F.col("__limit").cast("double"), F.col("__weight") * F.lit(float("inf") if final is None else final))
    return weighted.select("source", "source_size", target.alias("target"))


def source_offset(source: Column, seed: int) -> Column:
    """The random offset of a source, in [0, 1): 20 bits of a hash of seed and name (null: no name)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(float(OFFSET_STEPS))


def _placed(rows: DataFrame, sizes: DataFrame, seed: int, weights: tuple[int, ...], share_percent: int, most_copies: int) -> DataFrame:
    """``rows`` (doc_id, __key, __size and any others) with __target, __source_size and __copies."""
    groups = staged(sizes.groupBy("__key", "__size").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("__low"), F.max("doc_id").alias("__high")), "size-groups")
    sources = groups.groupBy("__key").agg(F.sum(F.col("__size") * F.col("n")).alias("source_size"))
    named = sources.select(F.expr("if(__key = '', null, substring(__key, 2))").alias("source"), "source_size")
    targets = source_targets(named, weights, share_percent, most_copies).withColumn("__key", _key(F.col("source"))).drop("source")

    # At most 1024 groups are as large as this; they are cut into ranges of doc_id.
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(RUN_ROWS, total // 1024)
    large = groups.filter(F.col("n") > most).select("__key", "__size", "__low", "__high", F.ceil(F.col("n") / F.lit(most)).alias("__runs"))
    place = F.col("doc_id").cast("double") - F.col("__low")
    width = F.col("__high").cast("double") - F.col("__low") + 1
    run = F.when(F.col("__runs").isNull(), F.lit(0)).when(F.col("doc_id").isNull(), F.col("__runs")).otherwise(F.floor(place / width * F.col("__runs")))

    def in_runs(frame: DataFrame) -> DataFrame:
        return frame.join(F.broadcast(large), ["__key", "__size"], "left").withColumn("__run", run.cast("long")).drop("__low", "__high", "__runs")

    runs = in_runs(sizes).groupBy("__key", "__size", "__run").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("__key").orderBy("__size", "__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(targets, "__key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    runs = runs.select("__key", "__size", "__run", "__before", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), rate.alias("__rate"))

    row = F.row_number().over(Window.partitionBy("__key", "__size", "__run").orderBy(F.col("doc_id").asc_nulls_last()))
    rank = F.col("__before") + F.col("__row")
    offset = source_offset(F.expr("if(__key = '', null, substring(__key, 2))"), seed)
    crossed = F.floor(offset + rank * F.col("__rate")) - F.floor(offset + (rank - 1) * F.col("__rate"))
    copies = F.least(crossed, F.ceil(F.col("__rate"))).cast("long")
    placed = in_runs(rows).withColumn("__row", row).join(runs, ["__key", "__size", "__run"])
    return placed.withColumn("__copies", copies).drop("__row", "__run", "__before", "__rate")


def _key(source: Column) -> Column:
    """A source as a key that is never null: '' for a null, else '=' and the name."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__key": _key(F.col("source")), "__size": word_count(whole_text())})


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_copies: int = MOST_COPIES) -> DataFrame:
    """doc_id, size, source, source_size, target, copies of every row of ``docs``.

    size counts words (null text: 0).  Null sources form one source; null doc_ids come last in their
    source and size.  Repeated rows are documents of their own; which of two equal ones gets a copy makes
    no difference.  If all sizes are zero, targets are zero and nothing is taken.  An empty table gives an
    empty result.  Reruns agree: positions are whole numbers and nothing depends on the order of rows.
    """
    sizes = staged(_keyed(docs.select("doc_id", "source", "text")).select("doc_id", "__key", "__size"), "sizes")
    placed = _placed(sizes, sizes, seed, weights, share_percent, most_copies)
    source = F.expr("if(__key = '', null, substring(__key, 2))")
    return placed.select("doc_id", F.col("__size").alias("size"), source.alias("source"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"))


def mixed_documents(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_copies: int = MOST_COPIES) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns unchanged; cases as in :func:`mix`."""
    sizes = staged(_keyed(docs.select("doc_id", "source", "text")).select("doc_id", "__key", "__size"), "sizes")
    rows = _keyed(docs.select(whole_row(docs.columns), "doc_id", "source", "text")).select("row", "doc_id", "__key", "__size")
    placed = _placed(rows, sizes, seed, weights, share_percent, most_copies).filter("__copies > 0")
    return placed.select("row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("row.*")
