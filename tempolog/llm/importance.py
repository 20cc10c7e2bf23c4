"""Importance resampling of documents toward a target by hashed word features.

Two passes over the texts in Arrow batches.  In the first, every partition counts its features into one vector
of buckets by ``np.bincount``; a tree of tasks adds the vectors up, so the driver gets one vector whatever the input.
Gains of the buckets are broadcast, and the second pass sums them over the features of each document.  Documents are
then drawn by Gumbel noise: the highest sums of weight and noise are a sample without replacement in proportion to
the exponential of weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import bound_batches, staged, tree_sum, whole_row, whole_text
from .words import Words, pieces

#: Fixed by the operator's contract.
BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED, UNIT = 10_000, 2, 20, 25, 7, 1000
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _extended(words: Words, at: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Crc registers after the words numbered ``at``, from the registers ``state``: byte by byte, all words at once."""
    starts, lengths = words.starts[at], words.ends[at] - words.starts[at]
    order = np.argsort(-np.minimum(lengths, LONG_WORD + 1), kind="stable")
    begin, size, register = starts[order], lengths[order], state[order]
    short = np.searchsorted(-size, -LONG_WORD)  # the words before are longer
    for k in range(int(size[short]) if short < len(size) else 0):
        upto = short + np.searchsorted(-size[short:], -k)
        some = register[short:upto]
        register[short:upto] = _CRC[(some ^ words.data[begin[short:upto] + k]) & 255] ^ (some >> 8)
    for n in range(short):
        whole = zlib.crc32(words.data[begin[n] : begin[n] + size[n]].tobytes(), int(register[n]) ^ 0xFFFFFFFF)
        register[n] = whole ^ 0xFFFFFFFF
    state = np.empty_like(register)
    state[order] = register
    return state


def feature_buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every run of 1 to 2 words: unsigned crc32 of its UTF-8 bytes, modulo the number of buckets."""
    text_of = words.text_of
    every = np.arange(len(text_of))
    state = np.full(len(every), 0xFFFFFFFF, np.uint32)
    hashed, texts = [], []
    for length in range(1, RUN + 1):
        state = _extended(words, every, state)
        hashed.append(state ^ np.uint32(0xFFFFFFFF))
        texts.append(text_of[every - (length - 1)])
        goes_on = every + 1 < len(text_of)
        goes_on[goes_on] = text_of[every[goes_on] + 1] == text_of[every[goes_on]]
        some = state[goes_on]
        every, state = every[goes_on] + 1, _CRC[(some ^ np.uint32(32)) & 255] ^ (some >> 8)
    return (np.concatenate(hashed) % BUCKETS).astype(np.int64), np.concatenate(texts)


def bucket_counts(texts: DataFrame, column: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for words in pieces(batch.column(0)):
                counts += np.bincount(feature_buckets(words)[0], minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([counts.tobytes()], pa.binary())})

    bound_batches(texts.sparkSession)
    return tree_sum(texts.select(whole_text(column).cast("binary").alias("text")).mapInArrow(run, "counts binary"), BUCKETS)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target and in the source, rounded down."""
    s_all, t_all = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(UNIT * math.log((int(t) + 1) * s_all / ((int(s) + 1) * t_all))) for s, t in zip(source, target, strict=True)], np.int64)


def weights(texts: pa.Array, gain: np.ndarray) -> pa.Array:
    """Of every text n_features and weight, the mean of its features' gains rounded down (0 if it has none)."""
    counts, means = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for words in pieces(texts):
        bucket, text = feature_buckets(words)
        n = np.bincount(text, minlength=len(words.counts))
        total = np.bincount(text, weights=gain[bucket].astype(np.float64), minlength=len(n)).astype(np.int64)  # whole numbers, far below 2^53
        counts.append(n)
        means.append(total // np.maximum(n, 1))
    return pa.StructArray.from_arrays([pa.array(np.concatenate(counts)), pa.array(np.concatenate(means))], names=["n_features", "weight"])


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, rounded down, from a hash of seed and id (a null id being the empty name)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(UNIT)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _scored(docs: DataFrame, target: DataFrame, carried: Column, seed: int) -> DataFrame:
    bound_batches(docs.sparkSession)
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs), bucket_counts(target)))  # 80 KB whatever the input

    @F.arrow_udf("n_features long, weight long")
    def weigh(texts: pa.Array) -> pa.Array:
        return weights(texts, gain.value)

    weighted = docs.select(carried.alias("row"), weigh(whole_text().cast("binary")).alias("w"), F.col("doc_id"))
    scored = weighted.select("row", "doc_id", "w.n_features", "w.weight", (F.col("w.weight") + noise(F.col("doc_id"), seed)).alias("score"))
    return staged(scored, "importance")


def _drawn(scored: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """Rows long enough to be drawn with their place (from 1), highest scores first, and how many places are drawn."""
    long_enough = scored.filter(F.col("n_features") >= RUN * LEAST_WORDS - 1)
    order = [-F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("n_features")]
    return numbered(long_enough, order, "place"), percent * long_enough.count() // 100


def resampling(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is null where a row is not drawn.

    Of the documents with at least 20 words, ``percent`` in a hundred (rounded down) are drawn, ties to the smaller
    doc_id, null ids last; repeated rows are documents of their own, and one of them may be drawn without the other.
    Null and empty texts have no features and weight 0; texts of any length are read whole.  An empty ``docs`` gives an
    empty result; with an empty target the gains lean against frequent buckets.  Other columns are not read.
    """
    scored = _scored(docs, target, F.lit(None).cast("int"), seed).drop("row")
    placed, quota = _drawn(scored, percent)
    short = scored.filter(F.col("n_features") < RUN * LEAST_WORDS - 1).withColumn("place", F.lit(None).cast("long"))
    both = placed.unionByName(short)
    return both.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= quota, F.col("place")).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns unchanged whatever their names; cases as in :func:`resampling`."""
    placed, quota = _drawn(_scored(docs, target, whole_row(docs.columns), seed), percent)
    return placed.filter(F.col("place") <= quota).select("row.*")
