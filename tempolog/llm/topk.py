"""Exact top-k search by inner product: tiled matrix products, partial selection, tree merging.

Vectors are dealt into row groups and queries into query groups of bounded size.  One task multiplies
one row group with one query group, tile by tile, keeping each query's best k as it goes; the lists of
different row groups are merged in a tree, so no task ever sees more than ``FAN_IN`` lists of a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROW_GROUP, QUERY_GROUP = 16_384, 8_192
ROW_TILE, QUERY_TILE = 2_048, 512
FAN_IN = 32
SCALE = 1024


def quantized(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, dim, v: floor(1024 * x) of every component; rows that take no part are left out."""
    usable = F.col(column).isNotNull() & F.col(id_column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(column, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long"))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), F.size(column).alias("dim"), whole.alias("v"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return (np.concatenate(values) if values else np.empty(0, np.int64)).reshape(len(column), dim)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floating point only where every partial sum is exact in it."""
    dim = queries.shape[1]
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(dim, 1)
    if top < 2**52:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if top < 2**62:
        return queries @ rows.T
    limits = np.iinfo(np.int64)
    return np.clip(queries.astype(object) @ rows.astype(object).T, limits.min + 1, limits.max).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the k highest scores, ties to smaller ids; invalid entries last."""
    order = np.lexsort((ids, -scores, ~valid), axis=1)[:, :k]
    return tuple(np.take_along_axis(a, order, axis=1) for a in (scores, ids, valid))


def tile_best(scores: np.ndarray, ids: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`best` for columns in ascending order of id, by partial selection where keys stay exact."""
    width = scores.shape[1]
    if width > k and np.abs(scores).max(initial=0) < 2**61 // max(width, 1):
        keys = np.where(valid, scores * width - np.arange(width), np.iinfo(np.int64).min)
        chosen = np.argpartition(keys, width - k, axis=1)[:, width - k :]
        scores, ids, valid = (np.take_along_axis(a, chosen, axis=1) for a in (scores, np.broadcast_to(ids, scores.shape), valid))
    else:
        ids = np.broadcast_to(ids, scores.shape)
    return best(scores, ids, valid, k)


def group_best(k: int):
    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        dim, part = key[0].as_py(), key[1].as_py()
        found = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(rows):
            row_ids = rows["row_id"].to_numpy()
            order = np.argsort(row_ids, kind="stable")
            row_ids, matrix = row_ids[order], _matrix(rows["row_v"], dim)[order]
            all_ids, all_queries = queries["vec_id"].to_numpy(), _matrix(queries["v"], dim)
            for q in range(0, len(all_ids), QUERY_TILE):
                query_ids, some = all_ids[q : q + QUERY_TILE], all_queries[q : q + QUERY_TILE]
                top = None
                for r in range(0, len(row_ids), ROW_TILE):
                    ids = row_ids[r : r + ROW_TILE]
                    valid = ids[None, :] != query_ids[:, None]
                    new = tile_best(products(some, matrix[r : r + ROW_TILE]), ids[None, :], valid, k)
                    top = new if top is None else best(*(np.concatenate(pair, axis=1) for pair in zip(top, new, strict=True)), k)
                scores, ids, valid = top
                found["query_id"].append(np.repeat(query_ids, valid.sum(axis=1)))
                found["vec_id"].append(ids[valid])
                found["score"].append(scores[valid])
        columns = {c: np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for c, v in found.items()}
        return pa.table(columns | {"part": np.full(len(columns["score"]), part, np.int64)})

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products, ties to smaller vec_id.

    ``is_query`` is a condition on vec_id.  Vectors that are null or hold null or non-finite components, and
    rows without id, take no part; only vectors of equal length are compared.  Rows of the query's own id
    are no candidates of it; other rows that repeat an id count one by one.  A query id that repeats is
    asked once, with its least vector.  Scores outside of a long are the nearest long.  An empty table, or a
    query without candidates, gives no rows.
    """
    clean = quantized(vectors, id_column, column)
    queries = clean.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("q")).select("vec_id", "q.dim", "q.v")
    row_count, query_count = vectors.count(), vectors.filter(F.col(id_column).isNotNull()).withColumnRenamed(id_column, "vec_id").filter(is_query).count()
    parts, blocks = max(1, -(-row_count // ROW_GROUP)), max(1, -(-query_count // QUERY_GROUP))

    def dealt(frame: DataFrame, own: str, groups: int, other: str, copies: int, salt: int) -> DataFrame:
        mixed = F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(groups)).cast("long")
        return frame.withColumn(own, mixed).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))

    left = dealt(queries, "block", blocks, "part", parts, 1).groupBy("dim", "part", "block")
    renamed = dealt(clean, "part", parts, "block", blocks, 2).select("dim", "part", "block", F.col("vec_id").alias("row_id"), F.col("v").alias("row_v"))
    right = renamed.groupBy("dim", "part", "block")
    lists = left.cogroup(right).applyInArrow(group_best(k), "query_id long, vec_id long, score long, part long")
    groups = parts
    while groups > FAN_IN:
        groups = -(-groups // FAN_IN)
        merge = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("part", F.floor(F.col("part") / F.lit(FAN_IN)).cast("long")).withColumn("row", F.row_number().over(merge)).filter(F.col("row") <= k).drop("row")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
