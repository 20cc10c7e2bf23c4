"""Vector code compression: product quantization whose codebooks are found by the filtering form of Lloyd's rounds.

Vectors are dealt into blocks.  For each part position a block has a kd-tree over its part vectors, whose nodes keep
their bounding box and the sum and number of what lies below.  A round walks the trees level by level with the entries
of the codebook that are still candidates of each node: an entry leaves where every point of the box is nearer to
another one.  A node with one candidate left is assigned as a whole, by its kept sum; leaves compare what is left.

Blocks are a table in the shared folder, built once.  A round broadcasts the codebooks (256 vectors), and each
partition sends one vector of sums and counts, added up by a tree of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import attach, bound_batches, staged, tree_sum
from .topk import SCALE, products

#: Fixed by the operator's contract.
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors of a block, and part vectors of a leaf at most.
BLOCK, LEAF = 8_192, 24
#: Components beyond this are taken as this, so that squared distances and sums of 10^11 vectors stay whole numbers of 64 bits.
MOST = 1 << 26
#: Nodes whose boxes are compared with entries at a time.
NODES = 256


@dataclass
class Tree:
    """Nodes of a kd-tree over ``points[order]``: each covers a range; children follow their parents' level."""

    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    box: np.ndarray
    sums: np.ndarray


def tree_order(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """An order of the points in which every node's range splits in the middle, along the box's widest side."""
    order = np.arange(len(points))
    ranges = [(0, len(points))]
    while ranges:
        low, high = ranges.pop()
        if high - low <= leaf or not points.shape[1]:
            continue
        own = points[order[low:high]]
        side = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        middle = (high - low) // 2
        order[low:high] = order[low:high][np.argpartition(own[:, side], middle)]
        ranges += [(low, low + middle), (low + middle, high)]
    return order


def tree_of(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over points in :func:`tree_order`, with each node's box and sum."""
    low, high, child, at = [0], [len(points)], [], 0
    while at < len(low):
        if high[at] - low[at] <= leaf or not points.shape[1]:
            child.append(-1)
        else:
            middle = low[at] + (high[at] - low[at]) // 2
            child.append(len(low))
            low += [low[at], middle]
            high += [middle, high[at]]
        at += 1
    box, sums = np.zeros((len(low), 2, points.shape[1]), np.int64), np.zeros((len(low), points.shape[1]), np.int64)
    for n in range(len(low) - 1, -1, -1):
        if child[n] < 0:
            own = points[low[n] : high[n]]
            box[n], sums[n] = (own.min(axis=0), own.max(axis=0)), own.sum(axis=0)
        else:
            a, b = child[n], child[n] + 1
            box[n, 0], box[n, 1], sums[n] = np.minimum(box[a, 0], box[b, 0]), np.maximum(box[a, 1], box[b, 1]), sums[a] + sums[b]
    return Tree(np.array(low), np.array(high), np.array(child), box, sums)


def remaining(box: np.ndarray, entries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The candidates (node by entry) that may be nearest to some point of the box, ties being the lower entry's."""
    norms = (entries * entries).sum(axis=1)
    middle = box[:, 0] + box[:, 1]  # twice the midpoint
    far = norms[None, :] - products(middle, entries)
    best = np.argmin(np.where(candidates, far, np.iinfo(np.int64).max), axis=1)
    apart = entries[None, :, :] - entries[best][:, None, :]
    reach = np.maximum(apart * box[:, 0][:, None, :], apart * box[:, 1][:, None, :]).sum(axis=2)
    least = norms[None, :] - norms[best][:, None] - 2 * reach  # how much farther than the best, where it is least so
    return candidates & ((least < 0) | (least == 0) & (np.arange(len(entries))[None, :] <= best[:, None]))


def nearest(points: np.ndarray, tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of every point (ties to the lower index), and sums and numbers of the points of each entry."""
    code = np.zeros(len(points), np.int64)
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    level, candidates = np.array([0]), np.ones((1, len(entries)), bool)
    while len(level):
        following, open_ = [], []
        for at in range(0, len(level), NODES):
            node, some = level[at : at + NODES], candidates[at : at + NODES]
            some = remaining(tree.box[node], entries, some)
            alone, leaf = some.sum(axis=1) == 1, tree.child[node] < 0
            entry = some.argmax(axis=1)
            for n, e in zip(node[alone], entry[alone], strict=True):
                code[tree.low[n] : tree.high[n]] = e
            np.add.at(sums, entry[alone], tree.sums[node[alone]])
            np.add.at(counts, entry[alone], tree.high[node[alone]] - tree.low[node[alone]])
            ends = np.flatnonzero(~alone & leaf)
            if len(ends):
                size = tree.high[node[ends]] - tree.low[node[ends]]
                place = np.repeat(tree.low[node[ends]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                own = points[place]
                far = (entries * entries).sum(axis=1)[None, :] - 2 * products(own, entries)
                code[place] = np.argmin(np.where(np.repeat(some[ends], size, axis=0), far, np.iinfo(np.int64).max), axis=1)
                np.add.at(sums, code[place], own)
                counts += np.bincount(code[place], minlength=len(entries))
            inner = ~alone & ~leaf
            following.append((tree.child[node[inner]][:, None] + np.arange(2)).ravel())
            open_.append(np.repeat(some[inner], 2, axis=0))
        level, candidates = np.concatenate(following), np.concatenate(open_)
    return code, sums, counts


def bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts begin and end; equal if ``dim`` is a multiple of ``parts``, else as equal as can be."""
    return [(k * dim // parts, (k + 1) * dim // parts) for k in range(parts)]


def _kept(vectors: DataFrame, id_column: str, column: str, label: str) -> DataFrame:
    usable = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(column, lambda x: F.greatest(F.least(F.floor(F.lit(SCALE) * x.cast("double")), F.lit(MOST)), F.lit(-MOST)).cast("long"))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), F.col(label).alias("label"), whole.alias("v"))


def _blocks(kept: DataFrame, dim: int, parts: int) -> DataFrame:
    """One row per block: ids, labels, vectors in rows, and for each part position the order of its tree."""

    def of(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        n = len(table)
        matrix = table["v"].combine_chunks().flatten().to_numpy().reshape(n, dim)
        orders = np.stack([tree_order(matrix[:, a:b]) for a, b in bounds(dim, parts)]).astype(np.int32)
        columns = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), table[c].combine_chunks()) for c in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays([*columns, pa.array([matrix.tobytes()], pa.binary()), pa.array([orders.tobytes()], pa.binary())], names=["vec_id", "label", "v", "orders"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                n += len(batch)
            if n >= BLOCK:
                yield of(held)
                held, n = [], 0
        if held:
            yield of(held)

    schema = StructType().add("vec_id", ArrayType(LongType())).add("label", ArrayType(kept.schema["label"].dataType)).add("v", "binary").add("orders", "binary")
    return staged(kept.filter(F.size("v") == dim).mapInArrow(run, schema), "blocks")


def _unpacked(row_v: bytes, row_orders: bytes, dim: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, Tree]]:
    """For each part position the order, the part vectors in it, and their tree."""
    orders = np.frombuffer(row_orders, np.int32).reshape(parts, -1)
    matrix = np.frombuffer(row_v, np.int64).reshape(orders.shape[1], dim)
    for order, (a, b) in zip(orders, bounds(dim, parts), strict=True):
        points = matrix[order, a:b]
        yield order, points, tree_of(points)


def trained(kept: DataFrame, blocks: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after all rounds, one of each part position, from those of the smallest ids."""
    first = kept.filter(F.size("v") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.array([row["v"] for row in first], np.int64).reshape(len(first), dim)
    books = [start[:, a:b] for a, b in bounds(dim, parts)]
    length = len(first) * (dim + parts)
    for _ in range(rounds):
        shared = kept.sparkSession.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(length, np.int64)
            for batch in batches:
                for v, orders in zip(batch.column(0), batch.column(1), strict=True):
                    got = [nearest(points, tree, book)[1:] for (_, points, tree), book in zip(_unpacked(v.as_py(), orders.as_py(), dim, parts), shared.value, strict=True)]
                    total += np.concatenate([x.ravel() for pair in got for x in pair])
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

        total, at, moved = tree_sum(blocks.select("v", "orders").mapInArrow(run, "sums binary"), length), 0, []
        for book in books:
            sums, counts = total[at : at + book.size].reshape(book.shape), total[at + book.size : at + book.size + len(book)]
            moved.append(np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], book))
            at += book.size + len(book)
        books = moved
    return books


def compressed(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code (two hex digits a part), error of every kept vector, and the codebooks.

    Vectors that are null or hold null or non-finite components are left out; of the rest, floor(1024 * x) of each component x counts
    (beyond 2^26 in size: that bound).  Codebooks start from the vectors of the smallest ids (null ids last; of one id the least vector
    first), fewer than 256 if there are fewer vectors.  Repeated rows are vectors of their own.  All vectors should have one length, that of
    the first of these; vectors of another length have a null code and error.  A length that is no multiple of the parts is cut as evenly as
    can be.  An empty table gives an empty result.  Other columns are not read.
    """
    bound_batches(vectors.sparkSession)
    kept = staged(_kept(vectors, id_column, column, label), "vectors")
    one = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    dim = one[0] if one else 0
    blocks = _blocks(kept, dim, parts)
    books = trained(kept, blocks, dim, parts, entries, rounds)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                ids, labels = (batch.column(c)[k].values for c in (0, 1))
                codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, ((order, points, tree), book) in enumerate(zip(_unpacked(batch.column(2)[k].as_py(), batch.column(3)[k].as_py(), dim, parts), shared.value, strict=True)):
                    code, _, _ = nearest(points, tree, book)
                    codes[order, p] = code
                    error[order] += ((points - book[code]) ** 2).sum(axis=1)
                text = codes.tobytes().hex()
                listed = [text[at : at + 2 * parts] for at in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(listed, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    schema = StructType().add("vec_id", "long").add("label", kept.schema["label"].dataType).add("code", "string").add("error", "long")
    coded = blocks.mapInArrow(run, schema)
    others = kept.filter(F.size("v") != dim).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(others), books


def books_digest(books: list[np.ndarray]) -> str:
    """Hex SHA-256 of all entries' components in decimals, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def with_label_errors(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels, nulls together) and codebooks_sha256."""
    key: Column = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = staged(coded.select("vec_id", "code", "error", key.alias("key")), "coded")
    sums = staged(rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    hot = sums.filter(F.col("n") * 1024 > rows.count()).select("key")
    return attach(rows, sums.drop("n"), ["key"], hot).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def reconstructed(coded: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """``coded`` with embedding, the vector that its code stands for (null for a null code)."""
    entries = F.lit([[[x / scale for x in entry] for entry in book.tolist()] for book in books])
    indices = F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.conv(F.substring("code", p * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    looked_up = F.flatten(F.transform(indices, lambda index, p: entries[p][index]))
    return coded.withColumn("embedding", F.when(F.col("code").isNotNull(), looked_up))
