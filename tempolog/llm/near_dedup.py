"""Near-duplicate detection: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Texts become weighted sets of five-word shingles (term frequency times inverse document frequency).
Consistent weighted samples, whose agreement has the weighted Jaccard similarity as its probability, are
cut into bands; texts that share a band are candidates.  Links are made in two steps, without all pairs of
a bucket.  First every member of a bucket is compared, by exact weighted Jaccard similarity, with the
bucket's hub, the member that meets most others over all its buckets, and connected components are formed.
Then, in blocks of bounded size, the samples of members of a bucket that are still in different components are
laid side by side; a bucket's largest component meets the others only.  Only those that agree with another in at least LEAST_AGREEMENT of them go on with their
texts, which are compared likewise, the best agreeing first.  So each pair of a bucket ends in one component,
or its texts have been compared, or its samples agree so seldom that texts of similarity 0.8 do so once in 10^9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, attach, bound_batches, staged, whole_text, whole_row

WORDS, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 a pair shares a band with a probability of 0.9987, at 0.85 of 0.99999; at 0.5 of 0.13.
BANDS, BAND_ROWS = 36, 8
#: Pairs of different components are compared if this share of their samples agrees: 6.4 standard deviations
#: below the similarity that counts, so what this rules out is a millionth of what the bands miss.
LEAST_AGREEMENT = 0.65
#: Shingles in fewer than this share of all documents weigh the same: log(1 / share) stops growing here.
RARE_SHARE = 0.0005
#: A rare shingle weighs at most this many times what the most frequent weighs.  Shared shingles of a large group
#: are frequent and edits are rare, so copies in it link from a plain similarity of 0.815 at the latest.
MOST_RATIO = 1.1
CELLS, BLOCKS = 1 << 20, 16
#: Members of one leader that one task compares; members of a bucket in one block of the second step.
SALT_MEMBERS, BLOCK_MEMBERS = 256, 1024
FAN_IN = 64

_TABLE = 1 << 18
#: The weight of a rare shingle that occurs once, which most shingles have.
COMMON = float(np.float32(np.log(1 / RARE_SHARE)))
_random = np.random.default_rng(20_240_229)


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, log c and beta of the sampling (Gamma(2, 1), Gamma(2, 1), uniform), by 18 bits of a hash.

    They are put in the order of the values that they give the common weight, so that among shingles of
    that weight the least hash is the sample.
    """
    r, c = (-np.log(_random.random(_TABLE)) - np.log(_random.random(_TABLE)) for _ in range(2))
    beta = _random.random(_TABLE)
    order = np.argsort(_log_a(np.log(COMMON), r, np.log(c), beta)[0], kind="stable")
    return r[order], np.log(c)[order], beta[order]


def _log_a(log_weight, r: np.ndarray, log_c: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.floor(log_weight / r + beta)
    return log_c - r * (t - beta) - r, t


_R, _LOG_C, _BETA = _draws()
_COMMON_VALUE, _COMMON_LEVEL = _log_a(np.log(COMMON), _R, _LOG_C, _BETA)
_ODD = _random.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of a UTF-8 text, ascending, and how often each occurs.

    Words are parted by ASCII white space, A-Z lowered; a text of fewer words is one shingle.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    count = len(words) - width + 1
    total = hashes[:count].copy()
    for k in range(1, width):
        total = total * _STEP + hashes[k : k + count]
    return np.unique(_mixed(total + np.uint64(width)), return_counts=True)


def _cells(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(44)).astype(np.int64)


def samples(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One consistent weighted sample per hash function: a hash of the shingle and its level."""
    size = len(_ODD)
    row = np.arange(size)
    best, chosen = np.full(size, np.inf), np.zeros(size, np.uint64)
    ordinary = weights == COMMON
    for part, log_weights in ((found[ordinary], None), (found[~ordinary], np.log(weights[~ordinary]))):
        for at in range(0, len(part), 2048):
            some = part[at : at + 2048]
            hashes = _ODD[:, None] * some[None, :] + _ADD[:, None]
            if log_weights is None:
                low = hashes.argmin(axis=1)
                index = (hashes[row, low] >> np.uint64(46)).astype(np.int64)
                value, level = _COMMON_VALUE[index], _COMMON_LEVEL[index]
            else:
                index = (hashes >> np.uint64(46)).astype(np.int64)
                values, levels = _log_a(log_weights[None, at : at + 2048], _R[index], _LOG_C[index], _BETA[index])
                low = values.argmin(axis=1)
                value, level = values[row, low], levels[row, low]
            sample = _mixed(some[low] + level.astype(np.int64).view(np.uint64) * _STEP)
            better = (value < best) | ((value == best) & (sample < chosen))
            best, chosen = np.where(better, value, best), np.where(better, sample, chosen)
    return chosen


def bands(sample: np.ndarray) -> np.ndarray:
    """One hash per band."""
    rows = sample.reshape(BANDS, BAND_ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        total = _mixed(total * _STEP + rows[:, k])
    return total.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over the sum of the greater; hashes ascending."""
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][at_a], b[1][at_b]).sum()
    total = a[1].sum() + b[1].sum() - common
    return float(common / total) if total > 0 else 0.0


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of texts, and cells of the sketch with the document frequencies of frequent shingles.

    Every row counts, so ``texts`` should be distinct.  A sketch of :data:`CELLS` counters, summed in a tree, gives
    each shingle its cell's count less the median of its block, which is what rare shingles put into a cell; cells
    below RARE_SHARE are left out, so what comes back has at most as many entries as the sketch has cells.
    """
    width = CELLS // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(CELLS, np.int32), 0
        held: list[np.ndarray] = []
        load = 0
        for batch in batches:
            for value in batch.column(0):
                held.append(_cells(shingles(value.as_py())[0]))
                load += len(held[-1])
                n += 1
                if load > 1_000_000:
                    counts += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.int32)
                    held, load = [], 0
        if load:
            counts += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.int32)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([_packed(task, k, counts[k * width : (k + 1) * width], n) for k in range(BLOCKS)], schema=_SKETCH)

    sketch = texts.mapInArrow(count, "task int, block int, n long, cells binary, counts binary")
    for _ in range(2):
        sketch = sketch.withColumn("task", F.floor(F.col("task") / F.lit(FAN_IN)).cast("int")).groupBy("task", "block").applyInArrow(_merged(width), "task int, block int, n long, cells binary, counts binary")
    final = staged(sketch.groupBy("block").applyInArrow(_frequent(width), "n long, cells binary, counts binary"), "frequencies")
    rows = final.collect()
    if not rows:
        return 0, np.empty(0, np.int64), np.empty(0, np.int64)
    cells = np.concatenate([np.frombuffer(r["cells"], np.int64) for r in rows])
    return rows[0]["n"], cells, np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows])


_SKETCH = pa.schema([("task", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])


def _packed(task: int, block: int, counts: np.ndarray, n: int) -> dict:
    """Counters of a block, only those in use if they are few, in 64 bits if 32 do not hold them."""
    used = np.flatnonzero(counts)
    sparse = 2 * len(used) < len(counts)
    kind = np.int32 if not len(counts) or counts.max() < 2**31 else np.int64
    return {"task": task, "block": block, "n": n, "cells": used.astype(np.int32).tobytes() if sparse else None, "counts": (counts[used] if sparse else counts).astype(kind).tobytes()}


def _summed(table: pa.Table, width: int) -> np.ndarray:
    total = np.zeros(width, np.int64)
    for cells, counts in zip(table["cells"].to_pylist(), table["counts"].to_pylist(), strict=True):
        used = np.arange(width) if cells is None else np.frombuffer(cells, np.int32)
        total[used] += np.frombuffer(counts, np.int32 if len(counts) == 4 * len(used) else np.int64)
    return total


def _merged(width: int):
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([_packed(table["task"][0].as_py(), table["block"][0].as_py(), _summed(table, width), sum(table["n"].to_pylist()))], schema=_SKETCH)

    return run


def _frequent(width: int):
    def run(table: pa.Table) -> pa.Table:
        counts, n = _summed(table, width), sum(table["n"].to_pylist())
        counts = counts - int(np.median(counts))
        cells = np.flatnonzero(counts > max(RARE_SHARE * n, 0))
        found = {"n": [n], "cells": [(cells + table["block"][0].as_py() * width).astype(np.int64).tobytes()], "counts": [counts[cells].tobytes()]}
        return pa.table(found, schema=pa.schema([("n", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())]))

    return run


class Weights:
    """Smoothed inverse document frequencies by cell: COMMON up to a share of RARE_SHARE, and linear in
    log(1 / share) down to COMMON / MOST_RATIO for a shingle of all texts."""

    def __init__(self, n: int, cells: np.ndarray, counts: np.ndarray):
        self.idf = np.full(CELLS, COMMON, np.float32)
        if n:
            least = COMMON / MOST_RATIO
            self.idf[cells] = least + (COMMON - least) * np.clip(np.log(n / np.minimum(counts, n)) / COMMON, 0, 1)

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        found, occurs = shingles(text)
        return found, self.idf[_cells(found)].astype(np.float64) * occurs


# --- connected components --------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node in links a, b; alternating large and small stars."""

    def stars(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))

    def clean(edges: DataFrame) -> DataFrame:
        return edges.filter("u <> v").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    edges = staged(clean(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "links")
    before = mark(edges)
    while before[0]:
        edges = staged(clean(stars(clean(stars(edges, True)), False)), "links")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


# --- comparing -------------------------------------------------------------------------------------


def _compare(weights):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        leader, own = None, None
        for batch in batches:
            rows = {"a": [], "b": [], "similarity": []}
            for b, node, member, text in zip(*(batch.column(k) for k in range(4)), strict=True):
                b = b.as_py()
                if not member.as_py():
                    leader, own = b, w.of(text.as_py())
                    continue
                if leader != b:
                    raise ValueError("a leader's text is missing")
                similarity = weighted_jaccard(own, w.of(text.as_py()))
                if similarity >= SIMILARITY:
                    rows["a"].append(node.as_py())
                    rows["b"].append(b)
                    rows["similarity"].append(similarity)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return run


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, weights) -> DataFrame:
    """The pairs a, b (member and leader) whose similarity suffices.

    Each member's text goes to its leaders and each leader's text to its members' tasks, at most
    SALT_MEMBERS members at a time; the leader comes first, so a task holds two texts.
    """
    sizes = staged(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", "n", F.ceil(F.col("n") / SALT_MEMBERS).cast("int").alias("salts")), "leaders")
    salted = attach(pairs, sizes.drop("n"), ["b"], _hot(sizes))
    members = salted.select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member"))
    leaders = sizes.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"))
    routes = staged(members.unionByName(leaders).join(nodes.select("node", "one_id"), "node"), "routes")
    sent = _texts_of(docs, routes)
    dealt = sent.repartition("b", "salt").sortWithinPartitions("b", "salt", "member", "node")
    return staged(dealt.select("b", "node", "member", "text").mapInArrow(_compare(weights), "a binary, b binary, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "verified")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (node, one_id and others) with the text of each node, from the one document that stands for it.

    Few wanted rows are broadcast, after they have been counted; more are joined by shuffling.
    """
    side = F.broadcast(wanted) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted
    texts = docs.select(F.col("doc_id").alias("__id"), _node().alias("__node"), whole_text().cast("binary").alias("text"))
    joined = texts.join(side, F.col("__id").eqNullSafe(F.col("one_id")) & (F.col("__node") == F.col("node")))
    return joined.select(*[c for c in wanted.columns if c != "one_id"], "text")


def _node():
    """A text's node: half of its SHA-256; equal texts are one node."""
    return F.substring(F.unhex(F.sha2(whole_text(), 256)), 1, 16)


def _hot(sizes: DataFrame) -> DataFrame:
    """The rows of ``sizes`` (with n) that hold over 1/1024 of all that is counted, so at most 1024."""
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return sizes.filter(F.col("n") * 1024 > total)


def link_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component of all nodes with a link."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(whole_text().cast("binary").alias("text")).distinct()  # exact copies make no shingle frequent
    weights = spark.sparkContext.broadcast(Weights(*document_frequencies(texts)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            rows = {"node": [], "bands": [], "bytes": []}
            for node, text in zip(batch.column(0), batch.column(1), strict=True):
                found, weight = w.of(text.as_py())
                if len(found):
                    sample = samples(found, weight)
                    rows["node"].append(node.as_py())
                    rows["bands"].append(bands(sample))
                    rows["bytes"].append(sample.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_pydict({"node": pa.array(rows["node"], pa.binary()), "bands": pa.array(rows["bands"], pa.list_(pa.int64())), "bytes": pa.array(rows["bytes"], pa.binary())})

    signed = docs.select(_node().alias("node"), whole_text().cast("binary").alias("text")).mapInArrow(sign, "node binary, bands array<bigint>, bytes binary")
    signed = staged(signed.groupBy("node").agg(F.first("bands").alias("bands"), F.first("bytes").alias("bytes")), "samples")
    members = signed.select("node", F.explode("bands").alias("band"))
    sizes = staged(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    hot = _hot(sizes)  # what is joined by band is salted for these
    shared = staged(attach(members, sizes, ["band"], hot).filter("n is not null"), "buckets")
    met = shared.groupBy("node").agg(F.sum("n").alias("met"))
    hubs = staged(shared.join(met, "node").groupBy("band").agg(F.max(F.struct("met", "node"))["node"].alias("hub")), "hubs")
    pairs = staged(attach(shared, hubs, ["band"], hot).filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    links = verified(docs, nodes, pairs, weights).select("a", "b")

    linked = components(links)
    labelled = shared.join(linked, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("band", F.lit(True).alias("__mixed"))
    rest = staged(attach(labelled, staged(mixed, "mixed-bands"), ["band"], hot).filter("__mixed").drop("__mixed"), "mixed")
    if rest.isEmpty():
        return linked
    more = staged(_linked_in_blocks(docs, nodes, rest, signed, weights), "links")
    return linked if more.isEmpty() else components(links.unionByName(more))


def _agreeing(table: pa.Table) -> np.ndarray:
    """Rows k, j of a group whose components differ and whose samples agree often enough, best agreement first.

    If the group is of two blocks, k and j are of different ones.  A pair counts in the first band that both share.
    """
    own, count = table["own"].to_numpy(), len(table)
    parent = np.unique(np.array(table["component"].to_pylist(), object), return_inverse=True)[1]
    if count < 2 or parent.max() == 0:
        return np.empty((2, 0), np.int64)
    bits = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8).reshape(count, -1)
    keys = np.array(table["bands"].to_pylist(), np.int64)
    here = (keys == table["band"][0].as_py()).argmax(axis=1)
    across = table["low"][0].as_py() != table["high"][0].as_py()
    pairs = [np.empty((3, 0), np.int64)]
    for k in range(1, count):
        others = np.flatnonzero((parent[:k] != parent[k]) & ((own[:k] != own[k]) if across else True))
        agree = (bits[others] == bits[k]).sum(axis=1)
        fine = agree >= LEAST_AGREEMENT * bits.shape[1]
        others, agree = others[fine], agree[fine]
        if len(others):
            first = (keys[others] == keys[k]).argmax(axis=1) == here[k]
            pairs.append(np.stack([-agree[first], np.full(first.sum(), k), others[first]]))
    found = np.concatenate(pairs, axis=1)
    return found[1:, np.lexsort(found[::-1])]


def _promising(table: pa.Table) -> pa.Table:
    """The rows of a group that agree with another one."""
    table = table.sort_by("node")
    return table.take(pa.array(np.unique(_agreeing(table))))


def _linked_in_blocks(docs: DataFrame, nodes: DataFrame, rest: DataFrame, signed: DataFrame, weights) -> DataFrame:
    """Links a, b between different components of a bucket, enough to join all that belong together.

    A bucket's members are cut into blocks of bounded size.  Those of the bucket's largest component have blocks of
    their own, which do not meet each other, for their members are joined already; all other blocks meet each
    block once, in a group of their own.  So a group holds at most two blocks whatever the bucket's size, and a member of
    the largest component is copied once for each block of others.  At first only their samples meet; texts are
    sent to a group for members that agree with another one there.  Pairs whose components have been joined in
    the group need no comparison, so no more links come out of a group than it has members.
    """
    many = rest.filter(F.col("n") > BLOCK_MEMBERS).groupBy("band", "component").agg(F.count(F.lit(1)).alias("of"))
    largest = many.groupBy("band").agg(F.max(F.struct("of", "component")).alias("largest")).select("band", F.col("largest.of").alias("joined"), F.col("largest.component").alias("largest"))
    sized = attach(rest, staged(largest, "largest"), ["band"], _hot(rest.filter(F.col("n") > BLOCK_MEMBERS).select("band", "n").distinct()))
    inside = F.coalesce(F.col("component") == F.col("largest"), F.lit(False))
    first = F.coalesce(F.ceil(F.col("joined") / BLOCK_MEMBERS), F.lit(0)).cast("int")  # blocks of the largest component
    blocks = first + F.ceil((F.col("n") - F.coalesce("joined", F.lit(0))) / BLOCK_MEMBERS).cast("int")
    own = F.when(inside, F.pmod(F.xxhash64("node"), first)).otherwise(first + F.pmod(F.xxhash64("node"), blocks - first)).cast("int")
    dealt = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.when(inside, first).otherwise(F.lit(0)), blocks - 1)))
    placed = dealt.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "component")
    columns = "band long, low int, high int, own int, node binary, component binary, bands array<bigint>, bytes binary"
    group = placed.join(signed, "node").select("band", "low", "high", "own", "node", "component", "bands", "bytes").groupBy("band", "low", "high")
    near = staged(group.applyInArrow(_promising, columns), "promising")
    wanted = near.select("node").distinct().join(nodes.select("node", "one_id"), "node")
    texts = staged(_texts_of(docs, staged(wanted, "wanted")), "texts")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def link(table: pa.Table) -> pa.Table:
        w = weights.value
        table = table.sort_by("node")
        names, parent = table["node"].to_pylist(), table["component"].to_pylist()
        root = {c: c for c in parent}
        sets: dict[int, tuple] = {}

        def find(x: bytes) -> bytes:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def weighted(k: int) -> tuple:
            if k not in sets:
                sets[k] = w.of(table["text"][k].as_py())
            return sets[k]

        found: dict[str, list] = {"a": [], "b": []}
        for k, j in _agreeing(table).T.tolist():
            x, y = find(parent[k]), find(parent[j])
            if x != y and weighted_jaccard(weighted(k), weighted(j)) >= SIMILARITY:
                root[x] = y
                found["a"].append(names[k])
                found["b"].append(names[j])
        return pa.table(found, schema=schema)

    return near.join(texts, "node").groupBy("band", "low", "high").applyInArrow(link, "a binary, b binary")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, kept of every row of ``docs``.

    A class holds all texts that links of a similarity of at least 0.8 join, and all rows of an equal text;
    class_id is its least doc_id (null if it has none), whose row stays.  Texts of any length are compared whole.  A null text counts as empty; all
    empty texts form one class, which nothing else joins.  Repeated rows of one doc_id and text are judged
    alike; an empty table gives an empty result; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows = staged(docs.select("doc_id", _node().alias("node")), "nodes")
    nodes = staged(rows.groupBy("node").agg(F.min("doc_id").alias("one_id"), F.count(F.lit(1)).alias("n")), "distinct")
    linked = link_nodes(docs, nodes)
    placed = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = F.min(F.struct(F.col("one_id").isNull().alias("last"), F.col("one_id").alias("id"), F.col("node").alias("of")))
    named = placed.groupBy("component").agg(first.alias("first"), F.sum("n").alias("class_size"))
    table = staged(placed.join(named, "component").select("node", F.col("first.id").alias("class_id"), F.col("first.of").alias("__first"), "class_size"), "classes")
    total = rows.count()
    hot = nodes.filter(F.col("n") * 1024 > total).select("node")
    joined = attach(rows, table, ["node"], hot)
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("__first"))
    return joined.select("doc_id", "class_id", F.col("class_size").cast("long").alias("class_size"), kept.alias("kept"), F.col("node").alias("__node"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each class, all columns unchanged."""
    stay = staged(classes(docs).filter("kept").select(F.col("doc_id").alias("__id"), "__node").distinct(), "stay")
    marked = docs.select(whole_row(docs.columns), "doc_id", _node().alias("text_node"))
    return marked.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_node") == F.col("__node")), "left_semi").select("row.*")
