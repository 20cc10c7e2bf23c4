"""Benchmark decontamination: suffix arrays over training texts, searched for every suffix of the benchmark's items.

Texts are indexed where they are read, a shard of about a piece of a batch at a time: the positions of its words in the
order of the suffixes that begin there.  Every suffix of an item is then looked up by binary search, one more word at
a time, in all shards' arrays; the interval of the array that is left after a window's length holds all places of the
window, and the last interval that is not empty the places of the longest verbatim match.

Nothing moves but the items: blocks of at most ``BLOCK_WORDS`` words (or one longer item) are broadcast, and texts
pass once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import running
from .common import bound_batches, staged, whole_row, whole_text
from .words import Words, pieces, words_of

#: Fixed by the operator's contract.
WINDOW = 10
#: Words of items that are broadcast at a time.
BLOCK_WORDS = 1 << 22
#: Places that are listed at a time.
PLACES = 1 << 21


@dataclass
class Items:
    """Items as numbers of words (from 1), one item after the other: what is searched for."""

    names: list[str]
    vocabulary: list[bytes]
    words: np.ndarray
    sizes: np.ndarray
    window: int

    @classmethod
    def of(cls, rows: list[tuple[str, bytes]], window: int = WINDOW) -> Items:
        """Items of names and texts; those without words are left out."""
        found = words_of(pa.array([text for _, text in rows], pa.binary()))
        numbered = found.array().dictionary_encode()
        kept = [name for (name, _), n in zip(rows, found.counts, strict=True) if n]
        return cls(kept, numbered.dictionary.to_pylist(), numbered.indices.to_numpy().astype(np.int64) + 1, found.counts[found.counts > 0], window)

    def numbers(self, words: Words) -> np.ndarray:
        """The words' numbers, 0 for words that no item has."""
        if not self.vocabulary or not len(words.starts):
            return np.zeros(len(words.starts), np.int64)
        return pc.fill_null(pc.index_in(words.array(), value_set=pa.array(self.vocabulary, pa.large_binary())), -1).to_numpy().astype(np.int64) + 1


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the suffixes that begin there, of which ``depth`` words count; by doubling.

    Words are numbers from 0; what lies beyond the end is less than any word.
    """
    n, rank, known = len(words), words.astype(np.int64), 1
    if not n:
        return np.empty(0, np.int64)
    while known < 4 and int(rank.max()) < 2**31:  # short keys need no order in between
        rank, known = _paired(rank, known), 2 * known
    while True:
        order = np.argsort(rank, kind="stable")
        new = np.cumsum(np.concatenate(([0], rank[order[1:]] != rank[order[:-1]])))
        if known >= depth or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        rank, known = _paired(rank, known), 2 * known


def _paired(rank: np.ndarray, known: int) -> np.ndarray:
    """Keys of twice the length: the rank here, then that ``known`` words on."""
    second = np.zeros(len(rank), np.int64)
    second[: len(rank) - known] = rank[known:] + 1
    return rank * (int(rank.max()) + 2) + second


def _bound(text: np.ndarray, order: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray, word: np.ndarray) -> np.ndarray:
    """For each interval of ``order`` whose suffixes share ``depth`` words, where suffixes with ``word`` next begin."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        at = order[np.minimum(middle, len(order) - 1)] + depth
        less = np.where(at < len(text), text[np.minimum(at, len(text) - 1)], -1) < word
        low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
    return low


@dataclass
class Found:
    """Of every item suffix with a window in a shard: the interval of all its places, and that of its longest match."""

    suffix: np.ndarray
    low: np.ndarray
    high: np.ndarray
    longest: np.ndarray
    longest_low: np.ndarray
    longest_high: np.ndarray


def search(text: np.ndarray, order: np.ndarray, items: Items) -> Found:
    """Binary search of every item suffix that is as long as its item's window."""
    n_words, ends = len(items.words), np.cumsum(items.sizes)
    left = np.repeat(ends, items.sizes) - np.arange(n_words)
    need = np.repeat(np.minimum(items.sizes, items.window), items.sizes)
    suffix = np.flatnonzero(left >= need)
    low, high, depth = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(order), np.int64), 0
    window = {k: np.zeros(n_words, np.int64) for k in ("low", "high", "longest", "longest_low", "longest_high")}
    while len(suffix):
        word = items.words[suffix + depth]
        new_low = _bound(text, order, depth, low, high, word)
        new_high = _bound(text, order, depth, new_low, high, word + 1)
        met = new_low < new_high
        suffix, low, high, depth = suffix[met], new_low[met], new_high[met], depth + 1
        full = need[suffix] == depth
        window["low"][suffix[full]], window["high"][suffix[full]] = low[full], high[full]
        window["longest"][suffix], window["longest_low"][suffix], window["longest_high"][suffix] = depth, low, high
        going = left[suffix] > depth
        suffix, low, high = suffix[going], low[going], high[going]
    some = np.flatnonzero(window["low"] < window["high"])
    return Found(some, *[window[k][some] for k in ("low", "high", "longest", "longest_low", "longest_high")])


class Shard:
    """Suffix array of the words of some texts, of those runs of words of items that can hold a window."""

    def __init__(self, words: Words, items: Items):
        numbers, text_of = items.numbers(words), words.text_of
        least = int(np.minimum(items.sizes, items.window).min()) if len(items.sizes) else 1
        breaks = np.flatnonzero(np.concatenate(([True], (numbers[1:] == 0) | (numbers[:-1] == 0) | (text_of[1:] != text_of[:-1]))) if len(numbers) else np.zeros(0, bool))
        lengths = np.diff(np.append(breaks, len(numbers)))
        kept = (lengths >= least) & (numbers[breaks] > 0)
        #: Where each kept run begins among all words, and in the array, where a 0 follows each run.
        self.run_starts, run_sizes = breaks[kept], lengths[kept]
        self.at = np.cumsum(run_sizes + 1) - run_sizes - 1
        self.text = np.zeros(int((run_sizes + 1).sum()), np.int64)
        place = np.repeat(self.at, run_sizes) + _within(run_sizes)
        self.text[place] = numbers[np.repeat(self.run_starts, run_sizes) + _within(run_sizes)]
        order = suffix_array(self.text, int(items.sizes.max()) if len(items.sizes) else 1)
        self.order = order[self.text[order] > 0]
        self.text_of, self.counts, self.items = text_of, words.counts, items

    def word_of(self, place: np.ndarray) -> np.ndarray:
        """Numbers among all words of the shard, of places in its array."""
        run = np.searchsorted(self.at, place, "right") - 1
        return self.run_starts[run] + place - self.at[run]

    def occurrences(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Items, first words and lengths of the places of all windows, some at a time; windows that are alike come once an item."""
        found = search(self.text, self.order, self.items)
        item = np.searchsorted(np.cumsum(self.items.sizes), found.suffix, "right")
        size = np.minimum(self.items.sizes, self.items.window)[item]
        distinct = np.unique(np.stack([item, found.low, found.high, size]), axis=1) if len(item) else np.zeros((4, 0), np.int64)
        places = distinct[2] - distinct[1]
        upto = np.cumsum(places)
        at = 0
        while at < len(places):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PLACES, "right")))
            item, low, _, size = distinct[:, at:end]
            n = places[at:end]
            yield np.repeat(item, n), self.word_of(self.order[np.repeat(low, n) + _within(n)]), np.repeat(size, n)
            at = end

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words whether they are hit; and pairs of text and item."""
        change = np.zeros(len(self.text_of) + 1, np.int64)
        pairs = [np.zeros(0, np.int64)]
        for item, word, size in self.occurrences():
            change += np.bincount(word, minlength=len(change)) - np.bincount(word + size, minlength=len(change))
            pairs.append(np.unique(self.text_of[word] * len(self.items.names) + item))
        pair = np.unique(np.concatenate(pairs))
        return np.cumsum(change[:-1]) > 0, pair // max(1, len(self.items.names)), pair % max(1, len(self.items.names))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... of each of several runs."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def blocks(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_column: str = "item_id", column: str = "text") -> Iterator[Items]:
    """Items in blocks of at most about ``block_words`` words, one of them on the driver at a time.

    Blocks are cut by running sums of bytes over an order of all items: each byte may begin a word at most every
    second time.  A null id is the empty name; null texts and those without words are no items.
    """
    name = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    rows = staged(items.select(name.alias("name"), whole_text(column).cast("binary").alias("text")).distinct(), "items")
    most_words = F.ceil((F.length("text") + 1) / 2)
    placed = staged(running(rows, ["name", F.xxhash64("text")], {"before": most_words}).withColumn("block", F.floor(F.col("before") / block_words)), "item-blocks")
    for block in sorted(row["block"] for row in placed.select("block").distinct().collect()):
        yield Items.of([(r["name"], bytes(r["text"])) for r in placed.filter(F.col("block") == block).collect()], window)


_SPANS = "array<struct<start:bigint,end:bigint>>"
_RESULT = f"n_words bigint, spans {_SPANS}, items array<string>"


def _looked_at(texts: pa.Array, earlier: pa.Array | None, items: Items) -> pa.Array:
    """Of every text the number of words, runs of hit words and names of items, with what was found for earlier blocks of items."""
    counts, sizes, starts, ends, names = [], [], [], [], []
    for words in pieces(texts):
        shard = Shard(words, items)
        is_hit, text, item = shard.hits()
        first = np.cumsum(words.counts) - words.counts
        by_text = np.searchsorted(text, np.arange(len(words.counts) + 1))
        for k, n in enumerate(words.counts.tolist()):
            before = earlier[len(counts)].as_py() if earlier is not None else {"spans": [], "items": []}
            counts.append(n)
            if by_text[k] == by_text[k + 1]:
                spans = [(span["start"], span["end"]) for span in before["spans"]]
                names.append(before["items"])
            else:
                own = np.zeros(n + 2, np.int8)
                own[1:-1] = is_hit[first[k] : first[k] + n]
                for span in before["spans"]:
                    own[span["start"] + 1 : span["end"] + 1] = 1
                spans = np.flatnonzero(np.diff(own)).reshape(-1, 2).tolist()
                names.append(sorted({*before["items"], *[items.names[i] for i in item[by_text[k] : by_text[k + 1]]]}))
            sizes.append(len(spans))
            starts += [a for a, _ in spans]
            ends += [b for _, b in spans]
    runs = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), runs)
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), spans, pa.array(names, pa.list_(pa.string()))], names=["n_words", "spans", "items"])


def _looking(spark: SparkSession, items: Items, text: Column, earlier: Column | None) -> Column:
    shared = spark.sparkContext.broadcast(items)

    @F.arrow_udf(_RESULT)
    def first(texts: pa.Array) -> pa.Array:
        return _looked_at(texts, None, shared.value)

    @F.arrow_udf(_RESULT)
    def next_(texts: pa.Array, results: pa.Array) -> pa.Array:
        return _looked_at(texts, results, shared.value)

    return first(text) if earlier is None else next_(text, earlier)


def _with_hits(docs: DataFrame, carried: Column, items: DataFrame, window: int, block_words: int) -> DataFrame:
    """``carried`` of every row of ``docs`` as row, and what was found in its text as found."""
    bound_batches(docs.sparkSession)
    rows = docs.select(carried.alias("row"), whole_text().cast("binary").alias("text"))
    looked = None
    for block in blocks(items, window, block_words):
        before = rows if looked is None else staged(looked, "block")
        looked = before.withColumn("found", _looking(docs.sparkSession, block, F.col("text"), None if looked is None else F.col("found")))
    if looked is None:
        looked = rows.withColumn("found", _looking(docs.sparkSession, Items.of([], window), F.col("text"), None))
    return looked.select("row", "found")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (names in order), spans (runs of hit words: start, end), contaminated of every row.

    A window is ``window`` consecutive words of an item, or all words of an item that has fewer; a word of a document
    is hit if it lies inside any place where a window occurs.  A null text has no words, texts of any length are looked at
    whole, repeated rows are judged alike.  Rows of one item_id are one item with the windows of all; a null item_id is an
    item with an empty name; items without words have no windows.  Without items nothing is hit; an empty table gives an empty result.
    """
    found = _with_hits(docs, F.col("doc_id"), items, window, block_words)
    listed = found.select(F.col("row").alias("doc_id"), "found.n_words", "found.items", "found.spans")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
    return listed.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (F.size("spans") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no window of ``items`` occurs, all columns unchanged whatever their names."""
    row = whole_row(docs.columns)
    return _with_hits(docs, row, items, window, block_words).filter(F.size("found.spans") == 0).select("row.*")


def longest_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """name, start, length, doc_id, doc_start: the longest verbatim match of every item suffix that has a window in ``docs``.

    ``start`` and ``doc_start`` count words from 0.  Of several longest matches of a suffix the least doc_id's first counts,
    null ids last.  Each shard sends at most one row for a suffix, and those of a suffix are reduced before they are shuffled.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", whole_text().cast("binary").alias("text"))
    schema = "name string, start long, length long, doc_id long, doc_start long"
    result = None
    for block in blocks(items, window, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for words in pieces(batch.column(1)):
                    yield _longest(Shard(words, shared.value), batch.column(0).slice(at, len(words.counts)))
                    at += len(words.counts)

        found = rows.mapInArrow(run, schema)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.min(F.struct((-F.col("length")).alias("l"), F.col("doc_id").isNull().alias("none"), "doc_id", "doc_start")).alias("best")
    chosen = result.groupBy("name", "start").agg(best)
    return chosen.select("name", "start", (-F.col("best.l")).alias("length"), "best.doc_id", "best.doc_start")


def _longest(shard: Shard, ids: pa.Array) -> pa.RecordBatch:
    items, found = shard.items, search(shard.text, shard.order, shard.items)
    ends = np.cumsum(items.sizes)
    item = np.searchsorted(ends, found.suffix, "right")
    first = np.cumsum(shard.counts) - shard.counts
    rank = np.lexsort((np.arange(len(ids)), pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy())) if len(ids) else np.zeros(0, np.int64)
    rank_of = np.empty(len(rank), np.int64)
    rank_of[rank] = np.arange(len(rank))
    word = np.zeros(len(item), np.int64)
    for n, (low, high) in enumerate(zip(found.longest_low, found.longest_high, strict=True)):
        places = shard.word_of(shard.order[low:high])
        word[n] = places[np.lexsort((places, rank_of[shard.text_of[places]]))[0]]
    text = shard.text_of[word] if len(word) else np.zeros(0, np.int64)
    columns = [pa.array([items.names[i] for i in item], pa.string()), pa.array(found.suffix - (ends - items.sizes)[item]), pa.array(found.longest), ids.take(pa.array(text)), pa.array(word - first[text] if len(word) else text)]
    return pa.RecordBatch.from_arrays(columns, names=["name", "start", "length", "doc_id", "doc_start"])
