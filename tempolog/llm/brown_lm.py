"""Class-based bigram language model with classes from exchange clustering.

P(w | v) = mix * P(class(w) | class(v)) * P(w | class(w)) + (1 - mix) * P(w), the last being the add-one
unigram, so that every text has a probability.  Words are counted over all training texts.  The most
frequent words are assigned to classes by the exchange algorithm; then every other training word gets the
class that its neighbours' classes, summed over all its occurrences, make most likely.  Only words that do not
occur in training belong to the class of their shape, which is read off their bytes.  A word's emission is
proportional to (its count + 1), as in the unigram, so that its probability is (count + 1) times a factor
of the classes alone.  Classes and counts of frequent words are broadcast, those of all others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, staged, whole_text

#: Words that exchange clustering begins with, classes it places them in, sweeps it makes.
CLUSTERED, CLASSES, SWEEPS = 1024, 48, 4
#: Distinct words from which on the first two grow, with the eighth root of the vocabulary.
VOCABULARY = 131_072
#: Words whose counts are broadcast, at most; all others' are joined.
BROADCAST_WORDS = 131_072
#: Distinct words a task counts before it passes partial counts on.
HELD_WORDS = 400_000
#: Tokens whose neighbours or pairs a task counts before it passes partial counts on.
HELD_TOKENS = 1_000_000
MIX = 0.85
SMOOTHING = 0.5
#: Shape classes: last byte '.', ',', another sign or a letter or digit, times ASCII or not.
SHAPES = 8
#: The end of a text, as a word: no word is empty.
END = b""


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id has the empty text's remainder."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text in lower case (A-Z only)."""
    return text.lower().split()


def shape(word: bytes) -> int:
    last = word[-1]
    sign = 0 if last == 46 else 1 if last == 44 else 3 if last > 127 or 97 <= last <= 122 or 48 <= last <= 57 else 2
    return sign + (0 if word.isascii() else 4)


def count_words(texts: DataFrame) -> DataFrame:
    """word (binary), n over all texts, the end once per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                found.update(words(value.as_py()))
                found[END] += 1
                if len(found) > HELD_WORDS:
                    yield flush()
        if found:
            yield flush()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words of at least some count, at most ``most`` of them, by falling count; the end is not among them."""
    level = F.floor(F.log2("n") * 16).cast("int")
    real = counts.filter(F.length("word") > 0)
    sizes = {r["level"]: r["words"] for r in real.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()}
    total, least = 0, None
    for at in sorted(sizes, reverse=True):  # at most 1024 levels
        total += sizes[at]
        if total > most:
            break
        least = at
    if least is None:
        return []
    table = real.filter(level >= least).toArrow()
    pairs = zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True)
    return sorted(pairs, key=lambda p: (-p[1], p[0]))


def exchange_classes(pairs: np.ndarray, words_placed: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every unit from its bigram counts (square matrix); units from ``words_placed`` on keep classes of their own.

    The most frequent words begin with a class each.  Then each word in turn enters, or moves to, the class
    that raises the log likelihood of class bigrams most; a sweep without a move ends it.
    """
    units = len(pairs)
    fixed = units - words_placed
    total = classes + fixed
    start = np.where(np.arange(words_placed) < classes, np.arange(words_placed), -1)
    assigned = np.concatenate([start, classes + np.arange(fixed)]).astype(np.int64)
    member = np.zeros((units, total))
    member[assigned >= 0, assigned[assigned >= 0]] = 1
    right_all = pairs @ member  # counts of unit then class
    left_all = pairs.T @ member  # counts of class before unit
    table = member.T @ right_all

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1.0))

    for _ in range(sweeps):
        moved = 0
        for w in range(words_placed):
            a = int(assigned[w])
            right, left, own = right_all[w].copy(), left_all[w].copy(), pairs[w, w]
            if a >= 0:
                right[a] -= own
                left[a] -= own
                table[a, :] -= right
                table[:, a] -= left
                table[a, a] -= own
            base = table[:classes, :]
            rows = f(base + right) - f(base)
            columns = f(table[:, :classes] + left[:, None]) - f(table[:, :classes])
            corner = np.arange(classes)
            both = f(table[corner, corner] + right[corner] + left[corner] + own) - f(table[corner, corner])
            gain = rows.sum(axis=1) + columns.sum(axis=0) - rows[corner, corner] - columns[corner, corner] + both
            out, into = table.sum(axis=1)[:classes], table.sum(axis=0)[:classes]
            gain -= f(out + right.sum() + own) - f(out) + f(into + left.sum() + own) - f(into)
            b = int(np.argmax(gain))
            if a >= 0 and gain[b] <= gain[a] + 1e-9:
                b = a
            table[b, :] += right
            table[:, b] += left
            table[b, b] += own
            if b != a:
                moved += 1
                assigned[w] = b
                for matrix, counts in ((right_all, pairs[:, w]), (left_all, pairs[w, :])):
                    if a >= 0:
                        matrix[:, a] -= counts
                    matrix[:, b] += counts
        if not moved:
            break
    return assigned


def growth(vocabulary: int) -> float:
    """What CLUSTERED and CLASSES are multiplied by."""
    return max(1.0, (vocabulary / VOCABULARY) ** 0.125)


def coded(docs: DataFrame, frequent: list[tuple[bytes, int]]) -> DataFrame:
    """row, doc_id, held_out, codes, words: each text as numbers of frequent words, the others as -1 - shape and by name."""
    index = docs.sparkSession.sparkContext.broadcast({w: k for k, (w, _) in enumerate(frequent)})
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("codes", pa.list_(pa.int32())), ("words", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        row = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        load = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, out, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens = words(value.as_py())
                codes = np.fromiter(map(known.get, tokens, repeat(-1)), np.int32, len(tokens))
                missing = np.flatnonzero(codes < 0)
                others = [tokens[k] for k in missing]
                codes[missing] = [-1 - shape(w) for w in others]
                held.append((row, doc_id, out, codes, others))
                row += 1
                load += len(tokens) + 1
                if load > 200_000:
                    yield flush()
                    held, load = [], 0
        if held:
            yield flush()

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), whole_text().cast("binary").alias("text"))
    return staged(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, codes array<int>, words array<binary>"), "coded")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and how many each row has."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def _with_ends(values: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """Values of texts one after another, each followed by the end, the first also preceded by it."""
    return np.concatenate([[end], np.insert(values, np.cumsum(lengths), end)])


def _pair_counts(numbers: DataFrame, column: str, units: int, read) -> np.ndarray:
    """Square matrix of bigram counts over ``read(column)``, the numbers of texts with ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = read(batch.column(0))
            for at in range(0, len(ids) - 1, HELD_TOKENS):
                part = ids[at : at + HELD_TOKENS + 1]
                codes, n = np.unique(part[:-1] * units + part[1:], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    table = numbers.select(column).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(units * units)
    matrix[table["code"].to_numpy()] = table["n"].to_numpy()
    return matrix.reshape(units, units)


def count_pairs(texts: DataFrame, unit_of: np.ndarray, units: int) -> np.ndarray:
    """Bigram counts of the seed words, the shape classes and the end; ``unit_of`` a code, those below zero at its end."""
    return _pair_counts(texts, "codes", units, lambda column: _with_ends(unit_of[_flat(column)[0]], _flat(column)[1], units - 1))


def placed_by_neighbours(texts: DataFrame, frequent: list[tuple[bytes, int]], seeds: int, class_of: np.ndarray, table: np.ndarray, classes: int) -> DataFrame:
    """word, n, class of every training word but the seeds.

    ``class_of`` gives the class of a code while only seeds are placed (the others have their shapes'), and
    ``table`` these classes' bigrams.  A word goes to the class of seeds under which the classes before and
    after all its occurrences are most likely; equal ones go to the first.
    """
    total = len(table)
    with_seeds = np.isin(np.arange(classes), class_of[:seeds])
    before = table[:, :classes] + SMOOTHING
    after = table[:classes, :].T + SMOOTHING
    gains = np.concatenate([np.log(before / before.sum(axis=0)), np.log(after / after.sum(axis=0))])
    gains[:, ~with_seeds] = -np.inf
    shared = texts.sparkSession.sparkContext.broadcast(([w for w, _ in frequent], class_of, gains))
    span = 2 * total

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, classes_of, _ = shared.value
        numbers: dict[bytes, int] = {}
        held: list[np.ndarray] = []
        load = 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            owners, starts = np.unique(keys // span, return_index=True)
            others = list(numbers)
            named = pa.array([names[k] if k < len(names) else others[k - len(names)] for k in owners.tolist()], pa.binary())
            offsets = pa.array(np.append(starts, len(keys)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (keys % span, n)]
            return pa.RecordBatch.from_arrays([named, *lists], names=["word", "codes", "counts"])

        for batch in batches:
            codes, lengths = _flat(batch.column(0))
            near = _with_ends(classes_of[codes], lengths, total - 1).astype(np.int64)
            # Where each token stands in ``near``: after the first end and the ends of the texts before its own.
            at = np.arange(len(codes)) + 1 + np.repeat(np.arange(len(lengths)), lengths)
            owner = codes.astype(np.int64)
            rare = np.flatnonzero(codes < 0)
            owner[rare] = [len(names) + numbers.setdefault(w, len(numbers)) for w in batch.column(1).flatten().to_pylist()]
            use = np.flatnonzero((codes < 0) | (codes >= seeds))
            owner, at = owner[use] * span, at[use]
            if len(use):
                held += [owner + near[at - 1], owner + total + near[at + 1]]
                load += len(use)
            if load > HELD_TOKENS or len(numbers) > HELD_WORDS:
                yield flush()
                numbers.clear()
                held, load = [], 0
        if held:
            yield flush()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains_of = shared.value[2]
        carried: pa.Table | None = None

        def decide(rows: pa.Table) -> pa.RecordBatch:
            names = rows["word"].combine_chunks()
            codes, lengths = _flat(rows["codes"].combine_chunks())
            counts = _flat(rows["counts"].combine_chunks())[0]
            first = np.append(True, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) if len(names) > 1 else np.array([True])
            starts = (np.cumsum(lengths) - lengths)[first]
            n = np.add.reduceat(np.where(codes < total, counts, 0), starts)
            best = np.empty(len(starts), np.int32)
            for k in range(0, len(starts), 4096):
                low, high = starts[k], starts[k + 4096] if k + 4096 < len(starts) else len(codes)
                worth = np.add.reduceat(gains_of[codes[low:high]] * counts[low:high, None], starts[k : k + 4096] - low, axis=0)
                best[k : k + 4096] = worth.round(9).argmax(axis=1)
            return pa.RecordBatch.from_arrays([names.filter(pa.array(first)), pa.array(n, pa.int64()), pa.array(best)], names=["word", "n", "class"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if carried is None else pa.concat_tables([carried, rows])
            if not len(rows):
                continue
            names = rows["word"]
            last = pc.index(names, names[len(names) - 1]).as_py()  # the last word may go on in the next batch
            if last:
                yield decide(rows.slice(0, last))
            carried = rows.slice(last)
        if carried is not None:
            yield decide(carried)

    near = texts.select("codes", "words").mapInArrow(gather, "word binary, codes array<int>, counts array<int>")
    return staged(near.repartition("word").sortWithinPartitions("word").mapInArrow(place, "word binary, n long, class int"), "word-classes")


class Model:
    """What scoring needs: log tables of bounded size, and class and log10(count + 1) of frequent words."""

    def __init__(self, frequent: list[tuple[bytes, int]], frequent_classes: np.ndarray, pairs: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray, tokens: int, vocabulary: int, texts: int):
        total = len(pairs)
        table = pairs + SMOOTHING
        follow = table / table.sum(axis=1, keepdims=True)
        self.tokens, self.vocabulary, self.end_class = tokens, vocabulary, total - 1
        size = tokens + vocabulary + 1
        self.log_size = np.log10(size)
        self.follow = MIX * follow
        # Of (count + 1); a class without words, as those of shapes, has one unknown word.
        room = np.maximum(class_tokens + class_words, 1)
        self.factor = np.log10(self.follow / room + (1 - MIX) / size)
        self.factor[:, -1] = np.log10(self.follow[:, -1] + (1 - MIX) * (texts + 1) / size)  # the end, its count included
        n = np.array([c for _, c in frequent], np.float64)
        self.count_log = np.append(np.log10(n + 1), [np.log10(texts + 1), 0.0])
        self.classes = np.append(frequent_classes, [total - 1, 0]).astype(np.int64)
        self.emission = np.append((n + 1) / room[frequent_classes], [1.0, 0.0])
        self.unigram = (1 - MIX) * np.append(n + 1, [texts + 1, 1.0]) / size
        self.end_known = texts > 0


def _learned(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the words that it does not carry (word, n, class), and all texts as classes."""
    bound_batches(docs.sparkSession)
    texts = docs.filter(~held_out(F.col("doc_id"))).select(whole_text().cast("binary").alias("text"))
    counts = staged(count_words(texts), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.max(F.when(F.length("word") == 0, F.col("n"))), F.lit(0)).alias("texts")).first()
    frequent = frequent_words(counts, BROADCAST_WORDS)
    grown = growth(totals["v"])
    classes, seeds = int(CLASSES * grown), min(len(frequent), int(CLUSTERED * grown))
    total = classes + SHAPES + 1
    numbered = coded(docs, frequent)
    training = numbered.filter("not held_out")

    # Seeds have units of their own, all others their shapes'; codes below zero count from the end of the table.
    shapes = np.array([shape(w) for w, _ in frequent[seeds:]], np.int64)
    backward = np.arange(SHAPES)[::-1]
    unit_of = np.concatenate([np.arange(seeds), seeds + shapes, seeds + backward]).astype(np.int64)
    pairs = count_pairs(training, unit_of, seeds + SHAPES + 1)
    assigned = exchange_classes(pairs, seeds, classes) if seeds else classes + np.arange(SHAPES + 1)
    member = np.zeros((len(pairs), total))
    member[np.arange(len(pairs)), assigned] = 1
    others = placed_by_neighbours(training, frequent, seeds, assigned[unit_of], member.T @ pairs @ member, classes)

    least = min((n for _, n in frequent), default=0)
    carried = others.filter(F.col("n") >= least).toArrow() if frequent else None
    frequent_classes = np.zeros(len(frequent), np.int64)
    frequent_classes[:seeds] = assigned[:seeds]
    if carried is not None:
        of = dict(zip(carried["word"].to_pylist(), carried["class"].to_pylist(), strict=True))
        frequent_classes[seeds:] = [of[w] for w, _ in frequent[seeds:]]
    class_tokens, class_words = np.zeros(total), np.zeros(total)
    for row in others.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        class_tokens[row["class"]], class_words[row["class"]] = row["n"], row["v"]
    np.add.at(class_tokens, assigned[:seeds], [n for _, n in frequent[:seeds]])
    np.add.at(class_words, assigned[:seeds], 1)
    rest = others.filter(F.col("n") < least)
    sequences = in_classes(numbered, rest, frequent, frequent_classes, classes, totals["texts"])
    kind = np.dtype(_kind(total))
    seen = sequences.filter("not held_out")
    bigrams = _pair_counts(seen, "classes", total, lambda column: np.append(total - 1, np.frombuffer(b"".join(column.to_pylist()), kind)).astype(np.int64))
    return Model(frequent, frequent_classes, bigrams, class_tokens, class_words, totals["n"], totals["v"], totals["texts"]), rest, sequences


def _kind(total: int) -> str:
    return "u1" if total <= 256 else "<u4"


def in_classes(numbered: DataFrame, rest: DataFrame, frequent: list[tuple[bytes, int]], frequent_classes: np.ndarray, classes: int, texts: int) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_known, counted (sum of log10(count + 1)), classes of each text with its end."""
    total = classes + SHAPES + 1
    kind = _kind(total)
    log_count = np.log10(np.array([n for _, n in frequent] + [0] * SHAPES, np.float64) + 1)
    class_of = np.concatenate([frequent_classes, classes + np.arange(SHAPES)[::-1]]).astype(kind)
    shared = numbered.sparkSession.sparkContext.broadcast((class_of, log_count))
    end, end_log = np.array([total - 1], kind).tobytes(), float(np.log10(texts + 1))

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, logs = shared.value
        for batch in batches:
            codes, lengths = _flat(batch.column(3))
            found = of[codes]
            rare = np.append(0, np.cumsum(codes < 0))
            ends = np.cumsum(lengths)
            starts = ends - lengths
            known = lengths - (rare[ends] - rare[starts]) + (1 if texts else 0)
            rows = [found[a:b].tobytes() + end for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            sums = [float(logs[codes[a:b]].sum()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(lengths + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(np.array(sums) + end_log, pa.float64()), pa.array(rows, pa.binary())],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "counted", "classes"],
            )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words that have been found leave their shapes' classes."""
        for batch in batches:
            rows = []
            for sequence, at, of in zip(batch.column(6).to_pylist(), batch.column(7), batch.column(8), strict=True):
                if at.is_valid:
                    own = np.frombuffer(sequence, kind).copy()
                    unplaced = np.flatnonzero((own >= classes) & (own < total - 1))
                    own[unplaced[at.values.to_numpy()]] = of.values.to_numpy()
                    sequence = own.tobytes()
                rows.append(sequence)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(rows, pa.binary())], names=batch.schema.names[:7])

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, counted double, classes binary"
    done = numbered.select("row", "doc_id", "held_out", "codes").mapInArrow(direct, schema)
    uses = numbered.select("row", F.posexplode("words").alias("at", "word"))
    entry = F.collect_list(F.struct("at", "class"))
    found = uses.join(rest, "word").groupBy("row").agg(entry.alias("found"), F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("gain"))
    joined = done.join(found, "row", "left").select(
        "row", "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("counted") + F.coalesce("gain", F.lit(0.0))).alias("counted"), "classes", F.col("found.at").alias("at"), F.col("found.class").alias("of"),
    )
    return staged(joined.mapInArrow(settle, schema), "sequences")


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the counts and classes of the words that it does not carry."""
    return _learned(docs)[:2]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Scores are log10 probabilities of the whole text with its end; the base is the add-one unigram.  A null
    text counts as empty and has the end only.  Repeated rows are scored one by one, and count in training
    one by one.  Without training texts every token is unknown.  An empty table gives an empty result.
    """
    model, _, sequences = _learned(docs)
    factor, end, kind = docs.sparkSession.sparkContext.broadcast(model.factor), model.end_class, _kind(model.end_class + 1)
    end_log = float(model.count_log[-2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = factor.value
        for batch in batches:
            totals = []
            for value in batch.column(6).to_pylist():
                own = np.frombuffer(value, kind)
                totals.append(float(f[np.append(end, own[:-1]), own].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:6], pa.array(totals, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "counted", "factors"])

    done = sequences.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, counted double, factors double")
    return done.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("counted") - F.col("n_tokens") * float(model.log_size)).alias("base_score"), (F.col("counted") - end_log + F.col("factors")).alias("score"),
    )
