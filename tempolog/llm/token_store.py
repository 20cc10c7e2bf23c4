"""Token-id output: documents' ids, each compressed alone with one shared zstandard dictionary.

The store is a Parquet table of blocks in ascending doc_id order.  A block row holds up to
``BLOCK_DOCS`` documents: their ids (``doc_ids``), where each one's frame begins in ``data``
(``offsets``), how many ids it has (``n_tokens``), the hash of the dictionary that compressed it and the
number of ids before the block within its shard.  One document is read with two array lookups and one
small decompression; Parquet's statistics of ``first_id`` and ``last_id`` find the block.
"""

from __future__ import annotations

import functools
import hashlib
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, staged, staged_path, whole_text

#: The dictionary is trained on this many whole documents at most, each of at most SAMPLE_CHARS.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 512, 32_768, 65_536
BLOCK_DOCS, BLOCK_BYTES = 1024, 4_000_000
#: Chunks whose ids each Python worker remembers, in two generations of this size.
REMEMBERED = 400_000
END_ID = 1
#: A letter that composing may turn into another one, whose lower case is not that of its parts.
_COMPOSING = r"[A-Z]\p{M}"
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())

BLOCK_SCHEMA = (
    "shard int, block int, first_id long, last_id long, n_docs int, n_ids long, ids_before long, width int, dict_sha256 string, "
    "doc_ids array<bigint>, offsets array<int>, n_tokens array<int>, data binary"
)


def _letters(text: str) -> bool:
    """Whether a text is letters only, and stays so when the tokenizer composes and lowers it."""
    return text.isalpha() and (text.isascii() or unicodedata.normalize("NFC", text).lower().isalpha())


class WordEncoder:
    """Ids of whole texts, by remembering those of the chunks between ASCII white space.

    The tokenizer drops white space and no token of it spans any, so a text's ids are its chunks' ids in
    order.  It lowers case, so chunks are kept with A-Z lowered, except in texts where a combining mark stands
    behind one of A-Z: the tokenizer composes them before it lowers.  The library encodes every new chunk, many
    in one call: letters alone, or letters and then ASCII signs, are one and two pieces of the tokenizer's
    own splitting, each of which ends in a token that ends a word.  Any other chunk is encoded by itself,
    and a text in which a special token may begin is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[bytes]) -> None:
        young, stems, odd = self.young, {}, []
        signed: list[tuple[bytes, bytes, bytes]] = []
        for chunk in chunks:
            stem = chunk.rstrip(_SIGNS)
            if not _letters(stem.decode("utf-8")):
                odd.append(chunk)
                continue
            if stem is not chunk and len(stem) < len(chunk):
                signed.append((chunk, stem, chunk[len(stem) :]))
            if stem not in young:
                stems[stem] = None
        names = list(stems)
        for at in range(0, len(names), 2048):
            some = names[at : at + 2048]
            (found,) = self._plain([b" ".join(some).decode("utf-8")])
            ids = np.array(found, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(some) and stops[-1] == len(ids):
                raw, start = ids.tobytes(), 0
                for stem, stop in zip(some, stops, strict=True):
                    young[stem] = raw[4 * start : 4 * stop]
                    start = stop
            else:  # a letter that normalizing takes apart
                for stem, own in zip(some, self._plain([s.decode("utf-8") for s in some]), strict=True):
                    young[stem] = np.array(own, "<u4").tobytes()
        odd += {signs for _, _, signs in signed if signs not in young}
        for at in range(0, len(odd), 4096):
            some = odd[at : at + 4096]
            for chunk, own in zip(some, self._plain([c.decode("utf-8") for c in some]), strict=True):
                young[chunk] = np.array(own, "<u4").tobytes()
        for chunk, stem, signs in signed:
            young[chunk] = young[stem] + young[signs]

    def _known(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk, learning those that are new."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = [c for c in chunks if c not in young]
        if old:
            again = [c for c in missing if c in old]
            young.update(zip(again, map(old.__getitem__, again), strict=True))
            missing = [c for c in missing if c not in young]
        self._learn(missing)
        return list(map(young.__getitem__, chunks))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids (32-bit) of the texts of a string array, without an end id.

        Arrow splits the texts and numbers their distinct chunks; only those pass through Python.
        """
        special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        lowered = pc.ascii_lower(texts)
        composing = pc.match_substring_regex(texts, _COMPOSING)
        if pc.any(composing).as_py():
            lowered = pc.if_else(composing, texts, lowered)
        split = pc.ascii_split_whitespace(lowered)
        coded = split.flatten().dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        known = self._known(coded.dictionary.cast(pa.binary()).to_pylist())
        table = np.frombuffer(b"".join(known), "<u4")
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(lengths) - lengths
        counts = lengths[at]
        ends = np.cumsum(counts)
        ids = table[np.repeat(starts[at] - ends + counts, counts) + np.arange(len(counts) and ends[-1])]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        found = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k in special.tolist():
            found[k] = np.array(self._plain([texts[k].as_py()])[0], "<u4")
        return found


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def slices(batch: pa.RecordBatch, text: int, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of text, which is its column number ``text``."""
    sizes = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(batch):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + most)))
        yield batch.slice(start, stop - start)
        start = stop


def serialized(ids: np.ndarray, width: int, end_id: int) -> bytes:
    """The ids and the end id as little-endian numbers of ``width`` bytes."""
    return np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, path: str, width: int, end_id: int = END_ID) -> bytes:
    """A zstandard dictionary of serialized id arrays, trained on a bounded sample of documents.

    The sample is the documents with the least hashes of doc_id, up to SAMPLE_DOCS, whole and of at most
    SAMPLE_CHARS; it decides how small frames get, never what they hold.
    """
    import zstandard

    chosen = [r[0] for r in docs.filter("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]
    sample = docs.filter(F.col("doc_id").isin(chosen)).select(whole_text().alias("text")).filter(F.length("text") <= SAMPLE_CHARS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = word_encoder(path).encode(batch.column(0))
            yield pa.RecordBatch.from_pydict({"ids": pa.array([serialized(i, width, end_id) for i in ids], pa.binary())})

    samples = sorted(bytes(r[0]) for r in sample.mapInArrow(run, "ids binary").limit(SAMPLE_DOCS).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their content serves as it is
        return b"".join(samples)[-DICTIONARY_BYTES:].rjust(16, b"\0")


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data)


def write_store(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> bytes:
    """Encode every whole text, append ``end_id``, and write the block table and its dictionary to ``folder``.

    A null text counts as empty and becomes the end id alone.  Documents are in ascending doc_id order,
    nulls first; repeated ids are neighbours.  Other columns are not read.  Returns the dictionary.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 65_536 else 4
    dictionary = train_dictionary(docs, path, width, end_id)
    name = hashlib.sha256(dictionary).hexdigest()

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary), write_dict_id=False)
        for batch in batches:
            for rows in slices(batch, 1):
                ids = word_encoder(path).encode(rows.column(1))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column(0),
                    "n_tokens": pa.array([len(i) + 1 for i in ids], pa.int32()),
                    "frame": pa.array([packer.compress(serialized(i, width, end_id)) for i in ids], pa.binary()),
                })

    frames = staged(docs.select("doc_id", whole_text().alias("text")).mapInArrow(compress, "doc_id long, n_tokens int, frame binary"), "frames")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, before, held
            ids, counts, data = zip(*held, strict=True)
            ends = np.cumsum([len(d) for d in data])
            row = {
                "shard": shard, "block": block, "first_id": next((i for i in ids if i is not None), None), "last_id": ids[-1], "n_docs": len(ids), "n_ids": sum(counts), "ids_before": before,
                "width": width, "dict_sha256": name, "doc_ids": list(ids), "offsets": [0, *ends.tolist()], "n_tokens": list(counts), "data": b"".join(data),
            }
            block, before, held = block + 1, before + row["n_ids"], []
            return pa.RecordBatch.from_pylist([row], schema=_BLOCKS)

        load = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held.append(row)
                load += len(row[2])
                if len(held) >= BLOCK_DOCS or load >= BLOCK_BYTES:
                    yield flush()
                    load = 0
        if held:
            yield flush()

    ordered = frames.repartitionByRange("doc_id", "n_tokens").sortWithinPartitions("doc_id", "n_tokens")
    ordered.mapInArrow(assemble, BLOCK_SCHEMA).write.parquet(f"{folder}/blocks")
    spark.createDataFrame([(name, dictionary)], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    return dictionary


_BLOCKS = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()),
    ("ids_before", pa.int64()), ("width", pa.int32()), ("dict_sha256", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())),
    ("n_tokens", pa.list_(pa.int32())), ("data", pa.binary()),
])


def load_dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    found = bytes(row["dictionary"])
    if hashlib.sha256(found).hexdigest() != row["dict_sha256"]:
        raise ValueError("the dictionary's bytes do not match its hash")
    return row["dict_sha256"], found


def unpack(data: bytes, begin: int, end: int, width: int, dictionary: bytes) -> np.ndarray:
    """The ids of the one document whose frame is ``data[begin:end]``."""
    import zstandard

    raw = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress(data[begin:end])
    return np.frombuffer(raw, f"<u{width}").astype("<u4")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document, or None; reads the blocks whose range holds the id."""
    name, dictionary = load_dictionary(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    at = F.array_position("doc_ids", F.lit(doc_id).cast("long")).cast("int")
    row = blocks.withColumn("at", at).filter("at > 0").selectExpr("dict_sha256", "width", "offsets[at - 1] b", "offsets[at] e", "data").first()
    if row is None:
        return None
    if row["dict_sha256"] != name:
        raise ValueError("the block was compressed with another dictionary")
    return unpack(bytes(row["data"]), row["b"], row["e"], row["width"], dictionary)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files.

    start counts the ids of all documents before it: those of earlier shards (one sum per shard), earlier
    blocks and earlier documents of the block.
    """
    name, dictionary = load_dictionary(spark, folder)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        opener = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != name:
                    raise ValueError("the block was compressed with another dictionary")
                start = row["shard_start"] + row["ids_before"]
                starts, lengths, sums = [], [], []
                for k in range(row["n_docs"]):
                    raw = opener.decompress(row["data"][row["offsets"][k] : row["offsets"][k + 1]])
                    ids = np.frombuffer(raw, f"<u{row['width']}").astype("<u4")
                    if len(ids) != row["n_tokens"][k]:
                        raise ValueError("a frame does not hold as many ids as its index says")
                    starts.append(start)
                    lengths.append(len(ids))
                    sums.append(zlib.crc32(ids.tobytes()))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row per shard, so at most as many as the write had tasks.
    placed = blocks.join(F.broadcast(starts), "shard").select("shard_start", "ids_before", "n_docs", "width", "dict_sha256", "doc_ids", "offsets", "n_tokens", "data")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_read(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the store to the shared folder and return what reading it back gives; an empty table gives no rows."""
    folder = staged_path(docs.sparkSession, "token-store")
    write_store(docs, path, folder, end_id)
    return read_store(docs.sparkSession, folder)
