"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bound_batches, whole_text

#: Texts longer than this are cut, at safe places, into parts of about this many characters.
PART_CHARS = 50_000

#: A match of the pattern never continues past the space in "letter, space, letter or digit", whatever
#: stands before it, and none looks behind; so encoding may start anew at such a space.
_SAFE = regex.compile(r"(?<=[A-Za-z\p{Ll}\p{Lu}0-9])\x20(?=[A-Za-z0-9\p{Ll}\p{Lu}])")

#: Runs of white space as long as this are found before the library sees them: its stack does not hold a million.
RUN_CHARS = 10_000
_SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The encoding of a rank file; kept in each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _decimal(path: str, pattern: str) -> list[bytes]:
    return [b"%d" % i for i in range(encoding(path, pattern).max_token_value + 1)]


def parts(text: str, chars: int = PART_CHARS) -> Iterator[str]:
    """The text in parts that encode separately to the same ids; a stretch without safe place stays whole."""
    start = 0
    while len(text) - start > chars:
        safe = _SAFE.search(text, start + chars)
        if not safe:
            break
        yield text[start : safe.start()]
        start = safe.start()
    yield text[start:]


@functools.lru_cache(maxsize=4)
def _long_run(chars: int) -> re.Pattern:
    return re.compile(f"[{_SPACES}]{{{chars},}}")


def without_runs(text: str, chars: int = RUN_CHARS) -> Iterator[tuple[str, bool]]:
    """The text in parts, and whether each is a single match of the pattern.

    A long run of white space at the end of the text is one match.  Elsewhere all of it but its last character is,
    and matching starts anew at that one; nothing before the run reaches into it.
    """
    start = 0
    for run in _long_run(chars).finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > start:
            yield text[start : run.start()], False
        yield text[run.start() : end], True
        start = end
    if start < len(text):
        yield text[start:], False


def encode(text: str, path: str, pattern: str) -> list[int]:
    bpe = encoding(path, pattern)
    if len(text) <= PART_CHARS:
        return bpe.encode_ordinary(text)
    ids: list[int] = []
    for stretch, single in without_runs(text):
        if single:
            ids += bpe._encode_single_piece(stretch)
        else:
            for part in parts(stretch):
                ids += bpe.encode_ordinary(part)
    return ids


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    """The raw bytes of the ids; they need not be whole characters."""
    return encoding(path, pattern).decode_bytes(ids)


def _texts(column: pa.Array) -> Iterator[str]:
    for i in range(len(column)):
        yield column[i].as_py()


def _bounded(rows: Iterator[tuple], schema: pa.Schema, weight, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``most`` units of weight each."""
    held: list[tuple] = []
    load = 0
    for row in rows:
        held.append(row)
        load += weight(row)
        if load >= most or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, load = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int): the token ids of every whole text.

    A null text counts as empty and gives no ids.  Texts may be of any length: long ones are cut where matching starts
    anew, and long runs of white space, which would overflow the library's stack, are encoded as the matches they are.  Repeated rows give repeated results; a null doc_id
    is carried.  Special tokens' strings are ordinary text.  Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, encode(text, path, pattern)) for b in batches for i, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True))
        yield from _bounded(rows, schema, lambda row: len(row[1]))

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes (binary) of rows doc_id, ids; null ids count as none."""
    bound_batches(tokens.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, decode(ids.as_py() or [], path, pattern)) for b in batches for i, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        yield from _bounded(rows, schema, lambda row: len(row[1]))

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded, in one pass.

    ids_sha256 is over the decimal ids joined by one space; decoded_sha256 over the decoded bytes.  Nulls
    and repeated rows as in :func:`encode_documents`.
    """
    bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def one(doc_id: int, text: str) -> tuple:
        ids = encode(text, path, pattern)
        names = _decimal(path, pattern)
        listed = hashlib.sha256(b" ".join([names[i] for i in ids])).hexdigest()
        return doc_id, len(ids), listed, hashlib.sha256(decode(ids, path, pattern)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (one(i, text) for b in batches for i, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True))
        yield from _bounded(rows, schema, lambda row: 1)

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
