"""Token counts kept up by deltas: totals by source, language and tokenizer version.

A batch of changes holds signed rows: an inserted document counts +1 and its tokens, a deleted one -1 and
minus its tokens, a revised one both.  A commit adds up a batch by group and puts it, with its id, into the next version of
the table: there whole or not at all, and one that is sent again changes nothing.  Totals are the sums of a version's
parts; a compaction puts one part in place of those of the version that it has read, or gives way to another that was first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.versions import Conflict, Version, VersionedTable
from . import bpe
from .common import bound_batches, staged, staged_path, whole_text, word_count
from .token_store import slices, word_encoder

GROUP = ("source", "lang", "tokenizer")
_DELTAS = StructType().add("source", "string").add("lang", "string").add("tokenizer", "string").add("docs", "long").add("tokens", "long")
_IDS = StructType().add("id", "string")
#: Versions that readers may still hold when a compaction deletes what earlier ones named.
KEPT_VERSIONS = 8
WORDS, BYTES = "whitespace-1", "utf8_bytes-1"
VOCABULARIES = ("byte_bpe_50k-1", "word_bpe_49k-1")


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang and the counts of both tokenizers that need no vocabulary of every whole text; a null text has none."""
    text = whole_text()
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), word_count(text).alias(WORDS), F.octet_length(text).cast("long").alias(BYTES))


def vocabulary_counts(byte_ranks: str, pattern: str, word_file: str, names: tuple[str, str] = VOCABULARIES):
    """Counts of a table of documents by two vocabularies: byte-level ranks with their pattern, and words with ends.

    A null text has none.  The counts are those of the ids that :mod:`bpe` and :mod:`token_store` give, without
    an end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 3):
                texts = rows.column(3)
                of_bytes = [len(bpe.encode(texts[k].as_py(), byte_ranks, pattern)) for k in range(len(texts))]
                of_words = [len(ids) for ids in word_encoder(word_file).encode(texts)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(of_bytes, pa.int64()), pa.array(of_words, pa.int64())], names=["doc_id", "source", "lang", *names])

    def counts(docs: DataFrame) -> DataFrame:
        bound_batches(docs.sparkSession)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), whole_text().alias("text"))
        return rows.mapInArrow(run, f"doc_id long, source string, lang string, `{names[0]}` long, `{names[1]}` long")

    return counts


def changes(rows: DataFrame, tokenizer: str, tokens: Column, sign: int) -> DataFrame:
    """Signed rows of documents that come (+1) or go (-1); null groups are groups of their own, null counts are zero."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (F.coalesce(tokens, F.lit(0)) * sign).cast("long").alias("tokens"))


class Rollup:
    """The table of totals in a folder that all executors share: parts of deltas, and parts of ids of the batches in them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = VersionedTable(spark, folder)

    def committed(self) -> DataFrame:
        """id of all batches that count."""
        return self.table.read("ids", _IDS)

    def _known(self, batch_id: str, version: Version) -> bool:
        """Whether a version holds a batch: parts of single ids are told by name, the others are looked up."""
        parts = version.parts.get("ids", [])
        if any(p.startswith(f"ids-{_tag(batch_id)}") for p in parts):
            return True
        many = Version(parts={"ids": [p for p in parts if p.startswith("ids-many-")]})
        return not self.table.read("ids", _IDS, many).filter(F.col("id") == batch_id).isEmpty()

    def commit(self, batch_id: str, signed: DataFrame) -> bool:
        """Add a batch (columns as of :func:`changes`); False, and no change, if its id has been committed."""
        if not batch_id:
            raise ValueError("a batch needs an id")
        if self._known(batch_id, self.table.version()):
            return False
        summed = signed.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        one = self.table.spark.createDataFrame([(batch_id,)], _IDS).coalesce(1)
        added = {"deltas": self.table.write("deltas", summed.filter("docs <> 0 or tokens <> 0")), "ids": self.table.write("ids", one, _tag(batch_id))}

        def change(latest: Version) -> dict[str, list[str]]:
            if self._known(batch_id, latest):
                raise Conflict(batch_id)
            return latest.parts | {kind: [*latest.parts.get(kind, []), part] for kind, part in added.items()}

        try:
            self.table.commit(change)
        except Conflict:
            return False
        return True

    def totals(self, version: Version | None = None) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of all groups that have documents or tokens, by default in the latest version."""
        summed = self.table.read("deltas", _DELTAS, version).groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return summed.filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self, version: Version | None = None) -> bool:
        """Put one part in place of all of a version, by default the latest; False, and no change, if another compaction has done so.

        A batch that is sent again is still known.  Parts that no kept version names are deleted.
        """
        version = version or self.table.version()
        totals = self.totals(version).select(*GROUP, F.col("n_docs").alias("docs"), F.col("n_tokens").alias("tokens"))
        ids = self.table.read("ids", _IDS, version).sort("id")  # so that a look-up reads few of their files
        parts = {"deltas": self.table.write("deltas", totals), "ids": self.table.write("ids", ids, "many-")}
        try:
            self.table.swap(parts, version)
        except Conflict:
            return False
        self.table.vacuum(KEPT_VERSIONS)
        return True


def _tag(batch_id: str) -> str:
    return hashlib.sha256(batch_id.encode()).hexdigest()[:32] + "-"


def maintained_totals(docs: DataFrame, labels: DataFrame, first: str = WORDS, second: str = BYTES, counts=token_counts) -> DataFrame:
    """Totals after three batches over whole tables: every document is loaded with its count by the first
    tokenizer; those labelled toxic are deleted; the rest of those labelled as of low quality are counted anew,
    by the second.  The second batch is sent twice.

    Labels that repeat count once, by their greatest toxic and least quality; those without doc_id, and documents
    without one, meet nothing.  Null sources and languages are groups of their own, null texts have no tokens,
    repeated documents count one by one; empty tables give empty totals or unchanged ones.  ``counts`` gives
    doc_id, source, lang and one column per tokenizer of a table of documents.
    """
    spark = docs.sparkSession
    counted = staged(counts(docs), "token-counts")
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"), F.min("quality").alias("__quality"))
    marked = staged(counted.join(marks, "doc_id").filter("__toxic = 1 or __quality = 0"), "marked")
    gone, revised = marked.filter("__toxic = 1"), marked.filter("coalesce(__toxic, 0) <> 1 and __quality = 0")
    rollup = Rollup(spark, staged_path(spark, "rollup"))
    rollup.commit("load", changes(counted, first, F.col(f"`{first}`"), 1))
    rollup.commit("delete", changes(gone, first, F.col(f"`{first}`"), -1))
    rollup.commit("revise", changes(revised, first, F.col(f"`{first}`"), -1).unionByName(changes(revised, second, F.col(f"`{second}`"), 1)))
    rollup.commit("delete", changes(gone, first, F.col(f"`{first}`"), -1))
    return rollup.totals()
