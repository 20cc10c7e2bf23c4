import hashlib
import threading
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import both
from tempolog.llm import bpe, queries, token_rollup, token_store
from tempolog.llm.common import staged_path

RANKS, PATTERN, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("word_bpe_49k.json")


def test_every_text_round_trips(odd_docs, rows):
    plain = bpe.encoding(RANKS, PATTERN)
    expected = []
    for r in odd_docs.collect():
        ids = plain.encode_ordinary(r["text"] or "")
        expected.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert rows(bpe.round_trip(odd_docs, RANKS, PATTERN)) == sorted(expected, key=repr)


def test_encoding_then_decoding_gives_the_bytes(odd_docs, no_docs):
    decoded = bpe.decode_documents(bpe.encode_documents(odd_docs, RANKS, PATTERN), RANKS, PATTERN)
    assert sorted(((r[0], bytes(r[1])) for r in decoded.collect()), key=repr) == sorted(((r["doc_id"], (r["text"] or "").encode()) for r in odd_docs.collect()), key=repr)
    assert bpe.round_trip(no_docs, RANKS, PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB1' .,\n\t 　é漢's", max_size=120), st.integers(1, 12))
def test_parts_encode_to_the_same_ids(text, chars):
    plain = bpe.encoding(RANKS, PATTERN)
    cut = list(bpe.parts(text, chars))
    assert "".join(cut) == text
    assert [i for p in cut for i in plain.encode_ordinary(p)] == plain.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "\xa0", "\u3000", "\x1c", "aB", "1", "!", "'s", "漢"]), max_size=14))
def test_runs_of_white_space_are_matches_of_their_own(said):
    plain, text = bpe.encoding(RANKS, PATTERN), "".join(said)
    cut = list(bpe.without_runs(text, 2))
    assert "".join(p for p, _ in cut) == text
    assert [i for p, single in cut for i in (plain._encode_single_piece(p) if single else plain.encode_ordinary(p))] == plain.encode_ordinary(text)


@pytest.mark.parametrize("unit", [" ", "\n", " \n", "a", "!", "x "])
def test_millions_of_one_sign(unit):
    """Ids are those of the parts that any match of the pattern keeps apart: the head, the run and the tail."""
    plain, count = bpe.encoding(RANKS, PATTERN), 3_000_000 // len(unit)
    text = "head." + unit * count + "?tail"
    ids = bpe.encode(text, RANKS, PATTERN)
    assert bpe.decode(ids, RANKS, PATTERN) == text.encode()
    run = unit * count
    if unit.isspace():
        last = ["?"] if unit[-1] != " " else [" ?"]
        pieces = ["head", ".", run[:-1], *([unit[-1]] if unit[-1] != " " else []), *last, "tail"]
    else:
        pieces = ["head", "." + run + "?", "tail"] if unit == "!" else ["head", ".", run, "?", "tail"] if unit == "a" else ["head", ".", "x", *[" x"] * (count - 1), " ?", "tail"]
    assert ids == [i for p in pieces for i in plain._encode_single_piece(p)]


def test_bytes_need_not_be_whole_characters():
    assert bpe.decode(bpe.encode("漢", RANKS, PATTERN)[:1], RANKS, PATTERN) in {"漢".encode()[:k] for k in (1, 2, 3)}


def library(text):
    return token_store.word_encoder(WORDS).tokenizer.encode(text, add_special_tokens=False).ids


#: Letters whose composed form with a mark has no capital among them, and marks.
MARKED = "YJHTWAK" + "".join(map(chr, range(0x300, 0x332)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="aB1' .,!\n\t\x1c ́éΣİﬁ漢<|>", max_size=40), st.text(alphabet=MARKED + "a .", max_size=12)), max_size=4))
def test_remembered_chunks_give_the_library_s_ids(texts):
    import pyarrow as pa

    texts = [*texts, "<|endoftext|> x <|ENDOFTEXT|>"]
    found = token_store.word_encoder(WORDS).encode(pa.array(texts, pa.string()))
    assert [f.tolist() for f in found] == [library(t) for t in texts]


def test_the_store_holds_every_document_in_order(spark, odd_docs, no_docs):
    folder = staged_path(spark, "store")
    token_store.write_store(odd_docs, WORDS, folder)
    found = token_store.read_store(spark, folder).orderBy("start").collect()
    docs = [(r["doc_id"], np.array([*library(r["text"] or ""), 1], "<u4")) for r in odd_docs.collect()]
    assert [r["doc_id"] for r in found] == sorted((d[0] for d in docs), key=lambda i: (i is not None, i or 0))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == Counter((i, len(a), zlib.crc32(a.tobytes())) for i, a in docs)
    assert [r["start"] for r in found] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in found])[:-1]]).tolist()
    by_id = dict(docs)
    assert token_store.read_document(spark, folder, 11).tolist() == by_id[11].tolist()
    assert token_store.read_document(spark, folder, 999) is None
    assert token_store.store_and_read(no_docs, WORDS).count() == 0


def test_another_dictionary_is_noticed(spark, odd_docs, tmp_path):
    folder = staged_path(spark, "store")
    token_store.write_store(odd_docs, WORDS, folder)
    spark.createDataFrame([("0" * 64, b"other")], "dict_sha256 string, dictionary binary").write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(ValueError, match="hash"):
        token_store.read_store(spark, folder)


def test_totals_follow_signed_batches(spark, odd_docs, no_docs):
    counts = token_rollup.token_counts(odd_docs).cache()
    words = token_rollup.WORDS
    rollup = token_rollup.Rollup(spark, staged_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    load = token_rollup.changes(counts, words, F.col(words), 1)
    assert rollup.commit("load", load)
    whole = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
    expected: dict = {}
    for r in odd_docs.collect():
        n, t = expected.get((r["source"], r["lang"]), (0, 0))
        expected[r["source"], r["lang"]] = (n + 1, t + len((r["text"] or "").encode().split()))
    assert whole == expected
    assert not rollup.commit("load", load)
    gone = counts.filter("source is null")
    assert rollup.commit("delete", token_rollup.changes(gone, words, F.col(words), -1))
    rollup.compact()
    assert not rollup.commit("delete", token_rollup.changes(gone, words, F.col(words), -1))
    assert {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()} == {k: v for k, v in expected.items() if k[0] is not None}
    assert rollup.commit("nothing", token_rollup.changes(token_rollup.token_counts(no_docs), words, F.col(words), 1))
    assert {r["id"] for r in token_rollup.Rollup(spark, rollup.table.folder).committed().collect()} == {"load", "delete", "nothing"}


def test_compactions_and_commits_in_any_order_lose_no_batch(spark, odd_docs):
    """One compaction holds a version while another batch is committed and folded by another compaction; then the first goes on."""
    counts = token_rollup.token_counts(odd_docs).cache()
    folder, one = staged_path(spark, "rollup"), odd_docs.count()
    rollup, other = token_rollup.Rollup(spark, folder), token_rollup.Rollup(spark, folder)
    change = token_rollup.changes(counts, token_rollup.WORDS, F.col(f"`{token_rollup.WORDS}`"), 1)

    def docs(version=None):
        return other.totals(version).agg(F.sum("n_docs")).first()[0]

    assert rollup.commit("one", change) and rollup.commit("a/b", change)
    held = rollup.table.version()
    reading = other.totals()
    assert other.commit("two", change) and other.compact()
    assert not rollup.compact(held)  # its parts have been replaced
    assert docs() == 3 * one and not rollup.commit("two", change) and not other.commit("one", change)
    held = rollup.table.version()
    assert other.commit("three", change)
    assert rollup.compact(held) and docs() == 4 * one
    assert reading.agg(F.sum("n_docs")).first()[0] == 2 * one  # a reader keeps its version
    assert sorted(r["id"] for r in other.committed().collect()) == ["a/b", "one", "three", "two"]


def test_an_id_that_two_send_at_once_counts_once(spark, odd_docs):
    counts = token_rollup.token_counts(odd_docs).cache()
    folder = staged_path(spark, "rollup")
    change = token_rollup.changes(counts, token_rollup.WORDS, F.col(f"`{token_rollup.WORDS}`"), 1)
    done = []
    threads = [threading.Thread(target=lambda: done.append(token_rollup.Rollup(spark, folder).commit("same", change))) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done) == [False, False, True]
    assert token_rollup.Rollup(spark, folder).totals().agg(F.sum("n_docs")).first()[0] == odd_docs.count()


def totals_by_hand(docs, labels, first, second):
    """Documents and tokens by group after the three batches; ``first`` and ``second`` count a text."""
    toxic, quality = {}, {}
    for r in labels:
        if r["doc_id"] is not None:
            toxic[r["doc_id"]] = max(toxic.get(r["doc_id"], 0), r["toxic"] or 0)
            quality.setdefault(r["doc_id"], []).append(r["quality"])
    found: Counter = Counter()
    tokens: Counter = Counter()
    for r in docs:
        if toxic.get(r["doc_id"]) == 1:
            continue
        low = min((q for q in quality.get(r["doc_id"], []) if q is not None), default=1) == 0
        name, count = second if low else first
        found[r["source"], r["lang"], name] += 1
        tokens[r["source"], r["lang"], name] += count(r["text"] or "")
    return {(*k, n, tokens[k]) for k, n in found.items()}


def test_totals_of_real_vocabularies(spark, odd_docs, no_docs, small):
    """Counts are those of the libraries; labels repeat, lack ids and values; tables may be empty."""
    names = token_rollup.VOCABULARIES
    counts = token_rollup.vocabulary_counts(RANKS, PATTERN, WORDS)
    plain = bpe.encoding(RANKS, PATTERN)
    by = (names[0], lambda t: len(plain.encode_ordinary(t))), (names[1], lambda t: len(library(t)))
    odd = spark.createDataFrame([(1, 0, 0, "x"), (1, 1, None, "x"), (13, 0, 1, "x"), (13, 0, 1, "x"), (None, 0, 1, "x"), (4, None, None, "x"), (777, 0, 0, "x")], "doc_id long, quality int, toxic int, source string")
    tables = [(odd_docs, odd), (odd_docs, odd.limit(0)), (no_docs, odd), tuple(spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))]
    for docs, labels in tables:
        expected = totals_by_hand(docs.collect(), labels.collect(), *by)
        assert {tuple(r) for r in token_rollup.maintained_totals(docs, labels, *names, counts).collect()} == expected


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, small, name):
    mine, other = both(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], small)
    assert mine == other
