import hashlib

import pytest

import corpus_pipeline
from tempolog.llm import bpe, quality
from test_dedup import Counted, brute_classes
from test_search_and_mix import mix_by_hand


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(corpus_pipeline.staged(stage(spark, found[-1], small), "stage"))
    return found


def test_stages_return_documents(stages):
    assert [s.columns for s in stages[:-1]] == [stages[0].columns] * 5
    counts = [s.count() for s in stages]
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0 and counts[5] == counts[4]


def test_the_classifier_s_rejections_go(spark, small, stages):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    kept = {r["doc_id"] for r in stages[1].collect()}
    judged = quality.classified(stages[0], labels).collect()
    assert kept == {r["doc_id"] for r in judged if r["__keep"]}
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all((i in kept) == bool(q) for i, q in known.items())


def test_one_of_each_text(stages):
    best: dict = {}
    for r in stages[1].collect():
        best[r["text"]] = max(r["doc_id"], best.get(r["text"], -1))
    assert {r["doc_id"] for r in stages[2].collect()} == set(best.values())


def test_one_of_each_class(stages):
    rows = stages[2].collect()
    assert {r["doc_id"] for r in stages[3].collect()} == {c for _, c, _ in brute_classes(rows, Counted(r["text"] or "" for r in rows))}


def test_the_mix(stages):
    copies = {d: c for d, _, _, _, c in mix_by_hand(stages[3].collect())}
    found: dict = {}
    for r in stages[4].collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
    assert found == {d: c for d, c in copies.items() if c}


def test_the_tokens(stages):
    import public_tokenizers

    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    plain = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in stages[5].collect():
        ids = plain.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_is_its_stages(spark, small, stages):
    assert sorted(map(repr, corpus_pipeline.run(spark, small).collect())) == sorted(map(repr, stages[-1].collect()))
