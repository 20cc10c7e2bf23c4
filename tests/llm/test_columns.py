"""Columns of any name pass every operator that returns documents, unchanged."""

import pytest

import corpus_pipeline
from tempolog.llm import decontaminate, exact_dedup, importance, mixing, near_dedup, quality
from tempolog.llm.common import quoted


def unchanged(docs, result):
    assert result.columns == docs.columns
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "__struct")]
    rows = result.select("doc_id", "text", "__struct", *[quoted(c) for c in extra]).collect()
    known = {r["doc_id"]: r["text"] for r in docs.collect()}
    for row in rows:
        assert row[1] == known[row[0]] and row[2]["doc_id"] == row[0]
        assert list(row)[3:] == [f"{row[0]}:{c}" for c in extra]
    return rows


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(1, 20)], "doc_id long, quality int, toxic int")


def test_exact(clashing_docs):
    for share in (exact_dedup.FREQUENT_SHARE, 0.9):
        assert unchanged(clashing_docs, exact_dedup.drop_equal_texts(clashing_docs, share))


def test_near(clashing_docs):
    assert unchanged(clashing_docs, near_dedup.drop_near_duplicates(clashing_docs))


def test_quality(clashing_docs, labels):
    unchanged(clashing_docs, quality.keep_good(clashing_docs, labels))
    judged = quality.classified(clashing_docs, labels)
    assert judged.count() == clashing_docs.count() and judged.columns[-5:] == quality.RESULTS


def test_mixing(clashing_docs):
    assert unchanged(clashing_docs, mixing.mixed_documents(clashing_docs))


def test_importance(clashing_docs):
    assert unchanged(clashing_docs, importance.resampled(clashing_docs, clashing_docs.limit(3)))


def test_decontamination(spark, clashing_docs):
    items = spark.createDataFrame([(1, " ".join(clashing_docs.filter("doc_id = 2").first()["text"].split()[:20]))], "item_id long, text string")
    assert 0 < len(unchanged(clashing_docs, decontaminate.without_contaminated(clashing_docs, items))) < clashing_docs.count()


def test_pipeline(spark, clashing_docs, labels, tmp_path):
    clashing_docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        unchanged(clashing_docs, docs)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_winners_that_repeat_leave_one_row(spark, rows):
    docs = spark.createDataFrame([(9, "hot", k % 2) for k in range(300)] + [(k, f"t{k}", k) for k in range(9)], "doc_id long, text string, n long")
    for share in (0.1, 0.999):
        kept = rows(exact_dedup.drop_equal_texts(docs, share))
        assert len(kept) == 10 and [r[0] for r in kept].count(9) == 1
