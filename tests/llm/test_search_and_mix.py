import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tempolog.llm import mixing, topk


def mix_by_hand(rows, weights=(3, 1, 2), percent=150, most=2, seed=7):
    sized = [(r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in rows]
    size = defaultdict(int)
    for _, s, z in sized:
        size[s] += z
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_names, left = {}, list(names), percent * sum(size.values()) / 100
    while open_names:  # share what is left by weight; a source that has too much stops at its limit
        level = left / sum(weight[s] for s in open_names)
        full = [s for s in open_names if weight[s] * level > most * size[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_names}
            break
        for s in full:
            target[s] = float(most * size[s])
            left -= most * size[s]
            open_names.remove(s)
    found = []
    for s in names:
        rate = target[s] / size[s] if size[s] else 0.0
        u = int(hashlib.sha256(f"{seed}:{s or ''}".encode()).hexdigest()[:5], 16) / 2**20
        order = sorted((z, d is None, d or 0) for d, src, z in sized if src == s)
        for k, (z, none, d) in enumerate(order, 1):
            found.append((None if none else d, z, size[s], round(target[s], 6), min(math.floor(u + k * rate) - math.floor(u + (k - 1) * rate), math.ceil(rate))))
    return sorted(found, key=repr)


def mixed(docs):
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"]) for r in mixing.mix(docs).collect()), key=repr)


def corpus(spark):
    rows = [(k, " ".join(["w"] * (k * k % 37)), f"s{min(k % 11, 5)}") for k in range(900)]
    return spark.createDataFrame([*rows, (None, "a b", None), (5000, None, "s1"), (5001, "x", "")], "doc_id long, text string, source string")


def test_mix_is_that_of_the_rule(spark, odd_docs, no_docs):
    docs = corpus(spark)
    assert mixed(docs) == mix_by_hand(docs.collect())
    assert Counter(mixed(odd_docs)) == Counter(mix_by_hand(odd_docs.collect()))
    assert mixed(no_docs) == []


def test_cut_runs_change_nothing(spark, monkeypatch):
    docs = corpus(spark)
    whole = mixed(docs)
    monkeypatch.setattr(mixing, "RUN_ROWS", 3)
    assert mixed(docs) == whole == mixed(docs.repartition(7))


def targets_by_hand(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by resharing the excess over the limits until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    at_limit, target = set(), {}
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in at_limit)
        free = [s for s in order if s not in at_limit]
        target = {s: most * sizes[s] if s in at_limit else weight[s] * left / sum(weight[f] for f in free) for s in order}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return target
        at_limit |= above


def test_targets_of_many_sources(spark, monkeypatch):
    random = np.random.default_rng(11)
    sizes = {f"host{k}": int(n) for k, n in enumerate(random.pareto(0.7, 700) * 10)} | {None: 400, "Ünü": 3, "": 0, "\U0001f600": 9, "\uffee": 50}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    expected = targets_by_hand(sizes)
    for looked_at in (64, 2):  # parts of the order, cut evenly and unevenly
        monkeypatch.setattr("tempolog.operators.order.LOOKED_AT", looked_at)
        found = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
        assert found.keys() == expected.keys()
        assert all(math.isclose(found[s], expected[s], rel_tol=1e-9, abs_tol=1e-9) for s in expected)
    assert mixing.source_targets(frame.limit(0)).count() == 0
    assert {r["target"] for r in mixing.source_targets(frame.filter("source_size = 0")).collect()} == {0.0}


def test_words_taken_are_near_the_target(spark):
    taken = mixing.mix(corpus(spark)).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n"), F.max("target").alias("t"), F.max("size").alias("z"), F.max("copies").alias("c")).collect()
    assert all(abs(r["n"] - r["t"]) <= r["z"] and r["c"] <= 2 for r in taken)


def test_documents_come_as_often_as_they_are_taken(spark, odd_docs):
    docs = corpus(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]})
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns
    assert mixing.mixed_documents(odd_docs).count() == sum(r["copies"] for r in mixing.mix(odd_docs).collect())


def test_columns_named_like_helpers_pass_through(spark):
    docs = corpus(spark).selectExpr("*", "1 as low", "2 as high", "3 as runs", "4 as n", "5 as target", "6 as source_size")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == mixing.mixed_documents(corpus(spark)).count()


def test_the_mix_runs_no_python(spark, capsys):
    mixing.mix(corpus(spark)).explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Pandas", "Arrow"))


def top_by_hand(rows, step, k):
    clean = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    queries = {}
    for i, v in clean:
        if i % step == 0:
            queries[i] = min(queries.get(i, v), v)
    for q, v in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in clean if j != q and len(w) == len(v))
        found += [(q, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(found, key=repr)


def vectors(spark):
    random = np.random.default_rng(3)
    rows = [(k, [float(np.float32(x)) for x in random.normal(size=8)]) for k in range(300)]
    rows += [(k, [0.5] * 8) for k in range(300, 360)] + [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (410, [1.0, 2.0]), (420, []), (5, [9.0] * 8), (10, [0.1] * 8)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_top_lists_are_those_of_all_products(spark, rows, monkeypatch):
    df = vectors(spark)
    expected = top_by_hand([(r["vec_id"], r["embedding"]) for r in df.collect()], 10, 7)
    assert rows(topk.top_k(df, F.col("vec_id") % 10 == 0, 7)) == expected
    for name, value in (("ROW_GROUP", 20), ("QUERY_GROUP", 9), ("ROW_TILE", 6), ("QUERY_TILE", 4), ("FAN_IN", 3)):
        monkeypatch.setattr(topk, name, value)
    assert rows(topk.top_k(df, F.col("vec_id") % 10 == 0, 7)) == expected


def test_other_columns_of_vectors_are_not_read(spark, rows):
    df = vectors(spark)
    wide = df.selectExpr("*", "1 as row_id", "'p' as part", "2 as score", "3 as rank", "null as query_id")
    assert rows(topk.top_k(wide, F.col("vec_id") % 10 == 0, 7)) == rows(topk.top_k(df, F.col("vec_id") % 10 == 0, 7))


def test_no_vectors_no_rows(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0).count() == 0


def test_large_components_stay_exact():
    rows = np.array([[2**40, -(2**40)], [2**40 + 1, 3]], np.int64)
    assert topk.products(rows, rows).tolist()[1][1] == min((2**40 + 1) ** 2 + 9, 2**63 - 1)
    small = np.array([[2**29, 1]], np.int64)
    assert topk.products(small, small).tolist() == [[2**58 + 1]]
