import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import passage
from tempolog.llm import exact_dedup, near_dedup
from tempolog.llm.common import whole_text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=400), st.integers(1, 10))
def test_misra_gries_keeps_what_is_frequent(values, counters):
    kept, lost = exact_dedup.misra_gries(((v, 1) for v in values), counters)
    true = Counter(values)
    assert all(kept.get(v, 0) <= n <= kept.get(v, 0) + lost for v, n in true.items())
    assert lost * (counters + 1) <= len(values)


def by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    found = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        found += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(found, key=repr)


def test_equal_texts_share_their_largest_id(odd_docs, rows):
    expected = by_hand(odd_docs.collect())
    assert rows(exact_dedup.group_equal_texts(odd_docs)) == expected
    assert rows(exact_dedup.group_equal_texts(odd_docs, share=0.1)) == expected  # frequent groups take the broadcast way


def test_one_of_each_text_stays_with_all_its_columns(odd_docs):
    kept = exact_dedup.drop_equal_texts(odd_docs)
    assert kept.columns == odd_docs.columns
    found = kept.select("doc_id", whole_text().alias("t")).collect()
    assert len({r["t"] for r in found}) == len(found) == len({r["text"] or "" for r in odd_docs.collect()})
    assert next(r["doc_id"] for r in found if r["t"] == passage(1, 120)) == 2


def test_repeated_winners_leave_one_row(spark, rows):
    docs = spark.createDataFrame([(1, "x"), (1, "x"), (0, "x")], "doc_id long, text string")
    for share in (exact_dedup.FREQUENT_SHARE, 0.9):
        assert rows(exact_dedup.drop_equal_texts(docs, share)) == [(1, "x")]


def test_frequent_losers_go_before_the_shuffle(spark, odd_docs, rows):
    """Both ways leave the same rows; of a frequent text only rows with the winner's id reach the window."""
    docs = spark.createDataFrame([(k, "hot" if k % 3 else f"t{k}", k, "k") for k in range(90)] + [(None, "hot", 0, None), (None, None, None, None)], "doc_id long, text string, n long, digest string")
    expected = sorted([(89, "hot", 89, "k"), *[(k, f"t{k}", k, "k") for k in range(0, 90, 3)], (None, None, None, None)], key=repr)
    for share in (0.5, 0.99):
        assert rows(exact_dedup.drop_equal_texts(docs, share)) == expected
    plan = exact_dedup.drop_equal_texts(docs, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin")
    again = [exact_dedup.drop_equal_texts(odd_docs.repartition(n), share) for n, share in ((2, 0.1), (5, 0.9))]
    assert rows(again[0]) == rows(again[1])


def test_empty_tables(no_docs):
    assert exact_dedup.group_equal_texts(no_docs).count() == 0
    assert exact_dedup.drop_equal_texts(no_docs).count() == 0
    assert near_dedup.classes(no_docs).count() == 0


def brute_classes(rows, weights):
    """Least id of each class by comparing all pairs of different texts."""
    texts = sorted({(r["text"] or "") for r in rows})
    sets = [weights.of(t.encode()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a][0]) and len(sets[b][0]) and near_dedup.weighted_jaccard(sets[a], sets[b]) >= 0.8:
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for r in rows:
        ids[find(texts.index(r["text"] or ""))].append(r["doc_id"])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((r["doc_id"], least[find(texts.index(r["text"] or ""))], len(ids[find(texts.index(r["text"] or ""))])) for r in rows), key=repr)


class Counted:
    """Weights of shingles from their words, with document frequencies counted over the distinct texts."""

    def __init__(self, texts):
        self.texts = set(texts)
        self.n = Counter(s for t in self.texts for s in set(self.words(t)))

    def words(self, text):
        words = text.encode().lower().split()
        width = min(5, len(words))
        return [tuple(words[k : k + width]) for k in range(len(words) - width + 1)] if words else []

    def of(self, text):
        """Numbers of the shingles, ascending, and their weights: 1 / 1.1 of the greatest at most for what all texts have."""
        most = math.log(1 / near_dedup.RARE_SHARE)
        occurs = Counter(self.words(text.decode()))
        idf = {s: most / 1.1 + (most - most / 1.1) * min(1, max(0, math.log(len(self.texts) / self.n[s]) / most)) for s in occurs}
        found = sorted((int.from_bytes(hashlib.sha256(repr(s).encode()).digest()[:8], "big"), idf[s] * c) for s, c in occurs.items())
        return np.array([h for h, _ in found], np.uint64), np.array([w for _, w in found])


def test_weights_are_those_of_counted_frequencies(spark, small):
    """Shingles' weights against frequencies counted word by word; cells that two shingles share may differ."""
    texts = sorted({r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()})[::4]
    docs = spark.createDataFrame([(t.encode(),) for t in texts], "text binary")
    weights, counted = near_dedup.Weights(*near_dedup.document_frequencies(docs)), Counted(texts)
    same = total = 0
    for t in texts:
        mine, other = (np.sort(w.of(t.encode())[1]) for w in (weights, counted))
        assert len(mine) == len(other)
        same += (np.abs(mine - other) < 1e-4).sum()
        total += len(mine)
    assert same > 0.97 * total


def test_counters_beyond_32_bits():
    row = near_dedup._packed(0, 0, np.array([0, 2**33, 0, 5, 0]), 3)
    table = near_dedup.pa.Table.from_pylist([row, near_dedup._packed(0, 0, np.array([1, 1, 1, 1, 1]), 2)], schema=near_dedup._SKETCH)
    assert near_dedup._summed(table, 5).tolist() == [1, 2**33 + 1, 1, 6, 1]


def near_copies(spark):
    """A base with copies that each change some words, a chain of them, and texts that share half."""
    rows, n = [], 0
    for seed in range(12):
        words = passage(seed + 20, 150).split()
        for copy in range(6):
            changed = [w + "x" if (k * (copy + 1) + copy) % 61 == 0 and copy else w for k, w in enumerate(words)]
            rows.append((n, " ".join(changed)))
            n += 1
        rows.append((n, " ".join(words[:75]) + " " + passage(seed + 99, 75)))
        n += 1
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_classes_are_those_of_all_pairs(spark, odd_docs):
    for docs in (near_copies(spark), odd_docs.select("doc_id", "text", "kept", "node")):
        rows = docs.collect()
        found = sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in near_dedup.classes(docs).collect()), key=repr)
        assert found == brute_classes(rows, Counted(r["text"] or "" for r in rows))


def test_large_groups_keep_their_links(spark):
    """Edited copies that make up a third of all rows, some of them repeated: classes are those of plain Jaccard of 0.8."""
    base = [f"w{k}" for k in range(300)]
    group = [" ".join(f"e{copy}" if k in (5 * copy + 10, 5 * copy + 110, 5 * copy + 210) else w for k, w in enumerate(base)) for copy in range(16)]
    alone = [" ".join(f"x{n}y{k}" for k in range(60)) for n in range(64)]
    texts = [*group, *group[:8], *group[:8], *alone]

    def plain(text):
        words = text.split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    sets = [plain(t) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:  # until the least number has come through every chain
        for a in range(len(texts)):
            for b in range(a):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
        if all(least[k] == least[least[k]] for k in least) and set(least[:32]) == {0}:
            break
    assert set(least[:32]) == {0} and least[32:] == list(range(32, 96))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()} == dict(enumerate(least))


def test_exact_copies_make_no_shingle_frequent(spark, monkeypatch):
    seen = []
    count = near_dedup.document_frequencies
    monkeypatch.setattr(near_dedup, "document_frequencies", lambda texts: seen.append(count(texts)) or seen[-1])
    docs = spark.createDataFrame([(k, passage(1, 60) if k < 40 else passage(k, 60)) for k in range(60)], "doc_id long, text string")
    near_dedup.classes(docs).count()
    ((n, _, counts),) = seen
    assert n == 21 and counts.max() <= 21


def test_one_of_each_class_stays(spark):
    docs = near_copies(spark)
    classes = {r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert {r["doc_id"] for r in near_dedup.drop_near_duplicates(docs).collect()} == classes


def test_samples_agree_as_often_as_sets_are_similar():
    random = np.random.default_rng(5)
    agreed, similar = [], []
    for _ in range(40):
        words = np.unique(random.integers(0, 2**63, 400, dtype=np.uint64))
        other = np.unique(np.concatenate([words[40:], random.integers(0, 2**63, 40, dtype=np.uint64)]))
        sets = [(s, np.where(s % np.uint64(4) == 0, k * near_dedup.COMMON, near_dedup.COMMON)) for s, k in ((words, 2), (other, 3))]
        agreed.append((near_dedup.samples(*sets[0]) == near_dedup.samples(*sets[1])).mean())
        similar.append(near_dedup.weighted_jaccard(*sets))
    assert abs(np.mean(agreed) - np.mean(similar)) < 0.02


def test_blocks_join_what_hubs_do_not(spark, monkeypatch):
    """With blocks of two members and no links from hubs, the second step finds the classes alone."""
    docs = near_copies(spark)
    expected = sorted(map(repr, near_dedup.classes(docs).select("doc_id", "class_id").collect()))
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 2)
    monkeypatch.setattr("tempolog.llm.common.BROADCAST_ROWS", 3)  # hot bands are salted
    monkeypatch.setattr(near_dedup, "verified", lambda docs, nodes, pairs, weights: pairs.withColumn("similarity", F.lit(0.0)).limit(0))
    assert sorted(map(repr, near_dedup.classes(docs).select("doc_id", "class_id").collect())) == expected


def test_largest_component_meets_the_others_only(spark, monkeypatch):
    """Hubs link some of the pairs; blocks of two members then find the same classes, whatever component is largest."""
    docs = near_copies(spark)
    expected = sorted(map(repr, near_dedup.classes(docs).select("doc_id", "class_id").collect()))
    verified = near_dedup.verified
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 2)
    for share in (2, 3, 1):  # one pair in so many is linked by its hub
        monkeypatch.setattr(near_dedup, "verified", lambda *args, share=share: verified(*args).filter(F.pmod(F.xxhash64("a", "b"), F.lit(share)) == 0))
        assert sorted(map(repr, near_dedup.classes(docs).select("doc_id", "class_id").collect())) == expected


def test_blocks_of_a_large_component_are_few(spark, monkeypatch):
    """Of 64 joined members and 4 others, each joined member meets one block, and each other one all blocks but its own once."""
    dealt = {}

    class Stop(Exception):
        pass

    def stop(docs, wanted):
        raise Stop

    staged = near_dedup.staged
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 4)
    monkeypatch.setattr(near_dedup, "staged", lambda df, name: dealt.setdefault(name, staged(df, name)))
    monkeypatch.setattr(near_dedup, "_promising", lambda table: table)
    monkeypatch.setattr(near_dedup, "_texts_of", stop)
    names = [k.to_bytes(2, "big") for k in range(68)]
    rest = spark.createDataFrame([(7, n, names[0] if k < 64 else n, 68) for k, n in enumerate(names)], "band long, node binary, component binary, n long")
    signed = spark.createDataFrame([(n, [7], b"x") for n in names], "node binary, bands array<bigint>, bytes binary")
    nodes = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "node binary, one_id long")
    try:
        near_dedup._linked_in_blocks(None, nodes, rest, signed, None)
    except Stop:
        pass
    groups = {}
    for r in dealt["promising"].collect():
        groups.setdefault((r["low"], r["high"]), set()).add(bytes(r["node"]))
    assert len(groups) == 17 and sum(map(len, groups.values())) == 64 + 17 * 4
    assert all(set(names[64:]) <= members for members in groups.values())


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 99)]
    df = spark.createDataFrame([(a.to_bytes(4, "big"), b.to_bytes(4, "big")) for a, b in links], "a binary, b binary")
    found = {int.from_bytes(r["node"], "big"): int.from_bytes(r["component"], "big") for r in near_dedup.components(df).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {100: 99, 101: 99}
