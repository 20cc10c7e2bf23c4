import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tempolog.llm import codes, decontaminate, importance
from tempolog.llm.words import words_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_by_hand(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features_by_hand(text):
    words = words_by_hand(text)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def random_texts(seed, n):
    rnd = random.Random(seed)
    letters, gaps = ["a", "b", "Ab", "é", "漢", "z9", "9", "y" * 70], [" ", "\n", ". ", "\x00", "-", "  "]
    return ["".join(rnd.choice(letters[: rnd.choice([2, 4, 8])]) + rnd.choice(gaps) for _ in range(rnd.choice([0, 1, 5, 20, 60]))) for _ in range(n)]


def test_features_are_runs_of_words():
    texts = [*random_texts(5, 200), "x" * 200 + " " + "y" * 64 + " " + "z" * 65 + " a"]
    bucket, text = importance.feature_buckets(words_of(pa.array([t.encode() for t in texts], pa.binary())))
    expected = Counter((k, zlib.crc32(f.encode()) % 10000) for k, t in enumerate(texts) for f in features_by_hand(t))
    assert Counter(zip(text.tolist(), bucket.tolist(), strict=True)) == expected


def resampling_by_hand(rows, target, percent=25, seed=7):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features_by_hand(t))

    s, t = counts(r["text"] for r in rows), counts(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in s}
    found = []
    for r in rows:
        features = features_by_hand(r["text"])
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:8], 16)
        found.append((r["doc_id"], len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    long_enough = sorted((f for f in found if f[1] >= 39), key=lambda f: (-f[3], f[0] is None, f[0] or 0))
    drawn = Counter(long_enough[: percent * len(long_enough) // 100])
    return found, drawn


@pytest.mark.parametrize("percent", [25, 60, 100])
def test_resampling_is_that_of_the_rule(spark, odd_docs, small, percent):
    target = spark.read.parquet(f"{small}/benchmark.parquet")
    items = [r["text"] for r in target.collect()] + ["alpha1 beta gamma"]
    target = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(None, None)], "item_id long, text string")
    rows = importance.resampling(odd_docs, target, percent).collect()
    found, drawn = resampling_by_hand(odd_docs.collect(), items, percent)
    assert Counter(tuple(r)[:4] for r in rows) == Counter(found)
    assert Counter(tuple(r)[:4] for r in rows if r["rank"] is not None) == drawn
    assert sorted(r["rank"] for r in rows if r["rank"] is not None) == list(range(1, sum(drawn.values()) + 1))
    taken = importance.resampled(odd_docs, target, percent)
    assert taken.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in taken.collect()) == Counter(k[0] for k in drawn.elements())


def test_resampling_of_nothing(spark, no_docs, odd_docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert importance.resampling(no_docs, nothing).collect() == []
    assert importance.resampled(no_docs, nothing).collect() == []
    assert importance.resampling(odd_docs, nothing).count() == odd_docs.count()


def contamination_by_hand(texts, items, window):
    windows = {}
    for name, text in items:
        words = words_by_hand(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add(name)
    found = []
    for text in texts:
        words, hit, names = words_by_hand(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if (w := tuple(words[k : k + size])) in windows:
                    names |= windows[w]
                    hit |= set(range(k, k + size))
        found.append((len(words), sorted(hit), sorted(names)))
    return found


@pytest.mark.parametrize("seed", range(40))
def test_suffix_arrays_find_what_comparing_all_windows_finds(seed):
    rnd = random.Random(seed)
    items = [(str(k % 4), t) for k, t in enumerate(random_texts(seed, rnd.choice([0, 1, 3, 6])))]
    texts = [t + (rnd.choice(items)[1] if items and rnd.random() < 0.5 else "") + "b a" for t in random_texts(seed + 100, 12)]
    window = rnd.choice([2, 5, 10])
    looked_for = decontaminate.Items.of([(n, t.encode()) for n, t in items], window)
    got = decontaminate._looked_at(pa.array([t.encode() for t in texts], pa.binary()), None, looked_for).to_pylist()
    mine = [(g["n_words"], sorted(k for s in g["spans"] for k in range(s["start"], s["end"])), g["items"]) for g in got]
    assert mine == contamination_by_hand(texts, items, window)


def test_contamination_in_blocks_of_items(spark, odd_docs, no_docs):
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    items = [(1, " ".join(texts[1].split()[5:40])), (2, texts[11]), (3, None), (None, "one two"), (4, " ".join(texts[12].split()[20_000:20_030])), (4, "Mail, JOE"), (5, texts[13]), (6, "...")]
    table = spark.createDataFrame(items, "item_id long, text string")
    named = [("" if i is None else str(i), t) for i, t in items]
    rows = odd_docs.collect()
    expected = Counter((r["doc_id"], n, len(hit), tuple(names)) for r, (n, hit, names) in zip(rows, contamination_by_hand([r["text"] for r in rows], named, 10), strict=True))
    for block_words in (decontaminate.BLOCK_WORDS, 25):
        found = decontaminate.contamination(odd_docs, table, block_words=block_words).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found) == expected
        assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in found)
        assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in found)
        clean = decontaminate.without_contaminated(odd_docs, table, block_words=block_words)
        assert clean.columns == odd_docs.columns
        assert Counter(r["doc_id"] for r in clean.collect()) == Counter(i for i, _, hit, _ in expected.elements() if not hit)
    assert decontaminate.contamination(no_docs, table).collect() == []
    nothing = decontaminate.contamination(odd_docs, table.limit(0)).collect()
    assert len(nothing) == len(rows) and not any(r["contaminated"] for r in nothing)


def test_longest_matches_and_where_they_are(spark):
    docs = spark.createDataFrame([(7, "x a b c d e f g y"), (3, "q a b c d e z"), (None, "a b c d e f g"), (2, "c d e f g h"), (9, None)], "doc_id long, text string")
    items = spark.createDataFrame([("i", "A b c d e f g h"), ("j", "c d"), ("k", "nothing here")], "item_id string, text string")
    expected = [("i", 0, 7, 7, 1), ("i", 1, 6, 7, 2), ("i", 2, 6, 2, 0), ("i", 3, 5, 2, 1), ("i", 4, 4, 2, 2), ("i", 5, 3, 2, 3), ("j", 0, 2, 2, 0)]
    for some in (docs, docs.repartition(5)):
        assert sorted(tuple(r) for r in decontaminate.longest_matches(some, items, window=3).collect()) == expected
    assert decontaminate.longest_matches(docs, items.limit(0)).collect() == []


def test_suffix_array_is_the_order_of_suffixes():
    rng = np.random.default_rng(2)
    for n, most, depth in ((0, 2, 4), (1, 2, 4), (50, 2, 60), (300, 3, 300), (400, 10**6, 400), (200, 1, 200)):
        words = rng.integers(0, most, n)
        assert decontaminate.suffix_array(words, depth).tolist() == sorted(range(n), key=lambda k: words[k:].tolist())


def test_filtering_assigns_as_comparing_all_does():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, width, k, size = int(rng.integers(1, 400)), int(rng.integers(0, 5)), int(rng.integers(1, 40)), int(rng.choice([2, 5, 100, codes.MOST]))
        points, entries = rng.integers(-size, size + 1, (n, width)), rng.integers(-size, size + 1, (k, width))
        order = codes.tree_order(points)
        assert sorted(order.tolist()) == list(range(n))
        points = points[order]
        code, sums, counts = codes.nearest(points, codes.tree_of(points), entries)
        nearest = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
        expected = np.zeros_like(entries)
        np.add.at(expected, nearest, points)
        assert (code == nearest).all() and (sums == expected).all() and (counts == np.bincount(nearest, minlength=k)).all()


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    kept = sorted(((r["vec_id"] is None, r["vec_id"] or 0, [math.floor(1024 * x) for x in r["embedding"]], r["label"]) for r in rows if r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])), key=lambda k: k[:3])
    if not kept:
        return []
    dim = len(kept[0][2])
    usable = [k for k in kept if len(k[2]) == dim]
    error, listed, books = np.zeros(len(usable), int), [""] * len(usable), []
    for p in range(parts):
        points = np.array([k[2] for k in usable], np.int64)[:, p * dim // parts : (p + 1) * dim // parts]
        book = points[:entries].copy()
        for round_ in range(rounds + 1):
            far = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
            code = far.argmin(axis=1)
            if round_ < rounds:
                book = np.array([points[code == e].sum(axis=0) // (code == e).sum() if (code == e).any() else book[e] for e in range(len(book))], np.int64).reshape(book.shape)
        error += far.min(axis=1)
        listed = [have + f"{c:02x}" for have, c in zip(listed, code, strict=True)]
        books.append(book)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    by_label = Counter()
    for k, e in zip(usable, error.tolist(), strict=True):
        by_label[k[3]] += e
    found = [(None if k[0] else k[1], c, e, by_label[k[3]], digest) for k, c, e in zip(usable, listed, error.tolist(), strict=True)]
    return found + [(None if k[0] else k[1], None, None, by_label.get(k[3]), digest) for k in kept if len(k[2]) != dim]


def test_codes_are_those_of_plain_rounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    schema = "vec_id long, embedding array<float>, label int, key string, code string, error long"
    rows = [(k // 2 if k < 20 else k, [float(x) for x in rng.normal(0, 0.02 if k % 3 else 1, 8)], [0, 1, None][k % 3] if k % 2 else 0, "k", "c", 1) for k in range(700)]
    rows += [rows[3], (None, rows[5][1], 1, None, None, None), (800, None, 1, "", "", 0), (801, [None] * 8, 1, "", "", 0), (802, [float("nan")] * 8, 1, "", "", 0), (803, [float("inf")] + [0.0] * 7, 1, "", "", 0), (804, [0.5] * 5, 3, "", "", 0), (805, [], 1, "", "", 0)]
    monkeypatch.setattr(codes, "BLOCK", 90)
    for some in (rows, rows[:5], [(r[0], (r[1] or [])[:5], *r[2:]) for r in rows if r[1] and None not in r[1]], [r for r in rows if r[1] == []]):
        table = spark.createDataFrame(some, schema).repartition(3)
        coded, books = codes.compressed(table)
        stored = [r.asDict() for r in table.collect()]
        assert sorted((tuple(r) for r in codes.with_label_errors(coded, books).collect()), key=repr) == sorted(codes_by_hand(stored), key=repr)
        known = coded.filter("code is not null").count()
        again = codes.reconstructed(coded, books).filter("code is not null").collect()
        assert len(again) == known and all(len(r["embedding"]) == sum(b.shape[1] for b in books) for r in again)
    empty = spark.createDataFrame([], schema)
    assert codes.with_label_errors(*codes.compressed(empty)).collect() == []
