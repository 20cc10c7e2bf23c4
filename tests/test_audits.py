import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tempolog.operators import audits
from tempolog.operators.versions import Conflict, VersionedTable

BASE = dt.datetime(2024, 1, 1)


def at(second):
    return BASE + dt.timedelta(seconds=second)


def test_a_further_input_leaves_what_was_found(spark):
    left = spark.createDataFrame([("k", 1, at(100)), ("k", 2, at(150)), ("j", 3, at(5))], "k string, left_id long, left_time timestamp")
    first = spark.createDataFrame([("k", 11, at(95)), ("k", 12, at(149)), ("j", 13, at(6))], "k string, right_id long, right_time timestamp")
    more = spark.createDataFrame([("k", 11, at(95)), ("k", 21, at(99)), ("j", 22, at(5))], "k string, right_id long, right_time timestamp")
    graph = audits.candidate_graph(left, first, ["k"], 60, "a")
    whole = audits.extended(graph, left, more, ["k"], 60, "b")
    rows = sorted((r["left_id"], r["right_id"], r["gap_seconds"], r["source"]) for r in whole.collect())
    assert rows == [(1, 11, 5.0, "a"), (1, 21, 1.0, "b"), (2, 11, 55.0, "a"), (2, 12, 1.0, "a"), (2, 21, 51.0, "b"), (3, 22, 0.0, "b")]
    degrees = {(r["left_id"], r["right_id"]): (r["left_degree"], r["right_degree"]) for r in audits.with_degrees(whole).collect()}
    assert degrees == {(1, 11): (2, 2), (1, 21): (2, 2), (2, 11): (3, 2), (2, 12): (3, 1), (2, 21): (3, 2), (3, 22): (1, 1)}
    truth = spark.createDataFrame([(1, 11), (2, 12), (9, 1)], "left_id long, true_id long")
    found = {(r["stage"], r["window"]): r.asDict() for r in audits.merge_audit(whole, truth, (10, 60), {"one": ["a"], "two": ["a", "b"]}).collect()}
    small = found["two", 10]
    assert (small["candidates"], small["left_matched"], small["right_matched"], small["unique_pairs"]) == (4, 3, 4, 2)
    assert (small["with_truth"], small["truth_in_window"], small["single"], small["several"], small["nearest_right"], small["nearest_wrong"]) == (2, 2, 1, 1, 1, 1)
    assert (found["one", 60]["candidates"], found["one", 60]["nearest_right"], found["two", 60]["nearest_wrong"]) == (3, 2, 1)


@pytest.mark.parametrize("slice_rows", [10**6, 50])
def test_clusters_are_those_of_one_walk(spark, slice_rows):
    draw = random.Random(3)
    rows = [(k, draw.choice(["hot", "hot", "a", "b", None]), at(draw.randrange(20_000)) if draw.random() < 0.95 else None, draw.randrange(3)) for k in range(300)]
    expected = {}
    for key in ("hot", "a", "b"):
        group, number = [], 0
        for row in sorted((r for r in rows if r[1] == key and r[2] is not None), key=lambda r: (r[2], r[0])) + [None]:
            if row is None or group and (row[2] - group[-1][2]).total_seconds() > 600:
                number += 1
                stays = min(group, key=lambda r: (r[3], r[2], r[0]))[0]
                expected |= {r[0]: (number, len(group), stays, "keep" if r[0] == stays else "merge") for r in group}
                group = []
            if row is not None:
                group.append(row)
    expected |= {r[0]: (None, 1, r[0], "keep") for r in rows if r[1] is None or r[2] is None}
    table = spark.createDataFrame(rows, "record_id long, key string, at timestamp_ntz, p int").repartition(5)
    found = {r["record_id"]: tuple(r)[1:] for r in audits.interval_clusters(table, 600, [F.col("p")], slice_rows).collect()}
    assert found == expected


def test_a_cleanup_is_done_once(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    records = spark.createDataFrame([(k, "s", at(100 * k if k < 3 else 10_000)) for k in range(4)], "record_id long, key string, at timestamp_ntz")
    version = table.append("records", records)
    actions = audits.interval_clusters(records, 600, [F.lit(0)])
    for _ in range(2):
        done = audits.execute_cleanup(table, "records", actions, version, 1)
    kept = [r["record_id"] for r in table.read("records", records.schema).collect()]
    assert sorted(kept) == [0, 3] and done.number == 2
    assert Counter(r["action"] for r in table.read("actions", actions.schema).collect()) == {"keep": 2, "merge": 2}
    with pytest.raises(Conflict):
        audits.execute_cleanup(table, "records", actions, version, 2)
    table.restore(version.number)
    assert table.read("records", records.schema).count() == 4
