import random
import re
import sqlite3

import pytest
from pyspark.sql import datasource as ds

from tempolog.sources import foreign

SCHEMA = "id long, name string, score double"


def made(path, rows, declared="id INTEGER PRIMARY KEY, name TEXT COLLATE NOCASE, score"):
    base = sqlite3.connect(path)
    base.execute(f"CREATE TABLE t ({declared})")
    base.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    base.commit()
    return base


def load(spark, path, schema=SCHEMA, step=100):
    spark.dataSource.register(foreign.History)
    spark.conf.set(foreign.PUSHDOWN, "true")
    return spark.read.format("sqlite_history").schema(schema).option("path", path).option("table", "t").option("step", step).load()


IDS = {
    "dense": range(1, 5001),
    "one huge": [*range(1, 1001), 2**63 - 1],
    "both ends": [-(2**63), *range(-50, 50), 2**63 - 1],
    "clusters": [*range(3000), *range(10**12, 10**12 + 3000), *range(10**15, 10**15 + 3000)],
    "random": random.Random(3).sample(range(2**62), 5000),
    "every thousandth": range(0, 3_000_000, 1000),
    "one": [7],
    "none": [],
}


@pytest.mark.parametrize("name", IDS)
def test_ranges_of_sparse_ids(name):
    ids = sorted(IDS[name])
    base = made(":memory:", [(i, None, None) for i in ids])
    parts = foreign.ranges_of_ids(base, "t", 500)
    held = [[i for i in ids if p.low <= i <= p.high] for p in parts]
    assert sum(held, []) == ids
    assert all(a.high < b.low for a, b in zip(parts, parts[1:], strict=False))
    assert len(parts) <= 3 * len(ids) // 500 + 5 and max(map(len, held), default=0) <= 1000


def test_planning_looks_at_a_bounded_number_of_ids():
    base = made(":memory:", [(i, None, None) for i in IDS["random"]])
    asked = []
    base.set_trace_callback(asked.append)
    foreign.ranges_of_ids(base, "t", 5)
    assert len(asked) < 5 * foreign.PROBES


def test_tables_without_row_ids_are_one_range(spark, tmp_path, rows):
    path = str(tmp_path / "h.sqlite")
    base = made(path, [], "id INTEGER PRIMARY KEY, name TEXT, score) WITHOUT ROWID --")
    base.execute("INSERT INTO t VALUES (1, 'a', 2)")
    base.commit()
    assert rows(load(spark, path)) == [(1, "a", 2.0)]


VALUES = [(1, "a", 1), (2, "A", 2.5), (3, "", None), (4, None, "no number"), (5, "äb", -0.0), (6, "b\U0001f600", 1e300), (7, "%a_", 3), (8, "aé", 0), (9, b"a", 7), (10, 12, b"x"), (11, "￿", 4)]
FILTERS = [
    "name <> ''", "name = 'a'", "name > 'a'", "name <= 'b'", "name IS NULL", "name IS NOT NULL", "name <=> 'A'", "NOT (name <=> 'a')", "name IN ('a', '12', 'x')", "name NOT IN ('a', 'b')",
    "name LIKE 'a%'", "name LIKE '%a'", "name LIKE '%a%'", "NOT name LIKE '%b%'", "name LIKE '%\U0001f600'", "name > '￿'", "id >= 3 AND id < 9", "id IN (1, 3, 99)", "score > 1", "score = 0", "score <= 2.5D",
    "score IS NULL", "score > double('NaN')", "name = 'a' OR id = 5", "length(name) = 1", "upper(name) = 'A' AND id > 1",
]


@pytest.mark.parametrize("encoding", ["UTF-8", "UTF-16le"])
def test_filters_are_those_of_spark(spark, tmp_path, rows, encoding):
    path = str(tmp_path / "h.sqlite")
    base = sqlite3.connect(path)
    base.execute(f"PRAGMA encoding = '{encoding}'")
    base.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT COLLATE NOCASE, score)")
    base.executemany("INSERT INTO t VALUES (?, ?, ?)", [r for r in VALUES if encoding == "UTF-8" or not isinstance(r[1], bytes)])
    base.commit()
    stored = spark.createDataFrame(load(spark, path).collect(), SCHEMA)
    assert stored.filter("id = 4").collect()[0]["score"] is None and stored.filter("id = 10").collect()[0]["name"] == "12"
    for text in FILTERS:
        assert rows(load(spark, path).filter(text)) == rows(stored.filter(text)), text


def test_the_plan_shows_pushed_filters_and_few_columns(spark, tmp_path):
    path = str(tmp_path / "h.sqlite")
    columns = ", ".join(c.replace(" long", " INTEGER PRIMARY KEY").replace(" string", " TEXT") for c in foreign.HISTORY.split(", "))
    base = sqlite3.connect(path)
    base.execute(f"CREATE TABLE {foreign.TABLE} ({columns})")
    base.executemany(f"INSERT INTO {foreign.TABLE} (created_at, video_url, location) VALUES (?, ?, ?)", [(f"2024-01-{k:02}", "u" if k % 3 else "", "x") for k in range(1, 20)])
    base.commit()
    df = foreign.read_history(spark, path, columns=["video_url"])
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "location" not in plan and not re.search(r"\bFilter\b", plan)
    assert "PushedFilters: [" in plan and "video_url" in plan.split("PushedFilters: [")[1]
    assert df.columns == ["video_url"] and df.count() == 13


def test_what_sqlite_reads_is_filtered(tmp_path):
    path = str(tmp_path / "h.sqlite")
    made(path, VALUES)
    from pyspark.sql.types import _parse_datatype_string as parsed

    reader = foreign.History({"path": path, "table": "t"}).reader(parsed(SCHEMA))
    left = [ds.EqualTo(("other",), "x"), ds.EqualTo(("id",), "text")]
    assert list(reader.pushFilters([ds.GreaterThan(("id",), 9), *left, ds.IsNotNull(("name",))])) == left
    assert [r[0] for part in reader.partitions() for r in reader.read(part)] == [10, 11]
