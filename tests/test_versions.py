import threading

import pytest

from tempolog.operators.versions import Conflict, VersionedTable

SCHEMA = "id long"


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"))


def ids(spark, table, version=None):
    from pyspark.sql.types import StructType

    return sorted(r["id"] for r in table.read("rows", StructType().add("id", "long"), version).collect())


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], SCHEMA).coalesce(1)


def test_versions_are_read_as_they_were(spark, table):
    assert ids(spark, table) == [] and table.version().number == 0
    first = table.append("rows", frame(spark, 1, 2))
    second = table.append("rows", frame(spark, 3))
    assert (ids(spark, table, first), ids(spark, table, second), ids(spark, table)) == ([1, 2], [1, 2, 3], [1, 2, 3])
    table.replace("rows", frame(spark, 9), second)
    assert ids(spark, table) == [9] and ids(spark, table, second) == [1, 2, 3]
    table.restore(first.number)
    assert ids(spark, table) == [1, 2] and table.numbers() == [1, 2, 3, 4]


def test_a_number_is_committed_once(spark, table):
    table.append("rows", frame(spark, 1), "w", 0)
    table.append("rows", frame(spark, 1), "w", 0)
    table.append("rows", frame(spark, 2), "other", 0)
    table.append("rows", frame(spark, 3), "w", 5)
    table.append("rows", frame(spark, 4), "w", 4)
    assert ids(spark, table) == [1, 2, 3] and table.version().writers == {"w": 5, "other": 0}


def test_a_crash_before_the_manifest_leaves_the_table_as_it_was(spark, table):
    table.append("rows", frame(spark, 1), "w", 0)
    table.write("rows", frame(spark, 2))  # and the writer is gone
    assert ids(spark, table) == [1]
    table.append("rows", frame(spark, 2), "w", 1)
    assert ids(spark, table) == [1, 2]


def test_compactions_and_commits_in_any_order_lose_nothing(spark, table):
    """Two compactions of one version: the second finds its rows replaced.  What is committed between stays."""
    table.append("rows", frame(spark, 1))
    seen = table.append("rows", frame(spark, 2))
    table.append("rows", frame(spark, 3))
    merged = frame(spark, *ids(spark, table, seen))
    table.replace("rows", merged, seen)
    assert ids(spark, table) == [1, 2, 3]
    with pytest.raises(Conflict):
        table.replace("rows", merged, seen)
    assert ids(spark, table) == [1, 2, 3]


def test_writers_at_once_all_get_their_turn(spark, table):
    errors = []

    def write(k):
        try:
            for n in range(3):
                table.append("rows", frame(spark, 10 * k + n), f"w{k}", n)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and ids(spark, table) == sorted(10 * k + n for k in range(4) for n in range(3))
    assert table.numbers() == list(range(1, 13))


def test_vacuum_keeps_what_kept_versions_name(spark, table, tmp_path):
    for k in range(4):
        table.append("rows", frame(spark, k))
    version = table.version()
    table.replace("rows", frame(spark, *range(4)), version)
    table.append("rows", frame(spark, 9))
    under_way = table.write("rows", frame(spark, 7))
    gone = table.vacuum(keep=2)
    assert len(gone) == 4 and set(gone) == set(version.parts["rows"]) and under_way not in gone
    assert ids(spark, table) == [0, 1, 2, 3, 9] and len(table.numbers()) == 2
    other = table.archive(str(tmp_path / "archive"))
    table.append("rows", frame(spark, 10))
    assert ids(spark, other) == [0, 1, 2, 3, 9]
