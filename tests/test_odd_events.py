"""Queries over few events that the test tables lack, against their SQL."""

import datetime as dt

import pytest
from compare import TABLES, both

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1, 12)


@pytest.fixture
def folder(spark, tmp_path):
    """Makes a folder with these events; other tables are the test tables."""

    def make(events):
        for t in TABLES:
            if t != "events":
                (tmp_path / f"{t}.parquet").symlink_to(f"{FOLDER}/{t}.parquet")
        import duckdb

        base = duckdb.connect()
        base.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
        base.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, NULL)", events)
        base.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return make


def agrees(spark, name, folder):
    mine, other = both(spark, entry.queries()[name], entry.oracle_sql()[name], folder)
    assert mine == other and mine
    return mine


def test_room_of_number_0_is_none(spark, folder):
    made = folder([(k, START + dt.timedelta(seconds=k), 1, kind, 1.0) for k, kind in enumerate(("signup", "click", "signup", "click", "error", "click"))])
    assert agrees(spark, "s17_markers_in_rooms", made) == [(1, None), (3, 2), (5, None)]


#: A song of length 0 with a line after it, one superseded, one left, one as the day's last; and lines at and about a threshold of whole milliseconds.
LENGTHS = [0.0, 0.0, 0.0, 6.69, 0.5, 0.11, 0.335]


@pytest.mark.parametrize("name", ["t1_settled_fold", "t16_records", "k11_promotion"])
def test_lengths_of_0_and_thresholds_of_whole_milliseconds(spark, folder, name):
    events, at = [], START
    for day in range(2):
        for n, value in enumerate(LENGTHS + [k / 10 for k in range(1, 40)]):
            events.append((at, "purchase", value))
            micros = round((round(value * 60, 1) * 800 - 1)) * 1000
            events += [(at + dt.timedelta(microseconds=max(micros + d, 400)), kind, 1.0) for d, kind in ((-1000, "view"), (0, "view"), (1000, "view"), (2000, ("error", "view", "view")[n % 3]))]
            at = events[-1][0] + dt.timedelta(seconds=1)
        events.append((at, "purchase", 0.0))
        at += dt.timedelta(days=1)
    agrees(spark, name, folder([(k, at, k % 9, kind, value) for k, (at, kind, value) in enumerate(events)]))


def test_names_of_earlier_rooms_count_after_60_whole_seconds(spark, folder):
    """A request 59.9997 seconds after entering is too early, though that rounds to 60.0."""
    at = {9: 0, 10: 1, 25: 10, 32: 69.9997, 33: 70.0, 34: 70.0001}
    made = folder([(k, START + dt.timedelta(seconds=at[k]), 1000, "view", 1.0) for k in at])
    assert [r[2] for r in agrees(spark, "t5_identity", made)] == [None, "expired", "expired"]
