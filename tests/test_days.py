import datetime as dt

import pytest
from pyspark.sql import functions as F

from tempolog.functions import timestamps as ts


def utc(*parts):
    return dt.datetime(*parts, tzinfo=dt.UTC)


@pytest.mark.parametrize(
    "day, zone, start",
    [
        (dt.date(2026, 3, 8), "America/New_York", utc(2026, 3, 8, 7, 0)),  # 02:30 does not exist: first minute after the gap
        (dt.date(2026, 10, 25), "Europe/Berlin", utc(2026, 10, 25, 0, 30)),  # 02:30 occurs twice: the first time
        (dt.date(2026, 6, 1), "Asia/Shanghai", utc(2026, 5, 31, 18, 30)),
    ],
)
def test_a_day_starts_at_its_first_valid_minute(day, zone, start):
    assert ts.day_start(day, ts.boundary_minutes("02:30"), zone).astimezone(dt.UTC) == start


def test_a_skipped_date_has_no_length(spark):
    days = ts.calendar(spark, dt.date(2011, 12, 29), dt.date(2011, 12, 31), "00:00", "Pacific/Apia").collect()
    lengths = {r["day"]: r["end_utc"] - r["start_utc"] for r in days}
    assert lengths[dt.date(2011, 12, 30)] == dt.timedelta(0)
    assert lengths[dt.date(2011, 12, 29)] == dt.timedelta(days=1)


@pytest.mark.parametrize("text", ["06:01", "24:00", "1:00", "00:60", "x"])
def test_bad_boundaries_are_errors(text):
    with pytest.raises(ValueError, match="boundary"):
        ts.boundary_minutes(text)


def test_stamps_of_every_form(spark, rows):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T05:04:05+02:00",), ("2024.01.02 11:04:05",), ("2024-01-02T11:04:05",), ("2024.01.02 11:04:05.50000",), ("nothing",), (None,)], "v string")
    found = [r[0] for r in df.select(ts.utc_text(ts.parse_instant(F.col("v"), "Asia/Shanghai"))).collect()]
    assert found == ["2024-01-02T03:04:05Z"] * 4 + ["2024-01-02T03:04:05.500000Z", None, None]


def test_offsets_must_be_named(spark):
    values = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.25-05:30", "2024-01-02T03:04:05", "2024-02-30T03:04:05Z", "2024-01-02 03:04:05Z", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(ts.has_explicit_offset(F.col("v"))).collect()] == [True, True, False, False, False, False]
