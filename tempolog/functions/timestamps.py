"""Timestamps, durations and days with a movable boundary."""

from __future__ import annotations

import datetime as dt
import re
from bisect import bisect_left
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of a log line: local wall clock without zone.
LINE_STAMP = r"^(\d{4}\.\d{2}\.\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?)"
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?)?(?:[Zz]|[+-]\d{2}:?\d{2}(?::?\d{2})?)?$"
_HAS_ZONE = r"(?:[Zz]|[+-]\d{2}:?\d{2})$"
#: Stamps that name their offset, for the source contract.
EXPLICIT_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"
LATEST_BOUNDARY = 6 * 60


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def line_stamp(line: Column) -> Column:
    """The stamp at the start of a log line, as text, or null."""
    return blank_to_null(F.regexp_extract(line, LINE_STAMP, 1))


def wall_clock(value: Column) -> Column:
    """A log stamp as a timestamp without zone; null where it is none."""
    return F.try_to_timestamp(value, F.lit("yyyy.MM.dd HH:mm:ss[.SSSSSS]")).cast("timestamp_ntz")


def parse_instant(value: Column, zone: str) -> Column:
    """ISO text with or without offset, or a log stamp, as an instant; zone-less values are of ``zone``.

    Null where the text is no timestamp.
    """
    text = F.trim(value)
    iso = F.when(text.rlike(_ISO), F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[zZ]$", "+00:00"), ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2"))
    zoned = F.when(text.rlike(r"\d[T ]\d") & text.rlike(_HAS_ZONE), F.try_to_timestamp(iso))
    naive = F.coalesce(F.when(~(text.rlike(r"\d[T ]\d") & text.rlike(_HAS_ZONE)), F.try_to_timestamp(iso)), F.try_to_timestamp(text, F.lit("yyyy.MM.dd HH:mm:ss[.SSSSSS]")))
    return F.coalesce(zoned, F.to_utc_timestamp(naive, zone))


def utc_text(instant: Column) -> Column:
    """UTC ISO text; microseconds only where there are any.  The session's zone must be UTC."""
    whole = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(instant), F.lit(1_000_000))
    return F.when(micros == 0, F.concat(whole, F.lit("Z"))).otherwise(F.concat(whole, F.lit("."), F.lpad(micros.cast("string"), 6, "0"), F.lit("Z")))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end, to three places."""
    gap = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.round(gap / F.lit(1e6), 3)


def back_dated(stamp: Column, offset_seconds: Column) -> Column:
    """When something began that had run for ``offset_seconds`` at ``stamp``; null unless it had."""
    return F.when(offset_seconds > 0, stamp - F.make_dt_interval(secs=offset_seconds.cast("decimal(18,6)")))


def has_explicit_offset(value: Column) -> Column:
    """Whether the text is a real date and time that names its offset."""
    return F.coalesce(value.rlike(EXPLICIT_OFFSET) & F.try_to_timestamp(F.when(value.rlike(EXPLICIT_OFFSET), value)).isNotNull(), F.lit(False))


# --- days that begin at a boundary -------------------------------------------------------------------


def boundary_minutes(text: str) -> int:
    """Minutes after midnight of ``HH:MM``, from 00:00 to 06:00."""
    found = re.fullmatch(r"(\d{2}):(\d{2})", text)
    minutes = int(found[1]) * 60 + int(found[2]) if found and int(found[2]) < 60 else -1
    if not 0 <= minutes <= LATEST_BOUNDARY:
        raise ValueError(f"a day boundary is HH:MM from 00:00 to 06:00, not {text!r}")
    return minutes


def day_start(day: dt.date, minutes: int, zone: str) -> dt.datetime:
    """UTC instant at which a day begins: its first valid wall minute from the boundary on, the first time it occurs.

    A wall time that the zone skips reads earlier by the offset after the gap than by the one before it; the day then begins
    where the offset changes between these two instants.
    """
    local = ZoneInfo(zone)
    wall = dt.datetime.combine(day, dt.time(), local) + dt.timedelta(minutes=minutes)
    by_later, by_earlier = wall.replace(fold=1), wall.replace(fold=0)
    low, high = by_later.astimezone(dt.UTC), by_earlier.astimezone(dt.UTC)
    if low >= high:  # there is such a time, once or twice
        return high
    minute, changed = dt.timedelta(minutes=1), by_later.utcoffset()
    return low + minute * bisect_left(range((high - low) // minute), True, key=lambda m: (low + m * minute).astimezone(local).utcoffset() == changed)


def calendar(spark: SparkSession, first: dt.date, last: dt.date, boundary: str, zone: str) -> DataFrame:
    """day, start_utc, end_utc for each day from first to last; a skipped day has no length."""
    minutes = boundary_minutes(boundary)
    starts = [day_start(first + dt.timedelta(days=k), minutes, zone) for k in range((last - first).days + 2)]
    rows = [(first + dt.timedelta(days=k), starts[k], starts[k + 1]) for k in range(len(starts) - 1)]
    return spark.createDataFrame(rows, "day date, start_utc timestamp, end_utc timestamp")


def with_day(rows: DataFrame, stamp: str, days: DataFrame) -> DataFrame:
    """``rows`` with the day that holds each stamp; the calendar has a row per day and is broadcast."""
    return rows.join(F.broadcast(days), (F.col(stamp) >= F.col("start_utc")) & (F.col(stamp) < F.col("end_utc")), "left").drop("start_utc", "end_utc")


def day_of_utc(stamp: Column, minutes: int) -> Column:
    """The day in UTC, with its boundary so many minutes after midnight."""
    return F.to_date(stamp - F.make_dt_interval(mins=F.lit(minutes)))
