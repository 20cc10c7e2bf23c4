"""Analytical reads: counts, timelines, distributions, top tracks, catalog search, recommendations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, text, timestamps
from ..operators import projection
from ..operators.order import numbered
from ..operators.projection import accepted, source_label
from .tables import CATALOG, DECISIONS, ORIGINS, PROJECTED, RECORDS, decisions, events, full, origins, projected, query, records, systems, table, tracks

DAY, BOUNDARY = dt.date(1998, 10, 27), "04:30"
AS_OF = "2000-01-01 00:00:00"
WEIGHTS = {"favorite": 2.0, "frequency": 3.0, "recency": 2.5, "want": 2.5}
SEED = "daily-playlist"


# --- counts ----------------------------------------------------------------------------------------


def count_records(rows: DataFrame) -> DataFrame:
    """One row of counts; zeros for an empty table."""
    status = F.col("effective_status")
    return rows.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(status == projection.ACCEPTED).alias("accepted"), F.count_if(status == projection.NEEDS_ATTENTION).alias("needs_attention"),
        F.count_if(F.col("track_id").isNull() & (status != projection.EXCLUDED)).alias("catalog_attention"),
    )


A1_SQL = f"""WITH {PROJECTED} SELECT count(*) AS records, count(*) FILTER (effective_status = 'accepted') AS accepted, count(*) FILTER (effective_status = 'needs_attention') AS needs_attention,
  count(*) FILTER (track_id IS NULL AND effective_status <> 'excluded') AS catalog_attention FROM projected"""


@query("a1_counts", A1_SQL)
def a1(spark: SparkSession, d: str) -> DataFrame:
    return count_records(projected(spark, d))


@query("a2_attention", f"SELECT needs_attention, catalog_attention FROM ({A1_SQL})")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return a1(spark, d).select("needs_attention", "catalog_attention")


def source_distribution(rows: DataFrame) -> DataFrame:
    return accepted(rows).groupBy(source_label().alias("source")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


LABEL = "coalesce(nullif(request_type, ''), nullif(evidence_source, ''), 'unknown')"


@query("a3_sources", f"WITH {PROJECTED} SELECT {LABEL} AS source, count(*) AS n FROM projected WHERE effective_status = 'accepted' GROUP BY 1 ORDER BY n DESC, source")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return source_distribution(projected(spark, d))


def top_tracks(rows: DataFrame, catalog: DataFrame, limit: int = 10) -> DataFrame:
    """Most played accepted tracks; title and artist of the latest play, rows without track by their own names.

    Rows are counted and limited first; only those of the few keys that remain meet the catalog.
    """
    key = F.coalesce(F.col("track_id").cast("string"), F.concat("record_system", F.lit(":"), "external_id"))
    keyed = accepted(rows).withColumn("track_key", key)
    top = keyed.groupBy("track_key").agg(F.count(F.lit(1)).alias("n"), F.max("played_at").alias("last")).orderBy(F.desc("n"), F.desc("last"), "track_key").limit(limit)
    latest = F.struct("played_at", "record_id")
    plays = keyed.join(F.broadcast(top.select("track_key")), "track_key", "left_semi").join(catalog, "track_id", "left")
    named = plays.groupBy("track_key").agg(F.max_by(F.coalesce("title", "video_name"), latest).alias("title"), F.max_by("artist", latest).alias("artist"))
    return top.join(named, "track_key").orderBy(F.desc("n"), F.desc("last"), "track_key").select("track_key", "title", "artist", "n")


@query("a4_top_tracks", f"""WITH {PROJECTED}, {CATALOG}, j AS (
  SELECT p.*, t.title, t.artist, coalesce(p.track_id::VARCHAR, record_system || ':' || external_id) AS track_key
  FROM projected p LEFT JOIN tracks t USING (track_id) WHERE effective_status = 'accepted'
) SELECT track_key, arg_max(coalesce(title, video_name), (played_at, record_id)) AS title, arg_max(artist, (played_at, record_id)) AS artist, count(*) AS n
FROM j GROUP BY track_key ORDER BY n DESC, max(played_at) DESC, track_key LIMIT 10""")  # fmt: skip
def a4(spark: SparkSession, d: str) -> DataFrame:
    return top_tracks(projected(spark, d), tracks(spark, d))


def track_stats(rows: DataFrame) -> DataFrame:
    """track_id, plays, last_played of accepted rows with a track."""
    return accepted(rows).filter("track_id is not null").groupBy("track_id").agg(F.count(F.lit(1)).alias("plays"), F.max("played_at").alias("last_played"))


STATS = "stats AS (SELECT track_id, count(*) AS plays, max(played_at) AS last_played FROM projected WHERE effective_status = 'accepted' AND track_id IS NOT NULL GROUP BY 1)"


@query("a5_track_stats", f"WITH {PROJECTED}, {STATS} SELECT track_id, plays, strftime(last_played, '%Y-%m-%d %H:%M:%S') AS last_played FROM stats")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return track_stats(projected(spark, d)).withColumn("last_played", F.date_format("last_played", "yyyy-MM-dd HH:mm:ss"))


@query("a7_kind_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a8_collected_sets", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY 1")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("a9_first_values", """SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_kind, arg_min(event_type, (ts, event_id)) FILTER (event_type <> 'view') AS first_not_view FROM events GROUP BY 1""")
def a9(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("ts", "event_id")
    return events(spark, d).groupBy("user_id").agg(F.min_by("event_type", order).alias("first_kind"), F.min_by("event_type", F.when(F.col("event_type") != "view", order)).alias("first_not_view"))


@query("a10_first_last_time", "SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id").agg(F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))


KIND_RANK = {"view": 10, "click": 20, "purchase": 30}


@query("a11_ranked_duration", """WITH r AS (SELECT *, CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 20 WHEN 'purchase' THEN 30 ELSE 0 END AS rank,
  lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, arg_max(event_id, (rank, -epoch_us(ts), -event_id)) AS chosen, count(*) FILTER (abs(value - before) > 0.001) AS conflicts FROM r GROUP BY 1""")  # fmt: skip
def a11(spark: SparkSession, d: str) -> DataFrame:
    """The duration of the highest-ranked source, the earliest of equals, and how often neighbours disagree."""
    from pyspark.sql import Window

    e = events(spark, d).withColumn("rank", keys.rank_of(F.col("event_type"), KIND_RANK)).withColumn("before", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    order = F.struct("rank", -F.unix_micros("ts"), -F.col("event_id"))
    return e.groupBy("user_id").agg(F.max_by("event_id", order).alias("chosen"), F.count_if(F.abs(F.col("value") - F.col("before")) > 0.001).alias("conflicts"))


# --- projections and filters -------------------------------------------------------------------------


@query("p1_effective_status", f"WITH {PROJECTED} SELECT record_id, manual_decision, effective_status FROM projected")
def p1(spark: SparkSession, d: str) -> DataFrame:
    return projected(spark, d).select("record_id", "manual_decision", "effective_status")


@query("p2_accepted", f"WITH {PROJECTED} SELECT record_id FROM projected WHERE effective_status = 'accepted'")
def p2(spark: SparkSession, d: str) -> DataFrame:
    return accepted(projected(spark, d)).select("record_id")


@query("p3_source_label", f"WITH {RECORDS} SELECT record_id, {LABEL} AS source FROM records")
def p3(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("record_id", source_label().alias("source"))


def timeline(rows: DataFrame, live_only: bool = False) -> DataFrame:
    """Rows for review: names of track and system, what the record says of itself, and its status."""
    shown = rows.filter(F.col("evidence_source") == projection.LIVE_SOURCE) if live_only else rows
    return shown.select(
        "record_id", F.date_format("played_at", "yyyy-MM-dd HH:mm:ss").alias("played_at"), F.coalesce("system_key", "record_system").alias("system_key"), "system_name",
        F.coalesce("title", "video_name").alias("title"), "artist", F.col("request_type").alias("source_type"), "default_status", "manual_decision", "effective_status",
        F.col("track_id").isNull().alias("catalog_attention"),
    )


TIMELINE = f"""{PROJECTED}, {CATALOG}, timeline AS (
  SELECT record_id, strftime(played_at, '%Y-%m-%d %H:%M:%S') AS played_at, coalesce(system_key, record_system) AS system_key, system_name, coalesce(title, video_name) AS title, artist,
         request_type AS source_type, default_status, manual_decision, effective_status, track_id IS NULL AS catalog_attention, evidence_source
  FROM projected LEFT JOIN tracks USING (track_id) LEFT JOIN systems USING (system_id)
)"""


@query("p4_timeline_live", f"WITH {TIMELINE} SELECT * EXCLUDE (evidence_source) FROM timeline WHERE evidence_source = 'vrc_log_live'")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return timeline(full(spark, d), live_only=True)


def of_day(spark: SparkSession, rows: DataFrame, stamp: str, day: dt.date, boundary: str = BOUNDARY, zone: str = "UTC") -> DataFrame:
    """Rows of one day: two literals, which reach the scan."""
    minutes = timestamps.boundary_minutes(boundary)
    start, end = (timestamps.day_start(day + dt.timedelta(days=k), minutes, zone).astimezone(dt.UTC) for k in (0, 1))
    return rows.filter((F.col(stamp) >= F.lit(start)) & (F.col(stamp) < F.lit(end)))


@query("p5_day", f"WITH {PROJECTED} SELECT record_id, effective_status FROM projected WHERE played_at >= TIMESTAMP '1998-10-27 04:30:00' AND played_at < TIMESTAMP '1998-10-28 04:30:00'")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return of_day(spark, projected(spark, d), "played_at", DAY).select("record_id", "effective_status")


@query("f5_days", """SELECT event_id, ((ts - INTERVAL 270 MINUTE)::DATE)::VARCHAR AS day FROM events""")
def f5(spark: SparkSession, d: str) -> DataFrame:
    """Every event's day by a join with the calendar, whose length is the span of the days."""
    e = events(spark, d)
    first, last = e.agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    days = timestamps.calendar(spark, first - dt.timedelta(days=1), last + dt.timedelta(days=1), BOUNDARY, "UTC")
    return timestamps.with_day(e.select("event_id", "ts"), "ts", days).select("event_id", F.col("day").cast("string").alias("day"))


def search_catalog(rows: DataFrame, fields: list[str], wanted: str, order: list, limit: int | None = None) -> DataFrame:
    """Rows whose fields, joined by spaces, hold the text in any case; then ordered, then limited (1 to 500, else 100)."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))
    most = 100 if limit is None else min(max(limit, 1), 500)
    return rows.filter(joined.contains(wanted.strip().lower())).orderBy(*order).limit(most)


@query("p6_search", """SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type, p_size::VARCHAR)), 'brand#1') ORDER BY p_size, p_partkey LIMIT 100""")
def p6(spark: SparkSession, d: str) -> DataFrame:
    return search_catalog(table(spark, d, "part"), ["p_name", "p_brand", "p_type", "p_size"], " Brand#1 ", ["p_size", "p_partkey"]).select("p_partkey", "p_name")


@query("p8_stale", f"WITH {RECORDS}, {ORIGINS} SELECT record_id FROM records WHERE default_status = 'pending' AND evidence_source = 'vrc_log_live' AND record_id IN (SELECT record_id FROM origins WHERE origin_table = 'watcher_playback_events')")
def p8(spark: SparkSession, d: str) -> DataFrame:
    stale = records(spark, d).filter((F.col("default_status") == "pending") & (F.col("evidence_source") == projection.LIVE_SOURCE))
    return stale.join(origins(spark, d).filter(F.col("origin_table") == "watcher_playback_events"), "record_id", "left_semi").select("record_id")


def display_name(external_id, title, artist, variant=None):
    """``title - artist [variant]``, after the id unless the title begins with it."""
    lead = F.substr(title, F.length(external_id) + 1, F.lit(1))
    has_id = title.startswith(external_id) & ((lead == ".") | lead.rlike(r"^\s$"))
    named = F.concat(title, F.when(F.coalesce(artist, F.lit("")) != "", F.concat(F.lit(" - "), artist)).otherwise(""))
    if variant is not None:
        named = F.concat(named, F.when(F.coalesce(variant, F.lit("")) != "", F.concat(F.lit(" ["), variant, F.lit("]"))).otherwise(""))
    return F.when(has_id, named).otherwise(F.concat(external_id, F.lit(". "), named))


@query("p10_display_name", """SELECT c_custkey, CASE WHEN starts_with(t, c_custkey::VARCHAR) AND substr(t, length(c_custkey::VARCHAR) + 1, 1) IN ('.', ' ') THEN n ELSE c_custkey || '. ' || n END AS name
FROM (SELECT c_custkey, t, t || ' - ' || lower(c_mktsegment) AS n FROM (SELECT c_custkey, c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN c_custkey || '. ' || c_name WHEN 1 THEN c_custkey || c_name ELSE c_name END AS t FROM customer))""")  # fmt: skip
def p10(spark: SparkSession, d: str) -> DataFrame:
    number, name = F.col("c_custkey").cast("string"), F.col("c_name")
    title = F.when(F.col("c_custkey") % 3 == 0, F.concat(number, F.lit(". "), name)).when(F.col("c_custkey") % 3 == 1, F.concat(number, name)).otherwise(name)
    return table(spark, d, "customer").select("c_custkey", display_name(number, title, F.lower("c_mktsegment")).alias("name"))


def report_lines(rows: DataFrame, zone: str) -> DataFrame:
    """record_id and ``HH:MM:SS name`` in the zone."""
    return rows.select("record_id", F.concat(F.date_format(F.from_utc_timestamp("played_at", zone), "HH:mm:ss"), F.lit(" "), F.coalesce("title", "video_name")).alias("line"))


@query("p11_report_lines", f"WITH {PROJECTED}, {CATALOG} SELECT record_id, strftime(played_at, '%H:%M:%S') || ' ' || coalesce(title, video_name) AS line FROM projected LEFT JOIN tracks USING (track_id) WHERE effective_status = 'accepted'")
def p11(spark: SparkSession, d: str) -> DataFrame:
    return report_lines(accepted(full(spark, d)), "UTC")


@query("p12_overlay", """SELECT event_id, upper(event_type[1]) || event_type[2:] AS label, (floor(value)::BIGINT // 60) || ':' || lpad((floor(value)::BIGINT % 60)::VARCHAR, 2, '0') AS shown,
  'user ' || user_id AS title, event_type AS series FROM events WHERE value >= 0""")  # fmt: skip
def p12(spark: SparkSession, d: str) -> DataFrame:
    parts = text.overlay_title(F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" | "), F.col("event_type")))
    label = F.concat(F.upper(F.substring("event_type", 1, 1)), F.substr(F.col("event_type"), F.lit(2)))
    return events(spark, d).filter("value >= 0").select("event_id", label.alias("label"), text.minutes_seconds(F.col("value")).alias("shown"), parts["title"].alias("title"), parts["series"].alias("series"))


@query("p13_current", """WITH c AS (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS cleared FROM events GROUP BY 1)
SELECT user_id, max(event_id) AS current FROM events JOIN c USING (user_id) WHERE event_type <> 'error' AND event_id > coalesce(cleared, -1) GROUP BY 1""")  # fmt: skip
def p13(spark: SparkSession, d: str) -> DataFrame:
    """Per user the latest event that is newer than the last clearing one."""
    e = events(spark, d)
    open_id = F.when(F.col("event_type") != "error", F.col("event_id"))
    grouped = e.groupBy("user_id").agg(F.max(open_id).alias("current"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("cleared"))
    return grouped.filter(F.col("current") > F.coalesce("cleared", F.lit(-1))).select("user_id", "current")


@query("p16_between", "SELECT count(*) AS n FROM events WHERE ts BETWEEN (SELECT min(ts) FROM events) AND (SELECT min(ts) FROM events) + INTERVAL 7 DAY")
def p16(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    first = e.agg(F.min("ts").alias("first"))
    return e.join(F.broadcast(first), F.col("ts").between(F.col("first"), F.col("first") + F.expr("INTERVAL 7 DAY"))).agg(F.count(F.lit(1)).alias("n"))


@query("p17_accepted_of_system", f"WITH {TIMELINE} SELECT record_id, title FROM timeline WHERE effective_status = 'accepted' AND system_key = 'nation_7'")
def p17(spark: SparkSession, d: str) -> DataFrame:
    return timeline(accepted(full(spark, d))).filter(F.col("system_key") == "nation_7").select("record_id", "title")


# --- joins -------------------------------------------------------------------------------------------


@query("j1_tracks_systems", f"WITH {CATALOG} SELECT track_id, system_key, title FROM tracks JOIN systems USING (system_id)")
def j1(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).join(systems(spark, d), "system_id").select("track_id", "system_key", "title")


@query("j2_decision_join", f"WITH {PROJECTED} SELECT record_id, default_status, manual_decision FROM projected")
def j2(spark: SparkSession, d: str) -> DataFrame:
    return projected(spark, d).select("record_id", "default_status", "manual_decision")


@query("j3_full_catalog", f"WITH {TIMELINE} SELECT record_id, system_key, title FROM timeline")
def j3(spark: SparkSession, d: str) -> DataFrame:
    return timeline(full(spark, d)).select("record_id", "system_key", "title")


@query("j4_origins", f"WITH {RECORDS}, {ORIGINS} SELECT record_id, origin_key, default_status FROM records JOIN origins USING (record_id)")
def j4(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).join(origins(spark, d), "record_id").select("record_id", "origin_key", "default_status")


@query("j5_staging_chain", f"WITH {RECORDS}, {CATALOG}, {DECISIONS} SELECT record_id, title, system_key, decision FROM records LEFT JOIN tracks USING (track_id) LEFT JOIN systems USING (system_id) LEFT JOIN decisions USING (record_id)")
def j5(spark: SparkSession, d: str) -> DataFrame:
    joined = projection.with_catalog(records(spark, d), tracks(spark, d), systems(spark, d)).join(decisions(spark, d), "record_id", "left")
    return joined.select("record_id", "title", "system_key", "decision")


@query("j6_semi", f"WITH {RECORDS}, {ORIGINS} SELECT record_id FROM records WHERE record_id IN (SELECT record_id FROM origins WHERE origin_table = 'dance_events')")
def j6(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).join(origins(spark, d).filter(F.col("origin_table") == "dance_events"), "record_id", "left_semi").select("record_id")


@query("j7_anti", f"WITH {RECORDS}, {ORIGINS} SELECT record_id FROM records r WHERE NOT EXISTS (SELECT 1 FROM origins o WHERE o.record_id = r.record_id)")
def j7(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).join(origins(spark, d), "record_id", "left_anti").select("record_id")


@query("j8_unknown_ids", "SELECT DISTINCT o_custkey + 100 AS id FROM orders WHERE o_custkey + 100 NOT IN (SELECT c_custkey FROM customer)")
def j8(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").select((F.col("o_custkey") + 100).alias("id")).distinct()
    return wanted.join(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id", "left_anti")


@query("j9_preferred_origin", f"""WITH {ORIGINS} SELECT record_id, origin_key FROM (
  SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY origin_table <> 'dance_events', origin_key) AS k FROM origins) WHERE k = 1""")  # fmt: skip
def j9(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct((F.col("origin_table") != "dance_events").alias("later"), "origin_key")
    return origins(spark, d).groupBy("record_id").agg(F.min_by("origin_key", order).alias("origin_key"))


@query("j22_point_lookup", f"WITH {CATALOG} SELECT track_id, title FROM tracks JOIN systems USING (system_id) WHERE system_key = 'nation_7' AND track_id = (SELECT min(track_id) FROM tracks JOIN systems USING (system_id) WHERE system_key = 'nation_7')")
def j22(spark: SparkSession, d: str) -> DataFrame:
    of_system = tracks(spark, d).join(systems(spark, d).filter(F.col("system_key") == "nation_7"), "system_id")
    return of_system.orderBy("track_id").limit(1).select("track_id", "title")


# --- recommendations ---------------------------------------------------------------------------------


def recommend(catalog: DataFrame, stats: DataFrame, as_of: str) -> DataFrame:
    """Catalog rows with plays, days_since and weight at an instant; never-played tracks count as fully rested."""
    days = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("last_played")) / F.lit(86_400e6)
    joined = catalog.join(stats, "track_id", "left").withColumns({"plays": F.coalesce("plays", F.lit(0)), "__days": days})
    rested = F.when(F.col("__days").isNull(), 1.0).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-0.1 * (F.col("__days") - 7))))
    weight = WEIGHTS["favorite"] * F.col("favorite").cast("double") + WEIGHTS["frequency"] / (1.0 + F.col("plays")) + WEIGHTS["recency"] * rested + WEIGHTS["want"] * F.col("want").cast("double")
    return joined.withColumns({"weight": F.round(weight, 3), "days_since": F.round("__days", 1)}).drop("__days")


def tiebreak(seed: str, key) -> object:
    """A number in [0, 1] from the first 32 bits of a hash of seed and key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def daily_playlist(weighted: DataFrame, day: dt.date, count: int = 20, seed: str = SEED) -> DataFrame:
    """The day's tracks: by weight, equals in an order that the day decides."""
    turn = tiebreak(f"{seed}-{day.isoformat()}", F.concat("system_key", F.lit(":"), F.col("track_id").cast("string")))
    return weighted.withColumn("turn", turn).orderBy(F.desc("weight"), "turn", "track_id").limit(count)


def catalog_flags(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("track_id"), F.col("c_nationkey").alias("system_id"), (F.col("c_mktsegment") == "BUILDING").alias("favorite"), (F.col("c_mktsegment") == "MACHINERY").alias("want"))
    return c.join(systems(spark, d), "system_id")


WEIGHTED = f"""{PROJECTED}, {STATS}, {CATALOG}, flagged AS (
  SELECT c_custkey AS track_id, system_key, c_mktsegment = 'BUILDING' AS favorite, c_mktsegment = 'MACHINERY' AS want FROM customer JOIN systems ON system_id = c_nationkey
), dated AS (SELECT f.*, coalesce(plays, 0) AS plays, (epoch_us(TIMESTAMP '2000-01-01') - epoch_us(last_played)) / 86400e6 AS d FROM flagged f LEFT JOIN stats USING (track_id)
), weighted AS (
  SELECT track_id, system_key, plays, round(d, 1) AS days_since,
    round(2.0 * favorite::INT::DOUBLE + 3.0 / (1.0 + plays) + 2.5 * CASE WHEN d IS NULL THEN 1.0 ELSE 1.0 / (1.0 + exp(-0.1 * (d - 7))) END + 2.5 * want::INT::DOUBLE, 3) AS weight FROM dated
), turns AS (SELECT *, ('0x' || substr(sha256('daily-playlist-1998-10-27:' || system_key || ':' || track_id), 1, 8))::BIGINT::DOUBLE / 4294967295.0 AS turn FROM weighted)"""


@query("m9_weights", f"WITH {WEIGHTED} SELECT track_id, plays, days_since, weight FROM weighted")
def m9(spark: SparkSession, d: str) -> DataFrame:
    return recommend(catalog_flags(spark, d), track_stats(projected(spark, d)), AS_OF).select("track_id", "plays", "days_since", "weight")


@query("m10_tiebreak", f"WITH {WEIGHTED} SELECT track_id, turn FROM turns")
def m10(spark: SparkSession, d: str) -> DataFrame:
    turn = tiebreak(f"{SEED}-{DAY.isoformat()}", F.concat("system_key", F.lit(":"), F.col("track_id").cast("string")))
    return catalog_flags(spark, d).select("track_id", turn.alias("turn"))


@query("o5_playlist", f"WITH {WEIGHTED} SELECT track_id, weight FROM turns ORDER BY weight DESC, turn, track_id LIMIT 20")
def o5(spark: SparkSession, d: str) -> DataFrame:
    weighted = recommend(catalog_flags(spark, d), track_stats(projected(spark, d)), AS_OF)
    return daily_playlist(weighted, DAY).select("track_id", "weight")


@query("j24_in_playlist", f"WITH {WEIGHTED}, top AS (SELECT track_id FROM turns ORDER BY weight DESC, turn, track_id LIMIT 20) SELECT record_id FROM records WHERE track_id IN (SELECT track_id FROM top)")
def j24(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).join(F.broadcast(o5(spark, d).select("track_id")), "track_id", "left_semi").select("record_id")


# --- orders and limits -------------------------------------------------------------------------------


@query("o1_catalog_order", """SELECT p_partkey, row_number() OVER (ORDER BY p_brand, coalesce(try_cast(regexp_extract(x, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0), x, p_partkey) AS place FROM (
  SELECT p_partkey, p_brand, CASE p_partkey % 3 WHEN 0 THEN p_size || 'abc' WHEN 1 THEN 'x' || p_size ELSE p_size::VARCHAR END AS x FROM part)""")  # fmt: skip
def o1(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    x = F.when(F.col("p_partkey") % 3 == 0, F.concat(size, F.lit("abc"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("x"), size)).otherwise(size)
    return numbered(table(spark, d, "part").withColumn("x", x), ["p_brand", keys.number_prefix(F.col("x")), "x", "p_partkey"]).select("p_partkey", "place")


@query("o2_recent", f"WITH {PROJECTED} SELECT record_id, {LABEL} AS source FROM projected WHERE effective_status = 'accepted' ORDER BY played_at DESC, record_id DESC LIMIT 8")
def o2(spark: SparkSession, d: str) -> DataFrame:
    recent = accepted(projected(spark, d)).orderBy(F.desc("played_at"), F.desc("record_id")).limit(8)
    return recent.select("record_id", source_label().alias("source"))


@query("o3_latest_live", "SELECT event_id FROM events ORDER BY coalesce(CASE WHEN event_type = 'purchase' THEN ts END, CASE WHEN event_type = 'click' THEN ts - INTERVAL 1 DAY END, ts - INTERVAL 2 DAY) DESC, event_id DESC LIMIT 25")
def o3(spark: SparkSession, d: str) -> DataFrame:
    when = F.coalesce(F.when(F.col("event_type") == "purchase", F.col("ts")), F.when(F.col("event_type") == "click", F.col("ts") - F.expr("INTERVAL 1 DAY")), F.col("ts") - F.expr("INTERVAL 2 DAY"))
    return events(spark, d).orderBy(when.desc(), F.desc("event_id")).limit(25).select("event_id")


@query("o4_day_order", f"WITH {PROJECTED} SELECT record_id, row_number() OVER (ORDER BY played_at, record_id) AS place FROM projected WHERE played_at >= TIMESTAMP '1998-10-27 04:30:00' AND played_at < TIMESTAMP '1998-10-28 04:30:00'")
def o4(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return of_day(spark, projected(spark, d), "played_at", DAY).select("record_id", F.row_number().over(Window.orderBy("played_at", "record_id")).cast("long").alias("place"))


@query("o6_latest_twenty", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 20")
def o6(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).orderBy(F.desc("event_id")).limit(20).select("event_id")


@query("o7_numeric_first", """SELECT p_partkey, row_number() OVER (ORDER BY n IS NULL, n, x, p_partkey) AS place FROM (
  SELECT p_partkey, x, CASE WHEN regexp_full_match(x, '\\d+') THEN x::BIGINT END AS n FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name ELSE p_size::VARCHAR END AS x FROM part))""")  # fmt: skip
def o7(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    n = F.when(x.rlike(r"^\d+$"), x.try_cast("bigint"))
    return numbered(table(spark, d, "part").select("p_partkey", x.alias("x"), n.alias("n")), [F.col("n").isNull(), "n", "x", "p_partkey"]).select("p_partkey", "place")


@query("o8_occurrence_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def o8(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return events(spark, d).select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("place"))


@query("o9_latest_day", "SELECT ((max(ts) - INTERVAL 270 MINUTE)::DATE)::VARCHAR AS day FROM events")
def o9(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).agg(timestamps.day_of_utc(F.max("ts"), timestamps.boundary_minutes(BOUNDARY)).cast("string").alias("day"))


# --- sets --------------------------------------------------------------------------------------------


@query("u1_set_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def u1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("u1_set_intersection", "SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders")
def u1b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).intersect(table(spark, d, "orders").select("o_custkey"))


@query("u2_union_roots", "SELECT 'a' AS root, s_suppkey AS id FROM supplier UNION ALL SELECT 'b', c_custkey FROM customer")
def u2(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "supplier").select(F.lit("a").alias("root"), F.col("s_suppkey").alias("id"))
    return left.unionByName(table(spark, d, "customer").select(F.lit("b").alias("root"), F.col("c_custkey").alias("id")))


@query("u3_ordered_distinct", "SELECT conv_id, array_to_string(list(role ORDER BY first_turn), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY 1, 2) GROUP BY 1")
def u3(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's roles in order of their first turn."""
    firsts = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    listed = firsts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("t", "role"))).alias("r"))
    return listed.select("conv_id", F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"))


# --- composite reads ---------------------------------------------------------------------------------


@query("c1_home", f"SELECT 'records' AS name, records AS n FROM ({A1_SQL}) UNION ALL SELECT 'accepted', accepted FROM ({A1_SQL}) UNION ALL SELECT 'needs_attention', needs_attention FROM ({A1_SQL}) UNION ALL SELECT 'catalog_attention', catalog_attention FROM ({A1_SQL}) UNION ALL SELECT 'tracks', count(*) FROM customer")
def c1(spark: SparkSession, d: str) -> DataFrame:
    counts = a1(spark, d).selectExpr("stack(4, 'records', records, 'accepted', accepted, 'needs_attention', needs_attention, 'catalog_attention', catalog_attention) as (name, n)")
    return counts.unionByName(table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n")).select(F.lit("tracks").alias("name"), "n"))


@query("c2_timeline_latest_day", f"""WITH {TIMELINE}, last AS (SELECT (max(played_at) - INTERVAL 270 MINUTE)::DATE AS day FROM records)
SELECT t.record_id, t.title, t.effective_status FROM timeline t JOIN records r USING (record_id) JOIN last ON (r.played_at - INTERVAL 270 MINUTE)::DATE = day""")  # fmt: skip
def c2(spark: SparkSession, d: str) -> DataFrame:
    """The timeline of the latest day that has rows: its date is found first, then two literals filter the scan."""
    last = records(spark, d).agg(timestamps.day_of_utc(F.max("played_at"), timestamps.boundary_minutes(BOUNDARY))).first()[0]
    return timeline(of_day(spark, full(spark, d), "played_at", last or DAY)).select("record_id", "title", "effective_status")


@query("c3_catalog", f"WITH {CATALOG} SELECT track_id, system_key, title FROM tracks JOIN systems USING (system_id) WHERE contains(lower(concat_ws(' ', system_key, title, artist)), 'auto') ORDER BY system_key, track_id LIMIT 500")
def c3(spark: SparkSession, d: str) -> DataFrame:
    rows = tracks(spark, d).join(systems(spark, d), "system_id")
    return search_catalog(rows, ["system_key", "title", "artist"], "AUTO", ["system_key", "track_id"], 900).select("track_id", "system_key", "title")


@query("c5_insights", f"""WITH {WEIGHTED} SELECT 'source' AS part, {LABEL} AS name, count(*)::DOUBLE AS amount FROM projected WHERE effective_status = 'accepted' GROUP BY 2
UNION ALL (SELECT 'recommended', track_id::VARCHAR, weight FROM turns ORDER BY weight DESC, turn, track_id LIMIT 10)""")  # fmt: skip
def c5(spark: SparkSession, d: str) -> DataFrame:
    sources = a3(spark, d).select(F.lit("source").alias("part"), F.col("source").alias("name"), F.col("n").cast("double").alias("amount"))
    weighted = recommend(catalog_flags(spark, d), track_stats(projected(spark, d)), AS_OF)
    top = daily_playlist(weighted, DAY, 10).select(F.lit("recommended").alias("part"), F.col("track_id").cast("string").alias("name"), F.col("weight").alias("amount"))
    return sources.unionByName(top)


@query("c6_day_report", f"WITH {PROJECTED}, {CATALOG} SELECT record_id, strftime(played_at, '%H:%M:%S') || ' ' || coalesce(title, video_name) AS line FROM projected LEFT JOIN tracks USING (track_id) WHERE effective_status = 'accepted' AND evidence_source = 'vrc_log_live' AND played_at >= TIMESTAMP '1998-10-27 04:30:00' AND played_at < TIMESTAMP '1998-10-28 04:30:00'")
def c6(spark: SparkSession, d: str) -> DataFrame:
    live = full(spark, d).filter(F.col("evidence_source") == projection.LIVE_SOURCE)
    return report_lines(accepted(of_day(spark, live, "played_at", DAY)), "UTC")


@query("c8_auto_source", f"WITH {WEIGHTED}, top AS (SELECT track_id FROM turns ORDER BY weight DESC, turn, track_id LIMIT 20) SELECT record_id, CASE WHEN track_id IN (SELECT track_id FROM top) THEN 'recommend' ELSE 'self' END AS source FROM records")
def c8(spark: SparkSession, d: str) -> DataFrame:
    """A self entry of a track in the day's playlist counts as recommended."""
    top = o5(spark, d).select("track_id", F.lit(True).alias("listed"))
    return records(spark, d).join(F.broadcast(top), "track_id", "left").select("record_id", F.when(F.col("listed"), "recommend").otherwise("self").alias("source"))
