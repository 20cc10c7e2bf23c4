"""Scalar functions over stand-in columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, text, timestamps, urls
from .tables import events, query, table


@query("f1_parse_instant", "SELECT event_id, epoch_us(ts) // 1000 * 1000 AS us FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 3")
def f1(spark: SparkSession, d: str) -> DataFrame:
    """Instants back from ISO with offset, ISO with Z, log stamps, and text that is none."""
    ts = F.col("ts")
    iso = F.concat(F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+02:00"))
    form = F.when(F.col("event_id") % 4 == 0, iso).when(F.col("event_id") % 4 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(F.col("event_id") % 4 == 2, F.date_format(ts, "yyyy.MM.dd HH:mm:ss.SSS")).otherwise("not a time")
    return events(spark, d).select("event_id", F.unix_micros(timestamps.parse_instant(form, "UTC")).alias("us"))


@query("f2_utc_text", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') || 'Z' END AS t FROM events WHERE epoch_us(ts) % 1000000 <> 0")
def f2(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.when(F.col("event_id") % 2 == 0, F.date_trunc("second", "ts")).otherwise(F.col("ts"))
    return events(spark, d).filter("unix_micros(ts) % 1000000 <> 0").select("event_id", timestamps.utc_text(stamp).alias("t"))


@query("f3_line_stamp", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y.%m.%d %H:%M:%S') END AS stamp FROM events")
def f3(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.when(F.col("event_id") % 3 == 0, "at ").otherwise(""), F.date_format("ts", "yyyy.MM.dd HH:mm:ss"), F.lit(" Log - x"))
    return events(spark, d).select("event_id", timestamps.line_stamp(line).alias("stamp"))


@query("f4_seconds_between", "SELECT event_id, round((epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000) / 1000.0, 3)::DOUBLE AS s FROM events")
def f4(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    whole = F.timestamp_millis(F.floor(F.unix_micros("ts") / 1000))
    before = F.lag("at").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events(spark, d).withColumn("at", whole).select("event_id", timestamps.seconds_between(before, F.col("at")).alias("s"))


@query("f7_explicit_offset", "SELECT event_id, event_id % 4 IN (0, 1) AS fine FROM events")
def f7(spark: SparkSession, d: str) -> DataFrame:
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    form = F.when(F.col("event_id") % 4 == 0, F.concat(base, F.lit("Z"))).when(F.col("event_id") % 4 == 1, F.concat(base, F.lit("-05:30"))).when(F.col("event_id") % 4 == 2, base).otherwise("2024-02-30T00:00:00Z")
    return events(spark, d).select("event_id", timestamps.has_explicit_offset(form).alias("fine"))


@query("f8_back_dated", "SELECT event_id, CASE WHEN value > 0 THEN epoch_us(ts) - round(value * 100)::BIGINT * 10000 END AS us FROM events")
def f8(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", F.unix_micros(timestamps.back_dated(F.col("ts"), F.round("value", 2))).alias("us"))


@query("f9_fixed_zone", "SELECT event_id, epoch_us(ts) // 1000000 - 28800 AS s FROM events")
def f9(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", F.unix_seconds(timestamps.parse_instant(F.date_format("ts", "yyyy.MM.dd HH:mm:ss"), "+08:00")).alias("s"))


def playback_urls(spark: SparkSession, d: str) -> DataFrame:
    """Songs' URLs of every form that is known, and the pages' own."""
    p, i = table(spark, d, "pages").select("page_id", "url"), F.col("page_id").cast("string")
    forms = (
        F.concat(F.lit("HTTP://API.UDON.DANCE/Api/Songs/play?id="), i), F.concat(F.lit("https://nya.xin.moe/files/a/"), i, F.lit("-b.mp4")), F.concat(F.lit("https://api.pypy.dance/video?id="), i),
        F.concat(F.lit("http://jd.pypy.moe/api/v1/videos/"), i, F.lit(".mp4")), F.concat(F.lit("https://global-cdn.dudufit.dance/videos/"), i, F.lit("-x.mp4")), F.concat(F.lit("https://www.dudufit.dance/en/videos/"), i, F.lit("/")),
        F.concat(F.lit("https://x.dudufit.dance/videos/"), i), F.col("url"), F.lit(""),
    )
    return p.select("page_id", F.element_at(F.array(*forms), (F.col("page_id") % 9 + 1).cast("int")).alias("url"))


@query("f10_classify_url", """SELECT page_id, CASE WHEN k < 2 THEN 'wannadance' WHEN k < 4 THEN 'pypydance' WHEN k < 6 THEN 'dudu' END AS system, CASE WHEN k < 6 THEN page_id::VARCHAR END AS external_id,
  ['wanna_api', 'wanna_cdn', 'pypydance_api', 'pypydance_api', 'dudu', 'dudu', 'dudu', 'other', 'empty'][k + 1] AS url_kind,
  ['api_query_id', 'cdn_file_path', 'api_query_id', 'api_video_file_path', 'cdn_file_path', 'web_video_path', 'unsupported_system', 'unsupported', 'none'][k + 1] AS method FROM (SELECT page_id, (page_id % 9)::INT AS k FROM pages)""")  # fmt: skip
def f10(spark: SparkSession, d: str) -> DataFrame:
    return playback_urls(spark, d).select("page_id", urls.classify_url(F.col("url")).alias("c")).select("page_id", "c.*")


@query("f12_clean_url", "SELECT page_id, rtrim(url, '.,);]}') AS url FROM pages")
def f12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.clean_url(F.concat(F.lit(" '"), "url", F.lit("' "))).alias("url"))


@query("f13_colour_tags", "SELECT p_partkey, p_name || p_brand AS t FROM part")
def f13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.without_colour_tags(F.concat(F.lit("<color=#ff0000>"), "p_name", F.lit("</COLOR>"), "p_brand")).alias("t"))


@query("f14_clean_name", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS name FROM part")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.clean_name(F.when(F.col("p_partkey") % 3 == 0, "　 \"\" ").otherwise(F.concat(F.lit("　'"), "p_name", F.lit("' ")))).alias("name"))


@query("f15_title_parts", "SELECT p_partkey, p_partkey::VARCHAR AS id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS marker FROM part")
def f15(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ". ").otherwise(" : "), "p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" ("), "p_brand", F.lit(")"))).otherwise(""))
    return table(spark, d, "part").select("p_partkey", text.title_parts(title).alias("t")).select("p_partkey", "t.*")


#: Texts and what they fold to: ligatures, sharp s, wide and half-width forms, numerals, a final sigma, other spaces.
FOLDED = (
    ("  \ufb01 Stra\u00dfe", "fi strasse"), ("\uff21\uff22\uff23\u3000\uff11\uff12", "abc 12"), ("\u2163 \t\u00c0\u00c9", "iv \u00e0\u00e9"), ("\uff8a\uff9e\uff9d\uff84\uff9e", "\u30d0\u30f3\u30c9"),
    ("\u03a3\u03af\u03c3\u03c5\u03c6\u03bf\u03c2", "\u03c3\u03af\u03c3\u03c5\u03c6\u03bf\u03c3"), ("E\u0301 \u2122\u00a0", "\u00e9 tm"), ("", ""),
)


@query("f16_folded_text", "SELECT p_partkey, trim(p_name || ' ' || [" + ", ".join(f"'{folded}'" for _, folded in FOLDED) + f"][p_partkey % {len(FOLDED)} + 1]) AS folded FROM part")
def f16(spark: SparkSession, d: str) -> DataFrame:
    added = F.element_at(F.array(*[F.lit(raw) for raw, _ in FOLDED]), (F.col("p_partkey") % len(FOLDED) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.folded_text(F.concat(F.initcap("p_name"), F.lit(" "), added)).alias("folded"))


@query("f17_search_text", "SELECT p_partkey, p_name AS title, p_brand AS artist FROM part")
def f17(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat("p_name", F.lit(" (live) [x]"))
    return table(spark, d, "part").select("p_partkey", text.search_title(title).alias("title"), text.search_artist(F.concat("p_brand", F.lit(" feat. Someone"))).alias("artist"))


@query("f19_coercions", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE -1 END::BIGINT AS n, CASE WHEN p_partkey % 2 = 0 THEN p_size END::DOUBLE AS x FROM part")
def f19(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise("n/a")
    return table(spark, d, "part").select("p_partkey", text.to_int(value, -1).alias("n"), text.to_float(value).alias("x"))


@query("f20_hash_keys", "SELECT o_orderkey, sha256(o_orderkey || chr(31) || coalesce(nullif(o_orderstatus, 'F'), '') || chr(31) || o_custkey) AS k FROM orders")
def f20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", keys.hash_key(F.col("o_orderkey"), F.nullif("o_orderstatus", F.lit("F")), F.col("o_custkey")).alias("k"))


@query("f22_truthy", "SELECT event_id, event_id % 5 < 3 AS t FROM events")
def f22(spark: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(v) for v in ("1", " TRUE ", "Yes", "no", "")]), (F.col("event_id") % 5 + 1).cast("int"))
    return events(spark, d).select("event_id", text.truthy(said).alias("t"))


@query("f23_guarded_json", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN json_extract(props, '$.k')::BIGINT END AS k FROM events")
def f23(spark: SparkSession, d: str) -> DataFrame:
    payload = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("  "), "props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("{"), "props")).otherwise("17")
    guarded = F.when(F.trim(payload).rlike(r"^[\{\[]"), payload)
    return events(spark, d).select("event_id", F.from_json(guarded, "k long")["k"].alias("k"))


@query("f25_csv_fields", "SELECT p_partkey, p_name AS name, p_size AS size, p_type || ', x' AS label FROM part")
def f25(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("\""), "p_name", F.lit("\", "), F.col("p_size").cast("string"), F.lit(", \""), "p_type", F.lit(", x\""))
    row = F.from_csv(line, F.lit("name string, size int, label string"), {"ignoreLeadingWhiteSpace": "true"})
    return table(spark, d, "part").select("p_partkey", row.alias("r")).select("p_partkey", "r.*")


@query("f26_json_array", "SELECT event_id, user_id AS song, event_id % 7 AS place FROM events UNION ALL SELECT event_id, user_id + 1, event_id % 7 FROM events")
def f26(spark: SparkSession, d: str) -> DataFrame:
    """Two entries per line, whose id stands under one of two names."""
    u, p = F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")
    line = F.concat(F.lit('[{"songId":'), u, F.lit(',"place":'), p, F.lit('},{"id":'), (F.col("user_id") + 1).cast("string"), F.lit(',"place":'), p, F.lit("}]"))
    entry = F.explode(F.from_json(line, "array<struct<songId: long, id: long, place: long>>"))
    return events(spark, d).select("event_id", entry.alias("e")).select("event_id", F.coalesce("e.songId", "e.id").alias("song"), F.col("e.place").alias("place"))


@query("f28_sorted_json", "SELECT o_orderkey, '{\"a\":' || CASE WHEN o_custkey % 2 = 0 THEN 'null' ELSE o_custkey::VARCHAR END || ',\"b\":\"' || o_orderstatus || '\"}' AS j FROM orders")
def f28(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", keys.sorted_json(b=F.col("o_orderstatus"), a=F.when(F.col("o_custkey") % 2 != 0, F.col("o_custkey"))).alias("j"))


@query("f29_unknown_duration", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS s FROM events")
def f29(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", text.real_duration(F.when(F.col("event_id") % 3 == 0, 114514.0).otherwise(F.col("value"))).alias("s"))


@query("f31_marker_fields", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS id, p_name AS name FROM part")
def f31(spark: SparkSession, d: str) -> DataFrame:
    marker = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit(" : "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", text.marker_fields(marker).alias("m")).select("p_partkey", "m.*")


@query("m11_request_rank", "SELECT user_id, CASE user_id % 4 WHEN 0 THEN 6 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END::INTEGER AS rank FROM (SELECT DISTINCT user_id FROM events)")
def m11(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("queued_self"), F.lit("self"), F.lit("random"), F.lit("else")), (F.col("user_id") % 4 + 1).cast("int"))
    return events(spark, d).select("user_id").distinct().select("user_id", keys.rank_of(kind, keys.REQUEST_RANKS).alias("rank"))


@query("m12_request_source", """SELECT o_orderkey, CASE k WHEN 0 THEN 'random' WHEN 1 THEN 'self' WHEN 2 THEN 'other' WHEN 3 THEN 'random' ELSE 'unknown' END AS source, CASE k WHEN 0 THEN 0.8 WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence
FROM (SELECT o_orderkey, (o_orderkey % 5)::INT AS k FROM orders)""")  # fmt: skip
def m12(spark: SparkSession, d: str) -> DataFrame:
    at = (F.col("o_orderkey") % 5 + 1).cast("int")
    name = F.element_at(F.array(*[F.lit(v) for v in (" Random", "me", "you", "", "named")]), at)
    user = F.element_at(F.array(*[F.lit(v) for v in ("", "usr_1", "usr_2", "", "")]), at)
    return table(spark, d, "orders").select("o_orderkey", keys.request_source(name, user, F.lit("usr_1")).alias("s")).select("o_orderkey", "s.*")


@query("m13_duration_rank", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 ELSE 0 END::INTEGER AS rank FROM orders")
def m13(spark: SparkSession, d: str) -> DataFrame:
    source = F.element_at(F.array(*[F.lit(v) for v in ("wanna_queue_json", "vrcx_payload", "wanna_video_duration", "none")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", keys.rank_of(source, keys.DURATION_RANKS).alias("rank"))


@query("c15_match_words", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def c15(spark: SparkSession, d: str) -> DataFrame:
    """Search terms of a matching batch: the first artist, once per part."""
    return table(spark, d, "part").groupBy(text.search_artist(F.concat("p_brand", F.lit(", x"))).alias("p_brand")).agg(F.count(F.lit(1)).alias("n"))
