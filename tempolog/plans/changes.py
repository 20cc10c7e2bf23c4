"""Merges over the stand-in tables: base and delta slices of orders, customers and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import merges, operations, projection
from ..operators.staging import staged
from .tables import DECISIONS, ORIGINS, RECORDS, decisions, events, origins, query, records, table


def evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    user = F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("usr_"), F.col("o_custkey").cast("string")))
    base = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("evidence_key"), F.col("o_orderstatus").alias("status"), user.alias("requester_user_id"), F.lit(1).alias("updated_at"))
    late = F.when(F.col("o_orderkey") % 4 == 0, F.lit("Z")).otherwise(F.col("o_orderstatus"))
    new = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("evidence_key"), late.alias("status"), F.lit("usr_new").alias("requester_user_id"), F.lit(2).alias("updated_at"))
    return base, new


@query("k4_evidence_merge", """WITH a AS (SELECT o_orderkey AS evidence_key, o_orderstatus AS status, CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'usr_' || o_custkey END AS u FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey AS evidence_key, CASE WHEN o_orderkey % 4 = 0 THEN 'Z' ELSE o_orderstatus END AS status, 'usr_new' AS u FROM orders WHERE o_orderkey % 2 = 0),
m AS (SELECT coalesce(a.evidence_key, b.evidence_key) AS evidence_key, coalesce(b.status, a.status) AS status, CASE WHEN b.evidence_key IS NULL THEN a.u WHEN a.evidence_key IS NULL THEN b.u ELSE coalesce(nullif(a.u, ''), b.u) END AS u,
  a.status AS old_status, a.u AS old_u, a.evidence_key IS NOT NULL AS there, b.evidence_key IS NOT NULL AS came FROM a FULL JOIN b ON a.evidence_key = b.evidence_key)
SELECT evidence_key, status, u AS requester_user_id, CASE WHEN NOT came THEN 1 WHEN NOT there THEN 2 WHEN status = old_status AND u = old_u THEN 1 ELSE 2 END::INTEGER AS updated_at,
  CASE WHEN NOT came THEN 'kept' WHEN NOT there THEN 'inserted' WHEN status = old_status AND u = old_u THEN 'unchanged' ELSE 'updated' END AS action FROM m""")  # fmt: skip
def k4(spark: SparkSession, d: str) -> DataFrame:
    return merges.merge_evidence(*evidence(spark, d))


@query("k5_origin_merge", """WITH b AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k, min(l_returnflag) AS f, min(l_linenumber) AS n FROM lineitem GROUP BY 1)
SELECT k AS origin_key, CASE WHEN n % 2 = 0 THEN f || '!' ELSE f END AS payload, CASE WHEN n % 3 <> 0 THEN 1 ELSE 2 END::INTEGER AS created_at,
  CASE WHEN n % 3 = 0 THEN 'inserted' WHEN n % 2 = 0 THEN 'updated' ELSE 'kept' END AS action FROM b WHERE n % 3 <> 0 OR n % 2 = 0""")  # fmt: skip
def k5(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("origin_key")
    lines = table(spark, d, "lineitem").groupBy(key).agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linenumber").alias("l_linenumber"))
    old = lines.filter("l_linenumber % 3 <> 0").select("origin_key", F.col("l_returnflag").alias("payload"), F.lit(1).alias("created_at"))
    new = lines.filter("l_linenumber % 2 = 0").select("origin_key", F.concat("l_returnflag", F.lit("!")).alias("payload"), F.lit(2).alias("created_at"))
    return merges.merge_origins(old, new)


@query("k6_kept_requester", f"""WITH {ORIGINS}, e AS (SELECT *, CASE WHEN requester_user_id % 3 = 0 THEN '' ELSE 'usr_' || requester_user_id END AS u, CASE WHEN requester_user_id % 2 = 0 THEN origin_table ELSE '' END AS s FROM (SELECT record_id, origin_key, min(origin_table) AS origin_table, min(requester_user_id) AS requester_user_id FROM origins GROUP BY 1, 2)),
ids AS (SELECT record_id, max(nullif(u, '')) AS known_id, arg_min(s, origin_key) FILTER (s <> '') AS first_source FROM e GROUP BY 1)
SELECT e.origin_key, CASE WHEN known_id IS NOT NULL THEN known_id ELSE 'usr_new' END AS requester_user_id, CASE WHEN known_id IS NOT NULL THEN coalesce(nullif(e.s, ''), first_source) ELSE 'new' END AS requester_source FROM e JOIN ids USING (record_id)""")  # fmt: skip
def k6(spark: SparkSession, d: str) -> DataFrame:
    o = origins(spark, d).groupBy("record_id", "origin_key").agg(F.min("origin_table").alias("origin_table"), F.min("requester_user_id").alias("requester_user_id"))
    o = staged(o, "origins")  # read three times below, grouped once
    user, source = F.when(F.col("requester_user_id") % 3 != 0, F.concat(F.lit("usr_"), F.col("requester_user_id").cast("string"))).otherwise(""), F.when(F.col("requester_user_id") % 2 == 0, F.col("origin_table")).otherwise("")
    existing = o.select("record_id", "origin_key", F.col("origin_key").alias("origin_id"), user.alias("requester_user_id"), source.alias("requester_source"))
    new = o.select("record_id", "origin_key", F.lit("usr_new").alias("requester_user_id"), F.lit("new").alias("requester_source"))
    return merges.keep_requester(new, existing).select("origin_key", "requester_user_id", "requester_source")


@query("k7_catalog_merge", """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 2 = 1 THEN c_name ELSE upper(c_mktsegment) END AS title, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN c_nationkey + 1 ELSE c_nationkey END::INTEGER AS players,
  CASE WHEN c_custkey % 2 = 1 THEN 'kept' WHEN c_custkey % 5 = 0 AND c_custkey % 3 <> 0 THEN 'unchanged' ELSE 'updated' END AS action FROM customer""")  # fmt: skip
def k7(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("players"))
    new = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.upper("c_mktsegment")).alias("title"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") + 1).alias("players"))
    return merges.merge_catalog(old, new, "id", plain=("players",))


@query("k8_system_upsert", "SELECT lower(trim(n_name)) AS key, n_name AS name FROM nation UNION ALL SELECT 'extra', 'Extra'")
def k8(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "nation").select(F.lower(F.trim("n_name")).alias("key"), F.col("n_name").alias("name"))
    new = spark.createDataFrame([(" EXTRA ", "Extra")], "key string, name string").withColumn("key", F.lower(F.trim("key")))
    return merges.merge(old, new, "key").select("key", "name")


@query("k9_last_state", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_min(event_id, event_id) FILTER (event_type = 'signup') AS first_signup FROM events GROUP BY 1")
def k9(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("user_id", "event_id", "event_type", F.when(F.col("event_type") == "signup", F.col("event_id").cast("string")).alias("first_signup"))
    found = merges.last_state(e, "user_id", "event_id", keep_first=("first_signup",))
    return found.select("user_id", "event_type", F.col("first_signup").cast("long").alias("first_signup"))


@query("k10_transition", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_custkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderstatus = 'O' AND o_custkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'done' END AS reason FROM orders""")  # fmt: skip
def k10(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise(F.col("o_orderstatus")).alias("status"), F.lit(None).cast("string").alias("reason"), F.when(F.col("o_custkey") % 2 != 0, F.col("o_custkey")).alias("promoted_id"))
    settled = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("completed").alias("status"), F.lit("done").alias("reason"))
    return merges.transition(rows, settled, "id").select("id", "status", "reason")


@query("p9_promotable", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 10 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0")
def p9(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("interrupted").alias("completion_status"), F.col("o_orderdate").alias("actual_play_at"), F.lit("s").alias("system_key"),
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey").cast("string")).otherwise("").alias("external_id"), F.when(k % 7 != 0, 1.0).alias("duration_seconds"), (k % 5 == 0).alias("observed_mid_play"),
    )
    return merges.promotable(rows).select("o_orderkey")


@query("c9_import_history", """WITH h AS (SELECT event_id, user_id, ts, event_id % 4 <> 0 AS known, CASE WHEN user_id % 5 = 0 THEN '' ELSE 'usr_' || user_id % 5 END AS requester FROM events),
n AS (SELECT *, CASE WHEN requester = 'usr_1' THEN 'self' WHEN requester <> '' THEN 'other' ELSE 'random' END AS kind FROM h WHERE known)
SELECT user_id::VARCHAR AS external_id, epoch_us(ts) AS played_us, kind AS request_type, 'accepted' AS default_status, nullif(requester, '') AS requester_user_id, CASE WHEN event_id % 3 = 0 THEN 'unchanged' ELSE 'inserted' END AS action FROM n""")  # fmt: skip
def c9(spark: SparkSession, d: str) -> DataFrame:
    """A history with unsupported rows imported over what an earlier import of every third row left."""
    e = events(spark, d)
    url = F.when(F.col("event_id") % 4 == 0, F.lit("https://example.org/x")).otherwise(F.concat(F.lit("http://api.udon.dance/Api/Songs/play?id="), F.col("user_id").cast("string")))
    user = F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("usr_"), (F.col("user_id") % 5).cast("string")))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    history = e.select(F.col("event_id").alias("id"), stamp.alias("created_at"), url.alias("video_url"), F.lit("n").alias("video_name"), F.lit("").alias("display_name"), user.alias("user_id"))
    first = operations.import_history(history.filter("id % 3 = 0"), None, None, "usr_1")
    done = operations.import_history(history, first.staging, first.evidence, "usr_1")
    return done.evidence.select("external_id", F.unix_micros("played_at").alias("played_us"), "request_type", "default_status", "requester_user_id", "action")


STAGE_RANKS = {"view": 1, "click": 2, "purchase": 3}


@query("k12_staged_precedence", """WITH r AS (SELECT *, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS rank FROM events),
o AS (SELECT user_id, arg_min(struct_pack(t := event_type, v := value, r := rank), event_id) AS s FROM r GROUP BY 1), n AS (SELECT user_id, arg_max(struct_pack(t := event_type, v := value, r := rank), event_id) AS s FROM r GROUP BY 1)
SELECT user_id, CASE WHEN n.s.r > o.s.r OR n.s.r = o.s.r AND n.s.v > o.s.v THEN n.s.t ELSE o.s.t END AS request_type, CASE WHEN n.s.r > o.s.r OR n.s.r = o.s.r AND n.s.v > o.s.v THEN n.s.v ELSE o.s.v END AS confidence FROM o JOIN n USING (user_id)""")  # fmt: skip
def k12(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    pick = F.struct(F.col("event_type").alias("request_type"), F.col("value").alias("confidence"))
    old = e.groupBy("user_id").agg(F.min_by(pick, "event_id").alias("s")).select("user_id", "s.*")
    new = e.groupBy("user_id").agg(F.max_by(pick, "event_id").alias("s")).select("user_id", "s.*")
    return merges.merge_staged(old, new, "user_id", STAGE_RANKS)


@query("k15_favorites", "SELECT c_custkey, c_nationkey = 3 AND c_custkey % 4 = 0 OR c_nationkey <> 3 AND c_mktsegment = 'BUILDING' AS favorite FROM customer")
def k15(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("system_key"), F.col("c_custkey").cast("string").alias("external_id"), (F.col("c_mktsegment") == "BUILDING").alias("favorite"))
    listed = c.filter("system_key = '3' and c_custkey % 4 = 0").select("external_id")
    return merges.set_favorites(c, listed, "3").select("c_custkey", "favorite")


@query("k16_decision_log", f"WITH {DECISIONS} SELECT record_id, CASE WHEN record_id % 3 = 0 THEN NULL WHEN record_id % 3 = 1 THEN 'needs_attention' ELSE decision END AS decision FROM decisions WHERE record_id % 3 <> 0")
def k16(spark: SparkSession, d: str) -> DataFrame:
    """Later entries of the log win; an entry without status clears."""
    first = decisions(spark, d).filter("record_id > 0")
    log = first.select("record_id", "decision", F.lit(1).alias("decided_at"), F.col("record_id").alias("decision_id"))
    later = first.filter("record_id % 3 <> 2").select("record_id", F.when(F.col("record_id") % 3 == 1, "needs_attention").alias("decision"), F.lit(2).alias("decided_at"), F.col("record_id").alias("decision_id"))
    return projection.active_decisions(projection.decide(log, later))


@query("k17_review", f"WITH {RECORDS}, {DECISIONS} SELECT record_id, 'excluded' AS effective_status FROM records WHERE record_id % 100 = 7")
def k17(spark: SparkSession, d: str) -> DataFrame:
    log = decisions(spark, d).select("record_id", "decision", F.lit(1).alias("decided_at"), F.col("record_id").alias("decision_id"))
    r = records(spark, d)
    new = r.filter("record_id % 100 = 7").select("record_id", F.lit("excluded").alias("decision"), F.lit(2).alias("decided_at"), F.col("record_id").alias("decision_id"))
    return projection.review(r, log, new).select("record_id", "effective_status")


@query("k18_repair", f"""WITH {RECORDS}, {ORIGINS}, s AS (SELECT record_id FROM records WHERE default_status = 'pending' AND evidence_source = 'vrc_log_live' AND record_id IN (SELECT record_id FROM origins WHERE origin_table = 'watcher_playback_events'))
SELECT record_id, CASE WHEN s.record_id IS NOT NULL THEN 'needs_attention' ELSE default_status END AS default_status, CASE WHEN s.record_id IS NOT NULL THEN 'interrupted' END AS observation_status FROM records LEFT JOIN s USING (record_id)""")  # fmt: skip
def k18(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    r = records(spark, d).withColumns({"observation_status": none, "observation_reason": none})
    return merges.settle_stale(r, origins(spark, d), projection.LIVE_SOURCE, "watcher_playback_events").select("record_id", "default_status", "observation_status")


@query("k19_unique_keys", """SELECT o_orderkey, CASE WHEN k = 1 THEN sha256(o_custkey::VARCHAR) ELSE sha256(o_custkey || chr(31) || k) END AS event_key FROM (
  SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)""")  # fmt: skip
def k19(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("base_key"))
    return merges.unique_keys(o, [F.col("o_orderkey")]).select("o_orderkey", "event_key")


@query("k23_no_downgrade", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o IN ('self', 'other', 'random') AND ro >= rn THEN o ELSE n END AS request_type FROM (
  SELECT o_orderkey, o, n, CASE o WHEN 'self' THEN 4 WHEN 'other' THEN 3 WHEN 'random' THEN 2 ELSE 0 END AS ro, CASE n WHEN 'self' THEN 4 WHEN 'other' THEN 3 WHEN 'random' THEN 2 ELSE 0 END AS rn FROM (
  SELECT o_orderkey, ['self', 'other', 'random', ''][(o_custkey % 4 + 1)::INT] AS o, ['random', 'self', 'other'][(o_orderkey % 3 + 1)::INT] AS n FROM orders))""")  # fmt: skip
def k23(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")

    def pick(values: tuple[str, ...], at):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))

    old = o.filter("o_orderkey % 2 = 0").select("o_orderkey", pick(("self", "other", "random", ""), F.col("o_custkey") % 4).alias("request_type"))
    new = o.select("o_orderkey", pick(("random", "self", "other"), F.col("o_orderkey") % 3).alias("request_type"))
    return merges.keep_higher_request(old, new, "o_orderkey")


@query("k24_missing_stubs", """SELECT n AS system_key, id AS external_id, min(nullif(v, '')) AS title, CASE n WHEN 'wannadance' THEN 'add_from_cache_or_stub' WHEN 'dudu' THEN 'add_stub' ELSE 'skip' END AS action FROM (
  SELECT ['wannadance', 'dudu', 'x'][(o_custkey % 3 + 1)::INT] AS n, o_custkey::VARCHAR AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'v' || o_orderkey ELSE '' END AS v, o_custkey FROM orders) WHERE o_custkey % 5 = 0 GROUP BY 1, 2""")  # fmt: skip
def k24(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    system = F.element_at(F.array(F.lit("wannadance"), F.lit("dudu"), F.lit("x")), (F.col("o_custkey") % 3 + 1).cast("int"))
    named = o.select(system.alias("system_key"), F.col("o_custkey").cast("string").alias("external_id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("v"), F.col("o_orderkey").cast("string"))).otherwise("").alias("video_name"))
    have = named.filter("cast(external_id as long) % 5 <> 0").select("system_key", "external_id").distinct()
    return merges.missing_stubs(named, have)


@query("k25_resume", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def k25(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return merges.remaining(table(spark, d, "customer").select("c_custkey"), done, "c_custkey")


@query("k13_catalog_bulk", "SELECT c_custkey AS song, sha256(lower(c_name) || chr(31) || lower(c_mktsegment)) AS music_key FROM customer")
def k13(spark: SparkSession, d: str) -> DataFrame:
    """Songs with the key of the music they play: one row per song, keys by title and artist."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("song"), keys.hash_key(F.lower("c_name"), F.lower("c_mktsegment")).alias("music_key"))


@query("k14_music_links", "SELECT count(*) AS songs, count(DISTINCT lower(c_mktsegment)) AS musics FROM customer")
def k14(spark: SparkSession, d: str) -> DataFrame:
    """Songs and the distinct musics that they link to, after a merge of the links on both keys."""
    links = table(spark, d, "customer").select(F.concat_ws("-", "c_custkey", F.lower("c_mktsegment")).alias("link"), F.lower("c_mktsegment").alias("music"))
    merged = merges.merge(links, links.filter(F.col("music") == "building"), "link")
    return merged.agg(F.count(F.lit(1)).alias("songs"), F.countDistinct("music").alias("musics"))
