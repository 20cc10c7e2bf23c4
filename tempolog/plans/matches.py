"""Matching, windows and differences between sources and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, timestamps, urls
from ..operators import audits, diffs, matching
from .tables import ORIGINS, PROJECTED, RECORDS, events, origins, projected, query, records, table

E_SQL = "p AS (SELECT user_id, event_id AS p_id, ts AS p_ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, event_id AS c_id, ts AS c_ts FROM events WHERE event_type = 'click')"
GAP = "(epoch_us(p_ts) - epoch_us(c_ts)) / 1e6"
WINDOWS = (600, 3600, 14400)


def kinds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, d)
    p = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("p_id"), F.col("ts").alias("p_ts"))
    return p, e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("c_id"), F.col("ts").alias("c_ts"))


@query("j10_hash_merge", """SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NOT NULL THEN b.name ELSE a.name END AS name FROM
  (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN
  (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE upper(c_mktsegment) END AS name FROM customer WHERE c_custkey % 2 = 0) b ON a.id = b.id""")  # fmt: skip
def j10(spark: SparkSession, d: str) -> DataFrame:
    """Two keyed catalogs: what the second has wins, even where it is blank."""
    c = table(spark, d, "customer")
    a = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("a_name"))
    b = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.upper("c_mktsegment")).alias("b_name"))
    return a.join(b, "id", "full_outer").select("id", F.coalesce("b_name", "a_name").alias("name"))


@query("j11_planned_in_day", f"""WITH {PROJECTED}, plan AS (SELECT c_custkey AS track_id, DATE '1995-01-01' + (c_custkey % 2000)::INT AS day FROM customer)
SELECT track_id, (SELECT count(*) FROM projected r WHERE r.track_id = plan.track_id AND effective_status = 'accepted' AND r.played_at >= plan.day + INTERVAL 270 MINUTE
  AND r.played_at < plan.day + INTERVAL 90 DAY + INTERVAL 270 MINUTE) AS n FROM plan""")  # fmt: skip
def j11(spark: SparkSession, d: str) -> DataFrame:
    """How many accepted plays a planned entry's span of days holds: equi-join with a range."""
    plan = table(spark, d, "customer").select(F.col("c_custkey").alias("track_id"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int")).cast("timestamp").alias("day"))
    start = F.col("day") + F.expr("INTERVAL 270 MINUTE")
    plays = projected(spark, d).filter("effective_status = 'accepted'").select(F.col("track_id").alias("played"), "played_at")
    joined = plan.join(plays, (F.col("track_id") == F.col("played")) & (F.col("played_at") >= start) & (F.col("played_at") < start + F.expr("INTERVAL 90 DAY")), "left")
    return joined.groupBy("track_id").agg(F.count("played").alias("n"))


@query("j12_near_pairs", """SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id
  AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000""")  # fmt: skip
def j12(spark: SparkSession, d: str) -> DataFrame:
    return matching.self_pairs(events(spark, d), ["user_id"], "event_id", "ts", 600, bucket_seconds=3600).select("left_id", "right_id")


@query("j13_window_join", f"""WITH {E_SQL}, n AS (SELECT p_id, w, count(c_id) AS k FROM p CROSS JOIN (VALUES (600), (3600), (14400)) v(w)
  LEFT JOIN c ON c.user_id = p.user_id AND {GAP} BETWEEN 0 AND w GROUP BY 1, 2)
SELECT w AS "window", count(*) AS "rows", count(*) FILTER (k > 0) AS matched, count(*) FILTER (k = 1) AS unique_matched FROM n GROUP BY 1""")  # fmt: skip
def j13(spark: SparkSession, d: str) -> DataFrame:
    p, c = kinds(spark, d)
    return matching.windows_hit(p, c, ["user_id"], "p_ts", "c_ts", "p_id", WINDOWS)


@query("j14_nearest", f"""WITH {E_SQL} SELECT p_id, c_id, round(abs({GAP}), 3) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY p_id ORDER BY abs(epoch_us(p_ts) - epoch_us(c_ts)), c_id) AS k
  FROM p JOIN c USING (user_id) WHERE abs(epoch_us(p_ts) - epoch_us(c_ts)) <= 7200000000) WHERE k = 1""")  # fmt: skip
def j14(spark: SparkSession, d: str) -> DataFrame:
    p, c = kinds(spark, d)
    pairs = matching.near_pairs(p, c, ["user_id"], "p_ts", "c_ts", 7200, bucket_seconds=7200)
    return matching.nearest(pairs, "p_id", ["c_id"], ["c_id"]).select("p_id", "c_id", F.round("best_gap", 3).alias("gap"))


@query("j15_as_of", f"WITH {E_SQL} SELECT p_id, c_id FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.p_ts >= c.c_ts")
def j15(spark: SparkSession, d: str) -> DataFrame:
    p, c = kinds(spark, d)
    found = matching.last_before(p.withColumnRenamed("p_ts", "at"), c.withColumnRenamed("c_ts", "at"), "user_id", "at", "c_id")
    return found.select("p_id", F.col("c_id").cast("long").alias("c_id"))


@query("j16_exact_anchor", """WITH a AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus <> 'F'),
a1 AS (SELECT * FROM a QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderdate) = 1), b1 AS (SELECT * FROM b QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderdate) = 1)
SELECT a1.o_orderkey AS left_id, b1.o_orderkey AS right_id FROM a1 JOIN b1 USING (o_custkey, o_orderdate)""")  # fmt: skip
def j16(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    left = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("left_id"), "o_custkey", "o_orderdate")
    right = o.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("right_id"), "o_custkey", "o_orderdate")
    return matching.exact_anchor(left, right, ["o_custkey", "o_orderdate"]).select("left_id", "right_id")


@query("j17_unique_both_ways", f"""WITH {E_SQL}, m AS (SELECT DISTINCT p_id, c_id FROM p JOIN c USING (user_id) WHERE {GAP} BETWEEN 0 AND 7200)
SELECT p_id, c_id FROM m QUALIFY count(*) OVER (PARTITION BY p_id) = 1 AND count(*) OVER (PARTITION BY c_id) = 1""")  # fmt: skip
def j17(spark: SparkSession, d: str) -> DataFrame:
    p, c = kinds(spark, d)
    return matching.unique_both_ways(matching.near_pairs(p, c, ["user_id"], "p_ts", "c_ts", 7200, after_only=True), "p_id", "c_id")


@query("j18_tolerance_exists", f"WITH {E_SQL} SELECT p_id FROM p WHERE EXISTS (SELECT 1 FROM c WHERE c.user_id = p.user_id AND abs(epoch_us(p_ts) - epoch_us(c_ts)) <= 900000000)")
def j18(spark: SparkSession, d: str) -> DataFrame:
    p, c = kinds(spark, d)
    return matching.has_near(p, c, ["user_id"], "p_id", "p_ts", "c_ts", 900).select("p_id")


def runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over orders: the second lacks some rows, has others, and changed some."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    new = o.filter("o_orderkey % 11 <> 0").withColumns({
        "o_orderstatus": F.when(F.col("o_orderkey") % 4 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")),
        "o_orderpriority": F.when(F.col("o_orderkey") % 6 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")), "o_custkey": F.col("o_custkey") + 1,
    })
    return o.filter("o_orderkey % 13 <> 0"), new


RUNS = """a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0),
b AS (SELECT o_orderkey, o_custkey + 1 AS o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 11 <> 0),
diff AS (SELECT * FROM (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed'
    WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'changed' END AS change,
    CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'o_orderpriority' END,
      CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END) END AS fields
  FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) WHERE change IS NOT NULL)"""


@query("j19_keyed_diff", f"WITH {RUNS} SELECT o_orderkey, change, fields FROM diff")
def j19(spark: SparkSession, d: str) -> DataFrame:
    return diffs.keyed_diff(*runs(spark, d), "o_orderkey", volatile=("o_custkey",))


@query("j20_ordinal_diff", f"""WITH {RUNS}, x AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS k, o_orderstatus AS s FROM a), y AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS k, o_orderstatus AS s FROM b)
SELECT * FROM (SELECT coalesce(x.k, y.k) AS ordinal, CASE WHEN x.k IS NULL THEN 'added' WHEN y.k IS NULL THEN 'removed' WHEN x.s IS DISTINCT FROM y.s THEN 'changed' END AS change FROM x FULL JOIN y ON x.k = y.k) WHERE change IS NOT NULL""")  # fmt: skip
def j20(spark: SparkSession, d: str) -> DataFrame:
    found = diffs.ordinal_diff(*runs(spark, d), ["o_orderkey"], ["o_orderstatus"])
    return found.select(F.col("ordinal").cast("long").alias("ordinal"), "change")


@query("j21_set_compare", """WITH a AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s, arg_max(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1),
b AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s, arg_max(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT count(*) FILTER (a.o_custkey IS NOT NULL AND b.o_custkey IS NOT NULL) AS in_both, count(*) FILTER (b.o_custkey IS NULL) AS left_only, count(*) FILTER (a.o_custkey IS NULL) AS right_only,
  count(*) FILTER (a.o_custkey IS NOT NULL AND b.o_custkey IS NOT NULL AND a.s IS DISTINCT FROM b.s) AS o_orderstatus_differs,
  count(*) FILTER (a.o_custkey IS NOT NULL AND b.o_custkey IS NOT NULL AND a.p IS DISTINCT FROM b.p) AS o_orderpriority_differs FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")  # fmt: skip
def j21(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return diffs.set_compare(o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 2 = 0"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"], "o_orderkey")


@query("j25_three_key_probe", f"""WITH {E_SQL}, room AS (SELECT p_id, p.user_id, c_id FROM p ASOF JOIN c ON p.user_id = c.user_id AND p.p_ts >= c.c_ts)
SELECT room.p_id, e.event_id FROM room JOIN events e ON e.user_id = room.user_id AND e.event_id = room.c_id AND e.event_type = 'click' WHERE e.value >= 20""")  # fmt: skip
def j25(spark: SparkSession, d: str) -> DataFrame:
    """As-of value first, then an equi-join on it with user and kind."""
    room = j15(spark, d).filter("c_id is not null").join(events(spark, d).select(F.col("event_id").alias("p_id"), "user_id"), "p_id")
    e = events(spark, d).filter("event_type = 'click' and value >= 20").select("user_id", "event_id")
    return room.join(e, (room["user_id"] == e["user_id"]) & (room["c_id"] == e["event_id"])).select("p_id", "event_id")


@query("j26_consumed_trace", """SELECT a.event_id, b.event_type IS NOT NULL AND a.k IS NOT DISTINCT FROM b.k AS agrees FROM (SELECT event_id, user_id, event_id // 2 AS line, event_id % 3 AS k FROM events WHERE event_type <> 'error') a
  LEFT JOIN (SELECT user_id, event_id // 2 AS line, event_type, CASE WHEN event_id % 5 <> 0 THEN event_id % 3 END AS k FROM events WHERE event_type = 'error') b ON a.user_id = b.user_id AND a.line = b.line""")  # fmt: skip
def j26(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", F.col("user_id").alias("file"), F.floor(F.col("event_id") / 2).alias("line"), "event_type", (F.col("event_id") % 3).alias("location"))
    marks = e.filter("event_type = 'error'").select("file", "line", F.col("event_type").alias("marker"), F.when(F.col("event_id") % 5 != 0, F.col("location")).alias("location"))
    return matching.trace(e.filter("event_type <> 'error'"), marks).select("event_id", "agrees")


# --- windows -----------------------------------------------------------------------------------------


@query("w1_gaps", """WITH g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events)
SELECT l AS "limit", count(*) FILTER (gap <= l) AS n FROM g CROSS JOIN (VALUES (60), (600), (3600)) v(l) GROUP BY 1""")  # fmt: skip
def w1(spark: SparkSession, d: str) -> DataFrame:
    return matching.gap_counts(events(spark, d), ["user_id"], "ts", "event_id", (60, 600, 3600))


@query("w2_occurrence_number", "SELECT event_id, user_id || '#' || greatest(1, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS occurrence FROM events")
def w2(spark: SparkSession, d: str) -> DataFrame:
    past = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    number = F.greatest(F.lit(1), F.sum((F.col("event_type") == "signup").cast("int")).over(past))
    return events(spark, d).select("event_id", F.concat(F.col("user_id").cast("string"), F.lit("#"), number.cast("string")).alias("occurrence"))


@query("w3_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context FROM events")
def w3(spark: SparkSession, d: str) -> DataFrame:
    past = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, d).select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(past).alias("context"))


@query("w4_section_ordinal", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, s ORDER BY turn) AS ordinal FROM (SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations)")
def w4(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn")).alias("s"))
    return c.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id", "s").orderBy("turn")).cast("long").alias("ordinal"))


@query("w5_monotone_clock", "SELECT event_id, epoch_us(max(ts) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING)) AS clock_us FROM events")
def w5(spark: SparkSession, d: str) -> DataFrame:
    """A running maximum over rows in another order: late stamps do not turn the clock back."""
    seen = Window.partitionBy("user_id").orderBy("value", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, d).select("event_id", F.unix_micros(F.max("ts").over(seen)).alias("clock_us"))


@query("w6_byte_budget", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 2000")
def w6(spark: SparkSession, d: str) -> DataFrame:
    """The last turns of a conversation that fit a budget of bytes."""
    used = F.sum(F.octet_length("text")).over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, d, "conversations").select("conv_id", "turn", used.alias("used")).filter("used <= 2000").select("conv_id", "turn")


@query("w7_first_wins", "SELECT c_mktsegment, c_nationkey, min(c_custkey) AS first FROM customer GROUP BY 1, 2")
def w7(spark: SparkSession, d: str) -> DataFrame:
    first = Window.partitionBy("c_mktsegment", "c_nationkey").orderBy("c_custkey")
    rows = table(spark, d, "customer").withColumn("k", F.row_number().over(first)).filter("k = 1")
    return rows.select("c_mktsegment", "c_nationkey", F.col("c_custkey").alias("first"))


@query("w8_superseded_by", """SELECT event_id, (SELECT min(b.event_id) FROM events b WHERE b.user_id % 10 = a.user_id % 10 AND b.event_type = 'purchase' AND b.event_id > a.event_id AND b.user_id <> a.user_id) AS next
FROM events a WHERE event_type = 'purchase'""")  # fmt: skip
def w8(spark: SparkSession, d: str) -> DataFrame:
    """The next start by another key in the session: of the next start and the first start after this key's run."""
    e = events(spark, d).filter("event_type = 'purchase'").withColumn("session", F.col("user_id") % 10)
    return matching.next_other(e, "session", "event_id", "user_id", "next").select("event_id", "next")


# --- profiles ----------------------------------------------------------------------------------------


@query("a6_delays", f"""WITH {E_SQL}, n AS (SELECT p_id, round({GAP}, 3) AS delay FROM p ASOF JOIN c ON p.user_id = c.user_id AND p.p_ts >= c.c_ts)
SELECT count(*) AS n, round(min(delay), 3) AS least, round(max(delay), 3) AS most, round(avg(delay), 3) AS mean FROM n""")  # fmt: skip
def a6(spark: SparkSession, d: str) -> DataFrame:
    p, c = kinds(spark, d)
    found = matching.last_before(p.withColumn("at", F.col("p_ts")), c.withColumn("at", F.col("c_ts")).withColumn("c_us", F.unix_micros("c_ts")), "user_id", "at", "c_us").filter("c_us is not null")
    delay = F.round((F.unix_micros("p_ts") - F.col("c_us").cast("long")) / 1e6, 3)
    return found.select(delay.alias("delay")).agg(F.count("delay").alias("n"), F.round(F.min("delay"), 3).alias("least"), F.round(F.max("delay"), 3).alias("most"), F.round(F.avg("delay"), 3).alias("mean"))


@query("a12_histograms", f"WITH {RECORDS} SELECT 'default_status' AS kind, default_status AS value, count(*) AS n FROM records GROUP BY 2 UNION ALL SELECT 'request_type', request_type, count(*) FROM records GROUP BY 2 UNION ALL SELECT 'evidence_source', evidence_source, count(*) FROM records GROUP BY 2")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return diffs.histograms(records(spark, d), ["default_status", "request_type", "evidence_source"])


@query("a13_surplus", "SELECT count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS surplus FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return diffs.duplicate_surplus(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a14_distinct_missing", f"WITH {RECORDS} SELECT evidence_source, count(DISTINCT external_id) AS missing FROM records WHERE track_id IS NULL GROUP BY 1")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).filter("track_id is null").groupBy("evidence_source").agg(F.countDistinct("external_id").alias("missing"))


@query("a15_pair_outcomes", f"""WITH {RUNS} SELECT CASE WHEN l IS NULL AND r IS NULL THEN 'both_missing' WHEN l IS NULL OR r IS NULL THEN 'one_missing' WHEN l = r THEN 'equal' ELSE 'different' END AS outcome, count(*) AS n
FROM (SELECT nullif(a.o_orderstatus, 'O') AS l, b.o_orderstatus AS r FROM a JOIN b USING (o_orderkey)) GROUP BY 1""")  # fmt: skip
def a15(spark: SparkSession, d: str) -> DataFrame:
    a, b = runs(spark, d)
    pairs = a.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")).alias("l")).join(b.select("o_orderkey", F.col("o_orderstatus").alias("r")), "o_orderkey")
    return diffs.pair_outcomes(pairs, "l", "r")


@query("a16_profile", f"WITH {RECORDS} SELECT count(*) AS n, epoch_us(min(played_at)) AS first, epoch_us(max(played_at)) AS last, count(*) FILTER (track_id IS NULL) AS track_id_missing, count(*) FILTER (request_type = '') AS request_type_missing FROM records")
def a16(spark: SparkSession, d: str) -> DataFrame:
    found = diffs.profile(records(spark, d), "played_at", ["track_id", "request_type"])
    return found.withColumns({"first": F.unix_micros("first"), "last": F.unix_micros("last")})


@query("a17_changed_fields", f"WITH {RUNS} SELECT unnest(string_split(fields, ',')) AS field, count(*) AS n FROM diff WHERE change = 'changed' GROUP BY 1")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return diffs.changed_fields(j19(spark, d))


@query("a18_coverage", f"WITH {RECORDS} SELECT evidence_source, round(CASE WHEN count(*) = 0 THEN 1.0 ELSE count(track_id)::DOUBLE / count(*) END, 6) AS coverage FROM records GROUP BY 1")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("evidence_source").agg(F.round(diffs.share(F.count("track_id"), F.count(F.lit(1))), 6).alias("coverage"))


@query("a20_buckets", "SELECT CASE WHEN p_size <= 20 THEN '0-20' WHEN p_size <= 40 THEN '21-40' WHEN p_size <= 60 THEN '41-60' WHEN p_size <= 80 THEN '61-80' ELSE '81-100' END AS bucket, count(*) AS n, min(p_size) AS least, max(p_size) AS most FROM part GROUP BY 1")
def a20(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    bucket = F.when(s <= 20, "0-20").when(s <= 40, "21-40").when(s <= 60, "41-60").when(s <= 80, "61-80").otherwise("81-100")
    return table(spark, d, "part").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("least"), F.max("p_size").alias("most"))


@query("a21_catalog_delta", "SELECT n_name AS system, count(c_custkey) FILTER (c_custkey % 7 = 0) AS inserted, count(c_custkey) AS total FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def a21(spark: SparkSession, d: str) -> DataFrame:
    """Songs per system after a sync, and how many the catalog lacked before it."""
    after = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    new = after.join(after.filter("c_custkey % 7 <> 0").select("c_custkey"), "c_custkey", "left_anti").select(F.col("c_custkey").alias("fresh"))
    joined = table(spark, d, "nation").join(after, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(new, F.col("c_custkey") == F.col("fresh"), "left")
    return joined.groupBy(F.col("n_name").alias("system")).agg(F.count("fresh").alias("inserted"), F.count("c_custkey").alias("total"))


@query("a22_import_stats", f"WITH {RECORDS} SELECT count(*) AS scanned, count(*) FILTER (track_id IS NULL) AS skipped, count(*) FILTER (track_id IS NOT NULL AND record_id % 2 = 0) AS changed FROM records")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("track_id").isNull()).alias("skipped"), F.count_if(F.col("track_id").isNotNull() & (F.col("record_id") % 2 == 0)).alias("changed"))


@query("a23_id_preserved", f"""WITH {RECORDS}, {ORIGINS} SELECT r.record_id, r.record_id % 4 = 0 OR coalesce(list_contains(ids, w), false) AS preserved
FROM (SELECT record_id, 1 + record_id % 100 AS w FROM records) r LEFT JOIN (SELECT record_id, list(requester_user_id) AS ids FROM origins GROUP BY 1) o USING (record_id)""")  # fmt: skip
def a23(spark: SparkSession, d: str) -> DataFrame:
    wanted = records(spark, d).select("record_id", F.when(F.col("record_id") % 4 != 0, 1 + F.col("record_id") % 100).alias("requester_user_id"))
    return diffs.id_preserved(wanted, origins(spark, d))


@query("a24_versions", "SELECT count(*) AS versions, count(*) FILTER (n > 1) AS reused, max(n) AS most FROM (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)")
def a24(spark: SparkSession, d: str) -> DataFrame:
    return diffs.versions_per_event(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query("a25_warning_kinds", """SELECT CASE user_id % 5 WHEN 0 THEN 'missing-room-context' WHEN 1 THEN 'expired-deferred-backfill' WHEN 2 THEN 'expired-session-end-backfill' WHEN 3 THEN 'expired-lookup' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1""")
def a25(spark: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x in ("no active room context", "mapping after grace window", "from expired mapping at session end", "used expired mapping", "else")]), (F.col("user_id") % 5 + 1).cast("int"))
    return events(spark, d).groupBy(text.warning_kind(said).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# --- contract ----------------------------------------------------------------------------------------


def contract_rows(rows: DataFrame) -> DataFrame:
    """Source rows with the song that a strict reading of the URL names, and why a row is set aside if it is."""
    key = urls.contract_key(F.col("video_url"))
    reason = F.when(key.isNull(), urls.deferred_reason(F.col("video_url"))).when(~timestamps.has_explicit_offset(F.col("created_at")), "invalid_or_timezone_missing_time")
    return rows.withColumns({"song": key, "reason": reason})


def contract_report(rows: DataFrame, optional: list[str]) -> DataFrame:
    """One row: source rows, eligible ones, their percentage, and eligible rows lost if a field were required."""
    eligible = F.col("reason").isNull()
    lost = [F.count_if(eligible & (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")).alias(f"lost_{c}") for c in optional]
    return rows.agg(F.count(F.lit(1)).alias("source_rows"), F.count_if(eligible).alias("eligible"), F.round(100 * F.count_if(eligible) / F.nullif(F.count(F.lit(1)), F.lit(0)), 4).alias("percent"), *lost)


def contract_source(spark: SparkSession, d: str) -> DataFrame:
    """Source rows made from pages: some with URLs of the contract, some that only come near."""
    p = table(spark, d, "pages").select("page_id", "url")
    i = F.col("page_id").cast("string")
    made = (
        F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("http://api.udon.dance/Api/Songs/play?id="), i)).when(F.col("page_id") % 6 == 1, F.concat(F.lit("https://api.dudufit.dance/api/v1/videos/"), i))
        .when(F.col("page_id") % 6 == 2, F.concat(F.lit("https://api.pypy.dance/video?id="), i, F.lit("&id=3"))).when(F.col("page_id") % 6 == 3, F.concat(F.lit("https://jd.pypy.moe/api/v1/videos/"), i, F.lit(".mp4")))
        .when(F.col("page_id") % 6 == 4, F.concat(F.lit("http://139.196.46.195:51886/Api/Songs/play?id="), i)).otherwise(F.col("url"))
    )
    stamp = F.when(F.col("page_id") % 5 == 0, "2024-01-02 03:04:05").otherwise("2024-01-02T03:04:05Z")
    return p.select("page_id", made.alias("video_url"), stamp.alias("created_at"), F.when(F.col("page_id") % 4 != 0, F.lit("x")).alias("location"))


CONTRACT_SQL = """made AS (SELECT page_id, page_id % 6 AS k, page_id % 5 = 0 AS bad, page_id % 4 = 0 AS gone FROM pages),
judged AS (SELECT *, CASE WHEN page_id = 0 THEN NULL WHEN k = 0 THEN 'wannadance:' || page_id WHEN k = 1 THEN 'dudu:' || page_id WHEN k = 3 THEN 'pypydance:' || page_id END AS song,
  CASE WHEN page_id > 0 AND k IN (0, 1, 3) THEN CASE WHEN bad THEN 'invalid_or_timezone_missing_time' END WHEN k = 4 THEN 'unverified_ip_alias' ELSE 'unsupported_other' END AS reason FROM made)"""


@query("p14_contract", f"WITH {CONTRACT_SQL} SELECT page_id, song, reason FROM judged")
def p14(spark: SparkSession, d: str) -> DataFrame:
    return contract_rows(contract_source(spark, d)).select("page_id", "song", "reason")


@query("a19_contract_report", f"WITH {CONTRACT_SQL} SELECT count(*) AS source_rows, count(*) FILTER (reason IS NULL) AS eligible, round(100.0 * count(*) FILTER (reason IS NULL) / count(*), 4) AS percent, count(*) FILTER (reason IS NULL AND gone) AS lost_location FROM judged")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return contract_report(contract_rows(contract_source(spark, d)), ["location"])


@query("c14_deferred_reasons", f"WITH {CONTRACT_SQL} SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY 1")
def c14(spark: SparkSession, d: str) -> DataFrame:
    return contract_rows(contract_source(spark, d)).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("p15_reasons", "SELECT o_orderkey, concat_ws('+', CASE WHEN o_orderstatus = 'O' THEN 'missing_actual_play' END, CASE WHEN o_custkey % 10 = 0 THEN 'missing_identity' END) AS reasons FROM orders")
def p15(spark: SparkSession, d: str) -> DataFrame:
    found = diffs.reasons(missing_actual_play=F.col("o_orderstatus") == "O", missing_identity=F.col("o_custkey") % 10 == 0)
    return table(spark, d, "orders").select("o_orderkey", found.alias("reasons"))


@query("c12_merge_audit", f"""WITH {E_SQL}, v AS (SELECT user_id, event_id AS c_id, ts AS c_ts FROM events WHERE event_type = 'view'), truth AS (SELECT p_id, arg_max(c_id, (c_ts, c_id)) AS true_id FROM p JOIN c USING (user_id) WHERE c_id % 3 <> 0 AND c_ts <= p_ts GROUP BY 1),
base AS (SELECT p_id, c_id, {GAP} AS gap, 'clicks' AS source FROM p JOIN c USING (user_id) WHERE {GAP} BETWEEN 0 AND 14400), g AS (SELECT * FROM base UNION ALL SELECT p_id, c_id, {GAP}, 'views' FROM p JOIN v USING (user_id) WHERE {GAP} BETWEEN 0 AND 14400),
seen AS (SELECT stage, w AS "window", p_id, c_id, gap FROM g, (VALUES ('baseline'), ('extended')) s(stage), (VALUES (600), (3600), (14400)) x(w) WHERE gap <= w AND (stage = 'extended' OR source = 'clicks')),
l AS (SELECT stage, "window", p_id, count(*) AS n, arg_min(c_id, (gap, c_id)) AS nearest, min(c_id) AS one, max((c_id = true_id)::INT) AS found, any_value(true_id) AS true_id FROM seen LEFT JOIN truth USING (p_id) GROUP BY 1, 2, 3),
r AS (SELECT stage, "window", c_id, count(*) AS n FROM seen GROUP BY 1, 2, 3)
SELECT l.stage, l."window", sum(l.n)::BIGINT AS candidates, count(*) AS left_matched, count(true_id) AS with_truth, count(*) FILTER (found = 1) AS truth_in_window, count(*) FILTER (true_id IS NOT NULL AND l.n = 1) AS single, count(*) FILTER (true_id IS NOT NULL AND l.n > 1) AS several,
  count(*) FILTER (nearest = true_id) AS nearest_right, count(*) FILTER (nearest <> true_id) AS nearest_wrong, (SELECT count(*) FROM r WHERE r.stage = l.stage AND r."window" = l."window") AS right_matched,
  count(*) FILTER (l.n = 1 AND EXISTS (SELECT 1 FROM r WHERE r.stage = l.stage AND r."window" = l."window" AND r.c_id = l.one AND r.n = 1)) AS unique_pairs FROM l GROUP BY 1, 2""")  # fmt: skip
def c12(spark: SparkSession, d: str) -> DataFrame:
    """Purchases against clicks, then against views too: what each input explains, and how often the nearest candidate is the known one."""
    p, c = kinds(spark, d)
    left = p.select("user_id", F.col("p_id").alias("left_id"), F.col("p_ts").alias("left_time"))
    clicks = c.select("user_id", F.col("c_id").alias("right_id"), F.col("c_ts").alias("right_time"))
    views = events(spark, d).filter("event_type = 'view'").select("user_id", F.col("event_id").alias("right_id"), F.col("ts").alias("right_time"))
    marks = clicks.filter("right_id % 3 <> 0").select("user_id", F.col("right_time").alias("left_time"), F.col("right_id").alias("true_id"))
    truth = matching.last_before(left, marks, "user_id", "left_time", "true_id").select("left_id", F.col("true_id").cast("long").alias("true_id")).filter("true_id is not null")
    graph = audits.candidate_graph(left, clicks, ["user_id"], max(WINDOWS), "clicks")
    whole = audits.extended(graph, left, views, ["user_id"], max(WINDOWS), "views")
    return audits.merge_audit(whole, truth, WINDOWS, {"baseline": ["clicks"], "extended": ["clicks", "views"]})


@query("c13_duplicates", """WITH e AS (SELECT event_id AS record_id, user_id AS key, ts AS t, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS p FROM events),
b AS (SELECT *, coalesce(epoch_us(t) - epoch_us(lag(t) OVER w) > 21600000000, true) AS begins FROM e WINDOW w AS (PARTITION BY key ORDER BY t, record_id)),
n AS (SELECT *, sum(begins::INT) OVER (PARTITION BY key ORDER BY t, record_id) AS cluster FROM b), g AS (SELECT *, count(*) OVER k AS size, first_value(record_id) OVER (PARTITION BY key, cluster ORDER BY p, t, record_id) AS survivor_id FROM n WINDOW k AS (PARTITION BY key, cluster))
SELECT record_id, cluster::BIGINT AS cluster, size, survivor_id, CASE WHEN record_id = survivor_id THEN 'keep' ELSE 'merge' END AS action FROM g""")  # fmt: skip
def c13_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user that follow one another within six hours, and which of them stays."""
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    records = events(spark, d).select(F.col("event_id").alias("record_id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp_ntz").alias("at"), rank.alias("p"))
    return audits.interval_clusters(records, 6 * 3600, [F.col("p")])


@query("c11_run_compare", f"WITH {RUNS} SELECT change, count(*) AS n FROM diff GROUP BY 1")
def c11(spark: SparkSession, d: str) -> DataFrame:
    return j19(spark, d).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("c13_cleanup_preview", """SELECT coalesce(nullif(concat_ws('+', CASE WHEN o_orderstatus = 'O' THEN 'missing_actual_play' END, CASE WHEN o_custkey % 10 = 0 THEN 'missing_identity' END), ''), 'candidate') AS reason, count(*) AS n FROM orders GROUP BY 1""")
def c13(spark: SparkSession, d: str) -> DataFrame:
    return p15(spark, d).groupBy(F.coalesce(F.nullif("reasons", F.lit("")), F.lit("candidate")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
