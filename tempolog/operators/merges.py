"""Merges into tables without row-level updates: outer joins whose result replaces the table.

Every function is pure.  ``changed`` counts what a writer would have touched, so an idempotent rerun
reports none.  :func:`replace_table` swaps the folder after the new data is complete.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import REQUEST_RANKS, hash_key, rank_of


def _old(name: str) -> Column:
    return F.col(f"old.{name}")


def _new(name: str) -> Column:
    return F.col(f"new.{name}")


def filled(old: Column, new: Column) -> Column:
    """The old value unless it is blank, then the new one."""
    return F.coalesce(F.nullif(old, F.lit("")), new)


def overlaid(old: Column, new: Column) -> Column:
    """The new value unless it is blank, then the old one."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def merge(old: DataFrame, new: DataFrame, key: str, rules: dict[str, object] | None = None, volatile: tuple[str, ...] = ()) -> DataFrame:
    """Full outer merge on ``key``: new values win, but for columns with a rule ``(old, new) -> column``.

    Adds action: inserted, updated, unchanged or kept.  Columns of ``volatile`` do not count as changes, and
    keep their old value where nothing else changed.  Both sides have one row per key.
    """
    rules = rules or {}
    names = [c for c in old.columns if c != key]
    joined = old.alias("old").join(new.alias("new"), F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    there, came = F.col(f"old.{key}").isNotNull(), F.col(f"new.{key}").isNotNull()
    merged = {c: F.when(there & came, rules[c](_old(c), _new(c)) if c in rules else _new(c)).when(came, _new(c)).otherwise(_old(c)) for c in names}
    same = F.lit(True)
    for c in names:
        if c not in volatile:
            same = same & merged[c].eqNullSafe(_old(c))
    action = F.when(~came, "kept").when(~there, "inserted").when(same, "unchanged").otherwise("updated")
    for c in volatile:
        merged[c] = F.when(there & came & same, _old(c)).otherwise(merged[c])
    return joined.select(F.coalesce(f"old.{key}", f"new.{key}").alias(key), *[merged[c].alias(c) for c in names], action.alias("action"))


def merge_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence records: new wins, a requester id once found stays, and no-ops leave updated_at alone."""
    return merge(old, new, "evidence_key", {"requester_user_id": filled}, volatile=tuple(c for c in ("updated_at",) if c in old.columns))


def merge_origins(old: DataFrame, new: DataFrame) -> DataFrame:
    """Provenance rows: new wins, but created_at stays."""
    rules = {"created_at": lambda o, n: F.coalesce(o, n)} if "created_at" in old.columns else {}
    return merge(old, new, "origin_key", rules)


def keep_requester(origins: DataFrame, existing: DataFrame) -> DataFrame:
    """New origins with the requester that their record has already: id of the record, source of its origins.

    ``existing``: record_id, origin_key, origin_id, requester_user_id, requester_source.  The same origin's
    source comes first, then that of the record's lowest origin id.
    """
    has_source = F.nullif(F.col("requester_source"), F.lit("")).isNotNull()
    by_key = existing.filter(has_source).select("origin_key", F.col("requester_source").alias("own_source"))
    by_record = existing.groupBy("record_id").agg(
        F.max(F.nullif(F.col("requester_user_id"), F.lit(""))).alias("known_id"), F.min_by("requester_source", F.when(has_source, F.col("origin_id"))).alias("first_source")
    ).filter("known_id is not null")  # a source is kept with an id only
    joined = origins.join(by_key, "origin_key", "left").join(by_record, "record_id", "left")
    has = F.col("known_id").isNotNull()
    return joined.withColumns({
        "requester_user_id": F.when(has, F.col("known_id")).otherwise(F.col("requester_user_id")),
        "requester_source": F.when(has, F.coalesce("own_source", "first_source")).otherwise(F.col("requester_source")),
    }).drop("own_source", "first_source", "known_id")


def merge_catalog(old: DataFrame, new: DataFrame, key: str, plain: tuple[str, ...] = ()) -> DataFrame:
    """Catalog rows: a blank never overwrites; ``plain`` columns are numbers, where only a null counts as blank."""
    rules = {c: (lambda o, n: F.coalesce(n, o)) if c in plain else overlaid for c in old.columns if c != key}
    return merge(old, new, key, rules)


def last_state(updates: DataFrame, key: str, order: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: the last update's values, but the first non-blank one of ``keep_first`` columns."""
    names = [c for c in updates.columns if c not in (key, *keep_first)]
    first = [F.min_by(c, F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col(order))).alias(c) for c in keep_first]
    last = updates.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("__last"), *first)
    return last.select(key, "__last.*", *keep_first)


def transition(rows: DataFrame, settled: DataFrame, key: str) -> DataFrame:
    """Pending, unpromoted rows take the settlement's status and reason; all others stay as they are."""
    found = settled.select(F.col(key).alias("__key"), F.col("status").alias("__status"), F.col("reason").alias("__reason"))
    open_row = (F.col("status") == "pending") & F.col("promoted_id").isNull() & F.col("__key").isNotNull()
    joined = rows.join(found, F.col(key) == F.col("__key"), "left")
    return joined.withColumns({"reason": F.when(open_row, F.col("__reason")).otherwise(F.col("reason")), "status": F.when(open_row, F.col("__status")).otherwise(F.col("status"))}).drop("__key", "__status", "__reason")


def promotable(rows: DataFrame) -> DataFrame:
    """Completed, really started, identified rows with a duration that were not first seen mid-play."""
    return rows.filter("completion_status = 'completed' AND actual_play_at IS NOT NULL AND system_key <> '' AND external_id <> '' AND duration_seconds IS NOT NULL AND NOT observed_mid_play")


def merge_staged(old: DataFrame, new: DataFrame, key: str, ranks: dict[str, int], type_column: str = "request_type") -> DataFrame:
    """Staging rows: one per key, replaced only by a higher rank, or an equal one with more confidence."""
    def weigh(frame: DataFrame, age: int) -> DataFrame:
        return frame.withColumn("__weight", F.struct(rank_of(F.col(type_column), ranks).alias("r"), F.col("confidence").alias("c"), F.lit(-age).alias("a")))

    both = weigh(old, 0).unionByName(weigh(new, 1))
    names = [c for c in old.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*names), "__weight").alias("__best")).select(key, "__best.*")


def keep_higher_request(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose request type does not fall below that of the existing row."""
    old = existing.select(F.col(key).alias("__key"), F.col("request_type").alias("__old"))
    joined = incoming.join(old, F.col(key) == F.col("__key"), "left")
    stays = (F.coalesce("__old", F.lit("")) != "") & (rank_of(F.col("__old"), REQUEST_RANKS) >= rank_of(F.col("request_type"), REQUEST_RANKS))
    return joined.withColumn("request_type", F.when(stays, F.col("__old")).otherwise(F.col("request_type"))).drop("__key", "__old")


def set_favorites(tracks: DataFrame, ids: DataFrame, system: str, additive: bool = False) -> DataFrame:
    """Tracks with the favorite flag of one system set from a list of external ids.

    Ids that the catalog lacks abort the import.  Other systems' flags stay; without ``additive`` the flags of
    tracks not listed are cleared.
    """
    listed = ids.select(F.col("external_id").alias("__id")).distinct()
    own = tracks.filter(F.col("system_key") == system).select(F.col("external_id").alias("__have"))
    unknown = listed.join(own, F.col("__id") == F.col("__have"), "left_anti")
    first = unknown.agg(F.min("__id")).first()[0]
    if first is not None:
        raise ValueError(f"the list names songs that the catalog lacks, such as {first}")
    joined = tracks.join(listed, F.col("external_id") == F.col("__id"), "left")
    rest = F.col("favorite") if additive else F.lit(False)
    flag = F.when(F.col("system_key") != system, F.col("favorite")).when(F.col("__id").isNotNull(), F.lit(True)).otherwise(rest)
    return joined.withColumn("favorite", flag).drop("__id")


def settle_stale(records: DataFrame, origins: DataFrame, source: str, table: str) -> DataFrame:
    """Records of a source whose origin is of ``table`` and that were left pending become interrupted."""
    left = origins.filter(F.col("origin_table") == table).select(F.col("record_id").alias("__record")).distinct()
    stale = records.filter((F.col("evidence_source") == source) & (F.col("default_status") == "pending")).join(left, F.col("record_id") == F.col("__record"), "left_semi").select(F.col("record_id").alias("__stale"))
    joined = records.join(stale, F.col("record_id") == F.col("__stale"), "left")
    hit = F.col("__stale").isNotNull()
    return joined.withColumns({
        "default_status": F.when(hit, "needs_attention").otherwise(F.col("default_status")),
        "observation_status": F.when(hit, "interrupted").otherwise(F.col("observation_status")),
        "observation_reason": F.when(hit, "watcher_interrupted_unexpectedly").otherwise(F.col("observation_reason")),
    }).drop("__stale")


def unique_keys(entries: DataFrame, order: list[Column]) -> DataFrame:
    """event_key of manual entries: the base key's hash; entries that share it get a numbered one."""
    turn = F.row_number().over(Window.partitionBy("base_key").orderBy(*order))
    numbered = entries.withColumn("__n", turn)
    return numbered.withColumn("event_key", F.when(F.col("__n") == 1, hash_key(F.col("base_key"))).otherwise(hash_key(F.col("base_key"), F.col("__n")))).drop("__n")


def missing_stubs(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """system_key, external_id, title, action of songs that candidates name and the catalog lacks."""
    missing = candidates.join(catalog.select("system_key", "external_id"), ["system_key", "external_id"], "left_anti")
    stubs = missing.groupBy("system_key", "external_id").agg(F.min(F.nullif(F.col("video_name"), F.lit(""))).alias("title"))
    action = F.when(F.col("system_key") == "wannadance", "add_from_cache_or_stub").when(F.col("system_key").isin("pypydance", "dudu"), "add_stub").otherwise("skip")
    return stubs.withColumn("action", action)


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed batch still has to do."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Write the whole table beside its folder, then swap; a failed write leaves the old one in place."""
    spark: SparkSession = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, fresh, past = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"))
    files = target.getFileSystem(conf)
    df.write.parquet(fresh.toString())
    if files.exists(target):
        files.rename(target, past)
    files.rename(fresh, target)
    files.delete(past, True)
    return spark.read.parquet(path)
