"""Differences between two runs, and profiles of one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .order import numbered


def keyed_diff(old: DataFrame, new: DataFrame, key: str, volatile: tuple[str, ...] = ()) -> DataFrame:
    """key, change (added, removed, changed) and the names of changed columns, in order; volatile ones do not count."""
    names = sorted(c for c in old.columns if c not in (key, *volatile))
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    fields = F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in names]))
    change = F.when(F.col(f"o.{key}").isNull(), "added").when(F.col(f"n.{key}").isNull(), "removed").when(F.size(fields) > 0, "changed")
    shown = F.when(change == "changed", F.array_join(fields, ",")).otherwise("")
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), change.alias("change"), shown.alias("fields")).filter(F.col("change").isNotNull())


def without_fields(value: Column, kind: DataType, names: tuple[str, ...]) -> Column:
    """A nested value without the fields of these names, at any depth of structs, arrays and map values."""
    if isinstance(kind, StructType):
        kept = [without_fields(value[f.name], f.dataType, names).alias(f.name) for f in kind.fields if f.name not in names]
        return F.when(value.isNotNull(), F.struct(*kept)) if kept else F.lit(None).cast("string")
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda item: without_fields(item, kind.elementType, names))
    if isinstance(kind, MapType):
        own = F.map_filter(value, lambda key, _: ~key.cast("string").isin(*names))
        return F.transform_values(own, lambda _, item: without_fields(item, kind.valueType, names))
    return value


def stable(rows: DataFrame, volatile: tuple[str, ...]) -> DataFrame:
    """``rows`` without the volatile fields, nested ones included: what two runs are compared by."""
    return rows.select(*[without_fields(F.col(f"`{f.name}`"), f.dataType, volatile).alias(f.name) for f in rows.schema.fields if f.name not in volatile])


def changed_fields(diff: DataFrame) -> DataFrame:
    """field, n: how often each column changed."""
    return diff.filter("change = 'changed'").select(F.explode(F.split("fields", ",")).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def ordinal_diff(old: DataFrame, new: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """ordinal, change: rows compared by their place in the order."""
    def placed(frame: DataFrame, name: str) -> DataFrame:
        return numbered(frame, order, "ordinal").select("ordinal", F.struct(*values).alias(name))

    joined = placed(old, "o").join(placed(new, "n"), "ordinal", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return joined.select("ordinal", change.alias("change")).filter("change is not null")


def set_compare(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    """One row: keys of both, of one side only, and mismatches per value; of a key that repeats, the last row counts."""
    def last(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias(name))

    joined = last(left, "l").join(last(right, "r"), keys, "full_outer")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    counts = [F.count_if(both & ~F.col(f"l.{v}").eqNullSafe(F.col(f"r.{v}"))).alias(f"{v}_differs") for v in values]
    return joined.agg(F.count_if(both).alias("in_both"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"), *counts)


def pair_outcomes(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """outcome, n: equal, different, one_missing, both_missing; blanks count as missing."""
    a, b = F.nullif(F.col(left).cast("string"), F.lit("")), F.nullif(F.col(right).cast("string"), F.lit(""))
    outcome = F.when(a.isNull() & b.isNull(), "both_missing").when(a.isNull() | b.isNull(), "one_missing").when(a == b, "equal").otherwise("different")
    return pairs.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def profile(rows: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """One row: number of rows, first and last time, and blanks per column."""
    blanks = [F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(f"{c}_missing") for c in columns]
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"), *blanks)


def histogram(rows: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return rows.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def histograms(rows: DataFrame, columns: list[str]) -> DataFrame:
    """kind, value, n for several columns, in one scan."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("p")).groupBy("p.kind", "p.value").agg(F.count(F.lit(1)).alias("n"))


def duplicate_surplus(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: groups with more than one row, and rows beyond the first."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def share(part: Column, whole: Column) -> Column:
    """part / whole; 1 where there is nothing."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(part / whole)


def reasons(**conditions: Column) -> Column:
    """The names of the conditions that hold, joined by '+'."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in conditions.items()])), "+")


def id_preserved(records: DataFrame, origins: DataFrame) -> DataFrame:
    """record_id, preserved: whether a record's requester is among its origins' ones."""
    seen = origins.groupBy("record_id").agg(F.collect_set("requester_user_id").alias("ids"))
    joined = records.join(seen, "record_id", "left")
    return joined.select("record_id", (F.col("requester_user_id").isNull() | F.coalesce(F.array_contains("ids", F.col("requester_user_id")), F.lit(False))).alias("preserved"))


def versions_per_event(rows: DataFrame, event: str, version: str) -> DataFrame:
    """One row: number of versions, of those that several events share, and the most events of one."""
    per = rows.groupBy(version).agg(F.countDistinct(event).alias("events"))
    return per.agg(F.count(F.lit(1)).alias("versions"), F.count_if(F.col("events") > 1).alias("reused"), F.max("events").alias("most"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
