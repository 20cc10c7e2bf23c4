"""Comparison of a query with SQL that DuckDB runs over the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value


def canonical(names, tuples):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(t[k]) for k in order) for t in tuples), key=repr)


def both(spark, query, sql, folder):
    df = query(spark, folder)
    base = duckdb.connect()
    base.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = base.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    return canonical(df.columns, [tuple(r) for r in df.collect()]), canonical(names, found.fetchall())
