"""Compare a Spark query with its SQL on DuckDB: columns by name, rows as a bag, doubles to 6 digits."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def assert_equal(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    a, b = bag(df.columns, df.collect()), bag(relation.columns, relation.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
