"""A query beside its SQL in DuckDB, rows in any order."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(repr(plain(r[k])) for k in order) for r in data)


def assert_same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(found.columns, found.fetchall())
    near = lambda c: Counter({tuple(f"{float(x):.6g}" if _number(x) else x for x in k): n for k, n in c.items()})
    assert a == b or near(a) == near(b), (list((a - b).items())[:3], list((b - a).items())[:3])


def _number(x):
    try:
        float(x)
    except ValueError:
        return False
    return True
