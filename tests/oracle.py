"""Runs DuckDB over the same Parquet tables and compares rows."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (bytearray, bytes)):
        return bytes(v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    return v


def assert_same(df, sql: str, sf_dir: str):
    names, rows = duck_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    order = sorted(names)
    ours = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in rows)
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
