"""Runs a query and its DuckDB SQL over the same folder and compares them as multisets of rows."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return names, cur.fetchall()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    return v


def same(spark, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    names, want = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(names), (name, df.columns, names)
    order = sorted(names)
    a = Counter(tuple(norm(r[c]) for c in order) for r in df.collect())
    b = Counter(tuple(norm(r[names.index(c)]) for c in order) for r in want)
    assert a == b, (name, len(a), len(b), list((a - b).items())[:3], list((b - a).items())[:3])
    return sum(a.values())
