"""Compares a query with its SQL on the smallest tables."""

import glob
import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, (int, float)):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def same(spark, query, sql) -> None:
    df = query(spark, SF)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    cur = connection().execute(sql)
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(names)
    assert sorted(got, key=str) == sorted(want, key=str)
