"""Compares a query with its SQL in DuckDB: columns, and rows as a multiset."""

import datetime
import os

import duckdb


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(d):
        if f.endswith(".parquet"):
            at = f"{d}/{f}/*.parquet" if os.path.isdir(f"{d}/{f}") else f"{d}/{f}"
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{at}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def compare(spark, con, d, query, sql) -> None:
    df = query(spark, d)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*cols).collect())
    c = con.execute(sql)
    names = [x[0] for x in c.description]
    assert sorted(names) == cols
    order = [names.index(k) for k in cols]
    want = sorted(tuple(plain(r[i]) for i in order) for r in c.fetchall())
    assert got == want
