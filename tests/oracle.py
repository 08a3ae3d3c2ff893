"""Compares a query with its SQL, run by DuckDB on the same tables."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connection(data: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        v = v.replace(tzinfo=None)
    return str(v)


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in data)


def compare(spark, con, query, sql: str, data: str = DATA) -> None:
    got = query(spark, data)
    con.execute(sql)
    names = [d[0] for d in con.description]
    want = rows(names, con.fetchall())
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == want
