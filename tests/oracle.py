"""Compares registered queries with their SQL in DuckDB on a data folder."""

import os
from collections import Counter
from pathlib import Path

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    for p in Path(SF_DIR).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def check(spark, query, sql):
    df = query(spark, SF_DIR)
    want = connection().sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    place = [want.columns.index(c) for c in columns]
    mine = Counter(tuple(r[c] for c in columns) for r in df.collect())
    assert mine == Counter(tuple(r[k] for k in place) for r in want.fetchall())
