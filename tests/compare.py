"""Query rows against DuckDB rows, order and floating point's last digits aside."""

from __future__ import annotations

import math
import os

import duckdb

SF_DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.7g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def connection():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF_DIR)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF_DIR}/{f}')")
    return con


def same(spark, query, sql: str) -> None:
    df = query(spark, SF_DIR)
    names = sorted(df.columns)
    found = sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=repr)
    rel = connection().sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(n) for n in names]
    assert found == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
