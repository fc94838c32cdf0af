"""Holds a query against its SQL in DuckDB."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(folder: str):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con


def same(spark, query, sql: str, folder: str) -> None:
    ours, theirs = query(spark, folder).toPandas(), connect(folder).execute(sql).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    for c in columns:
        equal = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert equal.all(), (c, a[~equal].head(3), b[~equal].head(3))
