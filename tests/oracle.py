"""Compares registered queries with their SQL, run by DuckDB over the same tables."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of(columns, rows, order):
    at = [columns.index(c) for c in order]
    tidy = lambda x: round(x, 9) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x
    return sorted(repr(tuple(tidy(r[i]) for i in at)) for r in rows)


def assert_same(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    want = con.sql(sql)
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()], order) == rows_of(want.columns, want.fetchall(), order)
