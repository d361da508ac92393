"""Runs a query and its SQL on the same parquet tables and compares all rows."""

import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def same(df, con, sql):
    got = df.collect()
    want = con.sql(sql)
    columns = list(want.columns)
    assert sorted(df.columns) == sorted(columns)
    assert normal([tuple(r) for r in got], df.columns) == normal(want.fetchall(), columns)
