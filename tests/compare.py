"""Row sets of Spark and of DuckDB in one comparable form."""

import datetime
import decimal
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()[:19]
    assert not isinstance(value, decimal.Decimal), "decimals and doubles hash differently"
    return str(value)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def assert_equal(df, con, sql):
    found = con.sql(sql)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    want = rows_of(found.fetchall(), found.columns)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
