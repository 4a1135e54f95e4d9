"""Compare a query's result with its SQL on another engine."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.isdir(path):
            path = sorted(glob.glob(f"{path}/*.parquet"))
        con.read_parquet(path).create_view(name)
    return con


def plain(value):
    """A value that is equal on both engines and can be sorted."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    other = con.execute(sql)
    columns = [c[0] for c in other.description]
    assert sorted(df.columns) == sorted(columns)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(columns, other.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == b
