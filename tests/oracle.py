"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def _plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return value


def rows_of_query(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(_plain(v) for v in row) for row in frame.select(*[f"`{c}`" for c in columns]).collect()), key=repr)


def rows_of_sql(sql: str, folder: str = SMALL, tables: dict | None = None):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if tables and name in tables:
            con.register(name, tables[name])
        elif os.path.exists(path):
            files = f"{path}/*.parquet" if os.path.isdir(path) else path
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    found = con.sql(sql)
    columns = sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    return columns, sorted((tuple(_plain(row[i]) for i in at) for row in found.fetchall()), key=repr)
