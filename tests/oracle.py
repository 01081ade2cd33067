"""Comparing a query with its SQL on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(path: str = DATA):
    c = duckdb.connect()
    for f in os.listdir(path):
        where = f"{path}/{f}"
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{where}{'/*.parquet' if os.path.isdir(where) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return v if v is None or isinstance(v, bool) else str(v)


def rows(columns, values) -> list[str]:
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(r[k]) for k in at]) for r in values)


def same(frame, connection, sql: str) -> bool:
    got = connection.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(names) == sorted(frame.columns) and rows(names, got.fetchall()) == rows(frame.columns, [tuple(r) for r in frame.collect()])
