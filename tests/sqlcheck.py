"""Compares a query with its SQL on DuckDB, by multiset of rows with columns in order of name."""

from __future__ import annotations

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _value(v) -> str:
    return f"{float(v):.9g}" if isinstance(v, (float, Decimal)) else str(v)


def _rows(rows, names: list[str]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def assert_same(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    wanted, got = _rows(found.fetchall(), names), _rows(df.collect(), df.columns)
    assert got == wanted, (list((got - wanted))[:3], list((wanted - got))[:3])
