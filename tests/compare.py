"""Spark's rows beside DuckDB's."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = Path(folder, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def rows(columns: list[str], names: list[str], data) -> list[tuple]:
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


def same(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    columns = sorted(df.columns)
    assert rows(columns, df.columns, df.collect()) == rows(columns, found.columns, found.fetchall())
