"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(map(canonical, value))
    return value


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(columns)
    return sorted(repr(tuple(canonical(r[columns.index(c)]) for c in order)) for r in rows)


def same(df, sql: str, con) -> None:
    result = con.sql(sql)
    assert sorted(df.columns) == sorted(result.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(result.columns, result.fetchall())
