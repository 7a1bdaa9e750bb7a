"""A query's rows beside those of its SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """DuckDB with the tables of ``sf_dir`` as views."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    if isinstance(value, bool) or value is None or isinstance(value, (int, str, bytes)):
        return value
    return str(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    """Rows with their columns sorted by name, in a fixed order."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def spark_rows(df) -> list[tuple]:
    return rows_of(df.columns, df.collect())


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> list[tuple]:
    found = con.execute(sql)
    return rows_of([c[0] for c in found.description], found.fetchall())
