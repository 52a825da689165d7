"""Run queries and their SQL twins side by side and compare whole results."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = os.path.join(folder, f"{table}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple((_kind(r[i]), _text(r[i])) for i in order) for r in rows)


def _text(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.date):
        return value.isoformat()
    return str(value)


def difference(spark_df, con, sql: str) -> str | None:
    """What differs between the two results, or None."""
    relation = con.execute(sql)
    columns = [d[0] for d in relation.description]
    expected = rows_of(columns, relation.fetchall())
    actual = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(columns)}"
    if actual == expected:
        return None
    extra = [r for r in actual if r not in set(expected)][:2]
    missing = [r for r in expected if r not in set(actual)][:2]
    return f"{len(actual)} rows against {len(expected)}; extra {extra}; missing {missing}"
