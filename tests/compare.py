"""Run a query and its SQL twin and compare rows, column names and kinds of type."""

from __future__ import annotations

import os

import duckdb
from pyspark.sql import DataFrame

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def kind(name: str) -> str:
    name = str(name).lower()
    for prefix, short in [("decimal", "decimal"), ("timestamp", "timestamp"), ("varchar", "string")]:
        if name.startswith(prefix):
            return short
    return {"integer": "int", "int32": "int"}.get(name, name)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when both sides agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: kind(d[1]) for d in result.description}
    expected = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"columns: {sorted(df.columns)} against {sorted(names)}"]
    found = []
    own = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    for name in names:
        if own[name] != kinds[name] and kinds[name] != '"null"':
            found.append(f"type of {name}: {own[name]} against {kinds[name]}")
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(actual) != len(expected):
        found.append(f"rows: {len(actual)} against {len(expected)}")
    unequal = [(a, b) for a, b in zip(actual, expected) if a != b]
    if unequal:
        found.append(f"{len(unequal)} rows differ, first: {unequal[0]}")
    return found
