"""Compare a Spark result with a DuckDB statement over the same tables."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def differences(df, con, statement: str) -> list[str]:
    """Human-readable differences; empty when equal to the last bit."""
    cursor = con.execute(statement)
    expected_columns, expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    found_columns, found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if expected_columns != found_columns:
        return [f"columns {found_columns} != {expected_columns}"]
    out = []
    if len(expected) != len(found):
        out.append(f"rows {len(found)} != {len(expected)}")
    a, b = set(expected), set(found)
    left = [r for r in found if r not in a][:3]
    right = [r for r in expected if r not in b][:3]
    if left or right:
        out += [f"only Spark {r}" for r in left] + [f"only DuckDB {r}" for r in right]
    return out
