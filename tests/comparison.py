"""Row-for-row comparison of a registered query with its SQL oracle."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def _plain(value):
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _sorted(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def differences(query_df, connection, sql: str) -> str:
    """An empty text when names, types and rows agree, else what differs."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected = _sorted(names, result.fetchall())
    if sorted(names) != sorted(query_df.columns):
        return f"columns {sorted(query_df.columns)} against {sorted(names)}"
    actual = _sorted(query_df.columns, [tuple(r) for r in query_df.collect()])
    if len(actual) != len(expected):
        return f"{len(actual)} rows against {len(expected)}"
    for a, e in zip(actual, expected):
        if a != e or [type(x) for x in a] != [type(x) for x in e]:
            return f"{a} against {e}"
    return ""
