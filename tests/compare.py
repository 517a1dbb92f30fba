"""Comparing a Spark result with DuckDB's answer to the check SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def rows(names: list[str], values: list) -> list[tuple]:
    """Rows with columns by name, as text, sorted."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in values)


def difference(df, connection, sql: str) -> str | None:
    relation = connection.sql(sql)
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} != {sorted(relation.columns)}"
    ours = rows(df.columns, [tuple(row) for row in df.collect()])
    theirs = rows(relation.columns, relation.fetchall())
    if ours == theirs:
        return None
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    first = next((a, b) for a, b in zip(ours, theirs) if a != b)
    return f"{sum(a != b for a, b in zip(ours, theirs))} rows differ, first {first}"[:1500]
