"""Compares a Spark result with DuckDB's, whatever the order of rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows_of_duckdb(sql: str, sf_dir: str):
    connection = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = connection.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def compare(df, sql: str, sf_dir: str) -> str:
    """Empty if both agree in columns and rows, else what differs first."""
    names, expected = rows_of_duckdb(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    key = lambda row: tuple((x is not None, str(x)) for x in row)
    theirs = sorted((tuple(_plain(r[names.index(c)]) for c in order) for r in expected), key=key)
    ours = sorted((tuple(_plain(r[c]) for c in order) for r in df.collect()), key=key)
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows, first {order}: {bad[0]}" if bad else ""
