"""Runs registered queries beside their SQL in DuckDB and compares all values, columns and rows in any order."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def _plain(v):
    if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    if type(v).__name__ == "Decimal" or isinstance(v, float) or hasattr(v, "dtype"):
        f = float(v)
        return int(f) if f == int(f) else f
    return v if isinstance(v, (int, str)) else str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differ(query, sql: str, spark, sf_dir: str) -> str | None:
    """What differs, or None."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    c = connect(sf_dir).execute(sql)
    names = [x[0] for x in c.description]
    want = rows_of(names, c.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    odd = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(odd)} of {len(got)} rows, such as {odd[0]}" if odd else None
