"""Run a query and its SQL side by side and compare columns and values."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None:
        return None
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "item"):
        return plain(x.item())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if type(x).__name__ == "Decimal":
        return plain(float(x))
    return x


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


def differences(df, con, sql: str) -> str:
    """An empty string if both give the same columns and rows; else what differs."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    theirs = rows_of(names, found.fetchall())
    ours = rows_of(df.columns, df.collect())
    if ours == theirs:
        return ""
    a, b = ours - theirs, theirs - ours
    return f"{ours.total()} and {theirs.total()} rows, {a.total()} only here {list(a)[:2]}, {b.total()} only there {list(b)[:2]}"
