"""Runs queries and their SQL side by side and compares the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def differences(spark, name: str, query, sql: str, folder: str) -> list[str]:
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    c = connection(folder)
    c.execute("SET TimeZone='UTC'")
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    want = rows(names, found.fetchall())
    out = [] if sorted(df.columns) == sorted(names) else [f"{name}: columns {sorted(df.columns)} and {sorted(names)}"]
    if got != want:
        out.append(f"{name}: {sum(got.values())} rows and {sum(want.values())}; here only {list((got - want))[:3]}, there only {list((want - got))[:3]}")
    return out
