"""Compares a query's rows with those of its DuckDB SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(d).glob("*.parquet")):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "asDict"):
        return tuple(plain(v) for _, v in sorted(x.asDict().items()))
    if isinstance(x, dict):
        return tuple(plain(v) for _, v in sorted(x.items()))
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(got: list[tuple], want: list[tuple]) -> bool:
    """Equal rows; floats may differ in the last place that is kept."""
    def near(a, b):
        if isinstance(a, tuple) and isinstance(b, tuple):
            return len(a) == len(b) and all(map(near, a, b))
        if isinstance(a, float) and isinstance(b, (float, int)) or isinstance(b, float) and isinstance(a, int):
            return abs(a - b) <= 2e-6 * max(1.0, abs(a))
        return a == b

    return len(got) == len(want) and all(map(near, got, want))


def compare(spark, query, sql: str, d: str, con=None) -> str:
    """Empty where both agree, else what differs."""
    df = query(spark, d)
    cur = (con or connect(d)).execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, got = rows_of(names, cur.fetchall()), rows_of(df.columns, df.collect())
    if same(got, want):
        return ""
    odd = [(a, b) for a, b in zip(got, want) if not same([a], [b])][:2]
    return f"{len(got)} rows and {len(want)}; first differences {str(odd)[:600]}"
