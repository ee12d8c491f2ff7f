"""Compare registered queries with their SQL in DuckDB, value by value."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/*.parquet')" if os.path.isdir(at) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) < 1e15 else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, decimal.Decimal)):
        return f"{float(v):.6g}" if isinstance(v, decimal.Decimal) else str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if hasattr(v, "asDict"):
        return str({k: plain(x) for k, x in v.asDict().items()})
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in v.items()})
    return str(v)


def differences(spark, query, sql: str, sf_dir: str) -> str:
    """Empty when both give the same columns and the same bag of rows."""
    df = query(spark, sf_dir)
    con = duck(sf_dir).execute(sql)
    cols = sorted(c[0] for c in con.description)
    if sorted(df.columns) != cols:
        return f"columns {sorted(df.columns)} vs {cols}"
    order = [[c[0] for c in con.description].index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in order) for r in con.fetchall())
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""
