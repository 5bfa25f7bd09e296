"""Side-by-side check of registered queries against DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _kind(v):
    return "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else type(v).__name__


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def differences(df, con, sql: str, tolerance: float = 0.0) -> list[str]:
    """What differs between a Spark result and the SQL result; empty if nothing does."""
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)}; first {got[:2]} / {want[:2]}"]
    bad = []
    for g, w in zip(got, want):
        for c, a, b in zip(got_cols, g, w):
            if a is None and b is None:
                continue
            if a is None or b is None or _kind(a) != _kind(b):
                bad.append(f"{c}: {a!r} ({_kind(a)}) != {b!r} ({_kind(b)}) in {g} / {w}")
            elif isinstance(a, float) and math.isfinite(a) and abs(a - b) > tolerance:
                bad.append(f"{c}: {a!r} != {b!r} in {g} / {w}")
            elif not isinstance(a, float) and a != b:
                bad.append(f"{c}: {a!r} != {b!r} in {g} / {w}")
        if len(bad) > 4:
            break
    return bad
