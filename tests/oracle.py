"""Runs a registered query and its SQL side by side and reports the first difference."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, int):
        return value
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return str(value)


def kind(value) -> str:
    if isinstance(value, decimal.Decimal):
        return "decimal"
    return type(value).__name__


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description."""
    rows = [r.asDict() for r in spark_df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    other = [dict(zip(names, r)) for r in cursor.fetchall()]
    cols = sorted(spark_df.columns)
    if cols != sorted(names):
        return f"columns {cols} vs {sorted(names)}"
    if len(rows) != len(other):
        return f"rows {len(rows)} vs {len(other)}"
    for c in cols:
        a = {kind(r[c]) for r in rows if r[c] is not None}
        b = {kind(r[c]) for r in other if r[c] is not None}
        if a and b and a != b:
            return f"types of {c}: {a} vs {b}"
    key = lambda r: [(v is None, str(v)) for v in r]
    left = sorted(([plain(r[c]) for c in cols] for r in rows), key=key)
    right = sorted(([plain(r[c]) for c in cols] for r in other), key=key)
    for a, b in zip(left, right):
        if a != b:
            bad = [c for c, x, y in zip(cols, a, b) if x != y]
            return f"{sum(x != y for x, y in zip(left, right))} rows differ, first in {bad}: {a} vs {b}"
    return None
