"""Results of the two engines, made comparable."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from pathlib import Path

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck() -> duckdb.DuckDBPyConnection:
    """A connection that knows the tables."""
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return c


def plain(x):
    """A value without its engine's type."""
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        x = float(x)
        return None if math.isnan(x) else round(x, 3)
    if isinstance(x, int):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return datetime.datetime(x.year, x.month, x.day).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows(columns: list[str], values) -> list[tuple]:
    """Sorted rows, columns in order of their names."""
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)
