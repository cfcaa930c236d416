"""Spark results against DuckDB's, as sorted rows of plain values."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def of_spark(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), table(df.columns, df.collect())


def of_duckdb(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as con:
        for p in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        return sorted(columns), table(columns, found.fetchall())


def close(a: tuple, b: tuple) -> bool:
    return all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6) for x, y in zip(a, b, strict=True))
