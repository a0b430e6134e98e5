"""Compares a query with its SQL in DuckDB, as values without order."""

from __future__ import annotations

import math
from pathlib import Path


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list):
        return str([_norm(x) for x in v])
    return "null" if v is None else str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, folder: str, fn, sql: str) -> str:
    """'' if equal, else what differs."""
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    df = fn(spark, folder)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    kind = {"tinyint": 1, "smallint": 1, "int": 1, "bigint": 2, "double": 3, "string": 4, "boolean": 5}
    other = {"INTEGER": 1, "BIGINT": 2, "DOUBLE": 3, "VARCHAR": 4, "BOOLEAN": 5}
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    odd = [(c, t, kinds[c]) for c, t in df.dtypes if kind.get(t, 0) != other.get(kinds[c], 0)]
    a, b = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    if a != b:
        return f"{len(a)} and {len(b)} rows, first unlike: {next((p for p in zip(a, b, strict=False) if p[0] != p[1]), None)}"
    return f"types {odd}" if odd else "" if a else "no rows"
