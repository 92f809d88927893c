"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path


def views(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 9)
    return str(v)


def as_rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when both agree, else what differs."""
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(rel.columns)}"
    ours, theirs = as_rows(df.columns, df.collect()), as_rows(rel.columns, rel.fetchall())
    if ours != theirs:
        a, b = ours - theirs, theirs - ours
        return (
            f"{name}: {sum(ours.values())} and {sum(theirs.values())} rows, {sum(a.values())} differ: "
            f"{sorted(df.columns)} {list(a)[:3]} / {list(b)[:3]}"
        )
    return None
