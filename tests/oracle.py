"""Spark rows against DuckDB rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    con.execute("SET TimeZone = 'UTC'")
    return con


def canonical(rows, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x + 0.0:.6f}"
        if isinstance(x, (int,)) or type(x).__name__ == "Decimal":
            return f"{float(x):.6f}"
        if isinstance(x, (list, tuple)):
            return str([value(y) for y in x])
        return str(x)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> str:
    """Empty if the rows are the same."""
    rows = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    a, b = canonical(rows, spark_df.columns), canonical(cur.fetchall(), names)
    if a == b:
        return ""
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"{len(a)} rows against {len(b)}; only in Spark {only_a}; only in SQL {only_b}"
