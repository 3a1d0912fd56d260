"""Side-by-side check of registered queries against their reference SQL in DuckDB."""

from __future__ import annotations

import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(rows: list[tuple]) -> list[tuple]:
    def value(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)):
            return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.6f}"
        if hasattr(v, "as_tuple"):
            return f"{float(v):.6f}"
        return str(v)

    return sorted(tuple(value(v) for v in row) for row in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description of the difference."""
    names = sorted(spark_df.columns)
    cursor = con.execute(sql)
    described = [d[0] for d in cursor.description]
    if sorted(described) != names:
        return f"columns {names} vs {sorted(described)}"
    order = [described.index(n) for n in names]
    expected = canonical([tuple(r[i] for i in order) for r in cursor.fetchall()])
    actual = canonical([tuple(r) for r in spark_df.select(*names).collect()])
    if len(actual) != len(expected):
        return f"rows {len(actual)} vs {len(expected)}"
    for a, e in zip(actual, expected):
        if a != e:
            return f"{a} vs {e}"
    return None
