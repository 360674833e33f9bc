"""Runs a registered query beside its DuckDB SQL and compares all rows."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def _canon(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return str([one(x) for x in v])
        if pd.isna(v):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v):.5f}".replace("-0.00000", "0.00000")
        return str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = _canon(got), _canon(want)
    if a == b:
        return ""
    x, y = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows of {sorted(got.columns)}; only Spark: {x}; only SQL: {y}"
