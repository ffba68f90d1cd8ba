"""Compare a registered query with its SQL oracle (DuckDB over the same
parquet tables): row count, column names and types, and values."""

from __future__ import annotations

import math

import pandas as pd

EXACT = True  # compare doubles bit for bit (the engines round where needed)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0 if EXACT else round(v, 9) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def frame_rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0)
                                            for x in r))


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> dict:
    out = {"rows_spark": len(spark_pdf), "rows_oracle": len(oracle_pdf),
           "cols_spark": sorted(spark_pdf.columns), "cols_oracle": sorted(oracle_pdf.columns)}
    out["cols_match"] = out["cols_spark"] == out["cols_oracle"]
    out["rows_match"] = len(spark_pdf) == len(oracle_pdf)
    if out["cols_match"] and out["rows_match"]:
        a, b = frame_rows(spark_pdf), frame_rows(oracle_pdf)
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        out["values_match"] = not diff
        out["first_diff"] = diff[:2]
    else:
        out["values_match"] = False
    return out
