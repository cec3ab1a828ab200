"""Results of Spark and of DuckDB, made comparable."""

import os

import duckdb
import pandas as pd


def canonical(df):
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False):
        cells = []
        for v in row:
            if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
                cells.append("null")
            elif isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
                cells.append(str(bool(v)))
            elif hasattr(v, "__float__") and not isinstance(v, str):
                f = float(v)
                cells.append(str(int(f)) if f.is_integer() else f"{f:.6f}")
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)


def by_sql(sql, data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return c.sql(sql).to_df()
