"""Spark results against DuckDB on the same tables, as the driver compares them."""

import os

import duckdb
import pandas as pd


def normal(df: pd.DataFrame) -> list:
    def value(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return "|".join(str(value(x)) for x in v)
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, pd.Timestamp):
            return str(v.tz_localize(None) if v.tz else v)
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(value(x) for x in row) for row in df.itertuples(index=False, name=None)), key=str)


def duck(folder: str):
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        path = os.path.join(folder, name) + ("/*" if os.path.isdir(os.path.join(folder, name)) else "")
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return connection
