"""Rows of a Spark frame and of a DuckDB statement in one comparable form."""

import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf_dir}/{t}'")
    return con


def rows(df) -> list:
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, float):
            return round(x, 6)
        return x if isinstance(x, (int, str, bool)) else str(x.tolist() if hasattr(x, "tolist") else x)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.astype(object).where(df.notna(), None).values.tolist()), key=repr)
