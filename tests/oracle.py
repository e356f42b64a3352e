"""Order-free comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str = SF) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"create view {t} as select * from read_parquet('{path}')")
    return c


def text(v) -> str:
    if v is None or (not isinstance(v, (list, np.ndarray, dict)) and pd.isna(v)):
        return "null"
    if isinstance(v, (float, np.floating)):
        return f"{v:.9g}"
    if isinstance(v, (int, np.integer)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(list(v) if isinstance(v, np.ndarray) else v).replace(" 00:00:00", "")


def canonical(df: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(df.columns)
    return sorted(tuple(text(v) for v in row) for row in df[columns].itertuples(index=False))
