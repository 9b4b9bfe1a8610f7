"""Run a query in Spark and its oracle in DuckDB and compare all rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def run_oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection.execute(sql).df()


def normalized(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values in comparable form, rows in a fixed order."""
    out = {}
    for name in sorted(frame.columns):
        column = frame[name]
        if pd.api.types.is_bool_dtype(column):
            out[name] = column.astype(str)
        elif pd.api.types.is_numeric_dtype(column):
            out[name] = np.round(column.astype(float), 6) + 0.0
        else:
            text = column.map(lambda v: None if v is None or v is pd.NaT or v != v else str(v)[:10] if hasattr(v, "year") else str(v))
            out[name] = text.astype(object).where(text.notna(), "<null>")
    table = pd.DataFrame(out)
    return table.sort_values(list(table.columns), na_position="last").reset_index(drop=True)


def differences(df: DataFrame, sql: str, sf_dir: str) -> str | None:
    """None if equal, else a short account of the difference."""
    left, right = normalized(df.toPandas()), normalized(run_oracle(sql, sf_dir))
    if list(left.columns) != list(right.columns):
        return f"columns {list(left.columns)} != {list(right.columns)}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    for name in left.columns:
        same = (left[name] == right[name]) | (left[name].isna() & right[name].isna())
        if not same.all():
            at = (~same).idxmax()
            return f"{name}: {(~same).sum()} differ, e.g. {left[name][at]!r} != {right[name][at]!r}"
    return None
