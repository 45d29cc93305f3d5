"""Runs a query and its SQL side by side."""

from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.01"


def tables(sf: str = SF):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(pdf) -> list:
    one = lambda v: tuple(map(one, v)) if isinstance(v, (list, np.ndarray)) else None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float, np.number, Decimal)) and not isinstance(v, bool) else str(v)
    names = sorted(pdf.columns)
    return sorted([tuple(one(v) for v in r) for r in pdf[names].itertuples(index=False)], key=repr)


def assert_same(got, con, sql: str) -> None:
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, next((x, y) for x, y in zip(a, b, strict=True) if x != y)
