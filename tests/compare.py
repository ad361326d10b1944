"""Side-by-side comparison of a registered query with its reference SQL."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    keys = [c for c in df.columns if df[c].dtype.kind in "OUT"] or list(df.columns)
    rest = [c for c in df.columns if c not in keys]
    return df.sort_values(keys + rest, ignore_index=True, na_position="first")


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    got, want = _sorted(got), _sorted(want)
    for name in got.columns:
        a, b = got[name], want[name]
        if a.dtype.kind == "f" or b.dtype.kind == "f":
            a, b = a.astype(float), b.astype(float)
            differ = ~((a == b) | (a.isna() & b.isna()))
        else:
            differ = ~((a.astype(object) == b.astype(object)) | (a.isna() & b.isna()))
        assert not differ.any(), (name, int(differ.sum()), got[differ].head(), want[differ].head())
        assert a.dtype.kind == b.dtype.kind, (name, a.dtype, b.dtype)
