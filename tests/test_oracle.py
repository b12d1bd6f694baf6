"""Every panel query against its SQL in DuckDB, on the smallest tables."""

import pathlib

import duckdb
import numpy as np
import pytest

from panelspark.queries import QUERIES, SQL

DATA = pathlib.Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and np.isnan(v)) else float(v) if type(v).__name__ == "Decimal" else str(v))
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = plain(got), plain(want)
    for c in a.columns:
        if a[c].dtype == float and b[c].dtype == float:
            np.testing.assert_allclose(a[c], b[c], atol=2e-6, rtol=1e-6, equal_nan=True, err_msg=c)
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).toPandas() is not None
