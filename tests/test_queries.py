"""Every query with SQL gives the rows of its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from paneloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiu" or str(df[c].dtype) in ("Int64", "Float64", "Int32"):
            df[c] = df[c].astype(float).round(4).fillna(-7.5)
        else:
            df[c] = df[c].map(lambda x: "" if x is None or x is pd.NaT else str(x)[:10] if hasattr(x, "isoformat") else str(x).lower())
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    a, b = plain(got), plain(want)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype == float and b[c].dtype == float:
            assert ((a[c] - b[c]).abs() <= 2e-4 + 1e-9 * b[c].abs()).all(), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


@pytest.mark.parametrize("name", ["m02_event_errors", "m16_pretrend", "m23_wild_bootstrap", "m34_sensitivity", "m25_permutation", "m18_local_moran", "m36_interactive_effects", "m38_generalized_control", "m37_matrix_completion", "m11_synthetic_did", "o8_hash_sample", "x7_transverse_mercator"])
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
