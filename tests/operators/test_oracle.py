"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from cityfeed.plans.catalog import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(D + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df, cols):
    def plain(v):
        if v is None or pd.isna(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        # a column of integers with nulls comes as floats from one of the two
        return float(v) if isinstance(v, int) and not isinstance(v, bool) else v

    return sorted(str(tuple(map(plain, r))) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, name):
    got, want = entry.queries()[name](spark, D).toPandas(), con.execute(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    for c in cols:
        if want[c].dtype.kind == "M":
            got[c], want[c] = got[c].astype(str), want[c].astype(str)
    assert rows(got, cols) == rows(want, cols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_run(spark, name):
    assert entry.queries()[name](spark, D).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
