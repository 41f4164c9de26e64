"""Every query with SQL, on the smallest tables, against DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from tabsight.queries.base import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Facts that the smallest tables lack.
LARGER = {"composite_keys_lineitem": "/root/testdata/sf0.01"}


def _norm(df):
    columns = sorted(df.columns)
    text = lambda v: repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return df[columns].map(text).sort_values(columns).reset_index(drop=True)


def _duck(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    folder = LARGER.get(name, SF)
    got, want = QUERIES[name](spark, folder).toPandas(), _duck(folder).sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _norm(got).equals(_norm(want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 11
    assert set(ORACLES) <= set(__spark_entry__.queries())
