"""Driver contract: flagship query, catalogue, and the DuckDB oracle gate on
the smallest driver tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, rows_key, type_mismatches  # noqa: E402

from conftest import SF_SMALL

# Least squares on every predictor: the smallest tables have fewer complete
# training days than predictors, so these run on the next size.
SF_FITS = SF_SMALL.replace("sf0.001", "sf0.01")
FITS = {"ols_study", "ols_ablation"}

SQL = E.oracle_sql()


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and df.columns[0] == "Data" and len(df.columns) == 19


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    def connect(sf):
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        return c
    return {sf: connect(sf) for sf in (SF_SMALL, SF_FITS)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    sf = SF_FITS if name in FITS else SF_SMALL
    df = E.queries()[name](spark, sf)
    srows, scols = [tuple(r) for r in df.collect()], df.columns
    rel = con[sf].sql(SQL[name])
    dcols, dtypes, drows = rel.columns, rel.types, rel.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert not type_mismatches(df.dtypes, dcols, dtypes)
    assert rows_key(scols, srows) == rows_key(dcols, drows)
