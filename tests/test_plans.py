"""Physical-plan checks: pushdown, pruning, single-shuffle pivots, broadcast
dimensions, no single-partition exchanges over facts."""

import datetime as dt

from pyspark.sql import functions as F

from enclima.dims import regions_df
from enclima.operators import clean, regions, reshape, resample
from enclima.plans import standins as S
from enclima.session import read_table

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_year_filter_pushed_to_parquet(spark):
    o = read_table(spark, SF_SMALL, "orders").select("o_orderdate", "o_totalprice")
    p = _plan(clean.year_range(o, "o_orderdate", after=1996, before=2001))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in p \
        or "ReadSchema: struct<o_orderdate:timestamp_ntz,o_totalprice:double>" in p


def test_fact_scan_prunes_columns(spark):
    p = _plan(S.gen_fact(spark, SF_SMALL))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in p
    assert "o_orderstatus" not in p


def test_pivot_is_one_shuffle_on_time_key(spark):
    g = S.gen_fact(spark, SF_SMALL)
    w = reshape.class_subsystem_wide(g, "ts", "cat", "sub", "value",
                                     ["1-URGENT", "2-HIGH"], ["ASIA", "EUROPE"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = w._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    agg_exchanges = [ln for ln in p.splitlines() if "Exchange hashpartitioning(ts#" in ln]
    assert len(agg_exchanges) == 1 and "partial_sum" in p and "SinglePartition" not in p


def test_dense_resample_has_no_join_and_no_single_partition(spark):
    cells = S.gen_fact(spark, SF_SMALL).groupBy("ts", "cat").agg(F.sum("value").alias("value"))
    p = _plan(resample.resample(cells, "ts", ["cat"], "value", "day", "mean"))
    assert "SinglePartition" not in p and "Union" in p
    assert "SortMergeJoin" not in p.split("Union")[0]


def test_region_join_broadcasts_literal_dimension(spark):
    grid = regions.grid_from_arrays(S.grid_arrays(spark, SF_SMALL), "Data", "values", S.GRID_LATS, S.GRID_LONS)
    p = _plan(regions.region_stat(grid, regions_df(spark), "median"))
    assert "NestedLoopJoin" not in p and "Cartesian" not in p and "SinglePartition" not in p


def test_remap_is_a_projection(spark):
    p = _plan(clean.remap_values(S.gen_fact(spark, SF_SMALL), "cat", S.PRIORITY_CLASS, out="cls"))
    assert p.count("Exchange") == S.gen_fact(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString().count("Exchange")
