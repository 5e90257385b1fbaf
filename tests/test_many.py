"""Exact quantiles of large groups and boxes through a tile index."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from enclima.operators import regions
from enclima.operators.quantile import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_quantiles_of_hot_and_small_groups(spark, accuracy):
    rng = random.Random(6)
    groups = {"hot": [rng.lognormvariate(0, 8) * rng.choice([-1, 1]) for _ in range(6000)],
              "ties": [5.0] * 2500 + [rng.choice([1.0, 5.0, 7.0]) for _ in range(700)],
              "one": [3.25], "two": [1.0, 2.0], None: [float(i) for i in range(11)], "wide": [1e308, -1e308, 5e-324, 0.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "`the key` string, v double").repartition(5)
    got = {r["the key"]: r for r in exact_quantiles(df, ["the key"], "v", PROBS, accuracy).collect()}
    assert set(got) == {*groups, "none"} and got["none"].n == 0 and got["none"].quantiles == [None] * len(PROBS)
    for k, vs in groups.items():
        assert got[k].n == len(vs)
        s = sorted(vs)
        for q, x in zip(PROBS, got[k].quantiles):
            rank = (len(s) - 1) * q
            low, high = s[int(np.floor(rank))], s[int(np.ceil(rank))]
            assert x == pytest.approx(low + (rank - np.floor(rank)) * (high - low), rel=1e-12, abs=0)


def test_no_task_holds_a_hot_group(spark):
    """A group's rows are added up before they meet: the window sees distinct
    values between the sketch's bounds only."""
    df = spark.range(0, 200_000, 1, 4).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    r = exact_quantiles(df, ["k"], "v", [0.5], accuracy=1000).first()
    s = sorted((i * 7919 % 200_003) for i in range(200_000))
    assert r.quantiles[0] == (s[99_999] + s[100_000]) / 2
    plan = exact_quantiles(df, ["k"], "v", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "collect_list(v" not in plan


def boxes(n, seed=2):
    rng, out = random.Random(seed), []
    for i in range(n):
        south, west = rng.uniform(-90, 80), rng.uniform(-180, 170)
        east = west + rng.uniform(0, 10) if i % 5 else -180 + rng.uniform(0, 20)       # every fifth crosses the date line
        out.append((f"r{i}", south + rng.uniform(-1, 12), south, west, east))
    return out + [("line", 10.0, 10.0, 20.0, 20.0), ("corner", -85.0, -90.0, 175.0, 180.0), ("none", -5.0, 5.0, 0.0, 9.0)]


def test_many_boxes_as_tested_one_by_one(spark):
    rng = random.Random(3)
    cells = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(400)] + [
        (900, 10.0, 20.0), (901, -90.0, 180.0), (902, 0.0, -180.0), (903, None, 1.0)]
    own = boxes(300)
    want = {(i, n) for i, lat, lon in cells if lat is not None for n, north, south, west, east in own
            if south <= lat <= north and (west <= lon <= east if west <= east else lon >= west or lon <= east)}
    grid = spark.createDataFrame(cells, "id long, lat double, lon double")
    table = spark.createDataFrame(own, "region string, north double, south double, west double, east double")
    for few, tile in ((64, 5.0), (64, 0.7), (1000, 5.0)):
        got = regions.cells_in_regions(grid, table, few=few, tile=tile).select("id", "region").collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == want
    plan = regions.cells_in_regions(grid, table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ten_thousand_boxes(spark):
    table = spark.createDataFrame(boxes(10_000), "region string, north double, south double, west double, east double")
    grid = spark.range(500).select("id", (F.rand(1) * 180 - 90).alias("lat"), (F.rand(2) * 360 - 180).alias("lon"))
    assert regions.cells_in_regions(grid, table).count() > 500


def test_spread_boxes_are_not_broadcast(spark):
    """The planner sees few bytes of boxes, not the many rows they spread to."""
    table = spark.range(5000).selectExpr("id AS region", "-60.0D AS south", "60.0D AS north", "-170.0D AS west", "170.0D AS east")
    grid = spark.range(0, 4_000_000, 1, 4).selectExpr("id", "id % 90 + 0.5D AS lat", "id % 180 + 0.5D AS lon")
    plan = regions.cells_in_regions(grid, table)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
