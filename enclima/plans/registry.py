"""Registry of named queries over the driver tables and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, base) -> DataFrame`` under ``name``; ``sql`` is the
    equivalent DuckDB statement over the same tables (None = rows-only check)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        fn.query_name = name
        return fn
    return deco


def R(expr: str, digits: int = 4) -> str:
    """SQL rounding that matches ``F.round`` (and never yields -0.0)."""
    return f"(ROUND(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


# Stand-in facts in SQL (see standins.py).
GEN_CTE = """gen AS (
  SELECT o.o_orderdate AS ts, r.r_name AS sub, o.o_orderpriority AS cat, o.o_totalprice AS value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""

LOAD_CTE = """ld AS (
  SELECT l.l_shipdate AS ts, r.r_name AS sub, l.l_quantity AS value,
         l.l_quantity, l.l_extendedprice, l.l_tax
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""

HOURLY_CTE = """hr AS (SELECT ts, event_type AS key, value FROM events)"""

CLASS_SQL = ("CASE WHEN cat IN ('1-URGENT', '2-HIGH') THEN 'HIGH' "
             "WHEN cat IN ('4-NOT SPECIFIED', '5-LOW') THEN 'OTHER' ELSE cat END")
