"""Queries: remap, pivots, grouping sets, dense resamples (sections 2.2, 2.3, 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import hour_start
from ..functions import rnd
from ..operators import clean, reshape, resample
from . import standins as S
from .registry import CLASS_SQL, GEN_CTE, HOURLY_CTE, LOAD_CTE, R, query

SUBS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
CLASSES = ["3-MEDIUM", "HIGH", "OTHER"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
LOAD_MEASURES = ["l_quantity", "l_extendedprice", "l_tax"]


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def gen_classes(spark, base):
    """GEN with its categories re-classified (PRJ-1, PRJ-2)."""
    return clean.remap_values(S.gen_fact(spark, base), "cat", S.PRIORITY_CLASS, out="cls")


def round_all(df, keep):
    return df.select(*keep, *[rnd(c).alias(c) for c in df.columns if c not in keep])


# --- PRJ-1, PRJ-2, FLT-5 ----------------------------------------------------
@query("category_remap_sum", sql=f"""
WITH {GEN_CTE}
SELECT {CLASS_SQL} AS cls, sub, {R('SUM(value)')} AS total, COUNT(*) AS n
FROM gen GROUP BY ALL""")
def category_remap_sum(spark, base):
    g = gen_classes(spark, base)
    return g.groupBy("cls", "sub").agg(rnd(F.sum("value")).alias("total"), F.count("*").alias("n"))


# --- RSH-2, PRJ-7, S2, S4 ---------------------------------------------------
def _pivot_hourly_sql():
    cols = ", ".join(
        f"{R(f'SUM(value) FILTER (WHERE key = {chr(39)}{k}{chr(39)})')} AS {_q('EV_' + k)}"
        for k in EVENT_TYPES)
    return f"WITH {HOURLY_CTE} SELECT date_trunc('hour', ts) AS Data, {cols} FROM hr GROUP BY 1"


@query("pivot_hourly", sql=_pivot_hourly_sql())
def pivot_hourly(spark, base):
    h = S.hourly_fact(spark, base).withColumn("Data", hour_start("ts"))
    wide = reshape.pivot_series(h, "Data", "key", "value", prefix="EV_")
    return round_all(wide, ["Data"])


# --- RSH-3, AGG-21 (long) ---------------------------------------------------
@query("class_subsystem_sets", sql=f"""
WITH {GEN_CTE}, g AS (SELECT ts, {CLASS_SQL} AS cls, sub, value FROM gen)
SELECT ts AS Data, cls, sub, {R('COALESCE(SUM(value), 0)')} AS value
FROM g GROUP BY GROUPING SETS ((ts, cls), (ts, cls, sub))""")
def class_subsystem_sets(spark, base):
    g = gen_classes(spark, base)
    out = reshape.class_subsystem_sets(g, "ts", "cls", "sub", "value")
    return out.select(F.col("ts").alias("Data"), "cls", "sub", rnd("value").alias("value"))


# --- RSH-3, AGG-21, JOI-2, AGG-20 (wide) ------------------------------------
def _class_wide_sql():
    cols = [f"{R(f'SUM(value) FILTER (WHERE cls = {chr(39)}{c}{chr(39)})')} AS {_q(c)}" for c in CLASSES]
    cols += [f"{R(f'SUM(value) FILTER (WHERE cls = {chr(39)}{c}{chr(39)} AND sub = {chr(39)}{s}{chr(39)})')}"
             f" AS {_q(c + '_' + s)}" for c in CLASSES for s in SUBS]
    return (f"WITH {GEN_CTE}, g AS (SELECT ts, {CLASS_SQL} AS cls, sub, value FROM gen) "
            f"SELECT ts AS Data, {', '.join(cols)} FROM g GROUP BY ts")


@query("class_subsystem_wide", sql=_class_wide_sql())
def class_subsystem_wide(spark, base):
    g = gen_classes(spark, base)
    wide = reshape.class_subsystem_wide(g, "ts", "cls", "sub", "value").withColumnRenamed("ts", "Data")
    return round_all(wide, ["Data"])


# --- AGG-1, RSH-4 -----------------------------------------------------------
def _multi_measure_sql():
    cols = [f"{R(f'SUM({m}) FILTER (WHERE sub = {chr(39)}{s}{chr(39)})')} AS {_q(s + '_' + m)}"
            for s in SUBS for m in LOAD_MEASURES]
    return f"WITH {LOAD_CTE} SELECT CAST(ts AS DATE) AS Data, {', '.join(cols)} FROM ld GROUP BY 1"


@query("multi_measure_pivot", sql=_multi_measure_sql())
def multi_measure_pivot(spark, base):
    ld = S.load_fact(spark, base).withColumn("Data", F.to_date("ts"))
    wide = reshape.multi_measure_pivot(ld, "Data", "sub", LOAD_MEASURES)
    return round_all(wide, ["Data"])


# --- dense resamples (AGG-2..6, AGG-8, S2, S3, DAT-3, DAT-4) ------------------
def gen_cells(spark, base):
    """Hourly-table cells of GEN: one row per (ts, series) with the sum."""
    g = S.gen_fact(spark, base)
    return g.groupBy("ts", F.col("cat").alias("series")).agg(F.sum("value").alias("value"))


_CELLS_SQL = f"{GEN_CTE}, cells AS (SELECT ts, cat AS series, SUM(value) AS value FROM gen GROUP BY ALL)"


def _dense_sql(label: str, step: str, agg: str, lo_hi_label: str | None = None) -> str:
    """Dense calendar oracle: every label between global bounds x every series."""
    lab = label.format(x="ts")
    if step == "month":
        cal = ("SELECT last_day(CAST(d AS DATE)) AS Data FROM bounds, "
               "unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) t(d)")
    elif step == "year":
        cal = ("SELECT make_date(year(d), 12, 31) AS Data FROM bounds, "
               "unnest(generate_series(date_trunc('year', lo), date_trunc('year', hi), INTERVAL 1 YEAR)) t(d)")
    else:
        interval = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY"}[step]
        cal = f"SELECT CAST(d AS DATE) AS Data FROM bounds, unnest(generate_series(lo, hi, {interval})) t(d)"
    return f"""
WITH {_CELLS_SQL},
bounds AS (SELECT CAST(min({lab}) AS TIMESTAMP) AS lo, CAST(max({lab}) AS TIMESTAMP) AS hi FROM cells),
cal AS ({cal}),
keys AS (SELECT DISTINCT series FROM cells),
lab AS (SELECT series, {lab} AS Data, value FROM cells)
SELECT keys.series, cal.Data, {agg} AS value
FROM cal CROSS JOIN keys LEFT JOIN lab ON lab.Data = cal.Data AND lab.series = keys.series
GROUP BY ALL"""


DAY = "CAST({x} AS DATE)"
WEEK = "CAST(date_trunc('week', {x}) AS DATE) + 6"
MONTH = "last_day(CAST({x} AS DATE))"
YEAR = "make_date(year({x}), 12, 31)"
SUM0 = R("COALESCE(SUM(value), 0)")
# Means round at 6 decimals: a mean of cent values over n <= 31 rows can end
# exactly on a 5 at the 5th decimal (8 | n), a rounding tie decided by the
# last bit of each engine's sum; at 6 decimals that needs 32 | n.
MEAN = R("AVG(value)", 6)


def _resample_query(freq, how):
    def run(spark, base):
        out = resample.resample(gen_cells(spark, base), "ts", ["series"], "value", freq, how)
        return out.select("series", "Data", rnd("value", 6 if how == "mean" else 4).alias("value"))
    return run


for _name, _freq, _how, _lab in [
    ("resample_day_sum", "day", "sum", DAY),
    ("resample_day_mean", "day", "mean", DAY),
    ("resample_week_mean", "week", "mean", WEEK),
    ("resample_month_sum", "month", "sum", MONTH),
    ("resample_month_mean", "month", "mean", MONTH),
    ("resample_year_sum", "year", "sum", YEAR),
]:
    query(_name, sql=_dense_sql(_lab, _freq, SUM0 if _how == "sum" else MEAN))(_resample_query(_freq, _how))
