"""Queries: year share, ordering, climatology / anomaly / rolling / index,
lags, decomposition, ENSO phase (sections 2.5, 2.6, 2.7, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import rnd
from ..operators import clean, climate, resample, scale
from ..session import materialize
from . import standins as S
from .q_reshape import _CELLS_SQL, gen_cells, gen_classes
from .registry import CLASS_SQL, GEN_CTE, LOAD_CTE, R, query


def load_monthly(spark, base):
    """Dense monthly load sums per subsystem (the input of the index helper)."""
    ld = S.load_fact(spark, base)
    return resample.resample(ld, "ts", ["sub"], "value", "month", "sum")


LOAD_MONTHLY_SQL = f"""{LOAD_CTE},
lm AS (SELECT sub, last_day(CAST(ts AS DATE)) AS Data, SUM(value) AS value FROM ld GROUP BY ALL),
bounds AS (SELECT CAST(min(Data) AS TIMESTAMP) lo, CAST(max(Data) AS TIMESTAMP) hi FROM lm),
cal AS (SELECT last_day(CAST(d AS DATE)) AS Data FROM bounds,
        unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) t(d)),
m AS (SELECT k.sub, cal.Data, COALESCE(SUM(lm.value), 0) AS value
      FROM cal CROSS JOIN (SELECT DISTINCT sub FROM lm) k
      LEFT JOIN lm ON lm.sub = k.sub AND lm.Data = cal.Data GROUP BY ALL)"""


# --- AGG-8, AGG-9, PIP-11 ---------------------------------------------------
@query("year_share", sql=f"""
WITH {GEN_CTE}, y AS (SELECT make_date(year(ts), 12, 31) AS Data, {CLASS_SQL} AS cls, SUM(value) AS v
                      FROM gen GROUP BY ALL)
SELECT Data, cls, {R('v')} AS total, {R('100 * v / SUM(v) OVER (PARTITION BY Data)')} AS share_pct FROM y""")
def year_share(spark, base):
    g = gen_classes(spark, base)
    y = resample.resample(g, "ts", ["cls"], "value", "year", "sum", dense=False)
    w = Window.partitionBy("Data")
    return y.select("Data", "cls", rnd("value").alias("total"),
                    rnd(F.lit(100.0) * F.col("value") / F.sum("value").over(w)).alias("share_pct"))


# --- PIP-11: monthly means -> yearly sums, shares and order of the classes -----------
@query("yearly_mix", sql=f"""
WITH {GEN_CTE}, c AS (SELECT ts, {CLASS_SQL} AS cls, SUM(value) AS v FROM gen GROUP BY ALL),
m AS (SELECT last_day(CAST(ts AS DATE)) AS Data, cls, AVG(v) AS v FROM c GROUP BY ALL),
y AS (SELECT make_date(year(Data), 12, 31) AS Data, cls, SUM(v) AS v FROM m WHERE year(Data) > 1994 GROUP BY ALL),
t AS (SELECT cls, RANK() OVER (ORDER BY SUM(v) DESC, cls) AS rnk FROM y GROUP BY cls)
SELECT Data, cls, {R('v', 6)} AS total, {R('100 * v / SUM(v) OVER (PARTITION BY Data)')} AS share_pct,
  CAST(rnk AS INTEGER) AS rnk FROM y JOIN t USING (cls)""")
def yearly_mix(spark, base):
    """Yearly sums of the monthly means of each class, their shares of the year
    and the classes' order by grand total, after the year cut."""
    cells = gen_classes(spark, base).groupBy("ts", "cls").agg(F.sum("value").alias("value"))
    m = resample.resample(cells, "ts", ["cls"], "value", "month", "mean", dense=False)
    m = clean.year_range(m, "Data", after=1994)
    y = materialize(resample.resample(m.withColumnRenamed("Data", "month"), "month", ["cls"], "value", "year", "sum",
                                      dense=False))
    # one row per class: the global ordering runs on a handful of rows
    order = y.groupBy("cls").agg(F.sum("value").alias("v")).select(
        "cls", F.rank().over(Window.orderBy(F.col("v").desc(), "cls")).alias("rnk"))
    share = F.lit(100.0) * F.col("value") / F.sum("value").over(Window.partitionBy("Data"))
    return y.join(order, "cls").select("Data", "cls", rnd("value", 6).alias("total"), rnd(share).alias("share_pct"), "rnk")


# --- SRT-2 ------------------------------------------------------------------
@query("source_order", sql=f"""
WITH {GEN_CTE}, t AS (SELECT {CLASS_SQL} AS cls, SUM(value) AS v FROM gen GROUP BY ALL)
SELECT cls, {R('v')} AS total, CAST(RANK() OVER (ORDER BY v DESC) AS INTEGER) AS rnk FROM t""")
def source_order(spark, base):
    t = gen_classes(spark, base).groupBy("cls").agg(F.sum("value").alias("v"))
    # one row per source: the global ordering runs on a handful of rows
    return t.select("cls", rnd("v").alias("total"),
                    F.rank().over(Window.orderBy(F.col("v").desc())).alias("rnk"))


# --- AGG-10, JOI-6 ----------------------------------------------------------
@query("climatology", sql=f"""
WITH {LOAD_MONTHLY_SQL}
SELECT sub, CAST(month(Data) AS INTEGER) AS month, {R('AVG(value)')} AS clim FROM m GROUP BY ALL""")
def climatology_q(spark, base):
    c = climate.climatology(load_monthly(spark, base), ["sub"], "Data", "value")
    return c.select("sub", "month", rnd("clim").alias("clim"))


# --- WIN-2 ------------------------------------------------------------------
@query("anomaly", sql=f"""
WITH {LOAD_MONTHLY_SQL}
SELECT sub, Data, {R('value - AVG(value) OVER (PARTITION BY sub, month(Data))')} AS anomaly FROM m""")
def anomaly_q(spark, base):
    a = climate.anomaly(load_monthly(spark, base), ["sub"], "Data", "value")
    return a.select("sub", "Data", rnd("anomaly").alias("anomaly"))


# --- WIN-1 ------------------------------------------------------------------
@query("rolling3", sql=f"""
WITH {LOAD_MONTHLY_SQL}
SELECT sub, Data, {R('AVG(value) OVER (PARTITION BY sub ORDER BY Data ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')}
       AS rolling FROM m""")
def rolling3(spark, base):
    r = climate.rolling_mean(load_monthly(spark, base), ["sub"], "Data", "value", 3, out="rolling",
                             bucket=F.year("Data"))
    return r.select("sub", "Data", rnd("rolling").alias("rolling"))


# --- WIN-3, AGG-15 ----------------------------------------------------------
@query("std_index", sql=f"""
WITH {LOAD_MONTHLY_SQL}
SELECT sub, Data, {R('value / STDDEV_SAMP(value) OVER (PARTITION BY sub)', 6)} AS std_index FROM m""")
def std_index(spark, base):
    s = climate.std_normalize(load_monthly(spark, base), ["sub"], "value", out="std_index")
    return s.select("sub", "Data", rnd("std_index", 6).alias("std_index"))


# --- WIN-4 ------------------------------------------------------------------
ANOMALY_INDEX_SQL = f"""{LOAD_MONTHLY_SQL},
an AS (SELECT sub, Data, value - AVG(value) OVER (PARTITION BY sub, month(Data)) AS a FROM m),
ro AS (SELECT sub, Data, AVG(a) OVER (PARTITION BY sub ORDER BY Data ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r
       FROM an),
ix AS (SELECT sub, Data, r / STDDEV_SAMP(r) OVER (PARTITION BY sub) AS idx FROM ro)"""


@query("anomaly_index", sql=f"WITH {ANOMALY_INDEX_SQL} SELECT sub, Data, {R('idx', 6)} AS idx FROM ix")
def anomaly_index_q(spark, base):
    _, _, idx = climate.anomaly_index(load_monthly(spark, base), ["sub"], "Data", "value", bucket=F.year("Data"))
    return idx.select("sub", "Data", rnd("index", 6).alias("idx"))


# --- WIN-5 ------------------------------------------------------------------
@query("lags", sql=f"""
WITH {_CELLS_SQL},
bounds AS (SELECT CAST(min(ts) AS TIMESTAMP) lo, CAST(max(ts) AS TIMESTAMP) hi FROM cells),
cal AS (SELECT CAST(d AS DATE) AS Data FROM bounds, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) t(d)),
dd AS (SELECT k.series, cal.Data, COALESCE(SUM(c.value), 0) AS value
       FROM cal CROSS JOIN (SELECT DISTINCT series FROM cells) k
       LEFT JOIN cells c ON c.series = k.series AND CAST(c.ts AS DATE) = cal.Data GROUP BY ALL)
SELECT series, Data, {R('value')} AS value,
  {R('LAG(value, 15) OVER w')} AS value_lag15,
  {R('LAG(value, 30) OVER w')} AS value_lag30,
  {R('LAG(value, 60) OVER w')} AS value_lag60, {R('LAG(value, 400) OVER w')} AS value_lag400
FROM dd WINDOW w AS (PARTITION BY series ORDER BY Data)""")
def lags(spark, base):
    d = resample.resample(gen_cells(spark, base), "ts", ["series"], "value", "day", "sum")
    out = climate.add_lags(d, ["series"], "Data", "value", [15, 30, 60, 400], bucket=F.year("Data"))
    return out.select("series", "Data", *[rnd(c).alias(c) for c in
                                          ["value", "value_lag15", "value_lag30", "value_lag60", "value_lag400"]])


# --- DEC-1 ------------------------------------------------------------------
@query("decompose", sql=f"""
WITH {_CELLS_SQL},
bounds AS (SELECT CAST(min(ts) AS TIMESTAMP) lo, CAST(max(ts) AS TIMESTAMP) hi FROM cells),
cal AS (SELECT last_day(CAST(d AS DATE)) AS Data FROM bounds,
        unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) t(d)),
mm AS (SELECT k.series, cal.Data, AVG(c.value) AS value
       FROM cal CROSS JOIN (SELECT DISTINCT series FROM cells) k
       LEFT JOIN cells c ON c.series = k.series AND last_day(CAST(c.ts AS DATE)) = cal.Data GROUP BY ALL),
z AS (SELECT series, Data, (value - AVG(value) OVER (PARTITION BY series))
        / COALESCE(NULLIF(STDDEV_POP(value) OVER (PARTITION BY series), 0), 1) AS value FROM mm),
t AS (SELECT series, Data, value, month(Data) AS pos,
        CASE WHEN COUNT(value) OVER w13 = 13
             THEN (SUM(value) OVER w13 - 0.5 * (LAG(value, 6) OVER w + LEAD(value, 6) OVER w)) / 12.0 END AS trend
      FROM z WINDOW w AS (PARTITION BY series ORDER BY Data),
                    w13 AS (PARTITION BY series ORDER BY Data ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
d AS (SELECT series, pos, AVG(value - trend) AS m FROM t GROUP BY ALL),
s AS (SELECT series, pos, m - AVG(m) OVER (PARTITION BY series) AS seasonal FROM d)
SELECT t.series, t.Data, {R('t.value')} AS value, {R('t.trend')} AS trend, {R('s.seasonal')} AS seasonal,
       {R('t.value - t.trend - s.seasonal')} AS resid
FROM t JOIN s ON t.series = s.series AND t.pos = s.pos""")
def decompose_q(spark, base):
    m = resample.resample(gen_cells(spark, base), "ts", ["series"], "value", "month", "mean")
    z = scale.standardize(m, ["series"], "value")
    d = climate.decompose(z, ["series"], "Data", "value")
    return d.select("series", "Data", *[rnd(c).alias(c) for c in ["value", "trend", "seasonal", "resid"]])


# --- DEC-1 (locally weighted) -------------------------------------------------
LOESS_PERIOD, LOESS_SPAN, LOESS_INNER = 12, 11, 5


def _loess_sql(src, by, x, y, span, last, extend=0, out="fit"):
    """Local lines at -extend .. last + extend from (by, x, y, last) of ``src``."""
    half, reach = (span - 1) // 2, span + extend
    return f"""(SELECT {by}, px AS {x}, (t0 + CASE WHEN c > (0.001 * last) ^ 2 THEN -a / c * (t1 - a * t0) ELSE 0 END) / s0 AS {out}
 FROM (SELECT *, s1 / s0 AS a, s2 / s0 - (s1 / s0) ^ 2 AS c FROM (
  SELECT {by}, px, last, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * y) AS t0, sum(w * d * y) AS t1 FROM (
   SELECT *, CASE WHEN abs(d) <= 0.001 * h THEN 1.0 WHEN abs(d) <= 0.999 * h THEN (1 - (abs(d) / h) ^ 3) ^ 3 ELSE 0 END AS w FROM (
    SELECT *, (j - px)::DOUBLE AS d, (greatest(px - lo, hi - px) + floor(greatest({span} - last - 1, 0) / 2))::DOUBLE AS h FROM (
     SELECT *, CASE WHEN last + 1 <= {span} THEN last ELSE lo + {span} - 1 END AS hi FROM (
      SELECT *, CASE WHEN last + 1 <= {span} THEN 0 ELSE greatest(0, least(px - {half}, last - {span} + 1)) END AS lo FROM (
       SELECT {by}, {x} AS j, {y} AS y, {last} AS last, unnest(range({x} - {reach}, {x} + {reach} + 1)) AS px FROM {src} WHERE {y} IS NOT NULL)
      WHERE px >= -{extend} AND px <= last + {extend}))
    WHERE j >= lo AND j <= hi))
  GROUP BY {by}, px, last)) WHERE s0 > 0)"""


def _decompose_loess_sql():
    p, ctes = LOESS_PERIOD, []
    for i in range(LOESS_INNER):
        sub = f"(SELECT series, n, pos % {p} AS phase, pos // {p} AS cycle, v - trend AS y FROM st{i})"
        ctes.append(f"""cy{i} AS MATERIALIZED (SELECT series, n, cycle * {p} + phase AS pos, c FROM
  {_loess_sql(sub, 'series, n, phase', 'cycle', 'y', LOESS_SPAN, f'((n - 1 - phase) // {p})', 1, 'c')}),
m1{i} AS (SELECT *, avg(c) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND {p - 1} FOLLOWING) AS m FROM cy{i}),
m2{i} AS (SELECT * REPLACE (avg(m) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND {p - 1} FOLLOWING) AS m)
  FROM m1{i}),
m3{i} AS MATERIALIZED (SELECT series, n, pos + {p} AS pos, m FROM (SELECT * REPLACE (avg(m) OVER (PARTITION BY series ORDER BY pos
  ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m) FROM m2{i}) WHERE pos + {p} < n),
lo{i} AS MATERIALIZED {_loess_sql(f'm3{i}', 'series, n', 'pos', 'm', p + 1, '(n - 1)', 0, 'low')},
se{i} AS MATERIALIZED (SELECT st{i}.* EXCLUDE (trend), cy{i}.c - lo{i}.low AS seasonal
  FROM st{i} JOIN cy{i} USING (series, pos) JOIN lo{i} USING (series, pos)),
tr{i} AS MATERIALIZED {_loess_sql(f'(SELECT *, v - seasonal AS de FROM se{i})', 'series, n', 'pos', 'de', 21, '(n - 1)', 0, 'trend')},
st{i + 1} AS MATERIALIZED (SELECT se{i}.* {'EXCLUDE (seasonal)' if i + 1 < LOESS_INNER else ''}, tr{i}.trend
  FROM se{i} JOIN tr{i} USING (series, pos))""")
    return ",\n".join(ctes)


@query("decompose_loess", sql=f"""
WITH {_CELLS_SQL},
bounds AS (SELECT CAST(min(ts) AS TIMESTAMP) lo, CAST(max(ts) AS TIMESTAMP) hi FROM cells),
cal AS (SELECT last_day(CAST(d AS DATE)) AS Data FROM bounds,
        unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) t(d)),
mm AS (SELECT k.series, cal.Data, AVG(c.value) AS value
       FROM cal CROSS JOIN (SELECT DISTINCT series FROM cells) k
       LEFT JOIN cells c ON c.series = k.series AND last_day(CAST(c.ts AS DATE)) = cal.Data GROUP BY ALL),
z AS (SELECT series, Data, (value - AVG(value) OVER (PARTITION BY series))
        / COALESCE(NULLIF(STDDEV_POP(value) OVER (PARTITION BY series), 0), 1) AS v FROM mm),
st0 AS MATERIALIZED (SELECT series, Data, v, row_number() OVER (PARTITION BY series ORDER BY Data) - 1 AS pos,
        count(*) OVER (PARTITION BY series) AS n, 0.0::DOUBLE AS trend FROM z),
{_decompose_loess_sql()}
SELECT series, Data, {R('v')} AS value, {R('trend')} AS trend, {R('seasonal')} AS seasonal,
       {R('v - trend - seasonal')} AS resid FROM st{LOESS_INNER}""")
def decompose_loess_q(spark, base):
    from ..operators.loess import decompose_loess
    m = resample.resample(gen_cells(spark, base), "ts", ["series"], "value", "month", "mean")
    z = scale.standardize(m, ["series"], "value")
    d = decompose_loess(z, ["series"], "Data", "value", [LOESS_PERIOD], [LOESS_SPAN], inner=LOESS_INNER)
    return d.select("series", "Data", *[rnd(c).alias(c) for c in ["value", "trend", "seasonal", "resid"]])


# --- GEO-4, AGG-17 ----------------------------------------------------------
@query("phase_label", sql=f"""
WITH {ANOMALY_INDEX_SQL},
st AS (SELECT sub, MIN(idx) lo, MAX(idx) hi FROM ix GROUP BY sub),
dd AS (SELECT ix.sub, ix.Data, ix.idx, abs(idx - lo) d0, abs(idx - lo / 4) d1, abs(idx - (lo + hi) / 2) d2,
              abs(idx - hi / 2) d3, abs(idx - hi) d4, lo, hi FROM ix JOIN st USING (sub))
SELECT sub, Data, {R('idx', 6)} AS idx, {R('lo', 6)} AS lo, {R('hi', 6)} AS hi,
  CASE WHEN idx IS NULL THEN NULL
       WHEN d0 = least(d0, d1, d2, d3, d4) THEN 'La Niña forte'
       WHEN d1 = least(d0, d1, d2, d3, d4) THEN 'La Niña médio'
       WHEN d2 = least(d0, d1, d2, d3, d4) THEN 'Neutralidade'
       WHEN d3 = least(d0, d1, d2, d3, d4) THEN 'El Niño médio'
       ELSE 'El Niño forte' END AS phase
FROM dd""")
def phase_label_q(spark, base):
    _, _, idx = climate.anomaly_index(load_monthly(spark, base), ["sub"], "Data", "value", bucket=F.year("Data"))
    st = idx.groupBy("sub").agg(F.min("index").alias("lo"), F.max("index").alias("hi"))
    lab = climate.phase_label(idx, ["sub"], "index").join(st, ["sub"])
    return lab.select("sub", "Data", rnd("index", 6).alias("idx"), rnd("lo", 6).alias("lo"),
                      rnd("hi", 6).alias("hi"), "phase")
