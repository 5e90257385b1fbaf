"""Queries: splits, folds, windows, forecasts, least squares, forests and
scoring (sections 2.6, 2.11)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clamp_negative, rnd
from ..operators import align, evaluate, forecast, split
from ..operators.regress import LinearModel
from ..session import materialize
from .q_frames import (_CELLS_DAY_SQL, GEN_CLASS_DAILY_SQL, LOAD_DAILY_SQL, gen_class_daily, gen_daily_long,
                       load_daily)
from .q_reshape import CLASSES, SUBS, _q
from .registry import R, query

CONTEXT, HORIZON, SEASON = 28, 7, 7
SPLIT_CONTEXT = 30


# --- WIN-6 ------------------------------------------------------------------
@query("split_70_30", sql=f"""
WITH {GEN_CLASS_DAILY_SQL},
p AS (SELECT Data, ROW_NUMBER() OVER (ORDER BY Data) AS rn, COUNT(*) OVER () AS n FROM gcd)
SELECT Data, CASE WHEN rn <= n - CAST(ceil(CAST(0.3 AS DOUBLE) * n) AS BIGINT) THEN 'train' ELSE 'test' END AS split
FROM p""")
def split_70_30(spark, base):
    return split.train_test_split(gen_class_daily(spark, base), "Data", 0.3).select("Data", "split")


# --- WIN-7 ------------------------------------------------------------------
@query("split_70_10_20", sql=f"""
WITH {GEN_CLASS_DAILY_SQL},
p AS (SELECT Data, ROW_NUMBER() OVER (ORDER BY Data) - 1 AS r, COUNT(*) OVER () AS n FROM gcd),
b AS (SELECT DISTINCT n AS nn, CAST(floor(CAST(0.7 AS DOUBLE) * n) AS BIGINT) AS a7,
             CAST(floor(CAST(0.8 AS DOUBLE) * n) AS BIGINT) AS a8 FROM p)
SELECT Data, 'train' AS split FROM p, b WHERE r < a7
UNION ALL SELECT Data, 'valid' FROM p, b WHERE r >= a7 - {SPLIT_CONTEXT} AND r < a8
UNION ALL SELECT Data, 'test' FROM p, b WHERE r >= a8 - {SPLIT_CONTEXT} AND r < nn""")
def split_70_10_20(spark, base):
    s = split.fraction_splits(gen_class_daily(spark, base), "Data", context=SPLIT_CONTEXT)
    return s.select("Data", "split")


# --- WIN-8 ------------------------------------------------------------------
@query("ts_cv_folds", sql=f"""
WITH {GEN_CLASS_DAILY_SQL},
p AS (SELECT Data, ROW_NUMBER() OVER (ORDER BY Data) - 1 AS r, COUNT(*) OVER () AS n FROM gcd),
g AS (SELECT Data, r, i, n - (5 - i) * (n // 6) AS s, n // 6 AS sz FROM p, range(0, 5) t(i))
SELECT Data, CAST(i AS INTEGER) AS fold, CASE WHEN r < s THEN 'train' ELSE 'test' END AS role
FROM g WHERE r < s + sz""")
def ts_cv_folds(spark, base):
    f = split.time_series_folds(gen_class_daily(spark, base), "Data", 5)
    return f.select("Data", "fold", "role")


# --- WIN-9 ------------------------------------------------------------------
def _windows_sql(context, horizon):
    return f"""{_CELLS_DAY_SQL},
w AS (SELECT series, Data AS origin, value,
        COUNT(*) OVER wc AS nc, MIN(Data) OVER wc AS ctx_start, AVG(value) OVER wc AS ctx_mean,
        COUNT(*) OVER wh AS nh, MAX(Data) OVER wh AS hz_end, AVG(value) OVER wh AS hz_mean
      FROM dd
      WINDOW wc AS (PARTITION BY series ORDER BY Data ROWS BETWEEN {context - 1} PRECEDING AND CURRENT ROW),
             wh AS (PARTITION BY series ORDER BY Data ROWS BETWEEN 1 FOLLOWING AND {horizon} FOLLOWING)),
fw AS (SELECT * FROM w WHERE nc = {context} AND nh = {horizon})"""


_W_SQL = _windows_sql(CONTEXT, HORIZON)
LONG_CONTEXT, LONG_HORIZON = 512, 96


def gen_windows(spark, base, context=CONTEXT, horizon=HORIZON, daily=None):
    # year buckets with overlapping edges: no task holds a whole series
    return split.context_windows(gen_daily_long(spark, base) if daily is None else daily, ["series"], "Data", "value", context, horizon,
                                 bucket=F.year("Data"))


def _arr_mean(c):
    return F.aggregate(F.transform(F.col(c), lambda s: s["v"]), F.lit(0.0), lambda a, v: a + v) / F.size(c)


def _window_rows(w):
    return w.select("series", "origin", F.element_at("context", 1)["t"].alias("ctx_start"),
                    rnd(_arr_mean("context")).alias("ctx_mean"), F.element_at("horizon", -1)["t"].alias("hz_end"),
                    rnd(_arr_mean("horizon")).alias("hz_mean"))


@query("context_windows", sql=f"""WITH {_W_SQL}
SELECT series, origin, ctx_start, {R('ctx_mean')} AS ctx_mean, hz_end, {R('hz_mean')} AS hz_mean FROM fw""")
def context_windows(spark, base):
    return _window_rows(gen_windows(spark, base))


@query("context_windows_long", sql=f"""WITH {_windows_sql(LONG_CONTEXT, LONG_HORIZON)}
SELECT series, origin, ctx_start, {R(f'ctx_mean * {LONG_CONTEXT}', 2)} AS ctx_total, hz_end,
  {R(f'hz_mean * {LONG_HORIZON}', 2)} AS hz_total FROM fw""")
def context_windows_long(spark, base):
    """Windows longer than their year bucket: 512 days of context, 96 of horizon
    (totals of cent values, so that no rounding tie arises)."""
    w = gen_windows(spark, base, LONG_CONTEXT, LONG_HORIZON)
    return w.select("series", "origin", F.element_at("context", 1)["t"].alias("ctx_start"),
                    rnd(_arr_mean("context") * LONG_CONTEXT, 2).alias("ctx_total"),
                    F.element_at("horizon", -1)["t"].alias("hz_end"),
                    rnd(_arr_mean("horizon") * LONG_HORIZON, 2).alias("hz_total"))


# --- WIN-10, FCS-1 (naive) --------------------------------------------------
_EXPLODE_SQL = f"""{_W_SQL},
ex AS (SELECT series, origin, CAST(s AS INTEGER) AS step, CAST(origin + CAST(s AS INTEGER) AS DATE) AS Data,
              value AS predicted FROM fw, range(1, {HORIZON + 1}) t(s))"""


def naive_exploded(spark, base, daily=None):
    return forecast.explode_forecasts(forecast.naive(gen_windows(spark, base, daily=daily), HORIZON), ["series"])


@query("forecast_explode", sql=f"""WITH {_EXPLODE_SQL}
SELECT series, origin, step, Data, {R('predicted')} AS predicted FROM ex""")
def forecast_explode(spark, base):
    e = naive_exploded(spark, base)
    return e.select("series", "origin", "step", "Data", rnd("predicted").alias("predicted"))


# --- AGG-14 -----------------------------------------------------------------
@query("forecast_overlap_mean", sql=f"""WITH {_EXPLODE_SQL}
SELECT series, Data, {R('AVG(predicted)')} AS predicted, COUNT(*) AS n_forecasts FROM ex GROUP BY ALL""")
def forecast_overlap_mean(spark, base):
    m = forecast.overlap_mean(naive_exploded(spark, base), ["series"])
    return m.select("series", "Data", rnd("predicted").alias("predicted"), "n_forecasts")


# --- FCS-3 (naive forecaster end to end) --------------------------------------
@query("forecast_naive", sql=f"""WITH {_EXPLODE_SQL},
om AS (SELECT series, Data, AVG(predicted) AS predicted FROM ex GROUP BY ALL),
j AS (SELECT om.series, om.Data, dd.value AS actual, om.predicted FROM om JOIN dd USING (series, Data))
SELECT series, last_day(Data) AS Data, {R('AVG(actual)', 6)} AS actual, {R('AVG(predicted)', 6)} AS predicted
FROM j GROUP BY ALL""")
def forecast_naive(spark, base):
    daily = materialize(gen_daily_long(spark, base))            # one pass over the facts
    om = forecast.overlap_mean(naive_exploded(spark, base, daily), ["series"])
    actual = daily.withColumnRenamed("value", "actual")
    a, p = align.restrict_to_common(actual, om, "Data")
    j = p.join(a, ["series", "Data"])
    m = evaluate.month_mean(j, ["series"], "Data", ["actual", "predicted"])
    return m.select("series", "Data", rnd("actual", 6).alias("actual"), rnd("predicted", 6).alias("predicted"))


# --- FCS-1 (seasonal naive) -------------------------------------------------
@query("forecast_seasonal", sql=f"""WITH {_W_SQL},
ex AS (SELECT fw.series, fw.origin, CAST(s AS INTEGER) AS step, CAST(fw.origin + CAST(s AS INTEGER) AS DATE) AS Data,
              CAST(fw.origin + CAST(s AS INTEGER) - {SEASON} AS DATE) AS src FROM fw, range(1, {HORIZON + 1}) t(s))
SELECT ex.series, ex.origin, ex.step, ex.Data, {R('dd.value')} AS predicted
FROM ex JOIN dd ON dd.series = ex.series AND dd.Data = ex.src""")
def forecast_seasonal(spark, base):
    fc = forecast.seasonal(gen_windows(spark, base), HORIZON, SEASON)
    e = forecast.explode_forecasts(fc, ["series"])
    return e.select("series", "origin", "step", "Data", rnd("predicted").alias("predicted"))


# --- FCS-1 / FCS-2 (linear) -----------------------------------------------------
RIDGE = 1e-3


def _linear_forecast(spark, base, with_exog: bool):
    from ..operators import lagged, scale
    d = gen_daily_long(spark, base)
    exog = ["load"] if with_exog else []
    if with_exog:
        ld = load_daily(spark, base)
        tot = ld.select("Data", sum(F.coalesce(F.col(f"`{c}`"), F.lit(0.0))
                                    for c in ld.columns if c != "Data").alias("load"))
        d = d.join(tot, "Data", "left")
    d = materialize(split.train_test_split(d, "Data", 0.3))
    learn = F.col("split") == "train"
    params = scale.fit_scaler(d, ["series"], "value", where=learn)
    z = scale.apply_scaler(d, params, ["series"], "value")
    if with_exog:
        z = scale.standardize_wide(z, exog, learn)
    z = materialize(z.join(split.date_positions(d, "Data").select("Data", "pos"), "Data"))
    models = lagged.fit_windows(z.where(learn), ["series"], "pos", "value", CONTEXT, HORIZON, exog, [RIDGE])
    om = lagged.forecast_mean(z, ["series"], "pos", "value", CONTEXT, HORIZON, "linear", models, exog,
                              origins=F.col("split") == "test")
    back = scale.apply_scaler(om, params, ["series"], "predicted", inverse=True)
    place = z.select("series", "pos", "Data")
    out = back.join(place, ["series", "pos"]).join(d.select("series", "Data", F.col("value").alias("actual")), ["series", "Data"])
    return out.select("series", "Data", rnd("predicted", 2).alias("predicted"), "n_forecasts", rnd("actual").alias("actual"))


def _linear_sql(exog: bool):
    """Ridge regression of all windows per series: centred normal equations,
    solved by elimination."""
    p = CONTEXT + (HORIZON if exog else 0)
    m = p + HORIZON
    load = (f""",
{LOAD_DAILY_SQL},
lt AS (SELECT Data, {' + '.join(f'COALESCE({_q("CARGA_" + s)}, 0)' for s in SUBS)} AS load FROM ldd)""" if exog else "")
    x_load = f"""
  UNION ALL SELECT a.series, a.rn AS origin, a.test, {CONTEXT} + h AS i, b.zl AS v FROM z a, range(1, {HORIZON + 1}) t(h)
    JOIN z b ON b.series = a.series AND b.rn = a.rn + h""" if exog else ""
    # a window is fitted on if no channel misses a value anywhere in it
    whole = f""" JOIN (SELECT a.series, a.rn AS origin FROM z a, range(1, {CONTEXT + 1}) t(c)
      JOIN z b ON b.series = a.series AND b.rn = a.rn - {CONTEXT} + c AND b.zl IS NOT NULL
      GROUP BY a.series, a.rn HAVING count(*) = {CONTEXT}) USING (series, origin)""" if exog else ""
    return f"""WITH RECURSIVE {_CELLS_DAY_SQL}{load},
p0 AS (SELECT Data, row_number() OVER (ORDER BY Data) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT Data FROM dd)),
sp AS MATERIALIZED (SELECT dd.series, Data, value, rn, rn > n - CAST(ceil(CAST(0.3 AS DOUBLE) * n) AS BIGINT) AS test
        {', load' if exog else ''} FROM dd JOIN p0 USING (Data) {'LEFT JOIN lt USING (Data)' if exog else ''}),
st AS (SELECT series, avg(value) AS mu, coalesce(nullif(stddev_pop(value), 0), 1) AS sd FROM sp WHERE NOT test GROUP BY 1),
{'sl AS (SELECT avg(load) AS mu, coalesce(nullif(stddev_pop(load), 0), 1) AS sd FROM sp WHERE NOT test),' if exog else ''}
z AS MATERIALIZED (SELECT sp.*, (value - st.mu) / st.sd AS zv {', (load - sl.mu) / sl.sd AS zl' if exog else ''}
       FROM sp JOIN st USING (series) {', sl' if exog else ''}),
x AS MATERIALIZED (SELECT a.series, a.rn AS origin, a.test, c AS i, b.zv AS v FROM z a, range(1, {CONTEXT + 1}) t(c)
    JOIN z b ON b.series = a.series AND b.rn = a.rn - {CONTEXT} + c{x_load}),
y AS MATERIALIZED (SELECT a.series, a.rn AS origin, b.test, {p} + h AS i, b.zv AS v FROM z a, range(1, {HORIZON + 1}) t(h)
    JOIN z b ON b.series = a.series AND b.rn = a.rn + h),
fx AS (SELECT series, origin FROM x WHERE v IS NOT NULL GROUP BY series, origin HAVING count(*) = {p}),
ly AS (SELECT series, origin FROM y WHERE v IS NOT NULL AND NOT test GROUP BY series, origin HAVING count(*) = {HORIZON}),
tr AS MATERIALIZED (SELECT * FROM (SELECT series, origin, i, v FROM x UNION ALL SELECT series, origin, i, v FROM y)
       SEMI JOIN (SELECT * FROM fx JOIN ly USING (series, origin){whole}) USING (series, origin)),
mn AS MATERIALIZED (SELECT series, i, avg(v) AS mu, count(*) AS n FROM tr GROUP BY ALL),
tc AS MATERIALIZED (SELECT series, origin, i, v - mu AS v FROM tr JOIN mn USING (series, i)),
g AS MATERIALIZED (SELECT a.series, a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i THEN {RIDGE} * count(*) ELSE 0 END AS v
      FROM tc a JOIN tc b USING (series, origin) WHERE a.i <= {p} GROUP BY a.series, a.i, b.i),
el AS (SELECT 0 AS k, series, i, j, v FROM g
  UNION ALL SELECT c.k + 1, c.series, c.i, c.j, CASE WHEN c.i = c.k + 1 THEN c.v / d.v ELSE c.v - f.v * r.v / d.v END
  FROM el c JOIN el r ON r.series = c.series AND r.i = c.k + 1 AND r.j = c.j
  JOIN el d ON d.series = c.series AND d.i = c.k + 1 AND d.j = c.k + 1
  JOIN el f ON f.series = c.series AND f.i = c.i AND f.j = c.k + 1 WHERE c.k < {p}),
w AS MATERIALIZED (SELECT series, i, j, v FROM el WHERE k = {p} AND j > {p}),
pr AS (SELECT q.series, q.origin, w.j, any_value(t.mu) + sum(w.v * (q.v - mn.mu)) AS zp
   FROM (SELECT * FROM x WHERE test) q SEMI JOIN fx USING (series, origin)
   JOIN w ON w.series = q.series AND w.i = q.i JOIN mn ON mn.series = q.series AND mn.i = q.i
   JOIN mn t ON t.series = q.series AND t.i = w.j
   WHERE (q.series, q.origin) IN (SELECT series, origin FROM y GROUP BY series, origin HAVING count(*) = {HORIZON}) GROUP BY q.series, q.origin, w.j),
om AS (SELECT series, origin + j - {p} AS rn, avg(zp) AS zp, count(*) AS n_forecasts FROM pr GROUP BY ALL)
SELECT om.series, sp.Data, {R('om.zp * st.sd + st.mu', 2)} AS predicted, n_forecasts, {R('sp.value')} AS actual
FROM om JOIN sp ON sp.series = om.series AND sp.rn = om.rn JOIN st ON st.series = om.series"""


@query("forecast_linear", sql=_linear_sql(False))
def forecast_linear(spark, base):
    return _linear_forecast(spark, base, False)


@query("forecast_linear_exog", sql=_linear_sql(True))
def forecast_linear_exog(spark, base):
    return _linear_forecast(spark, base, True)


# --- REG-1 (one predictor has a SQL oracle) ------------------------------------------
FEATURE = "CARGA_EUROPE"
_OLS_FRAME_SQL = f"""{GEN_CLASS_DAILY_SQL}, {LOAD_DAILY_SQL},
f AS (SELECT gcd.Data, {', '.join(f'gcd.{_q(c)}' for c in CLASSES)}, ldd.{_q(FEATURE)} AS x FROM gcd JOIN ldd USING (Data)
      WHERE {' AND '.join(f'gcd.{_q(c)} IS NOT NULL' for c in CLASSES)} AND ldd.{_q(FEATURE)} IS NOT NULL)"""


def ols_frame(spark, base):
    f = align.align([gen_class_daily(spark, base), load_daily(spark, base).select("Data", FEATURE)], "Data", "inner")
    from ..operators.clean import drop_incomplete
    return drop_incomplete(f, CLASSES + [FEATURE])


@query("ols_coef", sql=f"""WITH {_OLS_FRAME_SQL}
{' UNION ALL '.join(f"SELECT '{c}' AS target, 'intercept' AS term, {R(f'regr_intercept({_q(c)}, x)', 2)} AS coef FROM f "
                    f"UNION ALL SELECT '{c}', '{FEATURE}', {R(f'regr_slope({_q(c)}, x)', 2)} FROM f" for c in CLASSES)}""")
def ols_coef(spark, base):
    m = LinearModel.fit(ols_frame(spark, base), [FEATURE], CLASSES)
    return m.coefficients(spark).select("target", "term", rnd("coef", 2).alias("coef"))


# --- CLP-1 ------------------------------------------------------------------
def _clamped_sql():
    def pred(c):
        return f'm."a_{c}" + m."b_{c}" * te.x'
    coefs = ", ".join(f'regr_slope({_q(c)}, x) AS "b_{c}", regr_intercept({_q(c)}, x) AS "a_{c}"' for c in CLASSES)
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS target, te.Data, {R('te.' + _q(c), 2)} AS actual, "
        f"{R(f'CASE WHEN {pred(c)} < 0 THEN 0.0 ELSE {pred(c)} END', 2)} AS predicted FROM te, m"
        for c in CLASSES)
    cut = "n - CAST(ceil(CAST(0.3 AS DOUBLE) * n) AS BIGINT)"
    return f"""WITH {_OLS_FRAME_SQL},
p AS (SELECT *, ROW_NUMBER() OVER (ORDER BY Data) AS rn, COUNT(*) OVER () AS n FROM f),
tr AS (SELECT * FROM p WHERE rn <= {cut}),
te AS (SELECT * FROM p WHERE rn > {cut}),
m AS (SELECT {coefs} FROM tr)
{parts}"""


@query("ols_predict_clamped", sql=_clamped_sql())
def ols_predict_clamped(spark, base):
    f = split.train_test_split(ols_frame(spark, base), "Data", 0.3)
    m = LinearModel.fit(f.where(F.col("split") == "train"), [FEATURE], CLASSES)
    te = f.where(F.col("split") == "test")
    parts = None
    for c in CLASSES:
        p = te.select(F.lit(c).alias("target"), "Data", rnd(F.col(f"`{c}`"), 2).alias("actual"),
                      rnd(clamp_negative(m.prediction(c)), 2).alias("predicted"))
        parts = p if parts is None else parts.unionByName(p)
    return parts


# --- scoring on the naive daily forecaster ----------------------------------------
def scored_daily(spark, base):
    """Daily actuals with three reference forecasts: last value, same weekday
    last week, mean of the previous week."""
    d = gen_daily_long(spark, base)
    w = Window.partitionBy("series").orderBy("Data")
    return d.select("series", "Data", F.col("value").alias("actual"),
                    F.lag("value", 1).over(w).alias("naive"),
                    F.lag("value", 7).over(w).alias("seasonal"),
                    F.avg("value").over(w.rowsBetween(-7, -1)).alias("mean7"))


_SCORED_SQL = f"""{_CELLS_DAY_SQL},
sc AS (SELECT series, Data, value AS actual, LAG(value, 1) OVER w AS naive, LAG(value, 7) OVER w AS seasonal,
         AVG(value) OVER (PARTITION BY series ORDER BY Data ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean7
       FROM dd WINDOW w AS (PARTITION BY series ORDER BY Data)),
mm AS (SELECT series, last_day(Data) AS Data, AVG(actual) AS actual, AVG(naive) AS predicted FROM sc GROUP BY ALL)"""

_R2 = ("CASE WHEN VAR_POP(actual) * COUNT(*) > 0 THEN 1 - SUM((actual - predicted) ^ 2) / (VAR_POP(actual) * COUNT(*)) "
       "WHEN SUM((actual - predicted) ^ 2) = 0 THEN 1.0 ELSE 0.0 END")


def monthly_naive(spark, base, scored=None):
    scored = scored_daily(spark, base) if scored is None else scored
    return evaluate.month_mean(scored.withColumnRenamed("naive", "predicted"),
                               ["series"], "Data", ["actual", "predicted"])


# --- AGG-7 ------------------------------------------------------------------
@query("eval_month_mean", sql=f"""WITH {_SCORED_SQL}
SELECT series, Data, {R('actual', 6)} AS actual, {R('predicted', 6)} AS predicted FROM mm""")
def eval_month_mean(spark, base):
    m = monthly_naive(spark, base)
    return m.select("series", "Data", rnd("actual", 6).alias("actual"), rnd("predicted", 6).alias("predicted"))


# --- EVL-1, EVL-3 -----------------------------------------------------------
@query("metrics", sql=f"""WITH {_SCORED_SQL}
SELECT series, COUNT(*) AS n, {R(_R2, 6)} AS r2, {R('AVG((actual - predicted) ^ 2)', 2)} AS mse
FROM mm WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY series""")
def metrics(spark, base):
    m = evaluate.regression_metrics(monthly_naive(spark, base), ["series"], "actual", "predicted")
    return m.select("series", "n", rnd("r2", 6).alias("r2"), rnd("mse", 2).alias("mse"))


# --- EVL-2, MTH-2, AGG-19 ---------------------------------------------------
@query("adjusted_r2", sql=f"""WITH {_SCORED_SQL},
nd AS (SELECT series, COUNT(*) AS n_daily FROM sc WHERE naive IS NOT NULL GROUP BY series),
me AS (SELECT series, {_R2} AS r2 FROM mm WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY series)
SELECT series, n_daily, {R('r2', 6)} AS r2, {R('1 - (1 - r2) * (n_daily - 1) / (n_daily - 1 - 1)', 6)} AS adj_r2
FROM me JOIN nd USING (series)""")
def adjusted_r2(spark, base):
    sc = materialize(scored_daily(spark, base))                 # one pass over the facts
    nd = sc.where(F.col("naive").isNotNull()).groupBy("series").agg(F.count("*").alias("n_daily"))
    m = evaluate.regression_metrics(monthly_naive(spark, base, sc), ["series"], "actual", "predicted").join(nd, "series")
    m = evaluate.with_adjusted_r2(m, "n_daily", 1)
    return m.select("series", "n_daily", rnd("r2", 6).alias("r2"), rnd("adj_r2", 6).alias("adj_r2"))


# --- EVL-5, JOI-7, MTH-3 ----------------------------------------------------
_MODELS = ["mean7", "naive", "seasonal"]


@query("model_delta", sql=f"""WITH {_SCORED_SQL},
ok AS (SELECT * FROM sc WHERE naive IS NOT NULL AND seasonal IS NOT NULL AND mean7 IS NOT NULL),
ms AS (SELECT series, AVG((actual - naive) ^ 2) AS naive, AVG((actual - seasonal) ^ 2) AS seasonal,
              AVG((actual - mean7) ^ 2) AS mean7 FROM ok GROUP BY series)
{' UNION ALL '.join(f"SELECT series AS source, '{a}' AS model_a, '{b}' AS model_b, {R(f'100 * ({a} - {b}) / {b}')} AS delta_pct FROM ms"
                    for a in _MODELS for b in _MODELS if a != b)}""")
def model_delta(spark, base):
    from ..operators.clean import drop_incomplete
    sc = drop_incomplete(scored_daily(spark, base), _MODELS)
    long = None
    for mname in _MODELS:
        part = sc.select(F.col("series").alias("source"), F.lit(mname).alias("model"), "actual",
                         F.col(mname).alias("predicted"))
        long = part if long is None else long.unionByName(part)
    met = evaluate.regression_metrics(long, ["source", "model"], "actual", "predicted")
    d = align.model_delta(met, _MODELS, by="source", model="model", value="mse")
    return d.select("source", "model_a", "model_b", rnd("delta_pct").alias("delta_pct"))


# --- EVL-6 ------------------------------------------------------------------
@query("pairs", sql=f"""WITH {_SCORED_SQL},
p AS (SELECT Data, ROW_NUMBER() OVER (ORDER BY Data) AS rn, COUNT(*) OVER () AS n FROM (SELECT DISTINCT Data FROM sc)),
s AS (SELECT Data, CASE WHEN rn <= n - CAST(ceil(CAST(0.3 AS DOUBLE) * n) AS BIGINT) THEN 'train' ELSE 'test' END AS split
      FROM p)
SELECT series, Data, split, {R('actual')} AS actual, {R('naive')} AS predicted FROM sc JOIN s USING (Data)""")
def pairs(spark, base):
    sc = split.train_test_split(scored_daily(spark, base), "Data", 0.3)
    p = evaluate.pairs_table(sc, ["series"], "Data", "actual", "naive", "split")
    return p.select("series", "Data", "split", rnd("actual").alias("actual"), rnd("predicted").alias("predicted"))
