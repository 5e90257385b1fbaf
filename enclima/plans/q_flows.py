"""Queries: end-to-end flows on the stand-in facts (PIP-1..9, REG-2..4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import patches_df
from ..functions import rnd
from . import flows
from . import standins as S
from .q_frames import PATCH, WIDE_COLS, dense_daily_wide_sql
from .q_reshape import LOAD_MEASURES, SUBS, _q
from .q_sources import BOXES, INDICES, grid_sql, region_table
from .registry import CLASS_SQL, GEN_CTE, LOAD_CTE, R, query

CARGA = [f"CARGA_{s}" for s in SUBS]
REGION_COLS = [f"{r}_sst" for r in BOXES]
CAL = ["year", "month", "day", "weekday", "dayofyear", "quarter"]
HYDRO_COLS = [f"{s}_{m}" for s in SUBS for m in LOAD_MEASURES]
TARGETS = [c for c in WIDE_COLS if "OTHER" not in c]


def gen_tables(spark, base, hourly=True):
    g = S.gen_fact(spark, base).withColumnRenamed("cat", "fuel")
    return flows.generation_tables(g, fuel_map=S.PRIORITY_CLASS, patches=patches_df(spark, PATCH), hourly=hourly)


def ld_tables(spark, base, hourly=True):
    return flows.load_tables(S.load_fact(spark, base), hourly=hourly)


def _tables_long(tables):
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("table_name"), "series", F.col("Data").cast("timestamp_ntz").alias("Data"),
                         rnd("value", 6).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def _tables_sql(cells_cte: str, patch: bool) -> str:
    tgt, src = PATCH[0]
    dm = (f"SELECT series, Data, a FROM dd WHERE Data <> DATE '{tgt}' "
          f"UNION ALL SELECT series, DATE '{tgt}', a FROM dd WHERE Data = DATE '{src}'") if patch else \
        "SELECT series, Data, a FROM dd"
    return f"""WITH {cells_cte},
b AS (SELECT CAST(min(ts) AS TIMESTAMP) lo, CAST(max(ts) AS TIMESTAMP) hi FROM cells),
cal AS (SELECT CAST(d AS DATE) AS Data FROM b, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) t(d)),
dd AS (SELECT k.series, cal.Data, COALESCE(SUM(c.value), 0) AS s, AVG(c.value) AS a, COUNT(c.value) AS n
       FROM cal CROSS JOIN (SELECT DISTINCT series FROM cells) k
       LEFT JOIN cells c ON c.series = k.series AND CAST(c.ts AS DATE) = cal.Data GROUP BY ALL),
dm AS ({dm}),
mm AS (SELECT series, last_day(Data) AS Data, SUM(s) AS s, SUM(n) AS n FROM dd GROUP BY ALL)
SELECT 'hourly_MWmed' AS table_name, series, CAST(ts AS TIMESTAMP) AS Data, {R('value', 6)} AS value FROM cells
UNION ALL SELECT 'daily_MWh', series, CAST(Data AS TIMESTAMP), {R('s', 6)} FROM dd
UNION ALL SELECT 'monthly_MWh', series, CAST(Data AS TIMESTAMP), {R('s', 6)} FROM mm
UNION ALL SELECT 'daily_MWmed', series, CAST(Data AS TIMESTAMP), {R('a', 6)} FROM dm
UNION ALL SELECT 'monthly_MWmed', series, CAST(Data AS TIMESTAMP), {R('CASE WHEN n > 0 THEN s / n END', 6)} FROM mm"""


GEN_CELLS_SQL = f"""{GEN_CTE},
g AS (SELECT ts, {CLASS_SQL} AS cls, sub, value FROM gen),
cells AS (SELECT ts, CASE WHEN sub IS NULL THEN cls ELSE cls || '_' || sub END AS series,
                 COALESCE(SUM(value), 0) AS value
          FROM g GROUP BY GROUPING SETS ((ts, cls), (ts, cls, sub)))"""

LOAD_CELLS_SQL = f"""{LOAD_CTE},
cells AS (SELECT ts, 'CARGA_' || sub AS series, SUM(value) AS value FROM ld GROUP BY ALL)"""


# --- PIP-1 ------------------------------------------------------------------
@query("generation_tables", sql=_tables_sql(GEN_CELLS_SQL, patch=True))
def generation_tables(spark, base):
    return _tables_long(gen_tables(spark, base))


# --- PIP-2 ------------------------------------------------------------------
@query("load_tables", sql=_tables_sql(LOAD_CELLS_SQL, patch=False))
def load_tables(spark, base):
    return _tables_long(ld_tables(spark, base))


# --- flagship: wide daily MWmed generation table -----------------------------------
def generation_daily_mean_wide(spark, base):
    wide = flows.to_wide(gen_tables(spark, base, hourly=False)["daily_MWmed"], names=WIDE_COLS)
    return wide.select("Data", *[rnd(F.col(f"`{c}`")).alias(c) for c in WIDE_COLS])


def _gen_daily_wide_sql():
    cols = ", ".join(f"{R(f'MAX(a) FILTER (WHERE series = {chr(39)}{c}{chr(39)})')} AS {_q(c)}" for c in WIDE_COLS)
    base_sql = _tables_sql(GEN_CELLS_SQL, patch=True)
    head = base_sql[:base_sql.index("SELECT 'hourly_MWmed'")]
    return f"{head}SELECT Data, {cols} FROM dm GROUP BY Data"


@query("generation_daily_wide", sql=_gen_daily_wide_sql())
def generation_daily_wide(spark, base):
    return generation_daily_mean_wide(spark, base)


# --- PIP-3 ------------------------------------------------------------------
@query("hydrology_table", sql=f"""WITH {LOAD_CTE}
SELECT CAST(ts AS DATE) AS Data,
  {', '.join(f"{R(f'SUM({m}) FILTER (WHERE sub = {chr(39)}{s}{chr(39)})')} AS {_q(s + '_' + m)}"
             for s in SUBS for m in LOAD_MEASURES)}
FROM ld GROUP BY 1""")
def hydrology_table(spark, base):
    w = flows.hydrology_daily(S.load_fact(spark, base), "ts", "sub", LOAD_MEASURES, SUBS)
    return w.select("Data", *[rnd(F.col(f"`{c}`")).alias(c) for c in w.columns if c != "Data"])


# --- PIP-4 ------------------------------------------------------------------
_B = [f"{i}_B" for i in INDICES]


def _indices_sql():
    from .q_sources import SENTINEL_SQL, _IDX_CASE
    cols = ", ".join(f"{R(f'MAX(value) FILTER (WHERE index_name = {chr(39)}{i}{chr(39)})')} AS {_q(i)}"
                     for i in INDICES + _B)
    return f"""WITH {SENTINEL_SQL},
gb AS (SELECT {_IDX_CASE} || '_B' AS index_name, make_date(year(ts), month(ts), 1) AS Data,
              ROUND(SUM(value), 2) AS value FROM gen GROUP BY ALL),
allv AS (SELECT index_name, Data, value FROM clean UNION ALL SELECT index_name, Data, value FROM gb)
SELECT strftime(Data, '%Y-%m') AS Data, {cols} FROM allv GROUP BY 1"""


@query("indices_table", sql=_indices_sql())
def indices_table(spark, base):
    from ..sources import index_text as IT
    lines = S.index_text_lines(spark, base).withColumnRenamed("index_name", "index")
    semi = S.index_semicolon_rows(spark, base).withColumn("index_name", F.concat("index_name", F.lit("_B")))
    semi = IT.parse_semicolon_rows(semi, "index_name", "date_text", "value_text")
    w = flows.indices_table(lines, semi, names=INDICES + _B)
    return w.select("Data", *[rnd(F.col(f"`{c}`")).alias(c) for c in INDICES + _B])


# --- PIP-6 ------------------------------------------------------------------
def standin_training(spark, base, fit_on="all", hydro=False):
    targets = flows.to_wide(gen_tables(spark, base, hourly=False)["daily_MWmed"], names=WIDE_COLS)
    load = flows.to_wide(ld_tables(spark, base, hourly=False)["daily_MWmed"], names=CARGA)
    others = [region_table(spark, base)]
    if hydro:
        others.append(flows.hydrology_daily(S.load_fact(spark, base), "ts", "sub", LOAD_MEASURES, SUBS))
    return flows.training_frame(targets, load, others, drop=("OTHER",),
                                after=1994, before=2001, test_size=0.3, fit_on=fit_on)


def _training_sql(hydro=False, digits=None):
    """``digits``: rounding of targets and predictors (None: as the query shows
    them; otherwise that many decimals everywhere)."""
    gd = _gen_daily_wide_sql()
    gen_part = gd[len("WITH "):gd.index("SELECT Data, ")]
    gcols = ", ".join(f"COALESCE(MAX(a) FILTER (WHERE series = '{c}'), 0) AS {_q(c)}" for c in TARGETS)
    others = REGION_COLS + (HYDRO_COLS if hydro else [])
    exog = CARGA + CAL + others
    z = ", ".join(
        f"{R(f'({_q(c)} - AVG({_q(c)}) OVER ()) / COALESCE(NULLIF(STDDEV_POP({_q(c)}) OVER (), 0), 1)', digits or 6)} AS {_q(c)}"
        for c in exog)
    hyd = ", ".join(f"SUM({m}) FILTER (WHERE sub = '{s}') AS {_q(s + '_' + m)}" for s in SUBS for m in LOAD_MEASURES)
    cal = ("CAST(year(Data) AS DOUBLE) AS year, CAST(month(Data) AS DOUBLE) AS month, CAST(day(Data) AS DOUBLE) AS day, "
           "CAST(isodow(Data) - 1 AS DOUBLE) AS weekday, CAST(dayofyear(Data) AS DOUBLE) AS dayofyear, "
           "CAST(quarter(Data) AS DOUBLE) AS quarter")
    ld_sql = (f"{LOAD_CTE.replace('ld AS', 'ld0 AS', 1)}, ldx AS (SELECT ts, sub, value FROM ld0),\n"
              + dense_daily_wide_sql("ldd", "ldx", "'CARGA_' || sub", CARGA, ""))
    return f"""WITH {gen_part.rstrip()},
gtw AS (SELECT Data, {gcols} FROM dm GROUP BY Data),
{ld_sql},
{grid_sql("r_")},
rm AS (SELECT Data, region, AVG(value) AS v FROM r_cells GROUP BY ALL),
rw AS (SELECT Data, {', '.join(f"MAX(v) FILTER (WHERE region = '{r[:-4]}') AS {_q(r)}" for r in REGION_COLS)}
       FROM rm GROUP BY Data),
hw AS (SELECT CAST(ts AS DATE) AS Data, {hyd} FROM ld0 GROUP BY 1),
f0 AS (SELECT gtw.*, {', '.join(f'ldd.{_q(c)}' for c in CARGA)}, {cal},
              {', '.join(_q(c) for c in others)}
       FROM gtw JOIN ldd USING (Data) JOIN rw USING (Data){' JOIN hw USING (Data)' if hydro else ''}
       WHERE {' AND '.join(f'ldd.{_q(c)} IS NOT NULL' for c in CARGA)}
         AND {' AND '.join(f'{_q(c)} IS NOT NULL' for c in others)}
         AND Data >= DATE '1995-01-01' AND Data < DATE '2001-01-01'),
f1 AS (SELECT *, ROW_NUMBER() OVER (ORDER BY Data) AS rn, COUNT(*) OVER () AS n FROM f0)
SELECT Data, {', '.join(f'{R(_q(c), digits or 4)} AS {_q(c)}' for c in TARGETS)}, {z},
       CASE WHEN rn <= n - CAST(ceil(CAST(0.3 AS DOUBLE) * n) AS BIGINT) THEN 'train' ELSE 'test' END AS split
FROM f1"""


def _training_rows(frame, tcols, ecols):
    return frame.select("Data", *[rnd(F.col(f"`{c}`")).alias(c) for c in tcols],
                        *[rnd(F.col(f"`{c}`"), 6).alias(c) for c in ecols], "split")


@query("training_frame", sql=_training_sql())
def training_frame(spark, base):
    return _training_rows(*standin_training(spark, base))


@query("training_frame_hydrology", sql=_training_sql(hydro=True))
def training_frame_hydrology(spark, base):
    return _training_rows(*standin_training(spark, base, hydro=True))


# --- PIP-7, REG-1, CLP-1, EVL-1..3 --------------------------------------------------
def _ols_ctes(predictors, tag):
    """Least squares of every target on ``predictors`` over the train rows of
    ``fr``, solved by Gauss-Jordan elimination of the centred normal equations
    (a predictor that is constant in the train rows gets no weight), and the
    scores of the clamped test predictions: ends in a CTE ``sc_{tag}``."""
    p, m = len(predictors), len(TARGETS)
    mean = "AVG({0}) FILTER (WHERE split = 'train') OVER ()"
    xs = ", ".join(f"{_q(c)} - {mean.format(_q(c))}" for c in predictors)
    ys = ", ".join(_q(c) for c in TARGETS)
    ms = ", ".join(mean.format(_q(c)) for c in TARGETS)
    names = ", ".join(f"'{t}'" for t in TARGETS)
    return f"""
xy_{tag} AS (SELECT Data, split, [{xs}] AS xs, [{ys}] AS ys, [{ms}] AS ms FROM fr),
e_{tag} AS (SELECT Data, unnest(range(1, {p + 1})) AS i, unnest(xs) AS v FROM xy_{tag} WHERE split = 'train'),
y_{tag} AS (SELECT Data, unnest(range(1, {m + 1})) AS t, unnest(ys) - unnest(ms) AS v FROM xy_{tag} WHERE split = 'train'),
m_{tag} AS (SELECT a.i, b.i AS j, SUM(a.v * b.v) AS v FROM e_{tag} a JOIN e_{tag} b USING (Data) GROUP BY ALL
  UNION ALL SELECT a.i, {p} + y.t AS j, SUM(a.v * y.v) AS v FROM e_{tag} a JOIN y_{tag} y USING (Data) GROUP BY ALL),
el_{tag} AS (SELECT 0 AS k, i, j, v FROM m_{tag}
  UNION ALL SELECT c.k + 1, c.i, c.j, CASE WHEN d.v < 1e-6 THEN CASE WHEN c.i = c.k + 1 THEN 0 ELSE c.v END
      WHEN c.i = c.k + 1 THEN c.v / d.v ELSE c.v - f.v * r.v / d.v END
  FROM el_{tag} c JOIN el_{tag} r ON r.i = c.k + 1 AND r.j = c.j JOIN el_{tag} d ON d.i = c.k + 1 AND d.j = c.k + 1
  JOIN el_{tag} f ON f.i = c.i AND f.j = c.k + 1 WHERE c.k < {p}),
w_{tag} AS (SELECT j - {p} AS t, list(v ORDER BY i) AS w FROM el_{tag} WHERE k = {p} AND j > {p} GROUP BY 1),
pr_{tag} AS (SELECT t, last_day(Data) AS Data, ys[t] AS actual, greatest(ms[t] + list_dot_product(xs, w), 0) AS predicted
  FROM xy_{tag}, w_{tag} WHERE split = 'test'),
nd_{tag} AS (SELECT t, COUNT(*) AS n_daily FROM pr_{tag} GROUP BY t),
mo_{tag} AS (SELECT t, Data, AVG(actual) AS actual, AVG(predicted) AS predicted FROM pr_{tag} GROUP BY ALL),
sc_{tag} AS (SELECT [{names}][t] AS target, n_daily, mse, r2,
    1 - (1 - r2) * (n_daily - 1) / NULLIF(n_daily - {p} - 1, 0) AS adj_r2
  FROM (SELECT t, AVG((actual - predicted) ^ 2) AS mse,
               1 - SUM((actual - predicted) ^ 2) / (VAR_POP(actual) * COUNT(*)) AS r2 FROM mo_{tag} GROUP BY t)
  JOIN nd_{tag} USING (t))"""


def _ols_sql(models):
    return f"""WITH RECURSIVE fr AS ({_training_sql(digits=12)}),
{', '.join(_ols_ctes(cols, tag) for tag, cols in models.items())}
{' UNION ALL '.join(f"SELECT '{tag}' AS model, target, n_daily, {R('r2')} AS r2, {R('adj_r2')} AS adj_r2, "
                    f"{R('mse', -3)} AS mse FROM sc_{tag}" for tag in models)}"""


def _metric_rows(met):
    return met.select("model", "target", "n_daily", rnd("r2").alias("r2"), rnd("adj_r2").alias("adj_r2"),
                      rnd("mse", -3).alias("mse"))


LOAD_PREDICTORS = CARGA + CAL


@query("ols_study", sql=_ols_sql({"ols": LOAD_PREDICTORS + REGION_COLS}))
def ols_study(spark, base):
    frame, tcols, ecols = standin_training(spark, base)
    met, _, _ = flows.ols_study(frame, tcols, ecols)
    return _metric_rows(met)


# --- REG-2 ------------------------------------------------------------------
@query("ols_ablation", sql=_ols_sql({"ols_load": LOAD_PREDICTORS, "ols_load_sst": LOAD_PREDICTORS + REGION_COLS}))
def ols_ablation(spark, base):
    frame, tcols, ecols = standin_training(spark, base)
    load_only = [c for c in ecols if c not in REGION_COLS]
    a, _, _ = flows.ols_study(frame, tcols, load_only, model="ols_load")
    b, _, _ = flows.ols_study(frame, tcols, ecols, model="ols_load_sst")
    return _metric_rows(a.unionByName(b))


# --- REG-3, PIP-8 -------------------------------------------------------------
# The studies' forest: unlimited depth, half of the features per split.
RF_ARGS = dict(num_trees=200, max_features=0.5, seed=69)


@query("rf_predict")
def rf_predict(spark, base):
    frame, tcols, ecols = standin_training(spark, base)
    return flows.rf_predictions(frame, tcols, ecols, **RF_ARGS)


@query("rf_study")
def rf_study(spark, base):
    frame, tcols, ecols = standin_training(spark, base)
    met, _ = flows.rf_study(frame, tcols, ecols, **RF_ARGS)
    return met


TREE_BINS, TREE_LEAF = 32, 5


def _tree_ctes(rows, tag, features, depth):
    """One tree without draws, grown by joint variance reduction over the rows
    (id, xs, ys) of ``rows``: ends in ``nodes_{tag}`` (node, f, threshold, b)
    and ``at_{tag}`` (id, node) of the leaves."""
    p, m = len(features), len(TARGETS)
    out = [f"""
x_{tag} AS MATERIALIZED (SELECT id, unnest(range(1, {p + 1})) AS f, unnest(xs) AS v FROM {rows}),
y_{tag} AS MATERIALIZED (SELECT id, unnest(range(1, {m + 1})) AS t, unnest(ys) AS y FROM {rows}),
rk_{tag} AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS r, count(*) OVER (PARTITION BY f) AS n,
             min(v) OVER (PARTITION BY f) AS low FROM x_{tag}),
ed_{tag} AS MATERIALIZED (SELECT DISTINCT f, v FROM rk_{tag}, range(1, {TREE_BINS}) k(k)
             WHERE r = ceil(k::DOUBLE / {TREE_BINS} * n) AND v > low),
b_{tag} AS MATERIALIZED (SELECT x.id, x.f, count(e.v) AS b FROM x_{tag} x LEFT JOIN ed_{tag} e ON e.f = x.f AND x.v >= e.v
             GROUP BY ALL),
th_{tag} AS (SELECT f, v AS threshold, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS b FROM ed_{tag}),
at_{tag}0 AS (SELECT id, 1::BIGINT AS node FROM {rows})"""]
    for d in range(depth):
        out.append(f"""
im_{tag}{d} AS (SELECT node, sum(i) AS i FROM (SELECT node, t, sum(y * y) - sum(y) ^ 2 / count(*) AS i
             FROM at_{tag}{d} JOIN y_{tag} USING (id) GROUP BY ALL) GROUP BY node),
c_{tag}{d} AS (SELECT node, f, b, t, sum(y) AS s, count(*) AS n FROM at_{tag}{d} JOIN b_{tag} USING (id)
             JOIN y_{tag} USING (id) GROUP BY ALL),
r_{tag}{d} AS (SELECT node, f, b, t, sum(s) OVER w AS ls, sum(n) OVER w AS ln, sum(s) OVER g AS ts, sum(n) OVER g AS tn
             FROM c_{tag}{d} WINDOW w AS (PARTITION BY node, f, t ORDER BY b), g AS (PARTITION BY node, f, t)),
g_{tag}{d} AS (SELECT node, f, b, sum(ls ^ 2 / ln + (ts - ls) ^ 2 / (tn - ln) - ts ^ 2 / tn) AS gain FROM r_{tag}{d}
             WHERE ln >= {TREE_LEAF} AND tn - ln >= {TREE_LEAF} GROUP BY ALL),
s_{tag}{d} AS MATERIALIZED (SELECT node, f, b, threshold FROM (SELECT node, f, b, round(gain / i, 9) AS score,
               row_number() OVER (PARTITION BY node ORDER BY round(gain / i, 9) DESC, f, b) AS k
               FROM g_{tag}{d} JOIN im_{tag}{d} USING (node)) JOIN th_{tag} USING (f, b) WHERE k = 1 AND score > 0),
at_{tag}{d + 1} AS MATERIALIZED (SELECT a.id, CASE WHEN s.f IS NULL THEN a.node ELSE 2 * a.node + (q.b > s.b)::INT END AS node
             FROM at_{tag}{d} a LEFT JOIN s_{tag}{d} s USING (node) LEFT JOIN b_{tag} q ON q.id = a.id AND q.f = s.f)""")
    unions = " UNION ALL ".join(f"SELECT * FROM s_{tag}{d}" for d in range(depth))
    return ",".join(out) + f""",
sp_{tag} AS ({unions}),
lv_{tag} AS (SELECT DISTINCT id, node FROM (SELECT * FROM {' UNION ALL SELECT * FROM '.join(f'at_{tag}{d}' for d in range(depth + 1))}))"""


def _forest_rows_sql(where="split = 'train'"):
    names = LOAD_PREDICTORS + REGION_COLS
    return (f"SELECT Data AS id, [{', '.join(_q(c) for c in names)}] AS xs, [{', '.join(_q(c) for c in TARGETS)}] AS ys, "
            f"split FROM fr WHERE {where}")


@query("forest_tree", sql=f"""WITH fr AS MATERIALIZED ({_training_sql(digits=12)}),
tr AS ({_forest_rows_sql()}),{_tree_ctes('tr', 'a', LOAD_PREDICTORS + REGION_COLS, 2)}
SELECT lv_a.node, [{', '.join(f"'{t}'" for t in TARGETS)}][t] AS target, count(*) AS n,
  [{', '.join(f"'{c}'" for c in LOAD_PREDICTORS + REGION_COLS)}][any_value(sp_a.f)] AS feature,
  {R('any_value(sp_a.threshold)', 6)} AS threshold, {R('avg(y)', 6)} AS prediction
FROM lv_a JOIN y_a USING (id) LEFT JOIN sp_a USING (node) GROUP BY lv_a.node, t""")
def forest_tree(spark, base):
    """One joint tree of depth 2 without draws, node by node."""
    from ..operators.forest import fit_forests
    frame, tcols, ecols = standin_training(spark, base)
    ecols = LOAD_PREDICTORS + REGION_COLS
    forest = fit_forests(frame.where(F.col("split") == "train"), ecols, TARGETS,
                         [dict(num_trees=1, max_depth=2, min_samples_leaf=TREE_LEAF, bootstrap=False)], "Data",
                         bins=TREE_BINS)
    name = F.array(*[F.lit(c) for c in ecols])
    items = F.array(*[F.struct(F.lit(t).alias("target"), F.col("prediction")[i].alias("value")) for i, t in enumerate(TARGETS)])
    return (forest.nodes.select("node", "n", F.when(F.col("feature").isNotNull(), name[F.col("feature")]).alias("feature"),
                                rnd("threshold", 6).alias("threshold"), F.explode(items).alias("p"))
            .select("node", "p.target", "n", "feature", "threshold", rnd("p.value", 6).alias("prediction")))


# --- REG-4 ------------------------------------------------------------------
# All six searched parameters, two values each.
RF_GRID = dict(num_trees=[5, 10], max_features=["sqrt", 1.0], max_depth=[4, None], min_samples_split=[2, 10],
               min_samples_leaf=[1, 4], bootstrap=[True, False])


@query("rf_grid")
def rf_grid(spark, base):
    frame, tcols, ecols = standin_training(spark, base)
    return flows.rf_grid(frame, tcols, ecols, RF_GRID, n_splits=5)


# --- PIP-9 ------------------------------------------------------------------
def standin_channels(spark, base):
    """Load of every subsystem and sea temperature of every region, per day.
    A grid stands for a week here, so that the channels span the windows."""
    load = flows.to_wide(ld_tables(spark, base, hourly=False)["daily_MWmed"], names=CARGA)
    first = F.to_date(F.lit(S.GRID_START))
    day = F.date_add(first, 7 * F.datediff("Data", first) + F.col("_d"))
    sea = (region_table(spark, base).withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("Data", day)
           .drop("_d"))
    return load.join(sea, "Data")


def _forecast_rows(met):
    return met.select("model", "target", "n", rnd("r2").alias("r2"), rnd("mse", 0).alias("mse"))


@query("forecast_study")
def forecast_study(spark, base):
    """Weeks, 90 of context and 30 ahead, with all load and sea channels."""
    daily = gen_tables(spark, base, hourly=False)["daily_MWmed"]
    return _forecast_rows(flows.forecast_study(daily, 90, 30, 52, standin_channels(spark, base), "week", before=2001,
                                               drop=("OTHER",)))


@query("forecast_study_daily")
def forecast_study_daily(spark, base):
    """Days, 512 of context and 96 ahead, with all load and sea channels."""
    daily = gen_tables(spark, base, hourly=False)["daily_MWmed"]
    return _forecast_rows(flows.forecast_study(daily, 512, 96, 365, standin_channels(spark, base), "day", before=2001,
                                               drop=("OTHER",), ridges=(1e-1,)))


@query("forecast_finetune")
def forecast_finetune(spark, base):
    """One trained network for all targets, stopped early on the valid weeks."""
    daily = gen_tables(spark, base, hourly=False)["daily_MWmed"]
    return _forecast_rows(flows.forecast_study(daily, 90, 30, 52, standin_channels(spark, base), "week", before=2001,
                                               drop=("OTHER",), models=("naive", "trained"), epochs=12, steps=2, patience=4))
