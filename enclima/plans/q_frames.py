"""Queries: calendar features, missing values, patches, row operations,
alignment, peak day, distribution summary, standardisation
(sections 2.2, 2.4, 2.5, 2.7, 2.8, 2.9, 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import patches_df
from ..functions.calendar import hour_start
from ..functions import add_calendar_features, rnd
from ..operators import align, clean, reshape, resample, scale
from ..session import materialize
from . import standins as S
from .q_reshape import CLASSES, EVENT_TYPES, SUBS, _q, class_subsystem_wide, gen_classes, round_all
from .q_sources import BOXES, GRID_SQL, region_table
from .registry import CLASS_SQL, GEN_CTE, HOURLY_CTE, LOAD_CTE, R, query

PATCH = [("1998-12-01", "1998-12-02")]


# --- shared frames (Spark) ----------------------------------------------------
def daily_wide(cells, key, keys, prefix, how="mean"):
    """Dense daily statistic per key, then one column per key."""
    d = resample.resample(cells, "ts", [key], "value", "day", how)
    return reshape.pivot_masks(d, ["Data"], {f"{prefix}{k}": F.col(key) == F.lit(k) for k in keys},
                               "value", how="first")


def gen_class_daily(spark, base):
    cells = gen_classes(spark, base).groupBy("ts", "cls").agg(F.sum("value").alias("value"))
    return daily_wide(cells, "cls", CLASSES, "")


def load_daily(spark, base):
    cells = S.load_fact(spark, base).groupBy("ts", "sub").agg(F.sum("value").alias("value"))
    return daily_wide(cells, "sub", SUBS, "CARGA_")


# --- shared frames (SQL) --------------------------------------------------------
def dense_daily_wide_sql(name, src, key, keys, prefix, agg="AVG"):
    """CTE ``name`` = dense daily ``agg`` per key (global bounds), then wide."""
    cols = ", ".join(f"MAX(v) FILTER (WHERE k = '{k}') AS {_q(prefix + k)}" for k in keys)
    zero = "COALESCE(SUM(c.value), 0)" if agg == "SUM" else f"{agg}(c.value)"
    return f"""{name}_c AS (SELECT ts, {key} AS k, SUM(value) AS value FROM {src} GROUP BY ALL),
{name}_b AS (SELECT CAST(min(ts) AS TIMESTAMP) lo, CAST(max(ts) AS TIMESTAMP) hi FROM {name}_c),
{name}_cal AS (SELECT CAST(d AS DATE) AS Data FROM {name}_b, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) t(d)),
{name}_d AS (SELECT kk.k, cal.Data, {zero} AS v FROM {name}_cal cal CROSS JOIN (SELECT DISTINCT k FROM {name}_c) kk
             LEFT JOIN {name}_c c ON c.k = kk.k AND CAST(c.ts AS DATE) = cal.Data GROUP BY ALL),
{name} AS (SELECT Data, {cols} FROM {name}_d GROUP BY Data)"""


GEN_CLASS_DAILY_SQL = (f"{GEN_CTE}, gc AS (SELECT ts, {CLASS_SQL} AS cls, value FROM gen),\n"
                       + dense_daily_wide_sql("gcd", "gc", "cls", CLASSES, ""))
LOAD_DAILY_SQL = f"{LOAD_CTE},\n" + dense_daily_wide_sql("ldd", "ld", "sub", SUBS, "CARGA_")


def _class_wide_cte():
    cols = [f"SUM(value) FILTER (WHERE cls = '{c}') AS {_q(c)}" for c in CLASSES]
    cols += [f"SUM(value) FILTER (WHERE cls = '{c}' AND sub = '{s}') AS {_q(c + '_' + s)}"
             for c in CLASSES for s in SUBS]
    return (f"{GEN_CTE}, g AS (SELECT ts, {CLASS_SQL} AS cls, sub, value FROM gen), "
            f"cw AS (SELECT ts AS Data, {', '.join(cols)} FROM g GROUP BY ts)")


WIDE_COLS = CLASSES + [f"{c}_{s}" for c in CLASSES for s in SUBS]


# --- DAT-1, DAT-2 -----------------------------------------------------------
@query("calendar_features", sql=f"""
WITH {LOAD_CTE},
b AS (SELECT CAST(min(ts) AS TIMESTAMP) lo, CAST(max(ts) AS TIMESTAMP) hi FROM ld),
cal AS (SELECT CAST(d AS DATE) AS Data FROM b, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) t(d)),
dd AS (SELECT cal.Data, COALESCE(SUM(ld.value), 0) AS value FROM cal LEFT JOIN ld ON CAST(ld.ts AS DATE) = cal.Data
       GROUP BY ALL)
SELECT Data, {R('value')} AS value, CAST(year(Data) AS INTEGER) AS year, CAST(month(Data) AS INTEGER) AS month,
  CAST(day(Data) AS INTEGER) AS day, CAST(isodow(Data) - 1 AS INTEGER) AS weekday,
  CAST(dayofyear(Data) AS INTEGER) AS dayofyear, CAST(quarter(Data) AS INTEGER) AS quarter,
  strftime(Data, '%Y-%m') AS month_label
FROM dd""")
def calendar_features(spark, base):
    d = resample.resample(S.load_fact(spark, base), "ts", [], "value", "day", "sum")
    f = add_calendar_features(d, "Data").withColumn("month_label", F.date_format("Data", "yyyy-MM"))
    return f.withColumn("value", rnd("value"))


# --- NUL-2, NUL-3, NUL-4 ------------------------------------------------------
@query("null_fill_drop_count", sql=f"""
WITH {_class_wide_cte()}
SELECT COUNT(*) AS n_rows,
  CAST({' + '.join(f'COUNT(*) FILTER (WHERE {_q(c)} IS NULL)' for c in WIDE_COLS)} AS BIGINT) AS n_missing,
  COUNT(*) FILTER (WHERE {' AND '.join(f'{_q(c)} IS NOT NULL' for c in WIDE_COLS)}) AS n_complete,
  {R(' + '.join(f'SUM(COALESCE({_q(c)}, 0))' for c in WIDE_COLS))} AS filled_total
FROM cw""")
def null_fill_drop_count(spark, base):
    g = gen_classes(spark, base)
    w = reshape.class_subsystem_wide(g, "ts", "cls", "sub", "value", CLASSES, SUBS)
    cols = [c for c in w.columns if c != "ts"]
    w = materialize(w)                                          # read by three operators
    counted = w.agg(F.count("*").alias("n_rows"), clean.missing_cells(w, cols).alias("n_missing"))
    complete = clean.drop_incomplete(w, cols).agg(F.count("*").alias("n_complete"))
    filled = clean.fill_missing(w, cols, 0.0).agg(rnd(sum(F.sum(F.col(f"`{c}`")) for c in cols)).alias("filled_total"))
    return counted.crossJoin(complete).crossJoin(filled)        # one row each


# --- NUL-5 ------------------------------------------------------------------
@query("row_patch", sql=f"""
WITH {GEN_CLASS_DAILY_SQL}
SELECT Data, {', '.join(f'{R(_q(c))} AS {_q(c)}' for c in CLASSES)} FROM gcd WHERE Data <> DATE '{PATCH[0][0]}'
UNION ALL
SELECT DATE '{PATCH[0][0]}', {', '.join(f'{R(_q(c))}' for c in CLASSES)} FROM gcd WHERE Data = DATE '{PATCH[0][1]}'""")
def row_patch(spark, base):
    p = clean.patch_rows(gen_class_daily(spark, base), "Data", patches_df(spark, PATCH))
    return round_all(p, ["Data"])


@query("row_patch_absent_source", sql=f"""
WITH {GEN_CLASS_DAILY_SQL}
SELECT Data, {', '.join(f'{R(_q(c))} AS {_q(c)}' for c in CLASSES)} FROM gcd""")
def row_patch_absent_source(spark, base):
    """A patch whose source day lies outside the table changes nothing."""
    far = [(PATCH[0][0], "2090-01-01")]
    return round_all(clean.patch_rows(gen_class_daily(spark, base), "Data", patches_df(spark, far)), ["Data"])


# --- PRJ-5 ------------------------------------------------------------------
@query("row_total", sql=f"""
WITH {_class_wide_cte()}
SELECT Data, {R(' + '.join(f'COALESCE({_q(c)}, 0)' for c in CLASSES))} AS total FROM cw""")
def row_total(spark, base):
    w = reshape.class_subsystem_wide(gen_classes(spark, base), "ts", "cls", "sub", "value", CLASSES, SUBS)
    return clean.row_total(w, CLASSES).select(F.col("ts").alias("Data"), rnd("total").alias("total"))


# --- PRJ-6 ------------------------------------------------------------------
_HIGH = [f"HIGH_{s}" for s in SUBS]


@query("row_mean", sql=f"""
WITH {_class_wide_cte()}
SELECT Data, {R(f"({' + '.join(f'COALESCE({_q(c)}, 0)' for c in _HIGH)}) / "
               f"NULLIF({' + '.join(f'CASE WHEN {_q(c)} IS NULL THEN 0 ELSE 1 END' for c in _HIGH)}, 0)")} AS mean
FROM cw""")
def row_mean(spark, base):
    w = reshape.class_subsystem_wide(gen_classes(spark, base), "ts", "cls", "sub", "value", CLASSES, SUBS)
    return clean.row_mean(w, _HIGH).select(F.col("ts").alias("Data"), rnd("mean").alias("mean"))


# --- PRJ-8 ------------------------------------------------------------------
@query("macro_region", sql=f"""
WITH {GEN_CTE}
SELECT CAST(ts AS DATE) AS Data,
  CASE sub WHEN 'AMERICA' THEN 'AMERICAS' WHEN 'ASIA' THEN 'APAC' ELSE 'EMEA' END AS macro,
  {R('SUM(value)')} AS value
FROM gen GROUP BY ALL""")
def macro_region(spark, base):
    g = clean.remap_values(S.gen_fact(spark, base), "sub", S.MACRO_REGION, out="macro")
    return g.groupBy(F.to_date("ts").alias("Data"), "macro").agg(rnd(F.sum("value")).alias("value"))


# --- PRJ-3, PRJ-4 -----------------------------------------------------------
_KEPT = [c for c in WIDE_COLS if "OTHER" not in c and "ASIA" not in c]


@query("drop_by_name", sql=f"""
WITH {_class_wide_cte()}
SELECT Data, {', '.join(f'{R(_q(c))} AS {_q(c)}' for c in _KEPT)} FROM cw""")
def drop_by_name(spark, base):
    w = class_subsystem_wide(spark, base)
    return clean.drop_matching(w, ["OTHER", "ASIA"], keep=["Data"])


# --- FLT-1, FLT-2 -----------------------------------------------------------
@query("year_window", sql=f"""
WITH {GEN_CTE}
SELECT ts AS Data, cat AS series, {R('SUM(value)')} AS value FROM gen
WHERE year(ts) > 1996 AND year(ts) < 2001 GROUP BY ALL""")
def year_window(spark, base):
    g = clean.year_range(S.gen_fact(spark, base), "ts", after=1996, before=2001)
    return g.groupBy(F.col("ts").alias("Data"), F.col("cat").alias("series")).agg(rnd(F.sum("value")).alias("value"))


@query("year_equals", sql=f"""
WITH {LOAD_CTE}
SELECT sub, COUNT(*) AS n, {R('SUM(value)')} AS value FROM ld WHERE year(ts) = 1999 GROUP BY ALL""")
def year_equals(spark, base):
    ld = clean.year_equals(S.load_fact(spark, base), "ts", 1999)
    return ld.groupBy("sub").agg(F.count("*").alias("n"), rnd(F.sum("value")).alias("value"))


# --- PRE-1 ------------------------------------------------------------------
@query("preview", sql=f"""
WITH {LOAD_DAILY_SQL}
SELECT Data, {', '.join(f'{R(_q("CARGA_" + s))} AS {_q("CARGA_" + s)}' for s in SUBS)}
FROM ldd ORDER BY Data LIMIT 5""")
def preview(spark, base):
    return round_all(clean.preview(load_daily(spark, base), "Data", 5), ["Data"])


# --- JOI-3 ------------------------------------------------------------------
@query("align_inner", sql=f"""
WITH {GEN_CLASS_DAILY_SQL}, {LOAD_DAILY_SQL}
SELECT gcd.Data, {', '.join(f'{R("gcd." + _q(c))} AS {_q(c)}' for c in CLASSES)},
       {', '.join(f'{R("ldd." + _q("CARGA_" + s))} AS {_q("CARGA_" + s)}' for s in SUBS)}
FROM gcd JOIN ldd ON gcd.Data = ldd.Data
WHERE {' AND '.join(f'gcd.{_q(c)} IS NOT NULL' for c in CLASSES)}
  AND {' AND '.join(f'ldd.{_q("CARGA_" + s)} IS NOT NULL' for s in SUBS)}""")
def align_inner(spark, base):
    a = align.align([gen_class_daily(spark, base), load_daily(spark, base)], "Data", "inner", complete=True)
    return round_all(a, ["Data"])


# --- JOI-4 ------------------------------------------------------------------
_REG = BOXES


@query("align_left", sql=f"""
WITH {LOAD_DAILY_SQL}, {GRID_SQL},
rm AS (SELECT Data, region, AVG(value) AS v FROM cells GROUP BY ALL),
rw AS (SELECT Data, {', '.join(f"MAX(v) FILTER (WHERE region = '{r}') AS {_q(r + '_sst')}" for r in _REG)}
       FROM rm GROUP BY Data)
SELECT ldd.Data, {', '.join(f'{R("ldd." + _q("CARGA_" + s))} AS {_q("CARGA_" + s)}' for s in SUBS)},
       {', '.join(f'{R("rw." + _q(r + "_sst"), 6)} AS {_q(r + "_sst")}' for r in _REG)}
FROM ldd LEFT JOIN rw ON ldd.Data = rw.Data""")
def align_left(spark, base):
    a = align.align([load_daily(spark, base), region_table(spark, base)], "Data", "left")
    return a.select("Data", *[rnd(F.col(f"`CARGA_{s}`")).alias(f"CARGA_{s}") for s in SUBS],
                    *[rnd(F.col(f"`{r}_sst`"), 6).alias(f"{r}_sst") for r in _REG])


# --- JOI-5, SET-2 -----------------------------------------------------------
@query("common_dates", sql=f"""
WITH {GEN_CTE}, {LOAD_CTE}
SELECT CAST(ts AS DATE) AS Data FROM gen INTERSECT SELECT CAST(ts AS DATE) AS Data FROM ld""")
def common_dates(spark, base):
    a = S.gen_fact(spark, base).select(F.to_date("ts").alias("Data"))
    b = S.load_fact(spark, base).select(F.to_date("ts").alias("Data"))
    return align.common_dates(a, b, "Data")


@query("restrict_common", sql=f"""
WITH {GEN_CTE}, {LOAD_CTE},
a AS (SELECT CAST(ts AS DATE) AS Data, SUM(value) AS v FROM gen GROUP BY 1),
b AS (SELECT CAST(ts AS DATE) AS Data, SUM(value) AS v FROM ld GROUP BY 1)
SELECT 'gen' AS side, Data, {R('v')} AS value FROM a WHERE Data IN (SELECT Data FROM b)
UNION ALL SELECT 'load', Data, {R('v')} FROM b WHERE Data IN (SELECT Data FROM a)""")
def restrict_common(spark, base):
    a = S.gen_fact(spark, base).groupBy(F.to_date("ts").alias("Data")).agg(F.sum("value").alias("v"))
    b = S.load_fact(spark, base).groupBy(F.to_date("ts").alias("Data")).agg(F.sum("value").alias("v"))
    ra, rb = align.restrict_to_common(a, b, "Data")
    return (ra.select(F.lit("gen").alias("side"), "Data", rnd("v").alias("value"))
              .unionByName(rb.select(F.lit("load").alias("side"), "Data", rnd("v").alias("value"))))


# --- SET-1 ------------------------------------------------------------------
@query("union_files", sql=f"""
WITH {GEN_CTE}, {LOAD_CTE}
SELECT ts, sub, cat, value FROM gen
UNION ALL SELECT ts, sub, NULL AS cat, value FROM ld""")
def union_files(spark, base):
    g = S.gen_fact(spark, base).select("value", "cat", "sub", "ts")  # another column order
    ld = S.load_fact(spark, base).select("ts", "sub", "value")
    return reshape.union_by_name([g, ld]).select("ts", "sub", "cat", "value")


# --- AGG-11, TOP-1 ----------------------------------------------------------
HOURLY_TOTALS_SQL = f"{HOURLY_CTE}, ht AS (SELECT date_trunc('hour', ts) AS Data, SUM(value) AS total FROM hr GROUP BY 1)"


def hourly_totals(spark, base):
    h = S.hourly_fact(spark, base)
    return h.groupBy(hour_start("ts").alias("Data")).agg(F.sum("value").alias("total"))


@query("peak_day", sql=f"""
WITH {HOURLY_TOTALS_SQL}
SELECT Data, CAST(Data AS DATE) AS day, {R('total')} AS total FROM ht ORDER BY total DESC, Data ASC LIMIT 1""")
def peak_day(spark, base):
    p = align.peak_instant(hourly_totals(spark, base), "Data", "total")
    return p.select("Data", F.to_date("Data").alias("day"), rnd("total").alias("total"))


# --- FLT-3, JOI-9, PIP-10 -----------------------------------------------------
@query("peak_profile", sql=f"""
WITH {HOURLY_TOTALS_SQL},
pk AS (SELECT CAST(Data AS DATE) AS day FROM ht ORDER BY total DESC, Data ASC LIMIT 1)
SELECT date_trunc('hour', ts) AS Data,
  {', '.join(f"{R(f'SUM(value) FILTER (WHERE key = {chr(39)}{k}{chr(39)})')} AS {_q('EV_' + k)}" for k in EVENT_TYPES)},
  {R('SUM(value)')} AS total
FROM hr WHERE CAST(ts AS DATE) IN (SELECT day FROM pk) GROUP BY 1""")
def peak_profile(spark, base):
    # one pass over the events; the peak, its day and the total come from the hours
    hours = materialize(S.hourly_fact(spark, base).groupBy(hour_start("ts").alias("Data"), "key")
                        .agg(F.sum("value").alias("value")))
    pk = align.peak_instant(hours.groupBy("Data").agg(F.sum("value").alias("total")), "Data", "total")
    masks = {**{f"EV_{k}": F.col("key") == F.lit(k) for k in EVENT_TYPES}, "total": F.lit(True)}
    wide = reshape.pivot_masks(align.rows_on_day_of(hours, "Data", pk, "Data"), ["Data"], masks, "value")
    return round_all(wide, ["Data"])


# --- PIP-10: load peak -> that day's load and generation by class -----------------
def _peak_generation_sql():
    load = ", ".join(f"SUM(value) FILTER (WHERE sub = '{s}') AS {_q('CARGA_' + s)}" for s in SUBS)
    gen = ", ".join(f"SUM(value) FILTER (WHERE cls = '{c}') AS {_q(c)}" for c in CLASSES)
    out = ", ".join([f"{R('lw.' + _q('CARGA_' + s))} AS {_q('CARGA_' + s)}" for s in SUBS]
                    + [f"{R('gw.' + _q(c))} AS {_q(c)}" for c in CLASSES])
    return f"""WITH {GEN_CTE}, {LOAD_CTE},
lt AS (SELECT ts, SUM(value) AS total FROM ld GROUP BY ts),
pk AS (SELECT CAST(ts AS DATE) AS day FROM lt ORDER BY total DESC, ts LIMIT 1),
lw AS (SELECT ts AS Data, {load} FROM ld WHERE CAST(ts AS DATE) IN (SELECT day FROM pk) GROUP BY 1),
gw AS (SELECT ts AS Data, {gen} FROM (SELECT ts, {CLASS_SQL} AS cls, value FROM gen)
       WHERE CAST(ts AS DATE) IN (SELECT day FROM pk) GROUP BY 1)
SELECT lw.Data, {out} FROM lw LEFT JOIN gw ON lw.Data = gw.Data"""


@query("peak_load_generation", sql=_peak_generation_sql())
def peak_load_generation(spark, base):
    """Load and generation by class on the day of the highest total load."""
    cells = materialize(S.load_fact(spark, base).groupBy(F.col("ts").alias("Data"), "sub")
                        .agg(F.sum("value").alias("value")))
    pk = align.peak_instant(cells.groupBy("Data").agg(F.sum("value").alias("total")), "Data", "total")
    load = reshape.pivot_series(align.rows_on_day_of(cells, "Data", pk, "Data"), "Data", "sub", "value",
                                values=SUBS, prefix="CARGA_")
    gen = align.rows_on_instant_day(gen_classes(spark, base), "ts", pk, "Data").withColumnRenamed("ts", "Data")
    wide = reshape.pivot_series(gen, "Data", "cls", "value", values=CLASSES)
    return round_all(align.align([load, wide], "Data", "left"), ["Data"])


# --- AGG-18, SCL-1 ----------------------------------------------------------
_CELLS_DAY_SQL = f"""{GEN_CTE},
cells AS (SELECT ts, cat AS series, SUM(value) AS value FROM gen GROUP BY ALL),
b AS (SELECT CAST(min(ts) AS TIMESTAMP) lo, CAST(max(ts) AS TIMESTAMP) hi FROM cells),
cal AS (SELECT CAST(d AS DATE) AS Data FROM b, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) t(d)),
dd AS (SELECT k.series, cal.Data, COALESCE(SUM(c.value), 0) AS value
       FROM cal CROSS JOIN (SELECT DISTINCT series FROM cells) k
       LEFT JOIN cells c ON c.series = k.series AND CAST(c.ts AS DATE) = cal.Data GROUP BY ALL)"""


def gen_daily_long(spark, base):
    from .q_reshape import gen_cells
    return resample.resample(gen_cells(spark, base), "ts", ["series"], "value", "day", "sum")


@query("distribution_summary", sql=f"""
WITH {_CELLS_DAY_SQL},
z AS (SELECT series, Data, (value - AVG(value) OVER (PARTITION BY series))
        / COALESCE(NULLIF(STDDEV_POP(value) OVER (PARTITION BY series), 0), 1) AS z FROM dd)
SELECT series, COUNT(*) AS n, {R('MIN(z)')} AS min, {R('AVG(z)')} AS mean, {R('MAX(z)')} AS max,
  {R('quantile_cont(z, 0.25)')} AS q1, {R('quantile_cont(z, 0.5)')} AS median, {R('quantile_cont(z, 0.75)')} AS q3
FROM z WHERE Data >= DATE '1999-01-01' GROUP BY series""")
def distribution_summary(spark, base):
    z = scale.standardize(gen_daily_long(spark, base), ["series"], "value", out="z")
    z = clean.year_range(z, "Data", after=1998)
    from ..operators.quantile import exact_quantiles
    z = materialize(z)
    q = exact_quantiles(z, ["series"], "z", [0.25, 0.5, 0.75]).select("series", F.col("quantiles").alias("_q"))
    return (z.groupBy("series").agg(F.count("*").alias("n"), rnd(F.min("z")).alias("min"),
                                    rnd(F.avg("z")).alias("mean"), rnd(F.max("z")).alias("max")).join(q, "series")
             .select("series", "n", "min", "mean", "max", rnd(F.col("_q")[0]).alias("q1"),
                     rnd(F.col("_q")[1]).alias("median"), rnd(F.col("_q")[2]).alias("q3")))


@query("fact_quantiles", sql=f"""
WITH {GEN_CTE}, a AS (SELECT {CLASS_SQL} AS cls, value FROM gen UNION ALL SELECT 'all', value FROM gen)
SELECT cls, COUNT(value) AS n, {', '.join(f"{R(f'quantile_cont(value, {q})', 3)} AS q{int(q * 1000)}" for q in (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0))}
FROM a GROUP BY cls""")
def fact_quantiles(spark, base):
    """Quantiles of the raw facts per class and over all: groups that grow with the data."""
    from ..operators.quantile import exact_quantiles
    g = clean.remap_values(S.gen_fact(spark, base), "cat", S.PRIORITY_CLASS, out="cls").select("cls", "value")
    both = g.unionByName(g.select(F.lit("all").alias("cls"), "value"))
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    out = exact_quantiles(both, ["cls"], "value", probs, accuracy=1000)
    return out.select("cls", "n", *[rnd(F.col("quantiles")[i], 3).alias(f"q{int(q * 1000)}") for i, q in enumerate(probs)])


# --- SCL-1, AGG-16, AGG-19 --------------------------------------------------
@query("standardize_all", sql=f"""
WITH {_CELLS_DAY_SQL}
SELECT series, Data, {R('(value - AVG(value) OVER (PARTITION BY series)) / '
                        'COALESCE(NULLIF(STDDEV_POP(value) OVER (PARTITION BY series), 0), 1)', 6)} AS z FROM dd""")
def standardize_all(spark, base):
    z = scale.standardize(gen_daily_long(spark, base), ["series"], "value", out="z")
    return z.select("series", "Data", rnd("z", 6).alias("z"))


# --- SCL-2 ------------------------------------------------------------------
@query("standardize_train", sql=f"""
WITH {_CELLS_DAY_SQL},
p AS (SELECT series, AVG(value) AS mu, COALESCE(NULLIF(STDDEV_POP(value), 0), 1) AS sd, COUNT(*) AS n_fit
      FROM dd WHERE Data < DATE '1999-01-01' GROUP BY series)
SELECT dd.series, dd.Data, {R('(dd.value - p.mu) / p.sd', 6)} AS z, p.n_fit FROM dd JOIN p USING (series)""")
def standardize_train(spark, base):
    d = gen_daily_long(spark, base)
    params = scale.fit_scaler(d, ["series"], "value", where=F.col("Data") < F.lit("1999-01-01").cast("date"))
    z = scale.apply_scaler(d, params, ["series"], "value", out="z").join(
        params.select("series", F.col("n").alias("n_fit")), "series")
    return z.select("series", "Data", rnd("z", 6).alias("z"), "n_fit")
