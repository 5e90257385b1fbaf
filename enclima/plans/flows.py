"""End-to-end compositions (PIP-1..9) as library functions.

Each takes ordinary DataFrames in the long canonical model and returns
DataFrames; nothing here knows about the driver tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import FUEL_CLASS, patches_df
from ..functions import add_calendar_features, clamp_negative, sum_or_zero
from ..operators import align, clean, evaluate, lagged, reshape, resample, scale, split, trained
from ..operators.forest import DEFAULTS, fit_forests
from ..operators.regress import LinearModel
from ..session import materialize
from ..sources import index_text as IT

TABLES = ("hourly_MWmed", "daily_MWh", "monthly_MWh", "daily_MWmed", "monthly_MWmed")


# --- resampling shared by generation and load --------------------------------------
def resample_tables(cells: DataFrame, ts: str = "ts", series: str = "series", value: str = "value",
                    patches: DataFrame | None = None, hourly: bool = True) -> dict[str, DataFrame]:
    """The five tables of the reference from hourly cells (one row per hour
    and series): hourly MWmed, daily / monthly MWh (sums, empty bins 0) and
    daily / monthly MWmed (means of hours, empty bins NULL).

    The cells are checkpointed once (they feed the hourly table and the daily
    pass; with ``hourly=False`` the hourly table is not produced and the
    daily pass reads them directly). One aggregation reduces them to dense
    daily partials (sum, mean,
    count); the monthly tables are derived from those daily partials (sum of
    sums, sum of sums / sum of counts) instead of re-reading the hours."""
    if hourly:
        cells = materialize(cells)  # hours x series: read by the hourly table and the daily pass
    d = resample.resample_many(cells, ts, [series], value, "day", ("sum", "mean", "count"))
    daily_sum = d.select(series, "Data", F.col(f"{value}_sum").alias(value))
    daily_mean = d.select(series, "Data", F.col(f"{value}_mean").alias(value))
    if patches is not None:
        daily_mean = clean.patch_rows(daily_mean, "Data", patches)
    m = d.groupBy(series, F.last_day("Data").alias("Data")).agg(
        F.sum(f"{value}_sum").alias("_s"), F.sum(f"{value}_count").alias("_n"))
    monthly_sum = m.select(series, "Data", F.col("_s").alias(value))
    monthly_mean = m.select(series, "Data", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).alias(value))
    out = dict(zip(TABLES[1:], (daily_sum, monthly_sum, daily_mean, monthly_mean)))
    if hourly:
        out = {TABLES[0]: cells.select(series, F.col(ts).alias("Data"), value), **out}
    return out


def generation_cells(df: DataFrame, ts: str = "ts", sub: str = "sub", fuel: str = "fuel", value: str = "value",
                     fuel_map: dict | None = None, sep: str = "_") -> DataFrame:
    """Hourly cells of every class total and every ``{class}_{subsystem}``
    (PRJ-2 + RSH-3 in one grouping-sets aggregation), long form."""
    g = clean.remap_values(df, fuel, FUEL_CLASS if fuel_map is None else fuel_map, out="_cls")
    sets = reshape.class_subsystem_sets(g, ts, "_cls", sub, value)
    name = F.when(F.col(sub).isNull(), F.col("_cls")).otherwise(F.concat_ws(sep, "_cls", sub))
    return sets.select(F.col(ts).alias("ts"), name.alias("series"), F.col(value).alias("value"))


def generation_tables(df: DataFrame, ts: str = "ts", sub: str = "sub", fuel: str = "fuel", value: str = "value",
                      fuel_map: dict | None = None, patches: DataFrame | None = None,
                      hourly: bool = True) -> dict[str, DataFrame]:
    """PIP-1: generation facts -> the five generation tables (long); the
    hourly one only when ``hourly``."""
    cells = generation_cells(df, ts, sub, fuel, value, fuel_map)
    if patches is None:
        patches = patches_df(df.sparkSession)
    return resample_tables(cells, patches=patches, hourly=hourly)


def load_tables(df: DataFrame, ts: str = "ts", sub: str = "sub", value: str = "value",
                prefix: str = "CARGA_", hourly: bool = True) -> dict[str, DataFrame]:
    """PIP-2: load facts -> five ``CARGA_{subsystem}`` tables (long); the
    hourly one only when ``hourly``."""
    # pivot_table(aggfunc='sum'): an hour whose rows are all missing is 0
    cells = df.groupBy(F.col(ts).alias("ts"), F.concat(F.lit(prefix), F.col(sub)).alias("series")).agg(
        sum_or_zero(F.col(value).cast("double")).alias("value"))
    return resample_tables(cells, hourly=hourly)


def hydrology_daily(df: DataFrame, ts: str, sub: str, measures: Sequence[str],
                    subs: Sequence[str] | None = None) -> DataFrame:
    """PIP-3: per (date, subsystem) sums of every measure, one column per
    ``{subsystem}_{measure}``."""
    d = df.withColumn("Data", F.to_date(F.col(ts)))
    return reshape.multi_measure_pivot(d, "Data", sub, measures, keys=subs)


def indices_table(lines: DataFrame | None = None, semicolon_rows: DataFrame | None = None,
                  names: Sequence[str] | None = None, sentinels: DataFrame | None = None) -> DataFrame:
    """PIP-4: both text layouts -> long -> sentinels removed -> one column per
    index, ``Data`` as ``yyyy-MM``."""
    parts = []
    if lines is not None:
        parts.append(IT.parse_wide_lines(lines))
    if semicolon_rows is not None:
        parts.append(semicolon_rows)
    long = reshape.union_by_name(parts)
    clean_long = IT.null_sentinels(long, sentinels)
    names = reshape.distinct_values(clean_long, "index") if names is None else list(names)
    return IT.merge_indices(clean_long, names)


def to_wide(long: DataFrame, series: str = "series", value: str = "value", ts: str = "Data",
            names: Sequence[str] | None = None) -> DataFrame:
    names = reshape.distinct_values(long, series) if names is None else list(names)
    return reshape.pivot_masks(long, [ts], {n: F.col(series) == F.lit(n) for n in names}, value, how="first")


# --- PIP-6 ------------------------------------------------------------------------
def training_frame(targets: DataFrame, load: DataFrame, others: Sequence[DataFrame] = (), ts: str = "Data",
                   drop: Sequence[str] = ("Fotovoltaica", "Outras"), after: int | None = None,
                   before: int | None = None, test_size: float = 0.3, fit_on: str = "all"):
    """Targets (wide, filled with 0, names containing ``drop`` removed) aligned
    with load + calendar features and other exogenous tables on complete
    rows, restricted to a year window, exogenous columns standardised (ddof 0,
    fitted on all rows like the reference, or on the train rows) and split
    chronologically. Returns ``(frame, target_cols, exog_cols)``."""
    t = clean.drop_matching(targets, drop, keep=[ts])
    target_cols = [c for c in t.columns if c != ts]
    t = clean.fill_missing(t, target_cols, 0.0)
    ld = add_calendar_features(load, ts)
    frame = align.align([t, ld, *others], ts, "inner", complete=True)
    frame = clean.year_range(frame, ts, after=after, before=before)
    exog_cols = [c for c in frame.columns if c != ts and c not in target_cols]
    frame = frame.withColumns({c: F.col(f"`{c}`").cast("double") for c in exog_cols})
    stats = None
    if fit_on == "all":
        # scaler statistics over all rows are observed while the frame is written
        from pyspark.sql import Observation
        obs = Observation("scaler")
        frame = materialize(frame.observe(obs, *scale.wide_stat_aggs(exog_cols)))
        stats = obs.get
    else:
        frame = materialize(frame)
    frame = split.train_test_split(frame, ts, test_size)
    fit_where = (F.col("split") == "train") if fit_on == "train" else None
    frame = scale.standardize_wide(frame, exog_cols, fit_where, stats=stats)
    # the aligned base was materialized above; split and scaling are literal
    # projections over it
    return frame, target_cols, exog_cols


def _score(pred_long: DataFrame, n_daily: DataFrame, p: int, model: str) -> DataFrame:
    monthly = evaluate.month_mean(pred_long, ["target"], "Data", ["actual", "predicted"])
    met = evaluate.regression_metrics(monthly, ["target"], "actual", "predicted").join(n_daily, "target")
    met = evaluate.with_adjusted_r2(met, "n_daily", p)
    return met.select(F.lit(model).alias("model"), "target", "n_daily", "r2", "adj_r2", "mse")


def _long_predictions(test: DataFrame, targets: Sequence[str], pred_col) -> DataFrame:
    """(target, Data, actual, predicted) for every target in one scan: each
    row explodes into one struct per target (no union of per-target scans)."""
    items = [F.struct(F.lit(t).alias("target"), F.col(f"`{t}`").cast("double").alias("actual"),
                      clamp_negative(pred_col(t)).alias("predicted")) for t in targets]
    return (test.select("Data", F.explode(F.array(*items)).alias("_p"))
                .select("_p.target", "Data", "_p.actual", "_p.predicted"))


def ols_study(frame: DataFrame, targets: Sequence[str], exogs: Sequence[str], model: str = "ols"):
    """PIP-7: fit on train rows, predict test rows, clamp, monthly means,
    metrics; adjusted R2 uses the number of *daily* test rows (as the
    reference). Returns ``(metrics, long predictions, fitted model)``."""
    m = LinearModel.fit(frame.where(F.col("split") == "train"), exogs, targets)
    test = frame.where(F.col("split") == "test")
    pred = _long_predictions(test, targets, m.prediction)
    n_daily = pred.groupBy("target").agg(F.count("*").alias("n_daily"))
    return _score(pred, n_daily, len(exogs), model), pred, m


def rf_predictions(frame: DataFrame, targets: Sequence[str], exogs: Sequence[str], seed: int = 69,
                   **params) -> DataFrame:
    """REG-3: one joint forest of all targets, grown on the train rows; long
    test predictions, clamped at 0."""
    forest = fit_forests(frame.where(F.col("split") == "train"), exogs, targets, [params], "Data", seed=seed)
    found = forest.predict(frame.where(F.col("split") == "test"), ["Data", *targets])
    at = {t: F.col("prediction")[i] for i, t in enumerate(targets)}
    out = materialize(_long_predictions(found, targets, at.__getitem__))
    forest.discard()
    return out


def rf_study(frame: DataFrame, targets: Sequence[str], exogs: Sequence[str], **rf_args):
    """PIP-8: the OLS study with a joint random forest."""
    pred = rf_predictions(frame, targets, exogs, **rf_args)
    n_daily = pred.groupBy("target").agg(F.count("*").alias("n_daily"))
    return _score(pred, n_daily, len(exogs), "random_forest"), pred


GRID = ("num_trees", "max_features", "max_depth", "min_samples_split", "min_samples_leaf", "bootstrap")


def rf_grid(frame: DataFrame, targets: Sequence[str], exogs: Sequence[str], grid: dict[str, Sequence],
            n_splits: int = 5, ts: str = "Data", seed: int = 69, **fixed) -> DataFrame:
    """REG-4: every combination of the ``grid`` values, scored on expanding
    time-series folds of the train rows. One row per combination and fold: the
    six parameters, fold, rmse (mean over the targets), mean_rmse (over the
    folds) and best (smallest mean_rmse; a tie goes to the earlier combination).

    All forests of all folds grow together; forests that differ in their number
    of trees only are one forest, read at several sizes."""
    from itertools import product
    grid = {**{k: [v] for k, v in {**DEFAULTS, **fixed}.items()}, **{k: list(v) for k, v in grid.items()}}
    sizes = sorted(set(grid.pop("num_trees")))
    sets = [dict(zip(grid, values)) for values in product(*grid.values())]
    spark = frame.sparkSession
    folds = materialize(split.time_series_folds(frame.where(F.col("split") == "train").drop("split"), ts, n_splits))
    forest = fit_forests(folds.where("role = 'train'"), exogs, targets, [{**a, "num_trees": sizes[-1]} for a in sets],
                         ts, fold="fold", folds=n_splits, seed=seed)
    found = forest.predict(folds.where("role = 'test'").withColumnRenamed("fold", "_of"), [ts, *targets], "_of", sizes)
    error = F.lit(0.0)
    for i, t in enumerate(targets):
        gap = F.col("prediction")[i] - F.col(f"`{t}`").cast("double")
        error = error + F.sqrt(F.avg(gap * gap))
    scores = materialize(found.groupBy("set", "num_trees", "fold").agg((error / len(targets)).alias("rmse")))
    forest.discard()
    named = spark.createDataFrame(
        [(i, str(a["max_features"]), a["max_depth"], a["min_samples_split"], a["min_samples_leaf"], a["bootstrap"])
         for i, a in enumerate(sets)],
        "set int, max_features string, max_depth int, min_samples_split int, min_samples_leaf int, bootstrap boolean")
    mean = scores.groupBy("set", "num_trees").agg(F.avg("rmse").alias("mean_rmse"))
    top = mean.agg(F.min(F.struct("mean_rmse", "set", "num_trees")).alias("top"))
    # one row per combination, and one row: bounded by the grid
    return (scores.join(F.broadcast(mean), ["set", "num_trees"]).join(F.broadcast(named), "set").join(F.broadcast(top))
            .withColumn("best", (F.col("set") == F.col("top.set")) & (F.col("num_trees") == F.col("top.num_trees")))
            .select(*GRID, "fold", "rmse", "mean_rmse", "best"))


# --- PIP-9 ------------------------------------------------------------------------
def forecast_study(daily_long: DataFrame, context: int = 90, horizon: int = 30, season: int = 52,
                   exog: DataFrame | None = None, period: str = "week", before: int | None = None,
                   drop: Sequence[str] = ("Fotovoltaica", "Outras"), fractions: dict | None = None,
                   ridges: Sequence[float] = (1e-3, 1e-2, 1e-1, 1.0),
                   models: Sequence[str] = ("naive", "seasonal", "linear", "linear_exog"), **training) -> DataFrame:
    """PIP-9: means per ``period`` ("week" or "day"), complete dates only,
    70/10/20 split with context overlap, scaling fitted on train, forecasters
    (last value, seasonal, linear on the context, and with ``exog`` - a wide
    table per date, known in advance - linear with all its channels), overlap
    mean, dates common with the test actuals, monthly means, metrics per
    (model, target). Of several ``ridges`` each series takes the one with the
    smallest error on the valid split. The model ``trained`` is one network for
    all series and channels, fitted by gradient steps with early stop on the
    valid split (``training``: arguments of ``trained.fit``)."""
    d = clean.fill_missing(daily_long, ["value"], 0.0)
    d = clean.filter_keys_not_containing(d, "series", drop)
    if period != "day":
        d = resample.resample(d, "Data", ["series"], "value", period, "mean")
    channels = [] if exog is None else [c for c in exog.columns if c != "Data"]
    if channels:
        if period != "day":
            long = exog.unpivot(["Data"], [F.col(f"`{c}`") for c in channels], "series", "value")
            exog = to_wide(resample.resample(long, "Data", ["series"], "value", period, "mean"), names=channels)
        d = clean.drop_incomplete(d.join(exog, "Data"), channels)
    if before is not None:
        d = clean.year_range(d, "Data", before=before)
    d = materialize(clean.drop_incomplete(d, ["value"]))
    place = split.date_positions(d, "Data").select("Data", "pos")
    sp = materialize(split.fraction_splits(d.join(place, "Data"), "Data", fractions, context=context))
    learn = F.col("split") == "train"
    params = scale.fit_scaler(sp.where(learn), ["series"], "value")
    z = scale.apply_scaler(sp, params, ["series"], "value")
    z = materialize(scale.standardize_wide(z, channels, learn) if channels else z)
    part = {name: z.where(F.col("split") == name) for name in ("train", "valid", "test")}

    def run(rows, kind, models=None, extra=()):
        return lagged.forecast_mean(rows, ["series"], "pos", "value", context, horizon, kind, models, extra, season)

    def best_linear(extra):
        models = materialize(lagged.fit_windows(part["train"], ["series"], "pos", "value", context, horizon, extra, ridges))
        if len(ridges) == 1:
            return models
        errors = None
        for ridge in ridges:
            gap = run(part["valid"], "linear", models.where(F.col("ridge") == ridge), extra).join(
                part["valid"].select("series", "pos", "value"), ["series", "pos"])
            e = gap.groupBy("series").agg(F.avg((F.col("value") - F.col("predicted")) ** 2).alias("mse")).withColumn(
                "ridge", F.lit(float(ridge)))
            errors = e if errors is None else errors.unionByName(e)
        best = errors.groupBy("series").agg(F.min(F.struct("mse", "ridge")).alias("b")).select("series", F.col("b.ridge"))
        return materialize(models.join(best, ["series", "ridge"]))

    found = {}
    for name in models:
        if name in ("naive", "seasonal"):
            found[name] = run(part["test"], name)
        elif name == "linear":
            found[name] = run(part["test"], "linear", best_linear([]))
        elif name == "linear_exog" and channels:
            found[name] = run(part["test"], "linear", best_linear(channels), channels)
        elif name == "trained":
            net, _ = trained.fit(part["train"], part["valid"], ["series"], "pos", "value", context, horizon, channels, **training)
            found[name] = run(part["test"], net, None, channels)
    actual = sp.where(F.col("split") == "test").select("series", "pos", "Data", F.col("value").alias("actual"))
    out = None
    for name, forecasts in found.items():
        one = forecasts.withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    back = scale.apply_scaler(out, params, ["series"], "predicted", inverse=True)
    j = back.join(actual, ["series", "pos"])    # dates common to both
    monthly = evaluate.month_mean(j, ["model", "series"], "Data", ["actual", "predicted"])
    met = evaluate.regression_metrics(monthly, ["model", "series"], "actual", "predicted")
    return met.select("model", F.col("series").alias("target"), "n", "r2", "mse")
