"""Direct linear forecasts over context windows that are never formed
(FCS-1, FCS-2, FCS-3, AGG-14).

A window is ``width = context + horizon`` consecutive rows of a series. Its
predictors are the context values and, per exogenous channel, the values over
the horizon; its targets are the horizon values. The normal equations need
``G[i, j] = sum over windows s of a[s + i] * b[s + j]`` for pairs of channels.
Moving both offsets by one only exchanges the first window for the one behind
the last, so

    G[i + 1, j + 1] = G[i, j] + a[end + i] * b[end + j] - a[start + i] * b[start + j]

and lag products ``G[0, j]`` with the rows at the ends of every unbroken run
of windows give the whole matrix. A series is cut into blocks of rows; a block
(with the ``width`` rows behind it) computes its lag products with numpy and
sends one partial sum per lag; a hash aggregate adds them, and each series'
system is solved in an executor. Work is rows x width, not rows x width ** 2,
and rows are copied only at the block edges.

Forecasts are made block by block as well: a block returns, per date, the sum
and number of the forecasts of its own origins, so that the mean over origins
is one small aggregate and no window or single forecast is written.

Missing values: a window with a missing row or value in any channel is left
out; a forecast needs a complete context, complete exogenous values over the
horizon, and rows (not values) to exist there.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .regress import solve

BLOCK = 8192                                    # rows of a block, at least 8 widths


def _block_rows(width: int) -> int:
    return max(BLOCK, 8 * width)


def in_blocks(rows: DataFrame, keys: Sequence[str], pos: str, width: int, channels: Sequence[str]) -> DataFrame:
    """(keys, block, pos, c array): every row in its own block, and in those
    before whose windows reach it (one row beyond either end tells whether a
    run of windows goes on)."""
    size = _block_rows(width)
    first, last = F.floor((F.col(pos) - width) / size), F.floor((F.col(pos) + 1) / size)
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in channels])
    return (rows.select(*[F.col(f"`{k}`") for k in keys], F.col(pos).cast("long").alias("pos"), values.alias("c"),
                        F.explode(F.sequence(first, last)).alias("block")).where("block >= 0"))


def _dense(pos: np.ndarray, values, start: int, stop: int, channels: int) -> np.ndarray:
    """(stop - start) x channels with NaN where there is no row."""
    out = np.full((stop - start, channels), np.nan)
    if len(pos):
        out[pos - start] = np.array([[np.nan if v is None else v for v in row] for row in values], float)
    return out


def _runs(valid: np.ndarray) -> list[tuple[int, int]]:
    """[start, stop) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], valid.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _products(key, pdf, width: int, channels: int, keys: Sequence[str], size: int):
    """Partial sums of one block: n, sums at offset 0, lag products; and the
    rows at the ends of unbroken runs of windows."""
    import pandas as pd
    begin = int(key[-1]) * size
    x = _dense(pdf["pos"].to_numpy(), pdf["c"], begin - 1, begin + size + width, channels)
    whole = ~np.isnan(x).any(axis=1)
    count = np.concatenate([[0], np.cumsum(whole)])
    valid = count[width:] - count[:-width] == width             # window starts begin - 1 .. begin + size
    own = valid.copy()
    own[0] = own[-1] = False
    sums = np.zeros(1 + channels + channels * channels * width)
    ends = []
    for a, b in _runs(own):
        part = x[a:b + width - 1]
        sums[0] += b - a
        sums[1:1 + channels] += part[:b - a].sum(axis=0)
        lag = np.stack([np.correlate(part[:, j], part[:b - a, i], "valid")
                        for i in range(channels) for j in range(channels)])
        sums[1 + channels:] += lag.ravel()
        if not valid[a - 1]:
            ends.append((-1.0, x[a:a + width - 1]))
        if not valid[b]:
            ends.append((1.0, x[b:b + width - 1]))
    rows = [(*key[:-1], 0.0, sums.tolist())] if sums[0] else []
    rows += [(*key[:-1], sign, w.ravel().tolist()) for sign, w in ends]
    return pd.DataFrame(rows, columns=[*keys, "sign", "v"])


def _matrix(first_row: np.ndarray, first_col: np.ndarray, step: np.ndarray) -> np.ndarray:
    """G from its first row and column and the steps along the diagonals."""
    w = len(first_row)
    g = np.empty((w, w))
    g[0], g[:, 0] = first_row, first_col
    for i in range(w - 1):
        g[i + 1, 1:] = g[i, :-1] + step[i]
    return g


def _solved(batches, context: int, horizon: int, channels: int, keys: Sequence[str], ridges: Sequence[float]):
    import pandas as pd
    width = context + horizon
    for pdf in batches:
        rows = []
        for row in pdf.itertuples(index=False):
            own = list(row[:len(keys)])
            s, ends = np.array(row[len(keys)], float), row[len(keys) + 1]
            n = s[0]
            lag = s[1 + channels:].reshape(channels, channels, width)
            sign = np.array([e["sign"] for e in ends])
            edge = np.array([e["v"] for e in ends], float).reshape(len(ends), width - 1, channels)
            total = np.empty((channels, width))
            total[:, 0] = s[1:1 + channels]
            total[:, 1:] = total[:, :1] + np.cumsum(np.einsum("e,ewc->cw", sign, edge), axis=1)
            use = [slice(0, width)] + [slice(context, width)] * (channels - 1)
            parts = [[None] * channels for _ in range(channels)]
            for i in range(channels):
                for j in range(i, channels):
                    step = (edge[:, :, i] * sign[:, None]).T @ edge[:, :, j]
                    g = _matrix(lag[i, j], lag[j, i], step)[use[i], use[j]]
                    parts[i][j], parts[j][i] = g, g.T
            g = np.block(parts)
            mean = np.concatenate([total[i, use[i]] for i in range(channels)]) / n
            g = g - n * np.outer(mean, mean)
            x = np.r_[0:context, width:len(g)]
            y = np.r_[context:width]
            for ridge in ridges:
                coef, icpt = solve(n, np.concatenate([mean[x], mean[y]]), g[np.ix_(x, x)], g[np.ix_(x, y)],
                                   ridge * max(n, 1.0))
                rows.append([*own, float(ridge), int(n), coef.T.ravel().tolist(), icpt.tolist()])
        yield pd.DataFrame(rows, columns=[*keys, "ridge", "n", "_w", "_b"])


def fit_windows(rows: DataFrame, keys: Sequence[str], pos: str, value: str, context: int, horizon: int,
                exog: Sequence[str] = (), ridges: Sequence[float] = (1e-3,)) -> DataFrame:
    """Ridge models of every horizon step per series and ridge: (keys, ridge,
    n windows, ``_w`` horizon x predictors, row by row, ``_b``). ``pos`` numbers
    the rows of a series without gaps for consecutive time stamps; a ridge is
    per window. The products are summed once for all ridges."""
    keys, channels, width = list(keys), 1 + len(exog), context + horizon
    blocks = in_blocks(rows, keys, pos, width, [value, *exog])
    fields = [f for f in rows.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField("sign", T.DoubleType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    size = _block_rows(width)

    def products(key, pdf):
        return _products(key, pdf, width, channels, keys, size)

    parts = materialize(blocks.groupBy(*keys, "block").applyInPandas(products, schema))
    by = [F.col(f"`{k}`") for k in keys]
    # element-wise sums over the blocks, and the few ends of runs as they are
    cells = (parts.select(*by, "sign", F.posexplode(F.when(F.col("sign") == 0, F.col("v"))).alias("i", "s"))
             .groupBy(*keys, "i").agg(F.sum("s").alias("s")))
    sums = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("s")).select(
        *by, F.col("s.s").alias("s"))
    ends = parts.where("sign <> 0").groupBy(*keys).agg(F.collect_list(F.struct("sign", "v")).alias("ends"))
    out = T.StructType([*fields, T.StructField("ridge", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("_w", T.ArrayType(T.DoubleType())),
                        T.StructField("_b", T.ArrayType(T.DoubleType()))])
    return sums.join(ends, keys).select(*by, "s", "ends").mapInPandas(
        functools.partial(_solved, context=context, horizon=horizon, channels=channels, keys=keys, ridges=list(ridges)), out)


def _forecasts(x: np.ndarray, context: int, horizon: int, kind: str, season: int, w, b) -> np.ndarray:
    """Windows x horizon forecasts; NaN where an input is missing."""
    n = len(x) - context - horizon + 1
    y = x[:, 0]
    if kind == "naive":
        return np.repeat(y[context - 1:context - 1 + n, None], horizon, axis=1)
    if kind == "seasonal":
        at = context - season + np.arange(horizon) % season
        return y[np.arange(n)[:, None] + at]
    view = np.lib.stride_tricks.sliding_window_view
    parts = [view(y, context)[:n]] + [view(x[:, c], horizon)[context:context + n] for c in range(1, x.shape[1])]
    w = np.asarray(w, float).reshape(horizon, -1)
    out, at = np.tile(np.asarray(b, float), (n, 1)), 0
    for p in parts:
        out += p @ w[:, at:at + p.shape[1]].T
        at += p.shape[1]
    return out


def forecast_mean(rows: DataFrame, keys: Sequence[str], pos: str, value: str, context: int, horizon: int,
                  kind: str | Callable = "linear", models: DataFrame | None = None, exog: Sequence[str] = (),
                  season: int = 7, origins: Column | None = None) -> DataFrame:
    """(keys, pos, predicted, n_forecasts): mean of the forecasts that different
    origins made for a position. ``kind`` is ``naive``, ``seasonal``,
    ``linear`` (with ``models`` of ``fit_windows``) or a function of (rows x
    channels, context, horizon) that gives the forecasts of all its windows. ``origins``, a condition on
    the columns of ``rows``, names the rows that may be an origin."""
    keys, width, channels = list(keys), context + horizon, 1 + len(exog)
    size = _block_rows(width)
    may = F.lit(True) if origins is None else F.coalesce(origins, F.lit(False))
    marked = rows.withColumn("_may", may.cast("double"))
    blocks = in_blocks(marked, keys, pos, width, [value, *exog, "_may"])
    fields = [f for f in rows.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField("pos", T.LongType()), T.StructField("total", T.DoubleType()),
                           T.StructField("n", T.LongType())])

    def run(key, pdf, w=None, b=None):
        import pandas as pd
        begin = int(key[-1]) * size
        pdf = pdf[(pdf["pos"] >= begin) & (pdf["pos"] < begin + size + width - 1)]
        if not len(pdf):
            return pd.DataFrame({f.name: np.array([], object) for f in schema.fields})
        x = _dense(pdf["pos"].to_numpy(), pdf["c"], begin, begin + size + width - 1, channels + 1)
        may_start, x = x[context - 1:, channels], x[:, :channels]
        got = kind(x, context, horizon) if callable(kind) else _forecasts(x, context, horizon, kind, season, w, b)
        there = np.zeros(len(x), bool)
        there[pdf["pos"].to_numpy() - begin] = True
        count = np.concatenate([[0], np.cumsum(there)])
        full = count[width:] - count[:-width] == width          # every row of the window exists
        got[~(full & (may_start[:len(full)] == 1.0))] = np.nan
        s, o = np.nonzero(~np.isnan(got))
        total, n = np.zeros(len(x)), np.zeros(len(x), np.int64)
        np.add.at(total, s + context + o, got[s, o])
        np.add.at(n, s + context + o, 1)
        some = np.flatnonzero(n)
        return pd.DataFrame({**{k: np.array([v] * len(some), object) for k, v in zip(keys, key[:-1])}, "pos": some + begin,
                             "total": total[some], "n": n[some]})

    if kind == "linear":
        def with_model(key, pdf, model):
            if not len(model) or not len(pdf):
                return run(key, pdf.iloc[:0])
            return run(key, pdf, model["_w"].iloc[0], model["_b"].iloc[0])

        # a series' model goes to each of its blocks
        where = blocks.select(*keys, "block").distinct().select(
            *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col("block").alias("_block"))
        match = F.lit(True)
        for i, k in enumerate(keys):
            match = match & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
        placed = models.join(where, match).select(*[f"_k{i}" for i in range(len(keys))], "_block", "_w", "_b")
        parts = (blocks.groupBy(*keys, "block").cogroup(placed.groupBy(*[f"_k{i}" for i in range(len(keys))], "_block"))
                 .applyInPandas(with_model, schema))
    else:
        parts = blocks.groupBy(*keys, "block").applyInPandas(lambda key, pdf: run(key, pdf), schema)
    return (parts.groupBy(*keys, "pos").agg((F.sum("total") / F.sum("n")).alias("predicted"), F.sum("n").alias("n_forecasts")))
