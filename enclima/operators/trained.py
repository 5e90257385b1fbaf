"""A forecaster trained by gradient steps, with validation and early stop
(FCS-1, FCS-2).

One network serves all series: a window's context, taken relative to its last
value, and the known channels over the horizon give the horizon by a linear
part plus a hidden layer, relative to the last value again. At the start it is
the naive forecaster.

Data stay where they are: series are cut into blocks of rows once (written with
the rows a block's windows reach into). A step reads the blocks, every task
adds up the gradient of its windows of that mini-batch with numpy and returns
one partial, and a hash aggregate adds the partials element by element. The
driver holds the parameters only (predictors x hidden + hidden x horizon: a
size of the model, not of the data) and updates them (AdamW, one learning-rate
cycle). Windows are drawn into mini-batches by a hash of (series, position,
seed, epoch), so a fit does not depend on how the data are dealt.

Every epoch is written as a small table under ``path``: parameters, optimizer
state, losses. A fit that finds epochs there goes on behind the last one. The
fit stops when the loss on the validation rows has not fallen by ``threshold``
for ``patience`` epochs; the parameters of the best epoch are returned.

Missing values: as for window forecasts; windows with a missing value in any
channel are left out of the fit.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, ensure_checkpoint_dir, materialize_at
from .lagged import _block_rows, _dense, in_blocks

AT_ONCE = 4096                                  # windows held at once by a task


@dataclass
class Net:
    """Parameters: a linear part and one hidden layer."""

    context: int
    horizon: int
    channels: int
    hidden: int
    theta: np.ndarray = field(repr=False)

    @classmethod
    def start(cls, context: int, horizon: int, channels: int, hidden: int, seed: int) -> Net:
        p = context + channels * horizon
        first = np.random.default_rng(seed).normal(size=(p, hidden)) / math.sqrt(p)
        flat = np.concatenate([first.ravel(), np.zeros(hidden + hidden * horizon + p * horizon + horizon)])
        return cls(context, horizon, channels, hidden, flat)

    def parts(self, theta: np.ndarray) -> list[np.ndarray]:
        p, h, q = self.context + self.channels * self.horizon, self.hidden, self.horizon
        shapes, out, at = [(p, h), (h,), (h, q), (p, q), (q,)], [], 0
        for s in shapes:
            n = int(np.prod(s))
            out.append(theta[at:at + n].reshape(s))
            at += n
        return out

    def _inputs(self, x: np.ndarray, start: np.ndarray):
        """(predictors, last value) of the windows that start at ``start``."""
        c, q = self.context, self.horizon
        y = x[start[:, None] + np.arange(c), 0]
        known = [x[start[:, None] + c + np.arange(q), 1 + k] for k in range(self.channels)]
        return np.concatenate([y - y[:, -1:], *known], axis=1), y[:, -1:]

    def forecast(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        w1, b1, w2, w0, b0 = self.parts(self.theta)
        z, last = self._inputs(x, start)
        return np.tanh(z @ w1 + b1) @ w2 + z @ w0 + b0 + last

    def gradient(self, x: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray]:
        """(sum of squared errors, its gradient) over some windows."""
        w1, b1, w2, w0, b0 = self.parts(self.theta)
        z, last = self._inputs(x, start)
        a = np.tanh(z @ w1 + b1)
        error = a @ w2 + z @ w0 + b0 + last - x[start[:, None] + self.context + np.arange(self.horizon), 0]
        back = (error @ w2.T) * (1 - a * a)
        grad = [z.T @ back, back.sum(0), a.T @ error, z.T @ error, error.sum(0)]
        return float((error ** 2).sum()), 2 * np.concatenate([g.ravel() for g in grad])

    def __call__(self, x: np.ndarray, context: int, horizon: int) -> np.ndarray:
        """Forecasts of all windows of a block, NaN where an input is missing
        (for ``lagged.forecast_mean``)."""
        n = len(x) - context - horizon + 1
        return np.concatenate([self.forecast(x, np.arange(a, min(a + AT_ONCE, n))) for a in range(0, n, AT_ONCE)])


def blocks_of(rows: DataFrame, keys: Sequence[str], pos: str, value: str, exog: Sequence[str], width: int):
    """One row per block: keys, block, x (dense rows x channels, row by row,
    NaN where missing). Returns (table, path)."""
    size, channels = _block_rows(width), 1 + len(exog)
    own = in_blocks(rows, keys, pos, width, [value, *exog]).where(F.col("pos") >= F.col("block") * size)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    keys = list(keys)

    def pack(key, pdf):
        import pandas as pd
        begin = int(key[-1]) * size
        pdf = pdf[pdf["pos"] < begin + size + width - 1]
        stop = int(pdf["pos"].max()) + 1 if len(pdf) else begin
        x = _dense(pdf["pos"].to_numpy(), pdf["c"], begin, stop, channels)
        return pd.DataFrame({**{k: np.array([v], object) for k, v in zip(keys, key[:-1])},
                             "block": [int(key[-1])], "x": np.array([x.tobytes()], object)})

    return materialize_at(own.groupBy(*keys, "block").applyInPandas(pack, f"{fields}, block long, x binary"))


def _draw(name: str, block: int, n: int, seed: int, epoch: int) -> np.ndarray:
    """A number in [0, 1) for every window of a block."""
    import zlib
    return np.random.default_rng([zlib.crc32(name.encode()), block, seed, epoch]).random(n)


def _partial(batches, net: Net, keys: Sequence[str], seed: int, epoch: int, low: float, high: float, learn: bool):
    import pandas as pd
    width, channels = net.context + net.horizon, 1 + net.channels
    total = np.zeros(2 + (len(net.theta) if learn else 0))
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            x = np.frombuffer(row[-1], float).reshape(-1, channels)
            whole = np.concatenate([[0], np.cumsum(~np.isnan(x).any(axis=1))])
            if len(x) < width:
                continue
            start = np.flatnonzero(whole[width:] - whole[:-width] == width)
            if learn:
                u = _draw("|".join(map(str, row[:len(keys)])), int(row[len(keys)]), len(x), seed, epoch)[start]
                start = start[(u >= low) & (u < high)]
            for a in range(0, len(start), AT_ONCE):
                some = start[a:a + AT_ONCE]
                loss, grad = net.gradient(x, some)
                total[:2] += len(some) * net.horizon, loss
                if learn:
                    total[2:] += grad
    yield pd.DataFrame({"s": np.array([total], object) if len(total) == 0 else [total.tolist()]})


def _summed(blocks: DataFrame, **how) -> np.ndarray:
    parts = blocks.mapInPandas(functools.partial(_partial, **how), "s array<double>")
    rows = parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(2 + (len(how["net"].theta) if how["learn"] else 0))
    out[np.asarray(rows.column("i"))] = np.asarray(rows.column("v"))
    return out


def _rate(step: int, steps: int, peak: float) -> float:
    """One cycle: up for three tenths of the steps, then down to almost zero."""
    up = max(1.0, 0.3 * steps)
    if step < up:
        return peak * (0.04 + 0.96 * (1 - math.cos(math.pi * step / up)) / 2)
    return peak * (1e-4 + (1 - 1e-4) * (1 + math.cos(math.pi * (step - up) / max(1.0, steps - up))) / 2)


def _epochs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    found = [f.getPath() for f in fs.listStatus(p)]
    done = [f for f in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]     # whole tables only
    return sorted(int(f.getName().split("=")[1]) for f in done if f.getName().startswith("epoch="))


SAVED = "epoch int, step int, train double, valid double, best double, stale int, theta array<double>, " \
        "best_theta array<double>, m array<double>, v array<double>"


def fit(train: DataFrame, valid: DataFrame, keys: Sequence[str], pos: str, value: str, context: int, horizon: int,
        exog: Sequence[str] = (), hidden: int = 32, epochs: int = 20, steps: int = 4, rate: float = 1e-2,
        decay: float = 1e-2, patience: int = 5, threshold: float = 1e-6, seed: int = 1337, path: str | None = None,
        stop_after: int | None = None, log: Callable | None = None) -> tuple[Net, list[tuple[int, float, float]]]:
    """(network of the best epoch, [(epoch, train loss, valid loss)]).

    An epoch is ``steps`` mini-batches. ``path`` names the folder of the
    epochs (a fresh one under the shared folder if None, deleted at the end);
    ``stop_after`` ends this call after so many epochs, to be resumed later."""
    spark, width = train.sparkSession, context + horizon
    own = path is None
    if own:
        import uuid
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/enclima-tables/fit-{uuid.uuid4().hex}"
    learn, learn_path = blocks_of(train, keys, pos, value, exog, width)
    check, check_path = blocks_of(valid, keys, pos, value, exog, width)
    net = Net.start(context, horizon, len(exog), hidden, seed)
    m, v, step, best, best_theta, stale, history = (np.zeros_like(net.theta), np.zeros_like(net.theta), 0, math.inf,
                                                    net.theta, 0, [])
    done = _epochs(spark, path)
    if done:
        saved = spark.read.schema(SAVED).parquet(*[f"{path}/epoch={e}" for e in done]).select(
            *[c.split(" ")[0] for c in SAVED.split(", ")]).orderBy("epoch").collect()      # one row per epoch
        history = [(r["epoch"], r["train"], r["valid"]) for r in saved]
        r = saved[-1]
        net.theta, best_theta, m, v = (np.array(r[c]) for c in ("theta", "best_theta", "m", "v"))
        step, best, stale = r["step"], r["best"], r["stale"]
    begun = len(history)
    how = dict(keys=list(keys), seed=seed)
    for epoch in range(begun, epochs):
        if stale >= patience or (stop_after is not None and epoch - begun >= stop_after):
            break
        seen = np.zeros(2)
        for k in range(steps):
            s = _summed(learn, net=net, epoch=epoch, low=k / steps, high=(k + 1) / steps, learn=True, **how)
            seen += s[:2]
            if s[0] == 0:
                continue
            step += 1
            grad = s[2:] / s[0]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            lr = _rate(step - 1, epochs * steps, rate)
            net.theta = net.theta * (1 - lr * decay) - lr * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        c = _summed(check, net=net, epoch=epoch, low=0.0, high=1.0, learn=False, **how)
        train_loss, loss = (float(x[1] / x[0]) if x[0] else math.inf for x in (seen, c))
        if loss < best - threshold:
            best, best_theta, stale = loss, net.theta, 0
        else:
            stale += 1
        history.append((epoch, train_loss, loss))
        row = (epoch, step, train_loss, loss, best, stale, *[a.tolist() for a in (net.theta, best_theta, m, v)])
        spark.createDataFrame([row], SAVED).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    discard(spark, learn_path, check_path, *([path] if own else []))
    net.theta = best_theta
    return net, history
