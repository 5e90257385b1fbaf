"""Regions of the unit sphere: where near vectors meet.

A random rotation cuts a vector into two halves. Each half has ``codes`` random
directions, a pair of them is a region, and a vector belongs to the ``depth``
regions whose two directions fit it best (sum of both dot products). Whether
two vectors share a region depends on the rotation and their cosine only, not
on the table, so ``plan`` finds the depth by trials: pairs whose cosine is just
the threshold share a region with probability ``recall``, nearer ones more
often.

A sketch is the rotated vector in 4 bits per component. ``plan`` also tells
the cosine of sketches that all but a few in a thousand of these pairs reach.
"""

from __future__ import annotations

import functools
import math

import numpy as np

ROWS = 1500                                     # vectors of a region, about
DEEPEST = 32
MOST_CODES = (1 << 16) - 1                      # a region's number fits four bytes
STEP = 0.335                                    # width of a 4-bit cell, times sqrt(dim)
TRIALS = 4000


def _directions(rng, count: int, dim: int) -> np.ndarray:
    if not dim:
        return np.zeros((1, 0), np.float32)
    out = []
    while 2 * dim * len(out) < count:
        q = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        out.append(np.concatenate([q, -q]))
    return np.concatenate(out)[:count].astype(np.float32)


@functools.lru_cache(maxsize=4)
def _frame(dim: int, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(dim)
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0].astype(np.float32)
    half = (dim + 1) // 2
    return rotation, _directions(rng, codes, half), _directions(rng, codes, dim - half)


def rotated(x: np.ndarray, codes: int) -> np.ndarray:
    return x.astype(np.float32) @ _frame(x.shape[1], codes)[0]


def regions(y: np.ndarray, codes: int, depth: int) -> np.ndarray:
    """(n, depth) regions of rotated vectors, best first; fewer columns where
    there are fewer regions."""
    if codes == 1:
        return np.zeros((len(y), 1), np.int64)
    _, left, right = _frame(y.shape[1], codes)
    half, at, fit = left.shape[1], [], []
    for score in (y[:, :half] @ left.T, y[:, half:] @ right.T):
        k = min(depth, score.shape[1])
        best = np.argpartition(score, score.shape[1] - k, axis=1)[:, -k:]
        value = np.take_along_axis(score, best, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        at.append(np.take_along_axis(best, order, 1))
        fit.append(np.take_along_axis(value, order, 1))
    # the i-th and j-th best are behind i * j - 1 pairs at least
    i, j = np.array([(i, j) for i in range(at[0].shape[1]) for j in range(at[1].shape[1]) if (i + 1) * (j + 1) <= depth]).T
    best = np.argsort(-(fit[0][:, i] + fit[1][:, j]), axis=1, kind="stable")[:, :depth]
    return np.take_along_axis(at[0][:, i].astype(np.int64) * codes + at[1][:, j], best, 1)


def _pairs(dim: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=(2, TRIALS, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= np.einsum("nd,nd->n", x, z)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    return x, cosine * x + math.sqrt(1 - cosine * cosine) * z


def plan(dim: int, rows: int, cosine: float, recall: float) -> tuple[int, int, float]:
    """(codes, depth, least cosine of sketches) for so many vectors of one
    length; one region and no least cosine where they are few, or the cosine
    too low for regions."""
    codes = min(math.ceil(math.sqrt(rows * 16 / ROWS)), MOST_CODES) if rows > ROWS and dim > 1 and 0 < cosine < 1 else 1
    while codes > 1:
        ys = [rotated(v, codes) for v in _pairs(dim, cosine)]
        a, b = (regions(y, codes, DEEPEST) for y in ys)
        rank = np.arange(a.shape[1])
        need = np.where(a[:, :, None] == b[:, None, :], np.maximum(rank[:, None], rank) + 1.0, np.inf).min(axis=(1, 2))
        if (depth := np.quantile(need, recall, method="higher")) <= DEEPEST:
            p, q = (opened(sketches(y), dim) for y in ys)
            return codes, int(depth), float(np.quantile(np.einsum("nd,nd->n", p, q), 0.001))
        codes //= 2
    return 1, 1, -math.inf


def sketches(y: np.ndarray) -> np.ndarray:
    """(n, ceil(dim / 2)) bytes, two components in each."""
    dim = y.shape[1]
    cell = np.full((len(y), dim + dim % 2), 7, np.uint8)
    cell[:, :dim] = np.clip(np.floor(y * (math.sqrt(dim) / STEP)) + 8, 0, 15)
    return cell[:, ::2] << 4 | cell[:, 1::2]


def opened(sketch: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors of the sketches."""
    cell = np.empty((len(sketch), 2 * sketch.shape[1]), np.float32)
    cell[:, ::2], cell[:, 1::2] = sketch >> 4, sketch & 15
    x = (2 * cell - 15)[:, :dim]
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]
