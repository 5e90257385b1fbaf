"""Vectorised window hashes over one Arrow batch of texts (numpy helpers).

A batch's texts are handled as one array of *units* (bytes or word hashes)
with document bounds. A window is ``length`` consecutive units of one
document. Its *core* is the leftmost ``core`` units with the smallest hash
inside the window: equal windows have equal cores at equal offsets, so only
one core per run of windows has to be shuffled to find repeated windows.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit scrambling."""
    h = h ^ (h >> np.uint64(32))
    h *= _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * _M1
    h += right
    h ^= h >> np.uint64(31)
    return h


def rolling(units: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``units[i:i+length]`` for every i, by doubling: the hash of 2n
    units joins the hashes of its halves. Empty if there are fewer units."""
    n = len(units)
    if n < length:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, units.astype(np.uint64, copy=False), 1
    while True:
        if length & size:
            if out is None:
                out = power[:]
            else:
                m = min(len(out), len(power) - done)
                out = _join(out[:m], power[done:done + m])
            done += size
            if done == length:
                break
        power = _join(power[:len(power) - size], power[size:])
        size *= 2
    return mix(out[:n - length + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (block prefix/suffix minima)."""
    n = len(values)
    if n < width:
        return np.zeros(0, values.dtype)
    if width == 1:
        return values
    pad = (-n) % width
    v = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    prefix = np.minimum.accumulate(v, axis=1).ravel()
    suffix = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n - width + 1], prefix[width - 1:n])


#: Units handled at once; positions are packed into 26 bits.
AT_ONCE = 1 << 24


def cores(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, core: int, at_once: int = 0):
    """Runs of windows with one core.

    ``units`` holds the documents ``units[starts[d]:ends[d]]``. Returns arrays
    (doc, first, last, at, hash): the windows of document ``doc`` starting at
    ``first..last`` (absolute positions) all have their core at ``at``.

    More than ``at_once`` units are handled in pieces that overlap by ``length
    - 1``: a window's core depends on its own units only, so the runs that a
    seam cuts are joined again.
    """
    at_once = max(at_once or AT_ONCE, 2 * length)
    if len(units) <= at_once:
        return _cores(units, starts, ends, length, core)
    step, found = at_once - length + 1, []
    for a in range(0, len(units) - length + 1, step):
        b = min(a + at_once, len(units))
        doc, first, last, at, h = _cores(units[a:b], np.clip(starts, a, b) - a, np.clip(ends, a, b) - a, length, core)
        found.append((doc, first + a, last + a, at + a, h))
    doc, first, last, at, h = (np.concatenate(c) for c in zip(*found))
    seam = np.zeros(len(doc), bool)
    seam[1:] = (doc[1:] == doc[:-1]) & (at[1:] == at[:-1]) & (first[1:] == last[:-1] + 1)
    head = np.flatnonzero(~seam)
    return doc[head], first[head], last[np.append(head[1:], len(doc)) - 1], at[head], h[head]


def _cores(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, core: int):
    empty = np.zeros(0, np.int64)
    if len(units) < length:
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    h = rolling(units, core)
    low = np.uint64((1 << 26) - 1)
    packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_min(packed, length - core + 1) & low).astype(np.int64)
    n_win = np.maximum(ends - starts - length + 1, 0)
    valid = np.zeros(len(at) + 1, np.int32)
    has = n_win > 0
    np.add.at(valid, starts[has], 1)
    np.add.at(valid, starts[has] + n_win[has], -1)
    ok = np.cumsum(valid[:-1]) > 0
    # a run breaks where the core, the validity or the document changes
    brk = np.ones(len(at), bool)
    brk[1:] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])
    brk[starts[has]] = True
    first = np.flatnonzero(brk)
    last = np.append(first[1:], len(at)) - 1
    keep = ok[first]
    first, last = first[keep], last[keep]
    doc = np.searchsorted(starts, first, side="right") - 1
    # empty documents share their start with the next one: take the one that holds the position
    return doc, first, last, at[first], h[at[first]]


def split_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Words (runs of bytes other than 0x20, 0x09-0x0D) of the texts
    ``data[starts[d]:ends[d]]``: (word starts, word ends, first word of each
    document, past-the-last word of each document)."""
    word = ~((data == 0x20) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    edge[0] = edge[-1] = True
    edge[starts] = True
    edge[ends] = True
    cut = np.flatnonzero(edge)
    cut = cut[:-1] if len(cut) and cut[-1] == len(data) else cut
    nxt = np.append(cut[1:], len(data))
    is_word = word[cut] if len(cut) else np.zeros(0, bool)
    ws, we = cut[is_word], nxt[is_word]
    return ws, we, np.searchsorted(ws, starts, side="left"), np.searchsorted(ws, ends, side="left")


def word_hashes(data: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """64-bit hash of every word ``data[ws:we]``."""
    if not len(ws):
        return np.zeros(0, np.uint64)
    lens = we - ws
    total = int(lens.sum())
    begin = np.cumsum(lens) - lens
    at = np.arange(total) - np.repeat(begin, lens)
    power = np.cumprod(np.full(int(lens.max()) + 1, _M1 | np.uint64(1), np.uint64))
    codes = BYTE_CODES[data[np.repeat(ws, lens) + at]] * power[at]
    return mix(np.add.reduceat(codes, begin) + lens.astype(np.uint64))


def arrow_text(column):
    """(bytes, starts, ends) of an Arrow string or binary column; null texts are empty."""
    import pyarrow as pa
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset:]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    starts, ends = offsets[:-1] - lo, offsets[1:] - lo
    if column.null_count:
        ends = np.where(np.asarray(column.is_null()), starts, ends)
    return data[lo:hi], starts, ends


def slices(batch, column: str, budget: int = 1 << 21):
    """Cut an Arrow batch into runs of rows of about ``budget`` text bytes (a
    single longer text makes its own run), so that working memory is bounded."""
    import pyarrow.compute as pc
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    run = np.cumsum(size) // budget
    cut = np.flatnonzero(np.diff(run)) + 1
    for a, b in zip(np.append(0, cut), np.append(cut, batch.num_rows)):
        if b > a:
            yield batch.slice(int(a), int(b - a))
