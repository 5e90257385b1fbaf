"""A navigable small-world graph over the vectors of one shard (numpy).

Vectors are inserted in growing batches and queries run side by side, one step
of all beams at a time, so that the work is done by array operations.
"""

from __future__ import annotations

import numpy as np

BATCH = 256


class SmallWorld:
    """``unit``: (n, d) unit vectors. ``m``: links per vector on upper layers,
    2m on the ground layer. ``ef``: beam width while building."""

    def __init__(self, unit: np.ndarray, m: int = 12, ef: int = 32, seed: int = 7):
        self.x = np.ascontiguousarray(unit, np.float32)
        self.m, self.ef = m, ef
        n = len(self.x)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(1 - draw) / np.log(m)).astype(int), 6)
        if n:
            self.level[0] = self.level.max()            # the entry stands on every layer
        self.top = int(self.level.max()) if n else 0
        self.links = [np.full((n, 2 * m if lv == 0 else m), -1, np.int32) for lv in range(self.top + 1)]
        done = 0
        while done < n:
            self._insert(done, min(n, done + min(max(done, 32), BATCH)))
            done = min(n, done + min(max(done, 32), BATCH))

    # -- building -----------------------------------------------------------
    def _insert(self, a: int, b: int) -> None:
        new = np.arange(a, b)
        entry = np.zeros(len(new), np.int64)
        within = self.x[a:b] @ self.x[a:b].T
        np.fill_diagonal(within, -np.inf)
        for lv in range(self.top, -1, -1):
            here = self.level[new] >= lv
            if a:
                ids, sims = self._layer(self.x[a:b], entry, lv, self.ef if here.any() else 1, a)
                entry = np.where(ids[:, 0] >= 0, ids[:, 0], entry)
            else:
                ids, sims = np.full((len(new), 1), -1, np.int64), np.full((len(new), 1), -np.inf, np.float32)
            if not here.any():
                continue
            mates = np.where(here[None, :], within, -np.inf)
            k = min(self.ef, mates.shape[1])
            best = np.argsort(-mates, axis=1, kind="stable")[:, :k]
            mate_sims = np.take_along_axis(mates, best, 1)
            cand = np.concatenate([ids, np.where(np.isfinite(mate_sims), best + a, -1)], 1)[here]
            csim = np.concatenate([sims, mate_sims], 1)[here]
            nodes = new[here]
            self.links[lv][nodes] = self._diverse(cand, csim, self.links[lv].shape[1])
            self._back(nodes, lv)

    def _diverse(self, cand: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Per row: nearest candidates that are closer to the row's vector than
        to a link already chosen, then the nearest of the rest."""
        order = np.argsort(-np.where(cand >= 0, sims, -np.inf), axis=1, kind="stable")[:, :3 * width]
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        cand = np.where(np.isfinite(sims), cand, -1)
        v = self.x[np.maximum(cand, 0)]
        near = np.einsum("qid,qjd->qij", v, v)
        q, c = cand.shape
        picked, count, crowd = np.zeros((q, c), bool), np.zeros(q, int), np.full((q, c), -np.inf, np.float32)
        for j in range(c):
            take = (cand[:, j] >= 0) & (count < width) & (sims[:, j] > crowd[:, j])
            picked[:, j] = take
            count += take
            crowd[take] = np.maximum(crowd[take], near[take, j])
        rank = np.where(picked, 0, np.where(cand >= 0, 1, 2)) * c + np.arange(c)
        first = np.argsort(rank, axis=1, kind="stable")[:, :width]
        out = np.full((q, width), -1, np.int32)
        out[:, :first.shape[1]] = np.take_along_axis(cand, first, 1)
        return out

    def _back(self, nodes: np.ndarray, lv: int) -> None:
        """Links back from the chosen neighbours; crowded lists are chosen anew."""
        links = self.links[lv]
        src = np.repeat(nodes, links.shape[1])
        dst = links[nodes].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        where, first, count = np.unique(dst, return_index=True, return_counts=True)
        wide = np.full((len(where), links.shape[1] + int(count.max(initial=0))), -1, np.int64)
        wide[:, :links.shape[1]] = links[where]
        slot = links.shape[1] + np.arange(len(dst)) - np.repeat(first, count)
        wide[np.repeat(np.arange(len(where)), count), slot] = src
        wide.sort(axis=1)
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
        for a in range(0, len(where), 512):
            w, c = where[a:a + 512], wide[a:a + 512]
            sims = np.einsum("qd,qkd->qk", self.x[w], self.x[np.maximum(c, 0)])
            sims = np.where((c >= 0) & (c != w[:, None]), sims, -np.inf)
            links[w] = self._diverse(c, sims, links.shape[1])

    # -- searching ----------------------------------------------------------
    def _layer(self, q: np.ndarray, entry: np.ndarray, lv: int, ef: int, n: int):
        """Beam search of all rows of ``q`` on one layer: (ids, similarities),
        best first, -1 where a beam is not full."""
        rows = np.arange(len(q))
        ids = np.full((len(q), ef), -1, np.int64)
        sims = np.full((len(q), ef), -np.inf, np.float32)
        open_ = np.zeros((len(q), ef), bool)
        seen = np.zeros((len(q), n), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = entry, np.einsum("qd,qd->q", q, self.x[entry]), True
        seen[rows, entry] = True
        while True:
            live = np.flatnonzero(open_.any(axis=1))
            if not len(live):
                break
            pick = np.where(open_[live], sims[live], -np.inf).argmax(axis=1)
            node = ids[live, pick]
            open_[live, pick] = False
            nb = self.links[lv][node].astype(np.int64)
            ok = (nb >= 0) & ~seen[live[:, None], np.maximum(nb, 0)]
            r, c = np.nonzero(ok)
            seen[live[r], nb[r, c]] = True
            s = np.full(nb.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("kd,kd->k", q[live[r]], self.x[nb[r, c]])
            all_s = np.concatenate([sims[live], s], 1)
            keep = np.argsort(-all_s, axis=1, kind="stable")[:, :ef]
            sims[live] = np.take_along_axis(all_s, keep, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(ok, nb, -1)], 1), keep, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], ok], 1), keep, 1)
        return ids, sims

    def search(self, q: np.ndarray, ef: int):
        """Best ``ef`` found for every row of ``q``: (ids, similarities)."""
        entry = np.zeros(len(q), np.int64)
        for lv in range(self.top, 0, -1):
            ids, _ = self._layer(q, entry, lv, 1, len(self.x))
            entry = ids[:, 0]
        return self._layer(q, entry, 0, ef, len(self.x))

    def within(self, q: np.ndarray, least: float, ef: int, widest: int):
        """(row, id) pairs found with similarity >= least. Beams that are full
        of such vectors are widened until they are not; rows whose beam would
        have to be wider than ``widest`` are returned apart, without pairs."""
        q = np.ascontiguousarray(q, np.float32)
        rows, out_r, out_i = np.arange(len(q)), [np.zeros(0, int)], [np.zeros(0, int)]
        while len(rows) and ef <= widest:
            ids, sims = self.search(q[rows], ef)
            hit = (ids >= 0) & (sims >= least)
            full = hit.all(axis=1)
            r, c = np.nonzero(hit & ~full[:, None])
            out_r.append(rows[r])
            out_i.append(ids[r, c])
            rows, ef = rows[full], 2 * ef
        return np.concatenate(out_r), np.concatenate(out_i), rows
