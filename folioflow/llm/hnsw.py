"""Hierarchical navigable small-world graphs over unit vectors, built and searched many rows at a time in NumPy."""

from __future__ import annotations

import numpy as np


class Layer:
    """One level: which rows are on it, and up to ``width`` neighbours of each (-1: none)."""

    def __init__(self, n: int, width: int):
        self.near = np.full((n, width), -1, dtype=np.int32)


def diverse(query: np.ndarray, cand: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """For each query row the chosen neighbours among its candidates (-1: none), nearest first.

    A candidate is taken if it is closer to the query than to all taken ones; free places then go to
    the nearest that were passed over, so tight clusters keep both their inner and their outer links.
    """
    rows = len(cand)
    held = np.where(cand[:, :, None] >= 0, vectors[np.maximum(cand, 0)], 0.0)
    sim = np.einsum("qd,qcd->qc", query, held)
    sim[cand < 0] = -np.inf
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    held = np.take_along_axis(held, order[:, :, None], 1)
    among = np.einsum("qcd,qed->qce", held, held)
    taken, rank = np.zeros(cand.shape, dtype=bool), np.zeros(rows, dtype=int)
    repeated = np.zeros(cand.shape, dtype=bool)
    for c in range(cand.shape[1]):
        if c:
            repeated[:, c] = (cand[:, :c] == cand[:, c : c + 1]).any(axis=1)
        blocked = (taken & (among[:, c, :] > sim[:, c : c + 1])).any(axis=1)
        pick = (cand[:, c] >= 0) & ~blocked & ~repeated[:, c] & (rank < most)
        taken[pick, c], rank = True, rank + pick
    spare = (cand >= 0) & ~repeated & ~taken
    place = np.where(taken, np.cumsum(taken, axis=1), np.where(spare, taken.sum(axis=1, keepdims=True) + np.cumsum(spare, axis=1), cand.shape[1] + most + 1))
    order = np.argsort(place, axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(taken | spare, order, 1), np.take_along_axis(cand, order, 1), -1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


class Graph:
    """``width`` links on the upper levels and twice as many on the ground; a row reaches level k with chance width**-k."""

    def __init__(self, vectors: np.ndarray, width: int = 12, beam: int = 40, seed: int = 5):
        self.vectors, n = vectors, len(vectors)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n)) / np.log(width)).astype(int), 6)
        if n:
            level[0] = max(level.max(), level[0])
        self.layers = [Layer(n, 2 * width if k == 0 else width) for k in range(level.max() + 1 if n else 1)]
        self.entry, self.level, done = 0, level, 1
        while done < n:
            new = np.arange(done, min(n, done + min(done, 256)))
            self._insert(new, width, beam)
            done = int(new[-1]) + 1
        self._undirect(n)

    def _undirect(self, n: int) -> None:
        """The ground level's links in both directions, as offsets and targets: every row can be reached from its own neighbours."""
        near = self.layers[0].near
        a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel().astype(np.int64)
        a, b = a[b >= 0], b[b >= 0]
        flat = np.unique(np.concatenate([a * n + b, b * n + a]))
        self.first, self.target = np.searchsorted(flat, np.arange(n + 1) * n), flat % max(n, 1)

    def _insert(self, new: np.ndarray, width: int, beam: int) -> None:
        q = self.vectors[new]
        start = np.full((len(new), 1), self.entry)
        for k in range(len(self.layers) - 1, -1, -1):
            found, sims = self._beam(q, start, k, beam if k <= self.level[new].max() else 1)
            start = found[:, :1] if k else start
            on = self.level[new] >= k
            if not on.any():
                continue
            inside = q[on] @ q[on].T
            np.fill_diagonal(inside, -np.inf)
            kept = min(width, on.sum())
            close = np.argsort(-inside, axis=1)[:, :kept]
            mates = np.where(np.take_along_axis(inside, close, 1) > -np.inf, new[on][close], -1)
            near = diverse(q[on], np.concatenate([found[on], mates], axis=1), self.vectors, width)
            layer = self.layers[k].near
            layer[new[on], :width] = near
            src, dst = np.repeat(new[on], width), near.ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            order = np.argsort(dst, kind="stable")
            dst, src = dst[order], src[order]
            who, first, count = np.unique(dst, return_index=True, return_counts=True)
            extra = np.full((len(who), count.max() if len(who) else 0), -1, dtype=np.int64)
            extra[np.repeat(np.arange(len(who)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
            for at in range(0, len(who), 256):
                w = who[at : at + 256]
                layer[w] = diverse(self.vectors[w], np.concatenate([layer[w], extra[at : at + 256]], axis=1), self.vectors, layer.shape[1])

    def _beam(self, q: np.ndarray, start: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best rows reached from ``start`` on level k, best first (-1: fewer found)."""
        near, rows = self.layers[k].near, np.arange(len(q))
        seen = np.zeros((len(q), len(self.vectors) + 1), dtype=bool)
        ids = np.where(start >= 0, start, len(self.vectors))
        seen[rows[:, None], ids] = True
        sims = np.einsum("qd,qcd->qc", q, self.vectors[np.maximum(start, 0)])
        sims[start < 0] = -np.inf
        ids, sims = ids.astype(np.int64), sims
        opened = np.zeros(ids.shape, dtype=bool)
        while True:
            best = np.where(opened | (sims == -np.inf), -np.inf, sims)
            at = best.argmax(axis=1)
            live = best[rows, at] > -np.inf
            if not live.any():
                break
            r = rows[live]
            opened[r, at[live]] = True
            nxt = near[ids[r, at[live]]].astype(np.int64)
            nxt[nxt < 0] = len(self.vectors)
            fresh = ~seen[r[:, None], nxt] & (nxt < len(self.vectors))
            seen[r[:, None], nxt] = True
            got = np.full((len(q), nxt.shape[1]), -np.inf)
            val = np.einsum("qd,qcd->qc", q[r], self.vectors[np.minimum(nxt, len(self.vectors) - 1)])
            got[r] = np.where(fresh, val, -np.inf)
            add = np.full((len(q), nxt.shape[1]), len(self.vectors), dtype=np.int64)
            add[r] = nxt
            ids, sims = np.concatenate([ids, add], axis=1), np.concatenate([sims, got], axis=1)
            opened = np.concatenate([opened, np.zeros(add.shape, dtype=bool)], axis=1)
            if ids.shape[1] > beam:
                top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
                ids, sims, opened = (np.take_along_axis(x, top, 1) for x in (ids, sims, opened))
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(sims > -np.inf, ids, -1), sims

    def within(self, q: np.ndarray, threshold: float, beam: int, margin: float) -> np.ndarray:
        """A (queries x rows) table of the rows found at ``threshold`` or more.

        The beam search gives a start; then the beam widens without bound through every row within
        ``margin`` below the threshold, so a query in a crowd finds the whole crowd.
        """
        start = np.full((len(q), 1), self.entry)
        for k in range(len(self.layers) - 1, 0, -1):
            start = self._beam(q, start, k, 1)[0][:, :1]
        ids, sims = self._beam(q, start, 0, beam)
        n = len(self.vectors)
        known, hit = np.zeros((len(q), n + 1), dtype=bool), np.zeros((len(q), n), dtype=bool)
        known[:, n] = True
        ok = sims >= threshold - margin
        r, v = np.nonzero(ok)[0], ids[ok]
        s = sims[ok]
        known[r, v] = True
        while len(r):
            hit[r[s >= threshold - 1e-9], v[s >= threshold - 1e-9]] = True
            degree = self.first[v + 1] - self.first[v]
            ends = np.cumsum(degree)
            nxt = self.target[np.repeat(self.first[v] - ends + degree, degree) + np.arange(ends[-1])]
            r = np.repeat(r, degree)
            new = ~known[r, nxt]
            flat = np.unique(r[new] * (n + 1) + nxt[new])
            r, v = flat // (n + 1), flat % (n + 1)
            known[r, v] = True
            s = np.concatenate([np.einsum("pd,pd->p", q[r[a : a + 65536]], self.vectors[v[a : a + 65536]]) for a in range(0, len(r), 65536)]) if len(r) else np.empty(0)
            keep = s >= threshold - margin
            r, v, s = r[keep], v[keep], s[keep]
        return hit
