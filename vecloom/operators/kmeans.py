"""k-means on a bounded sample, flat and as a tree."""

from __future__ import annotations

import numpy as np

from ..plans import sizing
from .knn import pairwise

ITERATIONS = 20
TOLERANCE = 1e-4
#: Trees of at most so many nodes are descended by many rows together, as many as keep their distances within so many cells.
DENSE_NODES, ROUTE_CELLS = 16_384, 1 << 20


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n == 0, x, x / np.where(n == 0, 1, n))


def _seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ by squared l2, for every metric."""
    out = [x[rng.integers(len(x))]]
    far = lambda c: np.concatenate([((x[i:i + 8192] - c) ** 2).sum(1) for i in range(0, len(x), 8192)])
    d = far(out[0])
    for _ in range(k - 1):
        total = d.sum()
        out.append(x[rng.choice(len(x), p=d / total)] if total > 0 else x[rng.integers(len(x))])
        d = np.minimum(d, far(out[-1]))
    return np.array(out)


def _nearest(x: np.ndarray, c: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    near, dist = np.empty(len(x), np.int64), np.empty(len(x))
    for i in range(0, len(x), 4096):
        d = pairwise(metric, x[i:i + 4096], c)
        near[i:i + 4096], dist[i:i + 4096] = d.argmin(1), d.min(1)
    return near, dist


def kmeans(x: np.ndarray, k: int, metric: str = "l2", seed: int = 42, redo: int = 1) -> np.ndarray:
    """Centroids of the best of redo runs. An empty cluster takes half of the largest. Cosine centroids have length 1."""
    x = unit(x) if metric == "cosine" else x
    k = max(1, min(k, len(x)))
    best, best_cost = None, np.inf
    for run in range(redo):
        rng = np.random.default_rng([seed, run])
        c, last = _seeds(x, k, rng), np.inf
        for _ in range(ITERATIONS):
            near, d = _nearest(x, c, metric)
            cost = float(d.sum())
            n = np.bincount(near, minlength=k)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
            for e in np.flatnonzero(n == 0):
                big = int(n.argmax())
                c[e], c[big] = c[big] * (1 + 1e-4), c[big] * (1 - 1e-4)
                n[e] = n[big] // 2
                n[big] -= n[e]
            c = unit(c) if metric == "cosine" else c
            if abs(last - cost) <= TOLERANCE * max(abs(cost), 1e-12):
                break
            last = cost
        if cost < best_cost:
            best, best_cost = c, cost
    return best


def build_tree(x: np.ndarray, nlist: int, fan_out: int, metric: str, seed: int = 42, redo: int = 1) -> list[dict]:
    """Nodes (node_id, parent_id, level, is_leaf, cluster_id, centroid), level by level; every inner node has up to fan_out children."""
    x = unit(x) if metric == "cosine" else x
    levels = sizing.tree_levels(nlist, fan_out)
    nodes: list[dict] = []
    clusters = 0
    work = [(-1, x)]
    for level in range(levels):
        leaf, after = level == levels - 1, []
        for parent, rows in work:
            c = kmeans(rows, nlist if levels == 1 else fan_out, metric, seed + len(nodes), redo)
            near, _ = _nearest(rows, c, metric)
            for k in range(len(c)):
                mine = rows[near == k]
                if not leaf and not len(mine):
                    continue
                nodes.append({"node_id": len(nodes), "parent_id": parent, "level": level, "is_leaf": leaf, "cluster_id": clusters if leaf else None, "centroid": c[k].astype(np.float32).tolist()})
                clusters += leaf
                after.append((nodes[-1]["node_id"], mine))
        work = after
    return nodes


class Router:
    """Beam descent over a tree, for many rows at once."""

    def __init__(self, nodes: list[dict], metric: str):
        self.metric = metric
        self.centroid = np.array([n["centroid"] for n in nodes], np.float64)
        self.cluster = np.array([-1 if n["cluster_id"] is None else n["cluster_id"] for n in nodes])
        at = {n["node_id"]: i for i, n in enumerate(nodes)}
        self.children: dict[int, list[int]] = {}
        for i, n in enumerate(nodes):
            self.children.setdefault(at.get(n["parent_id"], -1), []).append(i)
        self.leaves = np.flatnonzero(self.cluster >= 0)
        self.parent = np.array([at.get(n["parent_id"], -1) for n in nodes])

    def route(self, q: np.ndarray, n: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(cluster ids, centroids' positions): the n nearest leaves met by each row, ties by position; -1 where there are fewer."""
        n = min(n, len(self.leaves))
        out = np.full((len(q), n), -1)
        nodes = len(self.centroid)
        if nodes <= DENSE_NODES or len(self.leaves) == nodes:
            step = max(1, ROUTE_CELLS // nodes)
            for i in range(0, len(q), step):
                out[i:i + step] = self._descend(q[i:i + step], n, beam)
        else:
            for r in range(len(q)):
                here, done = np.array(self.children[-1]), []
                while len(here):
                    inner = here[self.cluster[here] < 0]
                    done.append(here[self.cluster[here] >= 0])
                    if not len(inner):
                        break
                    d = pairwise(self.metric, q[r:r + 1], self.centroid[inner])[0]
                    kept = inner[np.argsort(d, kind="stable")[:beam]]
                    here = np.array([c for k in kept.tolist() for c in self.children.get(k, [])], int)
                leaf = np.concatenate(done).astype(int)
                d = pairwise(self.metric, q[r:r + 1], self.centroid[leaf])[0]
                best = leaf[np.argsort(d, kind="stable")[:n]]
                out[r, :len(best)] = best
        return np.where(out >= 0, self.cluster[out], -1), out

    def _descend(self, q: np.ndarray, n: int, beam: int) -> np.ndarray:
        """The same for some rows together: a node is masked for the rows that don't come to it."""
        d = pairwise(self.metric, q, self.centroid)
        leaf = self.cluster >= 0
        if not leaf.all():
            met, here = np.zeros(d.shape, bool), np.broadcast_to(self.parent < 0, d.shape)
            while True:
                met |= here & leaf
                inner = here & ~leaf
                if not inner.any():
                    break
                over = np.flatnonzero(inner.sum(1) > beam)
                if len(over):
                    far = np.argsort(np.where(inner[over], d[over], np.inf), axis=1, kind="stable")[:, beam:]
                    some = inner[over]
                    np.put_along_axis(some, far, False, 1)
                    inner[over] = some
                here = inner[:, self.parent] & (self.parent >= 0)
            d = np.where(met, d, np.inf)
        d = d[:, self.leaves]
        if n == 1:
            best = d.argmin(1)[:, None]
        elif 4 * n >= d.shape[1]:
            best = np.argsort(d, axis=1, kind="stable")[:, :n]
        else:
            near = d <= np.partition(d, n - 1, axis=1)[:, n - 1:n]
            tied = near.sum(1) > n
            best = np.empty((len(d), n), np.int64)
            best[~tied] = np.nonzero(near[~tied])[1].reshape(-1, n)
            best[~tied] = np.take_along_axis(best[~tied], np.argsort(np.take_along_axis(d[~tied], best[~tied], 1), axis=1, kind="stable"), 1)
            best[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :n]
        return np.where(np.isfinite(np.take_along_axis(d, best, 1)), self.leaves[best], -1)


def boundary_replica(d1: float, d2: float, epsilon: float) -> bool:
    """Whether the second list is so near that the row is stored there too."""
    return d1 != 0 and (d2 - d1) / abs(d1) <= epsilon


def soar_choice(v: np.ndarray, primary: np.ndarray, others: np.ndarray, weight: float) -> np.ndarray:
    """For each row of v: which of its other lists has a residual that is small and lies across the primary residual. Lists of NaN aren't chosen."""
    r = v - primary
    n = np.linalg.norm(r, axis=1, keepdims=True)
    r = np.where(n > 0, r / np.where(n > 0, n, 1), r)
    d = v[:, None] - others
    cost = (d * d).sum(2) + weight * np.einsum("nkd,nd->nk", d, r) ** 2
    return np.where(np.isnan(cost), np.inf, cost).argmin(1)
