"""Density clustering of vectors by group: reduction, hierarchy, validity and grid search.

A group is one time bucket or one brief's articles.  The hierarchy needs distances between all rows of a group, so a
group beyond `most_rows` is refused by name, never cut; `density_table` clusters whole tables.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    components: int = 10
    neighbors: int = 15
    min_cluster: int = 5
    min_samples: int = 3
    epsilon: float = 0.2

    def __post_init__(self):
        if not (2 <= self.components <= 50 and 2 <= self.neighbors <= 100 and self.min_cluster >= 2 and self.min_samples >= 1 and self.epsilon >= 0):
            raise ValueError(f"out of bounds: {self}")


def safe(n: int, p: Params) -> tuple[int, int, int]:
    """(neighbors, min_cluster, min_samples) that n rows allow."""
    near = max(1, n - 1) if n <= 3 else min(p.neighbors, n - 2 if n <= 10 else n - 1)
    size = 2 if n <= 5 else min(3, p.min_cluster) if n <= 10 else p.min_cluster
    return near, size, max(1, min(p.min_samples, size - 1))


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)


def reduce(x: np.ndarray, k: int) -> np.ndarray:
    """Principal components of unit vectors with fixed signs; up to three rows keep their first k numbers."""
    n, d = x.shape
    k = min(k, n - 1, d) if n > 3 else min(k, d)
    if n <= 3:
        return x[:, :k]
    mid = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(mid, full_matrices=False)
    axes = axes[:k]
    axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return mid @ axes.T


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def _tree(x: np.ndarray, core: np.ndarray, apart: np.ndarray | None = None) -> np.ndarray:
    """Minimum spanning tree of mutual reachability, rows (from, to, length); a row of distances (of `apart`, where known) at a time."""
    n = len(x)
    inside, best, frm, at, out = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), 0, np.empty((n - 1, 3))
    for i in range(n - 1):
        inside[at] = True
        d = np.maximum(np.maximum(np.sqrt(((x - x[at]) ** 2).sum(1)) if apart is None else apart[at], core), core[at])
        nearer = ~inside & (d < best)
        best[nearer], frm[nearer] = d[nearer], at
        at = int(np.where(inside, np.inf, best).argmin())
        out[i] = frm[at], at, best[at]
    return out


LEAST = 1e-12  # a shorter distance counts as this one


def merge_group(states: list[dict], edges: list[tuple[int, int, float]], least: int, name: str) -> tuple[list[tuple], list[tuple], list[dict]]:
    """(homes (point, cluster), clusters (id, parent, birth, chosen), nodes left) after merging nodes along edges, shortest first."""
    state, head = {s["node"]: s for s in states}, {s["node"]: s["node"] for s in states}
    homes, closed, made = [], [], 0

    def top(a: int) -> int:
        while head[a] != a:
            head[a] = head[head[a]]
            a = head[a]
        return a

    edges = sorted(edges, key=lambda e: e[2])
    i = 0
    while i < len(edges):
        j, w = i, edges[i][2]
        while j < len(edges) and edges[j][2] == w:
            j += 1
        roots = {r for a, b, _ in edges[i:j] for r in (top(a), top(b))}
        for a, b, _ in edges[i:j]:
            a, b = top(a), top(b)
            if a != b:
                head[max(a, b)] = min(a, b)
        groups: dict[int, list[dict]] = {}
        for r in sorted(roots):
            groups.setdefault(top(r), []).append(state.pop(r))
        level = 1 / max(w, LEAST)
        for at, parts in groups.items():
            large, small = [s for s in parts if s["cluster"]], [s for s in parts if not s["cluster"]]
            size, loose = sum(s["size"] for s in parts), sum(s["size"] for s in small)
            if not large and size < least:
                state[at] = _node(at, size, [p for s in small for p in s["points"]])
                continue
            if len(large) == 1:
                new = large[0]
                new["node"] = at
            else:
                made += 1
                new = _node(at, 0, None, f"{name}:{made}")
                for s in large:
                    mass = s["sum_left"] - level * s["n_left"] + (0 if s["split"] is None else (s["split"] - level) * s["n_split"])
                    closed.append((s["cluster"], new["cluster"], level, mass >= s["below"]))
                    new["below"] += max(mass, s["below"])
                if large:
                    new["split"], new["n_split"] = level, size - loose
            new["size"] = size
            new["n_left"] += loose
            new["sum_left"] += level * loose
            homes += [(p, new["cluster"]) for s in small for p in s["points"]]
            state[at] = new
        i = j
    return homes, closed, list(state.values())


def _node(node: int, size: int, points: list[int] | None, cluster: str | None = None) -> dict:
    return {"node": node, "size": size, "points": points, "cluster": cluster, "n_left": 0, "sum_left": 0.0, "split": None, "n_split": 0, "below": 0.0}


def density_labels(x: np.ndarray, min_cluster: int, min_samples: int, epsilon: float = 0.0, known: dict | None = None) -> np.ndarray:
    """Cluster of each row, -1: noise.  Clusters of the condensed hierarchy with the greatest excess of mass.

    known: what trials on the same rows share (distances, trees, hierarchies); a new dict for each x.
    """
    n = len(x)
    if n <= 3:
        return np.zeros(n, int)
    if min_cluster < 2:
        raise ValueError("min_cluster is 2 or more")
    known = {} if known is None else known
    k = min(min_samples, n - 1)
    if "apart" not in known:
        known["apart"] = np.array([np.sqrt(((x - r) ** 2).sum(1)) for r in x])
    if ("tree", k) not in known:
        core = np.partition(known["apart"], k - 1, axis=1)[:, k - 1]
        known["tree", k] = [(int(a), int(b), w) for a, b, w in _tree(x, core, known["apart"])]
    if (min_cluster, k) not in known:
        known[min_cluster, k] = merge_group([_node(i, 1, [i]) for i in range(n)], known["tree", k], min_cluster, "c")
    homes, closed, _ = known[min_cluster, k]
    parent, birth = {c: up for c, up, _, _ in closed}, {c: level for c, _, level, _ in closed}

    def highest(c: str | None, marked: set[str]) -> str | None:
        """The highest marked cluster from c upwards, below the root."""
        found = None
        while c in parent:
            found, c = c if c in marked else found, parent[c]
        return found

    taken = {c for c, _, _, chosen in closed if chosen}
    taken = {c for c in taken if highest(c, taken) == c}
    if epsilon > 0:
        merged = set()
        for c in taken:
            while 1 / birth[c] < epsilon and parent[c] in parent:
                c = parent[c]
            merged.add(c)
        taken = merged
    home, names, of = dict(homes), {None: -1}, []
    for i in range(n):
        c = highest(home.get(i), taken)
        names.setdefault(c, len(names) - 1)
        of.append(names[c])
    return np.array(of)


def _inner(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(rows, core distances, inner rows, longest inner edge) of a cluster's rows."""
    m, dim = y.shape
    if m < 2:
        return y, np.zeros(m), np.arange(m), 0.0
    logs = -dim * np.log(np.maximum(_distances(y, y), 1e-12))
    np.fill_diagonal(logs, -np.inf)
    peak = logs.max(axis=1)
    core = np.exp(-(peak + np.log(np.exp(logs - peak[:, None]).sum(axis=1)) - np.log(m - 1)) / dim)
    tree = _tree(y, core)
    ends = tree[:, :2].astype(int)
    degree = np.bincount(ends.ravel(), minlength=m)
    inner = np.flatnonzero(degree > 1) if (degree > 1).any() else np.arange(m)
    both = (degree[ends] > 1).all(axis=1)
    return y, core, inner, tree[both if both.any() else slice(None), 2].max()


def validity(x: np.ndarray, labels: np.ndarray, known: dict | None = None) -> float:
    """Density-based validity of the clusters of the rows that are not noise, -1 to 1; -1 where fewer than two.

    known: what labellings of the same rows share (scores, clusters, how far two lie apart); a new dict for each x.
    """
    names = np.unique(labels[labels >= 0])
    if len(names) < 2:
        return -1.0
    known = {} if known is None else known
    if (whole := labels.tobytes()) in known:
        return known[whole]
    x, parts = x.astype(float), []
    for c in names:
        rows = np.flatnonzero(labels == c)
        if (key := rows.tobytes()) not in known:
            known[key] = (len(known), *_inner(x[rows]))
        parts.append(known[key])
    total, kept = 0.0, (labels >= 0).sum()
    for i, (one, y, core, inner, sparse) in enumerate(parts):
        apart = np.inf
        for j, (two, z, core2, other, _) in enumerate(parts):
            if j != i:
                if (one, two) not in known:
                    known[one, two] = np.maximum(np.maximum(_distances(y[inner], z[other]), core[inner][:, None]), core2[other][None, :]).min()
                apart = min(apart, known[one, two])
        total += len(y) / kept * (apart - sparse) / max(apart, sparse, 1e-12)
    known[whole] = float(total)
    return known[whole]


def _labelled(x: np.ndarray, p: Params) -> np.ndarray:
    _, size, samples = safe(len(x), p)
    return density_labels(reduce(unit(x), p.components), size, samples, p.epsilon)


def cluster(rows: DataFrame, by: str, p: Params = Params(), most_rows: int = 5000, drop_noise: bool = False) -> DataFrame:
    """rows: id bigint, vec array, and the group column `by` (bigint); the result: by, id, cluster (-1: noise)."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        if len(f) > most_rows:
            raise ValueError(f"group {key[0]} has {len(f)} rows, more than {most_rows}: take finer groups")
        f = f.sort_values("id")
        return pd.DataFrame({by: f[by], "id": f["id"], "cluster": _labelled(np.stack(f["vec"].to_numpy()).astype(float), p)})

    out = rows.select(by, "id", "vec").where(F.col("vec").isNotNull()).groupBy(by).applyInPandas(run, f"{by} bigint, id bigint, cluster int")
    return out.where(F.col("cluster") >= 0) if drop_noise else out


# The grid of the search.
GRID = {"neighbors": (5, 10, 15, 30), "min_cluster": (3, 5, 8, 10), "min_samples": (1, 3, 5), "epsilon": (0.0, 0.2, 0.5)}


def grid_search(rows: DataFrame, by: str, p: Params = Params(), grid: dict = GRID, most_rows: int = 5000) -> DataFrame:
    """Best parameters of each group by validity: by, neighbors, min_cluster, min_samples, epsilon, score (-1: defaults).

    Each number of neighbors gives the group a layout of its own by its neighbour graph; the other settings are tried on it
    and share its distances, a tree for each number of samples, a hierarchy for each of these and size, and clusters met before.
    """
    from tidewire.operators import layout

    keys = ("neighbors", "min_cluster", "min_samples", "epsilon")
    trials = list(itertools.product(*(grid[k] for k in keys[1:])))

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        if len(f) > most_rows:
            raise ValueError(f"group {key[0]} has {len(f)} rows, more than {most_rows}: take finer groups")
        best = (-1.0, p.neighbors, p.min_cluster, p.min_samples, float(p.epsilon))
        if len(f) > 5:
            own = unit(np.stack(f.sort_values("id")["vec"].to_numpy()).astype(float))
            flat = reduce(own, p.components)
            for near in grid["neighbors"]:
                x = layout.reduce(own, flat, safe(len(own), replace(p, neighbors=near))[0])
                trees, scores = {}, {}
                for size, samples, eps in trials:
                    labels = density_labels(x, size, samples, eps, trees)
                    if len(set(labels.tolist()) - {-1}) >= 2 and (score := validity(x, labels, scores)) > best[0]:
                        best = (score, near, size, samples, float(eps))
        return pd.DataFrame([(key[0], *best[1:], best[0])], columns=[by, *keys, "score"])

    return rows.select(by, "id", "vec").where(F.col("vec").isNotNull()).groupBy(by).applyInPandas(run, f"{by} bigint, neighbors int, min_cluster int, min_samples int, epsilon double, score double")
