"""Whole-table density clustering: the tree, the hierarchy and the index against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.operators import density, density_table, vector_index


def blobs(k=3, n=30, dim=16, spread=0.6, noise=15, seed=7):
    r = np.random.default_rng(seed)
    mid = density.unit(r.normal(size=(k, dim)))
    return np.concatenate([m + r.normal(0, spread / dim**0.5, (n, dim)) for m in mid] + [r.normal(size=(noise, dim))])


def reach(x, samples):
    d = vector_index.distances(x, x)
    core = np.sort(d, axis=1)[:, samples - 1]
    return np.maximum(np.maximum(d, core[:, None]), core[None, :])


def parts(w, rows, below):
    """Components of rows by edges shorter than `below`."""
    left, out = set(rows), []
    while left:
        todo = [left.pop()]
        own = set(todo)
        while todo:
            a = todo.pop()
            near = {b for b in left if w[a, b] < below}
            left -= near
            own |= near
            todo += near
        out.append(own)
    return out


def brute_labels(x, size, samples, epsilon):
    """From the definition, from the longest edge down: no spanning tree."""
    w = reach(x, samples)
    levels = sorted(set(w[np.triu_indices(len(x), 1)]), reverse=True)
    clusters = [{"up": None, "birth": 0.0, "mass": 0.0}]
    home = {}

    def grow(rows, own, at):
        while at < len(levels):
            level = 1 / max(levels[at], 1e-12)
            split = parts(w, rows, levels[at])
            at += 1
            if len(split) == 1:
                continue
            large = [s for s in split if len(s) >= size]
            for s in split:
                if s not in large or len(large) > 1:
                    clusters[own]["mass"] += (level - clusters[own]["birth"]) * len(s)
                if s not in large:
                    home.update(dict.fromkeys(s, own))
            if len(large) == 1:
                rows = large[0]
                continue
            for s in large:
                clusters.append({"up": own, "birth": level, "mass": 0.0})
                grow(s, len(clusters) - 1, at)
            return

    grow(set(range(len(x))), 0, 0)
    below, chosen = [0.0] * len(clusters), set()
    for c in range(len(clusters) - 1, 0, -1):
        if clusters[c]["mass"] >= below[c]:
            chosen.add(c)
        below[clusters[c]["up"]] += max(clusters[c]["mass"], below[c])
    line = lambda c: [c, *line(clusters[c]["up"])] if c else []
    taken = {c for c in chosen if not any(u in chosen for u in line(c)[1:])}
    if epsilon:
        taken = {next((u for u in line(c) if 1 / clusters[u]["birth"] >= epsilon), line(c)[-1]) for c in taken}
    return [next((u for u in reversed(line(home[i])) if u in taken), -1) for i in range(len(x))]


def same(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b)) and all((x == -1) == (y == -1) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_labels_follow_the_definition(seed):
    r = np.random.default_rng(seed)
    x = r.integers(0, 12, (40, 2)).astype(float) if seed % 2 else blobs(3, 12, 3, 0.5, 6, seed)  # a grid has many equal distances
    for size, samples, epsilon in ((3, 2, 0.0), (4, 3, 0.3), (2, 1, 0.0), (5, 2, 1.1)):
        assert same(density.density_labels(x, size, samples, epsilon), brute_labels(x, size, samples, epsilon))


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")


def test_search_is_exact_and_probes_reach_recall(spark, tmp_path):
    x = blobs(6, 40, 12, 0.5, 30)
    t = table(spark, x)
    index = vector_index.build(t, 12)
    d = vector_index.distances(x, x)
    want = {(i, int(j), r + 1) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:5])}
    for probes in (1, 3):
        assert {(r.query_id, r.id, r["rank"]) for r in vector_index.search(t, index, 5, probes).collect()} == want
    assert {(r.query_id, r.id, r["rank"]) for r in vector_index.exact_pairs(t, t, 5).collect()} == want
    stored = vector_index.build(t, 12, str(tmp_path / "index"))
    some = t.where("id < 3")
    got = vector_index.search(some, stored, 5, 3, exact=False)
    assert vector_index.recall(got, vector_index.exact_pairs(some, t, 5)).head().recall >= 0.9
    scan = stored.rows.where(F.col("list").isin([0, 1]))
    scan.collect()
    leaf = scan._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert 0 < leaf.metrics().apply("numFiles").value() <= 2 < len(stored.rows.inputFiles())


def test_whole_table_equals_groups_in_memory(spark):
    x = blobs(4, 25, 16, 0.7, 20)
    x = np.concatenate([x, x[:6], x[:1], x[:1]])  # equal vectors
    p = density.Params(epsilon=0.1)
    rows = table(spark, x).unionByName(spark.createDataFrame([(9000, None)], "id bigint, vec array<double>"))
    got = {r.id: r.cluster for r in density_table.cluster_table(rows, p, most=25).collect()}
    assert len(got) == len(x)
    labels = [got[i] for i in range(len(x))]
    assert same(labels, density._labelled(x, p).tolist()) and len(set(labels)) > 2
    assert all(c == -1 or c == min(i for i in got if got[i] == c) for c in labels)


def test_tree_is_exact(spark):
    x = np.concatenate([blobs(3, 25, 4, 0.3, 0), 9 + blobs(2, 20, 4, 0.2, 4, 3)])  # the neighbour graph falls apart
    t = table(spark, x).withColumn("weight", F.lit(1))
    index = vector_index.build(t, 8)
    edges, cores = density_table.graph(t, index, 5, 3)
    tree = density_table.spanning_tree(t, index, edges, cores).collect()
    assert len(tree) == len(x) - 1
    core = np.sort(vector_index.distances(x, x), axis=1)[:, 2]
    assert sum(r.w for r in tree) == pytest.approx(density._tree(x, core)[:, 2].sum(), rel=1e-9)


@pytest.mark.parametrize("n", [0, 2, 4])
def test_small_tables(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 8))
    got = [r.cluster for r in density_table.cluster_table(table(spark, x).where(F.lit(n > 0))).orderBy("id").collect()] if n else []
    want = density._labelled(x, density.Params()) if n else np.zeros(0)
    assert len(got) == n and (n > 3 or set(got) <= {0}) and same(got, want.tolist())


@pytest.mark.parametrize("dim", [2, 10, 64])
def test_nearest_rows_equal_those_of_all_distances(dim):
    """Candidates by products lose no row and no tie: places and distances are those of sorting all distances."""
    r = np.random.default_rng(dim)
    a, b = r.integers(0, 3, (70, dim)) / 7, np.concatenate([r.integers(0, 3, (150, dim)) / 7, r.normal(1e3, 1e-6, (50, dim))])
    a, ids = np.concatenate([a, b[-20:]]), r.permutation(200)
    d = vector_index.distances(a, b)
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)
    for k in (1, 7, 200, 300):
        i, j, got = vector_index.nearest(a, b, ids, k)
        assert (j.reshape(90, -1) == order[:, :k]).all() and (got.reshape(90, -1) == np.take_along_axis(d, order, 1)[:, :k]).all()
        far = np.sort(d, axis=1)[:, 3]
        i, j, got = vector_index.nearest(a, b, ids, k, far)
        assert [(x, y) for x in range(90) for y in order[x, :k] if d[x, y] <= far[x]] == list(zip(i.tolist(), j.tolist(), strict=True)) and (got == d[i, j]).all()


def test_searches_hand_on_small_pieces():
    """A query may ask every list, so what a task holds at once doesn't grow with the number of lists."""
    f = pd.DataFrame({"id": np.arange(10_000)})
    for lists in (1, 100, 8192, 100_000):
        parts = list(vector_index.slices(iter([f, f.iloc[:0], f]), lists))
        assert max(len(p) for p in parts) * lists <= max(lists, vector_index.ASKED) and pd.concat(parts)["id"].tolist() == 2 * f["id"].tolist()
    assert list(vector_index.slices(iter([f]), 0)) == []
