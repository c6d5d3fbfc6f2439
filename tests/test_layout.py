"""The neighbour-graph reduction: weights, the layout in memory and in tables, and the grid's axis of neighbours."""

import numpy as np
import pytest

from tidewire.operators import density, layout, vector_index


def blobs(k=3, n=25, dim=12, spread=0.5, seed=5):
    r = np.random.default_rng(seed)
    mid = density.unit(r.normal(size=(k, dim)))
    return density.unit(np.concatenate([m + r.normal(0, spread / dim**0.5, (n, dim)) for m in mid])), np.repeat(np.arange(k), n)


def table(spark, x):
    return spark.createDataFrame([(10 * i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")


def test_weights_sum_to_their_goal():
    d = np.sort(np.random.default_rng(1).uniform(1, 3, (40, 15)), axis=1)
    w = layout.smooth(d)
    assert np.allclose(w.sum(axis=1), np.log2(15), rtol=1e-6) and np.allclose(w[:, 0], 1) and (np.diff(w, axis=1) <= 0).all()
    assert np.allclose(layout.smooth(np.zeros((2, 4))), 1)  # equal rows


def test_groups_are_apart_and_seeded():
    x, truth = blobs()
    flat = density.reduce(x, 5)
    y = layout.reduce(x, flat, 10)
    assert np.isfinite(y).all() and np.array_equal(y, layout.reduce(x, flat, 10)) and not np.allclose(y, layout.reduce(x, flat, 10, seed=8))
    d = vector_index.distances(y, y)
    same = truth[:, None] == truth[None, :]
    assert d[~same].min() > np.median(d[same])
    for n in range(4):
        assert np.array_equal(layout.reduce(x[:n], flat[:n], 5), flat[:n])


def test_table_equals_memory(spark):
    x, _ = blobs(n=20)
    flat = density.reduce(x, 3)
    t = table(spark, x)
    number = {r.id: r.i for r in layout.numbered(t.select("id"), size=16).collect()}
    assert sorted(number.values()) == list(range(len(x)))
    got = {r.id: r.vec for r in layout.table(t, table(spark, flat), neighbors=8, turns=3).collect()}
    order = [r.id // 10 for r in sorted(layout.numbered(t.select("id")).collect(), key=lambda r: r.i)]
    want = layout.reduce(x[order], flat[order], 8, turns=3)
    assert np.allclose([got[10 * i] for i in order], want, atol=1e-6)


def test_grid_has_an_axis_of_neighbours(spark):
    x, _ = blobs(n=12)
    rows = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "b bigint, id bigint, vec array<double>")
    grid = {"neighbors": (4, 10), "min_cluster": (3, 5), "min_samples": (1,), "epsilon": (0.0,)}
    best = density.grid_search(rows, "b", grid=grid).collect()
    assert len(best) == 1 and best[0].neighbors in (4, 10) and best[0].score > 0.3
    with pytest.raises(ValueError):
        density.Params(neighbors=1)
