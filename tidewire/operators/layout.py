"""Reduction by a neighbour graph: smooth edge weights and a seeded attract / repel layout.

1. The distances of each row to its neighbours become weights: exp(-(d - nearest) / width), the width set so that a
   row's weights sum to log2(neighbours); both directions of an edge are joined as a + b - a * b.
2. Coordinates start as principal components.  In a turn each row moves by the mean pull of its edges (by weight) and
   the mean push of PUSHES rows that a seeded shift of the rows' numbers picks, less with each turn.  All rows move at
   once, so a turn is two joins and sums by row, and the result doesn't depend on how rows lie in partitions.

The kernels are numpy functions; groups in memory and whole tables use the same ones.  Up to three rows keep their first
numbers, as they do without a graph.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators import vector_index as VI
from tidewire.operators.storage import forget, keep

# The shape of the pull for a least distance of 0.1 between rows, and the bound of a single force.
A, B, MOST = 1.577, 0.8951, 4.0
PUSHES, TURNS = 5, 60


def smooth(d: np.ndarray) -> np.ndarray:
    """Weights of the rows' sorted distances to their neighbours (without themselves)."""
    above = d - np.where(d > 0, d, np.inf).min(axis=1, initial=np.inf, keepdims=True)
    above = np.maximum(np.where(np.isfinite(above), above, 0), 0)
    goal = np.log2(max(2, d.shape[1]))
    lo, hi = np.full(len(d), 1e-6), np.full(len(d), 1e6)
    for _ in range(64):
        mid = np.sqrt(lo * hi)
        over = np.exp(-above / mid[:, None]).sum(axis=1) > goal
        hi, lo = np.where(over, mid, hi), np.where(over, lo, mid)
    return np.exp(-above / np.sqrt(lo * hi)[:, None])


def pull(diff: np.ndarray) -> np.ndarray:
    d2 = np.maximum((diff ** 2).sum(axis=1, keepdims=True), 1e-12)
    return np.clip(-2 * A * B * d2 ** (B - 1) / (1 + A * d2 ** B) * diff, -MOST, MOST)


def push(diff: np.ndarray) -> np.ndarray:
    d2 = (diff ** 2).sum(axis=1, keepdims=True)
    return np.clip(2 * B / ((0.001 + d2) * (1 + A * d2 ** B)) * diff, -MOST, MOST)


def shifts(n: int, turn: int, seed: int) -> list[int]:
    r = random.Random(seed * 1_000_003 + turn)
    return [r.randrange(1, n) for _ in range(PUSHES)]


def in_memory(y: np.ndarray, ends: np.ndarray, weight: np.ndarray, turns: int = TURNS, seed: int = 7) -> np.ndarray:
    """The layout of rows with coordinates y and edges (both directions)."""
    n = len(y)
    whole = np.bincount(ends[:, 0], weight, n)[:, None]
    for t in range(turns):
        move = np.zeros_like(y)
        np.add.at(move, ends[:, 0], weight[:, None] * pull(y[ends[:, 0]] - y[ends[:, 1]]))
        move /= np.maximum(whole, 1e-12)
        for s in shifts(n, t, seed):
            move += push(y - np.roll(y, -s, axis=0)) / PUSHES
        y = y + (1 - t / turns) * move
    return y


def scaled(y: np.ndarray) -> np.ndarray:
    return 10 * y / max(1e-12, np.abs(y).max(initial=0))


def reduce(x: np.ndarray, flat: np.ndarray, neighbors: int, turns: int = TURNS, seed: int = 7) -> np.ndarray:
    """Unit vectors x with principal components flat, by their neighbour graph; groups that fit in memory."""
    n = len(x)
    if n <= 3:
        return flat
    d = VI.distances(x, x)
    np.fill_diagonal(d, -1)  # a row is its own first neighbour
    near = np.argsort(d, axis=1, kind="stable")[:, 1:min(neighbors, n - 1) + 1]
    w = np.zeros((n, n))
    np.put_along_axis(w, near, smooth(np.take_along_axis(d, near, 1)), axis=1)
    w = w + w.T - w * w.T
    ends = np.argwhere(w > 0)
    return in_memory(scaled(flat), ends, w[ends[:, 0], ends[:, 1]], turns, seed)


# ---- whole tables ----------------------------------------------------------------------------------------------------

def weights(vectors: DataFrame, neighbors: int, index: VI.Index | None = None) -> DataFrame:
    """a, b, w: the joined weights of the neighbour graph, both directions; vectors: id, vec."""
    near = VI.search(vectors, index or VI.build(vectors), neighbors + 1).where(F.col("query_id") != F.col("id"))
    w = Window.partitionBy("query_id").orderBy("dist", "id")
    near = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= neighbors)  # equal rows may have crowded a row itself out
    lists = near.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("dist", "id"))).alias("_l"))  # `neighbors` entries

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, part in f.groupby(f["_l"].map(len)):
                ids = np.array([[x["id"] for x in r] for r in part["_l"]])
                got = smooth(np.array([[x["dist"] for x in r] for r in part["_l"]]))
                yield pd.DataFrame({"a": np.repeat(part["query_id"].to_numpy(), k), "b": ids.ravel(), "w": got.ravel()})

    one = keep(lists.mapInPandas(run, "a bigint, b bigint, w double"), "weights")
    both = one.select("a", "b", "w", F.lit(0.0).alias("v")).unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0.0).alias("w"), F.col("w").alias("v")))
    return both.groupBy("a", "b").agg(F.sum("w").alias("w"), F.sum("v").alias("v")).select("a", "b", (F.col("w") + F.col("v") - F.col("w") * F.col("v")).alias("w"))


def numbered(ids: DataFrame, size: int = 4096) -> DataFrame:
    """id, i: numbers from 0 without gaps, in the order of hashed parts of about `size` rows and of ids in them."""
    n = max(1, ids.count() // size)
    part = ids.select("id", F.pmod(F.xxhash64("id"), F.lit(n)).alias("_p"))
    held = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = held.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_off"))  # a row a part
    return part.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("id")) - 1).join(before, "_p").select("id", (F.col("_off") + F.col("_r")).alias("i"))


def _forces(pairs: DataFrame, kernel, dims: int) -> DataFrame:
    """i and the sums f0, f1, ... of w * kernel(y - z) over pairs (i, w, y, z)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                got = f["w"].to_numpy()[:, None] * kernel(VI.matrix(f["y"]) - VI.matrix(f["z"]))
                yield pd.DataFrame(got, columns=[f"f{c}" for c in range(dims)]).assign(i=f["i"].to_numpy()).groupby("i", as_index=False).sum()

    named = ", ".join(f"f{c} double" for c in range(dims))
    return pairs.mapInPandas(run, f"{named}, i bigint")


def table(vectors: DataFrame, flat: DataFrame, neighbors: int = 15, turns: int = TURNS, seed: int = 7) -> DataFrame:
    """id, vec: the layout of a whole table; vectors: id, vec (unit vectors); flat: id, vec (principal components)."""
    n = flat.count()
    if n <= 3:
        return flat.select("id", "vec")
    number = keep(numbered(flat.select("id")), "numbers")
    of = lambda c, name: number.select(F.col("id").alias(c), F.col("i").alias(name))
    edges = weights(vectors, neighbors).join(of("a", "i"), "a").join(of("b", "j"), "b").select("i", "j", "w")
    whole = edges.groupBy("i").agg(F.sum("w").alias("_whole"))
    edges = keep(edges.join(whole, "i").select("i", "j", (F.col("w") / F.col("_whole")).alias("w")), "edges")
    top = flat.agg(F.max(F.array_max(F.transform("vec", F.abs)))).head()[0]
    dims = len(flat.select("vec").head()[0])
    now = keep(flat.join(number, "id").select("i", F.transform("vec", lambda v: 10 * v / max(1e-12, top)).alias("y")), "layout")
    for t in range(turns):
        other = now.select(F.col("i").alias("j"), F.col("y").alias("z"))
        pulled = _forces(edges.join(now, "i").join(other, "j").select("i", "w", "y", "z"), pull, dims)
        asked = now.select("i", "y", F.explode(F.array(*[F.lit(s) for s in shifts(n, t, seed)])).alias("_s"))
        asked = asked.select("i", "y", F.lit(1 / PUSHES).alias("w"), ((F.col("i") + F.col("_s")) % n).alias("j"))
        pushed = _forces(asked.join(other, "j").select("i", "w", "y", "z"), push, dims)
        sums = pulled.unionByName(pushed).groupBy("i").agg(F.array(*[F.sum(f"f{c}") for c in range(dims)]).alias("_f"))
        part = 1 - t / turns
        new = keep(now.join(sums, "i").select("i", F.zip_with("y", "_f", lambda y, f: y + part * f).alias("y")), "layout")
        forget(now)
        now = new
    return now.join(number, "i").select("id", F.col("y").alias("vec"))
