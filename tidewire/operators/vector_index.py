"""An index for vectors: coarse centres with inverted lists, searched exactly by bounds or approximately by probes.

A list holds the vectors nearest to its centre, and the distance of the farthest of them (its radius).  A vector q has
no neighbour nearer than |q - centre| - radius in a list, so lists beyond a known distance needn't be read: that makes
the search exact.  With `probes` alone only the nearest lists are read.

Lists are compared with their queries in blocks of about `BLOCK` rows on each side, dealt by a hash, so a list that
holds a third of all vectors (or is asked by all queries) is many tasks, and each hands on k rows a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.storage import keep

BLOCK = 1024
ASKED = 16_384  # rows that a task hands on at once: a query may ask every list
MOST_LISTS = 8192  # centres go to every task: 8,192 of 384 numbers are 25 MB


@dataclass(frozen=True)
class Index:
    """rows: id, vec, list; centres and radii by list."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def lists_for(n: int) -> int:
    return int(min(MOST_LISTS, max(1, round(n ** 0.5))))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, by differences (equal pairs have equal distances, however they meet)."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        out[i:i + step] = np.sqrt(((a[i:i + step, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


def centres(vectors: DataFrame, n: int, sample: int = 20_000, steps: int = 8) -> np.ndarray:
    """n centres by k-means on the `sample` vectors with the smallest hash of their id (a bounded sample; every vector is indexed)."""
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(max(sample, n)).select("vec").toArrow().column(0).to_pylist()
    if not some:
        return np.zeros((0, 1))
    x = np.array(some, np.float64)
    c = np.unique(x, axis=0)
    c = c[np.random.default_rng(17).permutation(len(c))[:n]]
    for _ in range(steps):
        at = np.concatenate([((x[i:i + 1024] ** 2).sum(1)[:, None] - 2 * x[i:i + 1024] @ c.T + (c ** 2).sum(1)).argmin(1) for i in range(0, len(x), 1024)])
        count = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], c)
    return c


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def slices(frames: Iterator[pd.DataFrame], lists: int) -> Iterator[pd.DataFrame]:
    """Rows in pieces whose rows asking all lists are about ASKED: a piece's distances to centres and its answers stay that small."""
    step = max(1, ASKED // max(1, lists))
    for f in frames:
        for at in range(0, len(f) if lists else 0, step):
            yield f.iloc[at:at + step]


def build(vectors: DataFrame, n_lists: int | None = None, path: str | None = None) -> Index:
    """Index of vectors (id bigint, vec array of numbers of one length); null vectors are left out.

    With a path the lists are folders of Parquet files there, so that a search reads the files of the probed lists alone.
    """
    known = vectors.where(F.col("vec").isNotNull()).select("id", F.col("vec").cast("array<double>").alias("vec"))
    c = centres(known, n_lists or lists_for(known.count()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), BLOCK):
                part = f.iloc[at:at + BLOCK]
                d = distances(matrix(part["vec"]), c)
                near = d.argmin(axis=1)
                yield part.assign(list=near.astype(np.int32), away=d[np.arange(len(part)), near])

    placed = known.mapInPandas(run, "id bigint, vec array<double>, list int, away double")
    if path is None:
        placed = keep(placed, "index")
    else:
        placed.repartition("list").write.mode("overwrite").partitionBy("list").parquet(path)
        placed = known.sparkSession.read.schema("id bigint, vec array<double>, away double, list int").parquet(path)
    radii, sizes = np.zeros(len(c)), np.zeros(len(c), np.int64)
    for r in placed.groupBy("list").agg(F.max("away").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # a row a list
        radii[r.list], sizes[r.list] = r.far, r.n
    return Index(placed.select("id", "vec", "list"), c, radii, sizes)


def by_key(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of rows with equal keys in sorted frames, each whole."""
    held: list[pd.DataFrame] = []
    last = None
    for f in frames:
        if not len(f):
            continue
        marks = f[keys].to_numpy()
        cut = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(f)], strict=True):
            now = tuple(marks[lo])
            if held and now != last:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(f.iloc[lo:hi])
            last = now
    if held:
        yield pd.concat(held, ignore_index=True)


def meet(asks: DataFrame, base: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """compare(queries, rows) for all rows of a list and all queries that ask it, in blocks of about BLOCK rows on each side.

    asks and base have the same columns, among them id and list.
    """
    count = lambda t, name: t.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = count(asks, "_mp").join(count(base, "_mq"), "list")
    small = F.broadcast(sizes)  # a row a list, at most MOST_LISTS
    part = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = base.columns
    left = asks.select(own).join(small, "list").select(*own, part("_mp", 5).alias("_p"), every("_mq").alias("_q"), F.lit(True).alias("_asks"))
    right = base.select(own).join(small, "list").select(*own, every("_mp").alias("_p"), part("_mq", 5).alias("_q"), F.lit(False).alias("_asks"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in by_key(frames, ["list", "_p", "_q"]):
            asking = f["_asks"].to_numpy(bool)
            yield compare(f[asking], f[~asking])

    return left.unionByName(right).repartition("list", "_p", "_q").sortWithinPartitions("list", "_p", "_q").mapInPandas(run, schema)


FOUND = "query_id bigint, id bigint, dist double"


def nearest(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, far: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance): each a's k nearest rows of b, ties by ids; with `far` only those no farther than that.

    Products tell which rows may be among them, with room for their rounding; the distances are those of distances().
    """
    aa, bb = (a ** 2).sum(axis=1)[:, None], (b ** 2).sum(axis=1)[None, :]
    room = 1e-12 * a.shape[1] * (aa + bb.max(initial=0))
    rough = aa + bb - 2 * (a @ b.T)
    most = np.partition(rough, k - 1, axis=1)[:, k - 1:k] + 2 * room if len(b) > k else np.full((len(a), 1), np.inf)
    if far is not None:
        most = np.minimum(most, far[:, None] ** 2 * (1 + 1e-9) + room)
    i, j = np.nonzero(rough <= most)
    d, step = np.empty(len(i)), max(1, 4_000_000 // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        d[at:at + step] = np.sqrt(((a[i[at:at + step]] - b[j[at:at + step]]) ** 2).sum(axis=1))
    if far is not None:
        within = d <= far[i]
        i, j, d = i[within], j[within], d[within]
    order = np.lexsort((ids[j], d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], d[first]


def _nearest(asks: DataFrame, base: DataFrame, k: int, bound: str | None = None) -> DataFrame:
    """Each query's k nearest rows of each list that it asks; with a column `bound` of asks only rows no farther than that."""
    if bound:
        base = base.withColumn(bound, F.lit(None).cast("double"))

    def compare(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "dist": []})
        ids = b["id"].to_numpy()
        i, j, d = nearest(matrix(q["vec"]), matrix(b["vec"]), ids, k, q[bound].to_numpy() if bound else None)
        return pd.DataFrame({"query_id": q["id"].to_numpy()[i], "id": ids[j], "dist": d})

    return meet(asks, base, compare, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _asked(queries: DataFrame, index: Index, probes: int, bound: str | None = None) -> DataFrame:
    """Queries with a row for each list to read: the nearest ones, or all others whose rows may be within `bound`."""
    c, radii, some = index.centres, index.radii, index.sizes > 0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, len(c)):
            d = np.where(some, distances(matrix(f["vec"]), c), np.inf)
            near = np.zeros(d.shape, bool)
            np.put_along_axis(near, np.argsort(d, axis=1, kind="stable")[:, :probes], True, axis=1)
            if bound:
                near = ~near & some & (d - radii <= f[bound].to_numpy()[:, None] * (1 + 1e-9))
            i, j = np.nonzero(near & some)
            yield f.iloc[i].assign(list=j.astype(np.int32))

    return queries.select("id", "vec", *([bound] if bound else [])).mapInPandas(run, f"id bigint, vec array<double>{f', {bound} double' if bound else ''}, list int")


def search(queries: DataFrame, index: Index, k: int, probes: int = 4, exact: bool = True) -> DataFrame:
    """query_id, id, dist, rank: the k rows of the index nearest to each query (id, vec), itself included if it is there; ties by id.

    exact: after the `probes` nearest lists all others that the bounds don't rule out; else the `probes` lists alone.
    """
    q = queries.where(F.col("vec").isNotNull()).select("id", F.col("vec").cast("array<double>").alias("vec"))
    asked = _asked(q, index, probes)
    base = index.rows
    if not exact:
        wanted = [r.list for r in asked.select("list").distinct().collect()]  # list numbers, at most MOST_LISTS
        return best(_nearest(asked, base.where(F.col("list").isin(wanted)), k), k)
    first = keep(best(_nearest(asked, base, k), k), "nearest")
    far = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("dist").alias("_far"))
    bound = q.join(far, "id", "left").withColumn("_far", F.coalesce("_far", F.lit(float("inf"))))
    more = _nearest(_asked(bound, index, probes, "_far"), base, k, "_far")
    return best(first.drop("rank").unionByName(more), k)


def exact_pairs(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The same without an index: every query against every row, in blocks; for measuring the index on a set of queries."""
    one = lambda t: t.where(F.col("vec").isNotNull()).select("id", F.col("vec").cast("array<double>").alias("vec"), F.lit(0).alias("list"))
    return best(_nearest(one(queries), one(vectors), k), k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of the true neighbours that were found."""
    hit = found.select("query_id", "id", F.lit(1).alias("_hit"))
    return truth.join(hit, ["query_id", "id"], "left").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


def tuned(queries: DataFrame, index: Index, k: int, least: float = 0.9, probes: int = 4) -> tuple[DataFrame, float, int]:
    """(found, recall, probes): a search of the nearest lists alone, with as many of them (doubled each time) as a recall of `least` takes.

    The recall is measured on the queries themselves against the exact search.
    """
    truth = keep(search(queries, index, k), "truth")
    while True:
        found = keep(search(queries, index, k, probes, exact=False), "found")
        reached = recall(found, truth).head()[0]
        if reached is None or reached >= least or probes >= len(index.centres):
            return found, reached if reached is not None else 1.0, min(probes, len(index.centres))
        probes *= 2
