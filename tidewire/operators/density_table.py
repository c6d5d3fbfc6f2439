"""Density clustering of a whole table: exact mutual-reachability tree and condensed hierarchy, in tables.

1. Equal vectors are one point with a weight.  Unit vectors are reduced to principal components; only the sums and
   products of the columns reach the driver.
2. Core distances and a neighbour graph come from the vector index (exact by its bounds).
3. A spanning tree by Boruvka's rounds: each component takes its shortest edge that leaves it.  An edge of the graph is
   known to be the shortest while it is no longer than the distances up to which the component's points know their
   neighbours; components where that fails ask the index for nearer rows outside, within a bound taken from the lists'
   centres and radii.  So the tree is exact, and lists that lie inside one component are never read.
4. The hierarchy is built from the shortest edges up.  A round takes the shorter half of the edges left; every component
   of these is a group of at most `most` edges (else the half is halved again), and a task merges it and hands on one
   node: its size, its cluster's running sums and, while it is smaller than a cluster, its points.  Edges of equal length
   are one event, so the hierarchy doesn't depend on which of several shortest trees was found.
5. Clusters with the greatest excess of mass are chosen as the nodes close; what is left is the highest chosen cluster
   above each point's own, by jumps that double.

Nothing is collected but counts, the centres and the products of columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import layout
from tidewire.operators import vector_index as VI
from tidewire.operators.density import LEAST, Params, merge_group, safe
from tidewire.operators.storage import components, forget, keep

def axes(unit: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, k principal axes with fixed signs, rows) of unit vectors (vec), by sums of products: d * d numbers reach the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, None, None
        for f in frames:
            if len(f):
                x = VI.matrix(f["vec"])
                n, s, g = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
        if n:
            d = len(s)
            yield pd.DataFrame({"p": np.arange(d * d + d + 1), "v": np.concatenate([g.ravel(), s, [n]])})

    parts = unit.select("vec").mapInPandas(run, "p int, v double").groupBy("p").agg(F.sum("v").alias("v")).orderBy("p").toPandas()["v"].to_numpy()
    if not len(parts):
        return np.zeros(0), np.zeros((0, 0)), 0
    n = int(parts[-1])
    d = int((np.sqrt(4 * len(parts) - 3) - 1) / 2)
    g, mean = parts[: d * d].reshape(d, d), parts[d * d:-1] / n
    values, vectors = np.linalg.eigh(g - n * np.outer(mean, mean))
    found = vectors[:, np.argsort(-values, kind="stable")[: min(k, n - 1, d)]].T
    found = found * np.where(found[np.arange(len(found)), np.abs(found).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return mean, found, n


def reduced(points: DataFrame, k: int) -> DataFrame:
    """id, vec: unit vectors in their principal components."""

    def scaled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = VI.matrix(f["vec"])
                yield pd.DataFrame({"id": f["id"], "vec": list(x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8))})

    unit = keep(points.select("id", "vec").mapInPandas(scaled, "id bigint, vec array<double>"), "unit")
    mean, found, _ = axes(unit, k)

    def turned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"id": f["id"], "vec": list((VI.matrix(f["vec"]) - mean) @ found.T)})

    return unit.mapInPandas(turned, "id bigint, vec array<double>")


def graph(points: DataFrame, index: VI.Index, k: int, samples: int) -> tuple[DataFrame, DataFrame]:
    """(edges a, b, w; cores id, core, known): mutual reachability of k neighbours, each point's core distance and the distance up to which it knows its neighbours.

    points: id, vec, weight.  The core distance is that of the `samples`-th row, itself and equal rows included.
    """
    from pyspark.sql import Window

    near = keep(VI.search(points, index, k).join(points.select("id", "weight"), "id"), "near")
    upto = Window.partitionBy("query_id").orderBy("dist", "id").rowsBetween(Window.unboundedPreceding, 0)
    counted = near.withColumn("_have", F.sum("weight").over(upto))
    cores = counted.groupBy(F.col("query_id").alias("id")).agg(
        F.coalesce(F.min(F.when(F.col("_have") >= samples, F.col("dist"))), F.max("dist")).alias("core"), F.max("dist").alias("known"))
    cores = keep(cores, "cores")
    of = lambda c, name: cores.select(F.col("id").alias(c), F.col("core").alias(name))
    pairs = near.where(F.col("query_id") != F.col("id")).select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), "dist").groupBy("a", "b").agg(F.min("dist").alias("dist"))
    edges = pairs.join(of("a", "_ca"), "a").join(of("b", "_cb"), "b").select("a", "b", F.greatest("dist", "_ca", "_cb").alias("w"))
    return keep(edges, "graph"), cores


def _outside(index: VI.Index, points: DataFrame, upper: DataFrame | None) -> DataFrame:
    """Shortest edges (comp, w, a, b) from points of unsure components to rows of others, by lists.

    points: id, vec, core, comp, list, unsure; upper: comp, w: edges known already.
    """
    c, radii = index.centres, index.radii
    of_list = points.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("core").alias("core")).collect()  # a row a list
    lo, hi, core = np.full(len(c), -1), np.full(len(c), -1), np.zeros(len(c))
    there = np.zeros(len(c), bool)
    for r in of_list:
        lo[r.list], hi[r.list], core[r.list], there[r.list] = r.lo, r.hi, r.core, True
    asking = points.where("unsure").select("id", "vec", "core", "comp")

    def foreign(comp: np.ndarray) -> np.ndarray:
        return there & ~((lo == comp[:, None]) & (hi == comp[:, None]))

    def bounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = [np.zeros(0)]
            for part in VI.slices([f], len(c)):
                d = VI.distances(VI.matrix(part["vec"]), c) + radii
                most = np.maximum(np.maximum(d, core), part["core"].to_numpy()[:, None])
                own.append(np.where(foreign(part["comp"].to_numpy()), most, np.inf).min(axis=1))
            if len(f):
                yield pd.DataFrame({"comp": f["comp"], "u": np.concatenate(own)}).groupby("comp", as_index=False).min()

    rough = asking.mapInPandas(bounds, "comp bigint, u double")
    if upper is not None:
        rough = rough.unionByName(upper.select("comp", F.col("w").alias("u")))
    bound = keep(rough.groupBy("comp").agg((F.min("u") * (1 + 1e-9)).alias("u")), "bound")

    def lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in VI.slices(frames, len(c)):
            low = np.maximum(VI.distances(VI.matrix(f["vec"]), c) - radii, f["core"].to_numpy()[:, None])
            i, j = np.nonzero(foreign(f["comp"].to_numpy()) & (low <= f["u"].to_numpy()[:, None]))
            yield f.iloc[i][["id", "vec", "core", "comp"]].assign(list=j.astype(np.int32))

    asks = asking.join(bound, "comp").mapInPandas(lists, "id bigint, vec array<double>, core double, comp bigint, list int")

    def compare(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        w = np.maximum(np.maximum(VI.distances(VI.matrix(q["vec"]), VI.matrix(b["vec"])), q["core"].to_numpy()[:, None]), b["core"].to_numpy()[None, :])
        w[q["comp"].to_numpy()[:, None] == b["comp"].to_numpy()[None, :]] = np.inf
        x, y = q["id"].to_numpy(), b["id"].to_numpy()
        lo_, hi_ = np.minimum(x[:, None], y), np.maximum(x[:, None], y)
        at = [np.lexsort((hi_[i], lo_[i], w[i]))[0] for i in range(len(q))]
        r = np.arange(len(q))
        out = pd.DataFrame({"comp": q["comp"], "w": w[r, at], "a": lo_[r, at], "b": hi_[r, at]}).sort_values(["comp", "w", "a", "b"])
        return out[np.isfinite(out["w"])].groupby("comp", as_index=False).head(1)

    found = VI.meet(asks, points.select("id", "vec", "core", "comp", "list"), compare, "comp bigint, w double, a bigint, b bigint")
    return found


def spanning_tree(points: DataFrame, index: VI.Index, edges: DataFrame, cores: DataFrame) -> DataFrame:
    """a, b, w of the exact tree of mutual reachability; points: id."""
    comp = keep(points.select("id", F.col("id").alias("comp")), "comp")
    known, tree = keep(index.rows.join(cores, "id"), "known"), None
    while True:
        of = lambda c: comp.select(F.col("id").alias(c), F.col("comp").alias(f"_{c}"))
        leaving = keep(edges.join(of("a"), "a").join(of("b"), "b").where(F.col("_a") != F.col("_b")), "leaving")
        both = leaving.select(F.col("_a").alias("comp"), "w", "a", "b").unionByName(leaving.select(F.col("_b").alias("comp"), "w", "a", "b"))
        first = both.groupBy("comp").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("comp", "e.w", "e.a", "e.b")
        first = keep(first, "first")
        placed = known.join(comp, "id").join(first.select("comp", F.col("w").alias("_w")), "comp", "left")
        placed = keep(placed.withColumn("unsure", F.col("_w").isNull() | (F.greatest("known", "core") < F.col("_w"))).drop("_w"), "placed")
        if placed.where("unsure").isEmpty():
            chosen = first
        else:
            chosen = first.unionByName(_outside(index, placed, first)).groupBy("comp").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("comp", "e.w", "e.a", "e.b")
        new = keep(chosen.select("a", "b", "w").distinct(), "edges")
        forget(placed, first, leaving)
        if new.isEmpty():
            return tree
        tree = new if tree is None else tree.unionByName(new)
        merged = components(new.select("a", "b", "w").join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
        comp, old = keep(comp.join(merged, comp["comp"] == merged["node"], "left").select("id", F.coalesce("label", "comp").alias("comp")), "comp"), comp
        forget(old)
        if comp.select("comp").distinct().limit(2).count() < 2:
            return tree


# ---- the condensed hierarchy ----------------------------------------------------------------------------------------

STATE = "node bigint, size bigint, points array<bigint>, cluster string, n_left bigint, sum_left double, split double, n_split bigint, below double"
OUT = f"kind string, id bigint, cluster string, parent string, birth double, chosen boolean, state struct<{STATE.replace(' bigint', ': bigint').replace(' double', ': double').replace(' string', ': string').replace(' array', ': array')}>"


def _merged(states: DataFrame, edges: DataFrame, group: DataFrame | None, least: int, name: str) -> DataFrame:
    """merge_group() for each group of nodes (node, label); without groups all are one."""
    fields = [x.split(" ", 1)[0] for x in STATE.split(", ")]
    one = F.struct(*fields).alias("state")
    if group is None:
        nodes = states.select(F.lit(0).cast("bigint").alias("g"), one, F.lit(None).cast("struct<a:bigint,b:bigint,w:double>").alias("edge"))
        links = edges.select(F.lit(0).cast("bigint").alias("g"), F.lit(None).cast(nodes.schema["state"].dataType).alias("state"), F.struct("a", "b", "w").alias("edge"))
    else:
        nodes = states.join(group, "node").select(F.col("label").alias("g"), one, F.lit(None).cast("struct<a:bigint,b:bigint,w:double>").alias("edge"))
        links = edges.join(group.withColumnRenamed("node", "a"), "a").select(F.col("label").alias("g"), F.lit(None).cast(nodes.schema["state"].dataType).alias("state"), F.struct("a", "b", "w").alias("edge"))

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        states_ = []
        for s in f["state"].dropna():
            s = dict(s)
            s["points"] = None if s["points"] is None else [int(p) for p in s["points"]]
            s["split"] = None if s["split"] is None or np.isnan(s["split"]) else s["split"]
            states_.append(s)
        homes, closed, left = merge_group(states_, [(e["a"], e["b"], e["w"]) for e in f["edge"].dropna()], least, f"{name}.{key[0]}")
        rows = [("home", p, c, None, None, None, None) for p, c in homes] + [("cluster", None, c, up, birth, bool(x), None) for c, up, birth, x in closed] + [("node", None, None, None, None, None, s) for s in left]
        return pd.DataFrame(rows, columns=["kind", "id", "cluster", "parent", "birth", "chosen", "state"]).astype({"id": "Int64", "birth": "Float64", "chosen": "boolean"})

    return nodes.unionByName(links).groupBy("g").applyInPandas(run, OUT)


def hierarchy(points: DataFrame, tree: DataFrame, least: int, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(homes: id, cluster; clusters: cluster, parent (null: the root), birth, chosen) of points (id, weight) and their tree (a, b, w)."""
    heavy = F.col("weight") >= least
    none = lambda t: F.lit(None).cast(t)
    name = F.when(heavy, F.concat(F.lit("p"), F.col("id").cast("string")))
    states = keep(points.select(
        F.col("id").alias("node"), F.col("weight").cast("bigint").alias("size"), F.when(~heavy, F.array("id")).alias("points"), name.alias("cluster"),
        F.when(heavy, F.col("weight")).otherwise(0).cast("bigint").alias("n_left"), F.when(heavy, F.col("weight") / LEAST).otherwise(0.0).alias("sum_left"),
        none("double").alias("split"), F.lit(0).cast("bigint").alias("n_split"), F.lit(0.0).alias("below")), "states")
    homes = [points.where(heavy).select("id", name.alias("cluster"))]
    clusters, edges, turn, share = [], tree, 0, 0.5
    while True:
        left = edges.count()
        if left <= most:
            group, light = None, edges
        else:
            at = edges.agg(F.percentile_approx("w", share, 10_000)).head()[0]
            light = edges.where(F.col("w") <= at)
            group = components(light.select("a", "b"))
            widest = group.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0]
            if widest > most and share > 1e-4:
                share /= 2
                continue
        turn += 1
        done = keep(_merged(states, light, group, least, str(turn)), "merged")
        homes.append(done.where("kind = 'home'").select("id", "cluster"))
        clusters.append(done.where("kind = 'cluster'").select("cluster", "parent", "birth", "chosen"))
        nodes = done.where("kind = 'node'").select("state.*")
        if group is None:
            clusters.append(nodes.where(F.col("cluster").isNotNull()).select("cluster", none("string").alias("parent"), F.lit(0.0).alias("birth"), F.lit(False).alias("chosen")))
            break
        states = keep(states.join(group, "node", "left_anti").unionByName(nodes), "states")
        rest = edges.where(F.col("w") > at)
        of = lambda c: group.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
        edges = keep(rest.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "w"), "edges")
        share = 0.5
    every = lambda parts: keep(_union(parts), "hierarchy")
    return every(homes), every(clusters)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def above(clusters: DataFrame, highest: bool) -> DataFrame:
    """cluster, found: the highest (or nearest) marked one among a cluster and those above it, by jumps that double; clusters: cluster, parent, mark."""
    now = keep(clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("mark"), F.col("cluster")).alias("found")), "above")
    while not now.where(F.col("up").isNotNull()).isEmpty():
        far = now.select(F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("found").alias("_found"))
        pick = F.coalesce("_found", "found") if highest else F.coalesce("found", "_found")
        now, old = keep(now.join(far, "up", "left").select("cluster", F.col("_up").alias("up"), pick.alias("found")), "above"), now
        forget(old)
    return now.select("cluster", "found")


def chosen_clusters(clusters: DataFrame, epsilon: float) -> DataFrame:
    """cluster, found: the cluster that its points belong to in the end (null: noise)."""
    real = F.col("parent").isNotNull()
    found = above(clusters.withColumn("mark", real & F.col("chosen")), True)
    if epsilon <= 0:
        return found
    # Chosen clusters born beyond epsilon are merged upwards: to the nearest one born at epsilon or more, or below the root.
    taken = found.select(F.col("found").alias("cluster")).where(F.col("cluster").isNotNull()).distinct()
    roots = clusters.where(~real).select(F.col("cluster").alias("parent"), F.lit(True).alias("_root"))
    stops = clusters.join(roots, "parent", "left").withColumn("mark", real & (F.coalesce("_root", F.lit(False)) | (F.col("birth") <= 1 / epsilon)))
    merged = above(stops.select("cluster", "parent", "mark"), False).join(taken, "cluster").select(F.col("found").alias("cluster")).distinct().withColumn("_m", F.lit(True))
    return above(clusters.join(merged, "cluster", "left").select("cluster", "parent", F.coalesce("_m", F.lit(False)).alias("mark")), True)


def cluster_table(rows: DataFrame, p: Params = Params(), neighbors: int = 16, most: int = 100_000, n_lists: int | None = None, layout_turns: int = 0) -> DataFrame:
    """id, cluster for every row (id bigint, vec array): the smallest id of its cluster, -1 for noise.

    layout_turns: turns of the neighbour graph's layout on top of the principal components (0: the components alone).

    Cases: null vectors are left out; up to three rows are one cluster; equal vectors share a cluster; an empty table
    gives an empty table.
    """
    known = rows.where(F.col("vec").isNotNull()).select("id", F.col("vec").cast("array<double>").alias("vec"))
    points = keep(known.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")), "points")
    n = points.agg(F.sum("weight")).head()[0] or 0
    distinct = points.count()
    if n <= 3:
        return known.crossJoin(known.agg(F.min("id").alias("cluster"))).select("id", "cluster")
    _, least, samples = safe(n, p)
    if distinct == 1:
        return known.crossJoin(known.agg(F.min("id").alias("cluster"))).select("id", F.lit(-1).cast("bigint").alias("cluster"))
    flat = reduced(known, p.components)
    if layout_turns:
        ends = points.select("id")  # equal vectors are one row of the graph
        flat = layout.table(keep(known.join(ends, "id"), "vectors"), keep(flat.join(ends, "id"), "flat"), min(p.neighbors, distinct - 1), layout_turns)
    flat = keep(flat.join(points.select("id", "weight"), "id"), "flat")
    index = VI.build(flat, n_lists)
    edges, cores = graph(flat, index, max(samples, min(neighbors, distinct)), samples)
    tree = keep(spanning_tree(flat, index, edges, cores), "tree")
    homes, clusters = hierarchy(flat.select("id", "weight"), tree, least, most)
    final = homes.join(chosen_clusters(clusters, p.epsilon), "cluster", "left").select(F.col("id").alias("_rep"), "found")
    members = known.join(points.select("vec", F.col("id").alias("_rep")), "vec").select("id", "_rep")
    named = keep(members.join(final, "_rep").select("id", "found"), "named")
    smallest = named.where(F.col("found").isNotNull()).groupBy("found").agg(F.min("id").alias("cluster"))
    return named.join(smallest, "found", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
