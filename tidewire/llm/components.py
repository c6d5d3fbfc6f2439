"""Connected components of an edge table, kept in tables throughout.

Every node takes the smallest label among itself and its neighbours, then the label of its label, until nothing
changes.  Minima combine on the map side, and the joins carry no aggregate on their key, so adaptive execution may
split a hub that a third of all edges meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import forget, keep


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node reachable; and old, the same.

    Cases: nodes without edges aren't listed; repeated edges, either way round, count once; an edge from a node to
    itself lists it; edges with a null end are left out; an empty table gives an empty table.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = keep(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "edges")
    labels = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label"))
    labels = keep(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), F.col("label").alias("l")), "y").groupBy("x").agg(F.min("l").alias("l"))
        best = labels.join(near, F.col("node") == F.col("x")).select("node", F.col("label").alias("old"), F.least("label", "l").alias("mid"))
        of_label = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = keep(best.join(of_label, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")), "labels")
        forget(labels)
        labels = new
        if new.where(F.col("old") != F.col("label")).isEmpty():
            forget(both)
            return new
