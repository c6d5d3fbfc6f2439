"""Tables written once to the folder that driver and executors share, so that loops don't grow their plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a new folder where that is unset and the master is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tidewire_"))


def keep(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def forget(*tables: DataFrame) -> None:
    """Delete what keep() wrote for these tables; nothing may read them afterwards."""
    for t in tables:
        if path := getattr(t, "_kept_at", None):
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of an edge table (a, b): the smallest node reachable.  Minima over neighbours, then labels of labels, until none changes."""
    both = keep(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "links")
    labels = keep(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), F.col("label").alias("l")), "y").groupBy("x").agg(F.min("l").alias("l"))
        low = labels.join(near, F.col("node") == F.col("x")).select("node", F.col("label").alias("old"), F.least("label", "l").alias("mid"))
        new = keep(low.join(labels.select(F.col("node").alias("mid"), F.col("label").alias("far")), "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")), "labels")
        forget(labels)
        labels = new
        if new.where(F.col("old") != F.col("label")).isEmpty():
            forget(both)
            return new.select("node", "label")
