"""Durable steps of a run, and results that are kept for a time.

A step writes its table once, then a line in the run's journal: run, step, hash of its inputs, path.  A run that is
started again reads the tables of the steps whose inputs are the same and does the others.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.storage import keep
from tidewire.sources.blobs import stored

LINE = "run string, step string, input string, path string, at timestamp"


class Run:
    """Steps of one run under root (a folder that all executors reach)."""

    def __init__(self, spark: SparkSession, root: str, run: str):
        self.spark, self.root, self.run = spark, root.rstrip("/"), run
        self.done: list[str] = []
        self.skipped: list[str] = []

    def journal(self) -> DataFrame:
        path = f"{self.root}/journal"
        if not stored(self.spark, path):
            return self.spark.createDataFrame([], LINE)
        return self.spark.read.schema(LINE).parquet(path).where(F.col("run") == self.run)

    def step(self, name: str, work: Callable[..., DataFrame], *inputs: DataFrame, **given) -> DataFrame:
        """The step's table: that of an earlier try with the same inputs, or work(*inputs, **given), written.

        Inputs are the same if they are tables of the same earlier steps and equal values; other tables are told apart
        by their plans' text, so let them be read by path.  A step that failed between its table and its line is done again.
        """
        told = [getattr(t, "_step_path", None) or t._jdf.queryExecution().analyzed().canonicalized().toString() for t in inputs]
        mark = hashlib.sha256(json.dumps([name, told, given], sort_keys=True, default=str).encode()).hexdigest()
        lines = self.journal().where((F.col("step") == name) & (F.col("input") == mark)).orderBy(F.desc("at")).limit(1).collect()
        if lines:
            self.skipped.append(name)
            out = self.spark.read.parquet(lines[0].path)
            out._step_path = lines[0].path
            return out
        path = f"{self.root}/tables/{self.run}/{name}_{uuid.uuid4().hex}"
        work(*inputs, **given).write.parquet(path)
        line = self.spark.range(1).select(F.lit(self.run).alias("run"), F.lit(name).alias("step"), F.lit(mark).alias("input"), F.lit(path).alias("path"), F.current_timestamp().alias("at"))
        line.write.mode("append").parquet(f"{self.root}/journal")
        self.done.append(name)
        out = self.spark.read.parquet(path)
        out._step_path = path
        return out


# ---- a cache of results ----------------------------------------------------------------------------------------------

def split(requests: DataFrame, cache: DataFrame, now: Column, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(requests with the cached result, requests to be answered, each key once): results past `expires` don't count.

    cache: key, result, expires; of several results of a key the one that stays longest counts.
    """
    fresh = cache.where(F.col("expires") > now).groupBy(key).agg(F.max_by("result", "expires").alias("result"))
    hits = requests.join(fresh, key)
    return hits, requests.join(fresh.select(key), key, "left_anti").dropDuplicates([key])


def renewed(cache: DataFrame, answers: DataFrame, seconds: Column, now: Column, key: str = "cache_key") -> DataFrame:
    """The cache's next snapshot: results that haven't expired and have no new answer, and the answers (key, result)."""
    stays = cache.where(F.col("expires") > now).join(answers.select(key), key, "left_anti").select(key, "result", "expires")
    new = answers.dropDuplicates([key]).select(key, "result", F.timestamp_seconds(F.unix_timestamp(now) + seconds).alias("expires"))
    return keep(stays.unionByName(new), "cache")
