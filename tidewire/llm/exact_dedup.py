"""Exact duplicates by 128-bit content hash, with the bytes compared inside each group.

One aggregation per hash carries the smallest and the largest text of the group: they are equal exactly when all
texts of the group are.  Map-side combining folds a group of any size to one row per map task, so a group holding a
third of all rows costs one task no more than another.  Groups in which the two differ (hash collisions) are split
by the text itself.

Cases: a null text counts as empty; null ids are kept as rows and never stay unless all ids of the group are null;
rows that repeat an id with the same text count each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import keep as store


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stays: str = "min", hash_of=None) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.  stays: "min" or "max" id of a group."""
    pick = {"min": F.min, "max": F.max}[stays]
    hash_of = hash_of or (lambda c: F.unhex(F.md5(c)))
    base = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("_h", hash_of(F.col("_t")))
    groups = store(
        base.groupBy("_h").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), pick("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        .select("_h", "_keep", "_n", (F.col("_lo") != F.col("_hi")).alias("_mixed")),
        "hash_groups",
    )
    rows = base.withColumn("_sha", F.sha2("_t", 256))
    out = rows.drop("_t").join(groups.where(~F.col("_mixed")).drop("_mixed"), "_h")
    mixed = groups.where("_mixed").select("_h")
    if not mixed.isEmpty():
        inside = rows.join(mixed, "_h", "left_semi")
        own = inside.groupBy("_h", "_t").agg(pick("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        out = out.unionByName(inside.join(own, ["_h", "_t"]).drop("_t"))
    return out.select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"),
    )
