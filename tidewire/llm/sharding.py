"""Rendezvous (highest random weight) sharding of stable record keys over weighted shards.

Each shard draws a hash of (key, shard); the largest draw wins, or with weights the largest weight / -ln(u).  A new
shard can only win rows for itself, and a removed shard only gives up its own.

Slots number the rows of a shard without gaps.  They are not one window per shard: rows are numbered inside 256
sub-buckets of the key's hash, and the sub-buckets' counts (at most shards x 256 rows, broadcast) give the offsets.

Cases: a null key hashes as the word "null"; a null text has no bytes and checksum 0; equal keys go to the same
shard and get different slots; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUB_HEX = 2  # hex digits of the sub-bucket: 16 ** 2 of them


def _draw(key: Column, shard: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, 15), 16, 10).cast("bigint")


def winner(key: Column, n_shards: int, weights: list[float] | None = None) -> Column:
    """Shard of a key, in 0..n_shards-1.  Ties go to the smallest shard."""
    every = F.sequence(F.lit(0), F.lit(n_shards - 1))
    if weights is None:
        best = F.array_max(F.transform(every, lambda s: F.struct(_draw(key, s).alias("h"), (-s).alias("s"))))
    else:
        if len(weights) != n_shards or min(weights) < 0:
            raise ValueError("one weight of 0 or more for each shard")
        w = F.array(*[F.lit(float(x)) for x in weights])
        unit = lambda s: (_draw(key, s).cast("double") + 0.5) / F.lit(float(16**15))
        best = F.array_max(F.transform(every, lambda s: F.struct((F.get(w, s) / -F.ln(unit(s))).alias("h"), (-s).alias("s"))))
    return (-best["s"]).cast("int")


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 40, weights: list[float] | None = None, overhead: int = 16) -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot, grown_shard (the shard among n_shards + 1; null with weights)."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = df.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + F.lit(overhead)).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col(text_col)), F.lit(0)).cast("bigint").alias("text_crc32"),
        winner(key, n_shards, weights).alias("shard"),
        (winner(key, n_shards + 1) if weights is None else F.lit(None).cast("int")).alias("grown_shard"),
        F.substring(F.md5(key), 1, SUB_HEX).alias("_sub"),
    )
    counts = rows.groupBy("shard", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_sub")
    offsets = counts.select("shard", "_sub", (F.sum("_n").over(before) - F.col("_n")).alias("_off"))
    numbered = rows.withColumn("_r", F.row_number().over(Window.partitionBy("shard", "_sub").orderBy("_id", "text_crc32")))
    return numbered.join(F.broadcast(offsets), ["shard", "_sub"]).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_off") + F.col("_r") - 1).cast("bigint").alias("slot"), "grown_shard",
    )
