"""Snapshot forms of the row-level writes: every change is a projection or a join that yields the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAILED = ["FETCH_FAILED", "RENDER_FAILED", "AI_ANALYSIS_FAILED", "EMBEDDING_FAILED", "R2_UPLOAD_FAILED"]


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of incoming that are inserted: the first of each key in `order` that existing doesn't have."""
    first = incoming.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") == 1).drop("_r")
    return first.join(existing.select(key), key, "left_anti")


def reset_failed(articles: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Snapshot after a bulk retry: listed rows are pending again, without reason or processing time."""
    hit = F.col("_hit").isNotNull()
    marked = articles.join(ids.select(id_col).distinct().withColumn("_hit", F.lit(1)), id_col, "left")
    return marked.withColumns({
        "status": F.when(hit, F.lit("PENDING_FETCH")).otherwise(F.col("status")),
        "fail_reason": F.when(~hit, F.col("fail_reason")), "processed_at": F.when(~hit, F.col("processed_at")),
    }).drop("_hit")


def cascade_delete(sources: DataFrame, articles: DataFrame, gone: DataFrame, source_key: str = "name", article_key: str = "source_name") -> tuple[DataFrame, DataFrame]:
    """Snapshots of both tables without the listed sources and their articles."""
    keys = gone.select(source_key)
    return sources.join(keys, source_key, "left_anti"), articles.join(keys.withColumnRenamed(source_key, article_key), article_key, "left_anti")


def next_status(pdf: Column, fetched: Column, analysed: Column, embedded: Column, stored: Column) -> Column:
    """The status chain of one processing pass; each argument is a boolean outcome, null where the step didn't run."""
    return (F.when(pdf, "SKIPPED_PDF").when(fetched.isNull(), "PENDING_FETCH").when(~fetched, "FETCH_FAILED").when(analysed.isNull(), "CONTENT_FETCHED").when(~analysed, "AI_ANALYSIS_FAILED")
            .when(~embedded, "EMBEDDING_FAILED").when(~stored, "R2_UPLOAD_FAILED").otherwise("PROCESSED"))


def numbered(keys: DataFrame, key: str, out: str = "id", parts: int = 256) -> DataFrame:
    """Distinct keys with their place (1, 2, ...) in ascending order, null first.

    Keys are numbered inside `parts` ranges, whose limits are the keys of smallest hash: a sample that every run draws alike,
    one row of fewer than `parts` keys.  Each range holds about the same number of keys, however alike their beginnings are.
    """
    limits = keys.where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(parts - 1).agg(F.sort_array(F.collect_list(key)).alias("_limits"))
    placed = keys.crossJoin(F.broadcast(limits)).withColumn("_g", F.size(F.filter("_limits", lambda x: x <= F.col(key)))).drop("_limits")
    counted = placed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    before = counted.select("_g", (F.sum("_n").over(Window.orderBy("_g")) - F.col("_n")).alias("_off"))  # at most `parts` rows
    own = F.row_number().over(Window.partitionBy("_g").orderBy(key))
    return placed.withColumn("_r", own).join(F.broadcast(before), "_g").withColumn(out, (F.col("_off") + F.col("_r")).cast("bigint")).drop("_g", "_r", "_off")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, spread: str, parts: int = 16) -> DataFrame:
    """rows joined to the one row of their group; a group's rows are dealt to `parts` tasks by the hash of `spread`.

    For keys of few values, one of which may hold a third of the rows; the groups' rows are repeated `parts` times.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(parts)))
    return dealt.join(groups.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))), [key, "_part"]).drop("_part")


def batches(ids: DataFrame, id_col: str = "id", size: int = 100) -> DataFrame:
    """Queue messages of at most `size` ids in order.

    Ids are numbered inside ranges of equal width first, ranges inside groups of 4,096: no window holds the table, and the
    one over all groups has a row for every 26 million ids.
    """
    wide = F.floor(F.col(id_col) / (size * 64))
    counted = ids.groupBy(wide.alias("_g")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.floor(F.col("_g") / 4096))
    running = lambda part, order: F.sum("_n").over(part.orderBy(order)) - F.col("_n")
    above = counted.groupBy("_h").agg(F.sum("_n").alias("_n")).select("_h", running(Window, "_h").alias("_base"))
    offsets = counted.withColumn("_own", running(Window.partitionBy("_h"), "_g")).join(above, "_h").select("_g", (F.col("_base") + F.col("_own")).alias("_off"))
    numbers = ids.withColumn("_g", wide).withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(id_col)))
    placed = numbers.join(offsets, "_g").withColumn("batch", F.floor((F.col("_off") + F.col("_r") - 1) / size).cast("bigint"))
    return placed.groupBy("batch").agg(F.sort_array(F.collect_list(id_col)).alias("ids"))
