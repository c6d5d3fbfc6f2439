"""Blobs under keys: article texts by day, JSON metrics, listings by prefix.

Keys are paths below a root that all executors reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.storage import keep

SEED = {"id": 1, "name": "Hacker news", "url": "https://news.ycombinator.com/rss", "scrape_frequency": 1, "category": "news", "paywall": False}


def put_texts(articles: DataFrame, root: str, ts: str = "created_at", id_col: str = "id", text: str = "content") -> None:
    """Article texts as Parquet under their keys: year, month and day of `ts`, and the id.

    A text replaces the one stored under its key, all others of its day stay; of rows with one key the last by time
    (then by text) counts.  The touched days are written beside the store and then swapped in, so a batch that is run
    again changes nothing.  Rows without an id or a time have no key and are refused.
    """
    spark, day = articles.sparkSession, ["y", "m", "d"]
    rows = articles.select(F.col(id_col).alias("id"), F.col(text).alias("content"), F.col(ts).alias("_ts"))
    if not rows.where(F.col("id").isNull() | F.col("_ts").isNull()).isEmpty():
        raise ValueError("a text without an id or a time has no key")
    rows = rows.select("*", F.year("_ts").alias("y"), F.month("_ts").alias("m"), F.dayofmonth("_ts").alias("d"))
    new = keep(rows.groupBy("id", *day).agg(F.max(F.struct("_ts", F.coalesce("content", F.lit("")).alias("_c"), "content")).alias("_b")).select("id", F.col("_b.content").alias("content"), *day), "texts")
    if stored(spark, root):
        kind = new.schema["id"].dataType.simpleString()
        old = spark.read.schema(f"id {kind}, content string, y int, m int, d int").parquet(root)
        touched = new.select(*day).distinct()
        new = keep(old.join(touched, day, "left_semi").join(new.select("id", *day), ["id", *day], "left_anti").select("id", "content", *day).unionByName(new), "texts")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*day).parquet(root)


def stored(spark: SparkSession, root: str) -> bool:
    """Whether there is anything under root."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def get_text(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The one blob under a key year/month/day/id.txt: only that day's files are read."""
    y, m, d, name = key.split("/")
    rows = spark.read.parquet(root)
    return rows.where((F.col("y") == int(y)) & (F.col("m") == int(m)) & (F.col("d") == int(d)) & (F.col("id").cast("string") == name.removesuffix(".txt"))).select("id", "content")


def append_new(rows: DataFrame, root: str, key: str = "id") -> DataFrame:
    """Append the rows whose key isn't stored yet (the first of each key), and return them: a batch run again appends nothing."""
    spark = rows.sparkSession
    first = rows.dropDuplicates([key])
    new = keep(first.join(spark.read.parquet(root).select(key), key, "left_anti") if stored(spark, root) else first, "new")
    new.write.mode("append").parquet(root)
    return new


def put_metrics(rows: DataFrame, root: str, key: str) -> None:
    """A run's metrics as JSON lines under root/key: summary and details."""
    rows.write.mode("overwrite").json(f"{root}/{key}")


def listing(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """path, size and time of upload of every blob whose key begins with prefix; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    key = F.substring_index("path", root.rstrip("/") + "/", -1)
    return files.select(key.alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("uploaded")).where(F.col("key").startswith(prefix))


def newest(spark: SparkSession, root: str, prefix: str = "", most: int = 50) -> DataFrame:
    """The `most` newest blobs, ties by key."""
    return listing(spark, root, prefix).orderBy(F.desc("uploaded"), "key").limit(most)


def json_fixture(spark: SparkSession, path: str, schema: str, field: str = "articles") -> DataFrame:
    """The records of JSON files, each an array or an object with the array in `field`; _error tells of files and records that can't be read."""
    one = F.from_json(F.col("r"), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    listed = F.coalesce(F.expr(f"try_variant_get(v, '$.{field}', 'array<variant>')"), F.expr("try_variant_get(v, '$', 'array<variant>')"))
    rows = raw.select(F.explode_outer(listed).alias("x")).select(F.to_json("x").alias("r"))
    read = rows.select("r", one.alias("o"))
    error = F.when(F.col("r").isNull(), "no records").when(F.col("o._bad").isNotNull() | F.col("o").isNull() | ~F.startswith("r", F.lit("{")), F.concat(F.lit("broken record: "), F.substring("r", 1, 100)))
    return read.select("o.*", error.alias("_error")).drop("_bad")


def seed(spark: SparkSession) -> DataFrame:
    """The row that a new sources table starts with."""
    return spark.createDataFrame([SEED], "id bigint, name string, url string, scrape_frequency int, category string, paywall boolean")
