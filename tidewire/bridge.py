"""The logical tables (articles, sources, metrics, reports) as projections of the driver's tables.

The same projections stand as CTE text for the oracle.  "Now" is a literal in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.tables import numbered

NOW = "2024-01-31 00:00:00"
DIM = 64


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def hours_ago(n: int) -> Column:
    return now() - F.expr(f"INTERVAL {n} HOURS")


def text_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def articles(spark: SparkSession, d: str, labels: bool = False, vectors: bool = False) -> DataFrame:
    """Articles; the label and vector tables are joined only where asked for."""
    i = F.col("doc_id")
    k = (i * 7 + F.floor(i / 20)) % 10
    docs = read(spark, d, "documents")
    if labels:
        docs = docs.join(read(spark, d, "labels"), "doc_id", "left")
    if vectors:
        docs = docs.join(read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    published = F.timestamp_seconds(F.lit(1704067200) + (i * 37) % 720 * 3600)
    out = docs.withColumns({"_k": k, "publish_date": published}).withColumn("created_at", F.col("publish_date") + F.expr("INTERVAL 1 HOUR"))
    cols = [
        i.alias("id"), F.substring(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), 1, 60).alias("title"), F.col("text").alias("content"),
        F.col("lang").alias("language"), F.col("source").alias("source_name"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), i.cast("string")).alias("url"),
        F.when(F.col("_k") <= 5, "PROCESSED").when(F.col("_k") == 6, "PENDING_FETCH").when(F.col("_k") == 7, "FETCH_FAILED").when(F.col("_k") == 8, "AI_ANALYSIS_FAILED").otherwise("SKIPPED_TOO_OLD").alias("status"),
        "publish_date", "created_at",
        F.when(F.col("_k") != 6, F.timestamp_seconds(F.unix_timestamp("created_at") + i % 50 * 60)).alias("processed_at"),
        F.when(F.col("_k") == 7, F.concat(F.lit("Fetch failed: code "), (F.lit(400) + i % 5).cast("string"))).when(F.col("_k") == 8, F.concat(F.lit("Analysis failed: model "), (i % 3).cast("string"))).alias("fail_reason"),
        F.when(F.col("_k") <= 5, F.concat_ws("/", F.year("created_at").cast("string"), F.month("created_at").cast("string"), F.dayofmonth("created_at").cast("string"), F.concat(i.cast("string"), F.lit(".txt")))).alias("content_file_key"),
        F.when(i % 10 < 7, "COMPLETE").when(i % 10 < 9, "PARTIAL_USEFUL").otherwise("PARTIAL_USELESS").alias("completeness"),
        F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.substring(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), 1, 60))).alias("event_summary_points"),
        F.array(F.col("lang"), F.col("source")).alias("topic_tags"),
    ]
    if labels:
        cols.append(F.when(F.col("toxic") == 1, "JUNK").when(F.col("quality") == 1, "OK").when(F.col("quality") == 0, "LOW_QUALITY").alias("content_quality"))
    if vectors:
        cols.append(F.col("embedding"))
    return out.select(*cols)


def sources(spark: SparkSession, d: str) -> DataFrame:
    """One row for each source name, numbered by name."""
    s = numbered(read(spark, d, "documents").select(F.col("source").alias("name")).distinct(), "name")
    i = F.col("id")
    return s.select(
        "id", F.concat(F.lit("https://"), "name", F.lit(".example.com/feed")).alias("url"), "name", ((i - 1) % 4 + 1).cast("int").alias("scrape_frequency"),
        (i % 3 == 0).alias("paywall"), F.when(i % 2 == 0, "tech").otherwise("world").alias("category"),
        F.when(i % 7 != 0, F.timestamp_seconds(F.unix_timestamp(now()) - i * 3600)).alias("last_checked"),
        F.when(i % 5 != 0, F.timestamp_seconds(F.lit(1704067200) + i * 60)).alias("do_initialized_at"))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """Workflow step events; any step may start, end or fail."""
    e = read(spark, d, "events")
    return e.select(
        "event_id", F.col("user_id").alias("workflow_id"), F.col("event_type").alias("step_name"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("value") * 1000).alias("duration"),
        F.when(F.col("event_id") % 11 == 0, "failed").when(F.col("event_id") % 3 == 0, "started").otherwise("completed").alias("status"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Briefs, one for each order."""
    o = read(spark, d, "orders")
    i = F.col("o_orderkey")
    return o.select(
        i.alias("id"), F.concat(F.lit("Brief "), i.cast("string")).alias("title"), F.timestamp_seconds(F.lit(1704067200) + i * 7 * 3600).alias("created_at"),
        (i % 40).cast("int").alias("total_articles"), (i % 17).cast("int").alias("used_articles"), (i % 9).cast("int").alias("total_sources"),
        F.when(i % 4 != 0, F.concat(F.lit("model-"), (i % 3).cast("string"))).alias("model_author"),
        F.when(i % 3 == 0, F.to_json(F.struct(F.concat(F.lit("wf"), i.cast("string")).alias("workflowId")))).when(i % 3 == 1, F.to_json(F.struct(F.lit("hybrid").alias("strategy"), ((i % 10) / 10).alias("min_quality")))).alias("clustering_params"))


# ---- the same as CTE text -------------------------------------------------------------------------------------------

ARTICLES = """articles AS (SELECT *, CASE WHEN k <= 5 THEN year(created_at)::VARCHAR || '/' || month(created_at)::VARCHAR || '/' || day(created_at)::VARCHAR || '/' || id::VARCHAR || '.txt' END AS content_file_key,
 CASE WHEN k <> 6 THEN created_at + to_minutes((id % 50)::INTEGER) END AS processed_at FROM (SELECT *, publish_date + INTERVAL 1 HOUR AS created_at FROM (
 SELECT d.doc_id AS id, substr(split_part(d.text, chr(10), 1), 1, 60) AS title, d.text AS content, d.lang AS language, d.source AS source_name,
 'https://' || d.source || '.example.com/' || d.doc_id::VARCHAR AS url, (d.doc_id * 7 + d.doc_id // 20) % 10 AS k,
 CASE WHEN (d.doc_id * 7 + d.doc_id // 20) % 10 <= 5 THEN 'PROCESSED' WHEN (d.doc_id * 7 + d.doc_id // 20) % 10 = 6 THEN 'PENDING_FETCH' WHEN (d.doc_id * 7 + d.doc_id // 20) % 10 = 7 THEN 'FETCH_FAILED'
  WHEN (d.doc_id * 7 + d.doc_id // 20) % 10 = 8 THEN 'AI_ANALYSIS_FAILED' ELSE 'SKIPPED_TOO_OLD' END AS status,
 TIMESTAMP '2024-01-01' + to_hours(((d.doc_id * 37) % 720)::INTEGER) AS publish_date,
 CASE (d.doc_id * 7 + d.doc_id // 20) % 10 WHEN 7 THEN 'Fetch failed: code ' || (400 + d.doc_id % 5)::VARCHAR WHEN 8 THEN 'Analysis failed: model ' || (d.doc_id % 3)::VARCHAR END AS fail_reason,
 CASE WHEN d.doc_id % 10 < 7 THEN 'COMPLETE' WHEN d.doc_id % 10 < 9 THEN 'PARTIAL_USEFUL' ELSE 'PARTIAL_USELESS' END AS completeness,
 CASE WHEN d.doc_id % 5 = 0 THEN [] ELSE [substr(split_part(d.text, chr(10), 1), 1, 60)] END AS event_summary_points, [d.lang, d.source] AS topic_tags,
 CASE WHEN l.toxic = 1 THEN 'JUNK' WHEN l.quality = 1 THEN 'OK' WHEN l.quality = 0 THEN 'LOW_QUALITY' END AS content_quality, e.embedding
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id)))"""
SOURCES = f"""sources AS (SELECT id, 'https://' || name || '.example.com/feed' AS url, name, ((id - 1) % 4 + 1)::INTEGER AS scrape_frequency, id % 3 = 0 AS paywall,
 CASE WHEN id % 2 = 0 THEN 'tech' ELSE 'world' END AS category, CASE WHEN id % 7 <> 0 THEN TIMESTAMP '{NOW}' - to_hours(id::INTEGER) END AS last_checked,
 CASE WHEN id % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(id::INTEGER) END AS do_initialized_at
 FROM (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT source AS name FROM documents)))"""
METRICS = """metrics AS (SELECT event_id, user_id AS workflow_id, event_type AS step_name, ts, value * 1000 AS duration,
 CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 3 = 0 THEN 'started' ELSE 'completed' END AS status, (props->>'$.k')::BIGINT AS k FROM events)"""
REPORTS = """reports AS (SELECT o_orderkey AS id, 'Brief ' || o_orderkey::VARCHAR AS title, TIMESTAMP '2024-01-01' + to_hours((o_orderkey * 7)::INTEGER) AS created_at, (o_orderkey % 40)::INTEGER AS total_articles,
 (o_orderkey % 17)::INTEGER AS used_articles, (o_orderkey % 9)::INTEGER AS total_sources, CASE WHEN o_orderkey % 4 <> 0 THEN 'model-' || (o_orderkey % 3)::VARCHAR END AS model_author, o_orderkey % 3 AS m FROM orders)"""
T = f"TIMESTAMP '{NOW}'"
