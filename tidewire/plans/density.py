"""Density clustering, embeddings of text and reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidewire.bridge import ARTICLES, articles, read
from tidewire.functions import vector as V
from tidewire.operators import density, density_table, models, providers, tables
from tidewire.operators.ladder import SERVICE, Step, ladder
from tidewire.plans.registry import query

c = F.col


def _vectors(spark, d):
    """Vectors by ranges of 500 ids, which stand for time buckets: a group's size doesn't grow with the table."""
    return read(spark, d, "embeddings").select(F.expr("vec_id div 500").alias("bucket"), c("vec_id").alias("id"), c("embedding").alias("vec"))


@query()
def density_clusters(spark, d):
    """All vectors in one clustering: each one's cluster (its smallest id), -1 for noise."""
    return density_table.cluster_table(read(spark, d, "embeddings").select(c("vec_id").alias("id"), c("embedding").alias("vec")))


@query()
def density_grid(spark, d):
    return density.grid_search(_vectors(spark, d), "bucket")


@query("""SELECT label, count(*) AS n, least(15, greatest(3, count(*) // 3)) AS neighbors, least(10, greatest(2, count(*) // 5)) AS components, greatest(2, count(*) // 10) AS min_cluster, 1 AS min_samples, 0.1::DOUBLE AS min_dist, 0.5::DOUBLE AS epsilon FROM embeddings GROUP BY label""")
def adaptive_params(spark, d):
    g = read(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    part = lambda k: F.expr(f"n div {k}")
    return g.select("label", "n", F.least(F.lit(15), F.greatest(F.lit(3), part(3))).alias("neighbors"), F.least(F.lit(10), F.greatest(F.lit(2), part(5))).alias("components"),
                    F.greatest(F.lit(2), part(10)).alias("min_cluster"), F.lit(1).alias("min_samples"), F.lit(0.1).alias("min_dist"), F.lit(0.5).alias("epsilon"))


@query(r"SELECT doc_id, 384 AS dim, CASE WHEN regexp_matches(coalesce(text, ''), '\S') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents")
def hashed_embeddings(spark, d):
    e = providers.embed(read(spark, d, "documents").select("doc_id", "text"))
    return e.select("doc_id", F.size("embedding").alias("dim"), F.round(V.norm(c("embedding")), 4).alias("norm"))


@query("""WITH q AS (SELECT label, min(vec_id) AS query_id, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label), s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]) AS score FROM q JOIN embeddings e ON e.label = q.label AND vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 4) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 3""")
def rerank(spark, d):
    """The three contexts of each label nearest to its first vector; each map task keeps three, so little is shuffled."""
    e = read(spark, d, "embeddings")
    q = e.groupBy("label").agg(F.min("vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("v"))
    s = tables.join_groups(e, q, "label", "vec_id").where(c("vec_id") != c("query_id")).select("query_id", c("vec_id").alias("id"), V.cosine(c("v"), c("embedding")).alias("score"))
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(c("rank") <= 3).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS word FROM documents), h AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT AS h FROM w),
p AS (SELECT doc_id, h % 384 AS place, sum(1 - 2 * (h // 384 % 2)) AS v FROM h GROUP BY ALL), u AS (SELECT doc_id, place, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 4) AS v FROM p WHERE v <> 0),
b AS (SELECT doc_id, count(*) FILTER (v <> 0) AS places, max(abs(v)) AS top, arg_min(place, (-abs(v), place)) AS place FROM u GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text <> '' THEN 384 END AS dimensions, CASE WHEN text <> '' THEN coalesce(places, 0) END AS places, CASE WHEN text <> '' THEN coalesce(top, 0.0) END AS top, place::INTEGER AS place,
CASE WHEN coalesce(text, '') = '' THEN 'text is required (string or array)' END AS error FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id""")
def served_embeddings(spark, d):
    """Vectors of whole texts, pooled by windows of 512 words: the numbers that aren't zero, the largest and its place."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    e = ladder(docs, models.embedding(), [Step("hashed", models.Embedder(), SERVICE)]).select("doc_id", "answer.error", "answer.value.dimensions", F.get("answer.value.embeddings", 0).alias("_v"))
    far = e.withColumn("_v", F.transform("_v", lambda x: F.round(F.abs(x), 4))).withColumn("top", F.array_max("_v"))
    return far.select("doc_id", "dimensions", F.size(F.filter("_v", lambda x: x != 0)).alias("places"), "top", F.when(c("top") > 0, F.array_position("_v", c("top")) - 1).cast("int").alias("place"), "error")


@query(f"""WITH {ARTICLES}, v AS (SELECT *, embedding IS NOT NULL AS has, content IS NOT NULL AS whole FROM articles), k AS (SELECT 'documents' AS records, CASE WHEN text IS NULL THEN 'unknown' ELSE 'text_item' END AS kind FROM documents
UNION ALL SELECT 'vectors', 'embedding_item' FROM embeddings UNION ALL SELECT 'labelled', 'extended_item' FROM embeddings
UNION ALL SELECT 'articles', CASE WHEN has AND whole AND url IS NOT NULL THEN 'article_item' WHEN has THEN 'extended_item' ELSE 'unknown' END FROM v
UNION ALL SELECT 'texts', CASE WHEN has AND whole THEN 'vector_item' WHEN whole THEN 'text_item' ELSE 'unknown' END FROM v) SELECT records, kind, count(*) AS n FROM k GROUP BY ALL""")
def item_formats(spark, d):
    """How many records of each table, written as JSON (a null is left out), are of each accepted format."""
    a, e = articles(spark, d, vectors=True), read(spark, d, "embeddings")
    records = {
        "documents": read(spark, d, "documents").select(c("doc_id").alias("id"), "text", "lang"), "vectors": e.select(c("vec_id").alias("id"), "embedding"), "labelled": e.select(c("vec_id").alias("id"), "embedding", "label"),
        "articles": a.select("id", "title", "content", "url", "embedding", c("publish_date").alias("publishDate"), "status", "created_at"), "texts": a.select(c("content").alias("text"), "embedding")}
    kinds = [t.select(F.lit(name).alias("records"), providers.record_format(F.to_json(F.struct("*"))).alias("kind")) for name, t in records.items()]
    return reduce(lambda x, y: x.unionByName(y), kinds).groupBy("records", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id::VARCHAR AS id, len(embedding) AS dim, label::VARCHAR AS label FROM embeddings")
def normalized_vectors(spark, d):
    items = providers.normalized_items(read(spark, d, "embeddings").withColumnRenamed("vec_id", "id"))
    return items.select("id", F.size("embedding").alias("dim"), c("metadata")["label"].alias("label"))
