"""Vectors, clusters and stories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.bridge import ARTICLES, articles, read
from tidewire.functions import vector as V
from tidewire.operators import tables, vector_index
from tidewire.plans.registry import query

c = F.col


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, round(embedding[1]::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-8), 4) AS first FROM embeddings""")
def l2_normalize(spark, d):
    e = read(spark, d, "embeddings")
    return e.select("vec_id", F.round(V.norm(c("embedding")), 4).alias("norm"), F.round(F.get(V.normalized(c("embedding")), 0), 4).alias("first"))


def directions(spark, d):
    """id and unit vector; vectors of length zero have no direction and are no one's neighbours."""
    e = read(spark, d, "embeddings").select(c("vec_id").alias("id"), V.normalized(c("embedding"), 0.0).alias("vec"), V.norm(c("embedding")).alias("_n"))
    return e.where(c("_n") > 0).select("id", "vec")


def by_cosine(found, k: int):
    """Neighbours other than the query itself; on unit vectors the cosine follows from the distance."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    near = found.where(c("query_id") != c("id")).select("query_id", "id", (1 - c("dist") * c("dist") / 2).alias("score"))
    return near.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]) AS score FROM q, embeddings WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 4) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def cosine_topk(spark, d):
    """Exact: lists that the index's bounds rule out aren't read, the others meet their queries in blocks of tasks."""
    e = directions(spark, d)
    found = vector_index.search(e.where(c("id") % 100 == 0), vector_index.build(e), 6)
    return by_cosine(found, 5).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


@query()
def indexed_topk(spark, d):
    """The same from as few of the lists as a measured recall of 0.9 takes; recall and probes are alike in all rows."""
    e = directions(spark, d)
    found, recall, probes = vector_index.tuned(e.where(c("id") % 100 == 0), vector_index.build(e), 6)
    return by_cosine(found, 5).select("query_id", "id", F.round("score", 4).alias("score"), "rank", F.lit(round(recall, 4)).alias("recall"), F.lit(probes).alias("probes"))


@query("""SELECT a.label, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS mean_cosine, count(*) AS pairs FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def intra_label_cosine(spark, d):
    """Mean pairwise cosine inside each label, from the sum of unit vectors: (|sum|^2 - n) / (n (n - 1)); no pair is made."""
    e = read(spark, d, "embeddings").select("label", F.posexplode(V.normalized(c("embedding"), 0.0)).alias("p", "x"))
    s = e.groupBy("label", "p").agg(F.sum("x").alias("s"), F.sum(c("x") * c("x")).alias("own"), F.count(F.lit(1)).alias("n"))
    t = s.groupBy("label").agg(F.sum(c("s") * c("s")).alias("all"), F.sum("own").alias("own"), F.max("n").alias("n")).where(c("n") > 1)
    return t.select("label", F.round((c("all") - c("own")) / (c("n") * (c("n") - 1)), 6).alias("mean_cosine"), F.expr("n * (n - 1) div 2").alias("pairs"))


@query("""SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'DIMENSION' END AS error FROM embeddings""")
def vector_validity(spark, d):
    return read(spark, d, "embeddings").select("vec_id", V.error(c("embedding"), 64).alias("error"))


@query(f"""WITH {ARTICLES} SELECT (SELECT count(*) FROM articles) AS n_articles, (SELECT count(DISTINCT vec_id) FROM embeddings) AS n_embeddings, (SELECT count(*) FROM articles WHERE embedding IS NULL) AS missing, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS unknown""")
def dataset_join_check(spark, d):
    a, e = articles(spark, d).select("id", F.lit(1).alias("x")), read(spark, d, "embeddings").select(c("vec_id").alias("id"), F.lit(1).alias("y"))
    return a.join(e, "id", "full_outer").agg(F.count("x").alias("n_articles"), F.count("y").alias("n_embeddings"), F.count_if(c("y").isNull()).alias("missing"), F.count_if(c("x").isNull()).alias("unknown"))


def clusters(spark, d):
    """The label as given cluster id; label 9 plays the noise."""
    return read(spark, d, "embeddings").select(c("vec_id").alias("id"), F.when(c("label") == 9, -1).otherwise(c("label")).alias("cluster"), "embedding")


CL = "cl AS (SELECT vec_id AS id, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster, embedding FROM embeddings)"


@query(f"""WITH {CL} SELECT count(DISTINCT cluster) FILTER (WHERE cluster >= 0) AS n_clusters, count(*) FILTER (WHERE cluster < 0) AS n_outliers, round(count(*) FILTER (WHERE cluster < 0) * 1.0 / count(*), 4)::DOUBLE AS outlier_ratio FROM cl""")
def cluster_stats(spark, d):
    out = F.count_if(c("cluster") < 0)
    return clusters(spark, d).agg(F.count_distinct(F.when(c("cluster") >= 0, c("cluster"))).alias("n_clusters"), out.alias("n_outliers"), F.round(F.try_divide(out, F.count(F.lit(1))), 4).alias("outlier_ratio"))


@query(f"WITH {CL} SELECT cluster, count(*) OVER (PARTITION BY cluster) AS size, id FROM cl")
def cluster_members(spark, d):
    """A row for each member, clusters by size with the noise last: no list of a cluster's members in one row."""
    every = clusters(spark, d).select("cluster", "id")
    sized = tables.join_groups(every, every.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster", "id")
    return sized.select("cluster", "size", "id").orderBy(c("cluster") == -1, F.desc("size"), "cluster", "id")


@query(f"""WITH {CL}, x AS (SELECT cluster, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM cl) SELECT cluster, (p - 1)::INTEGER AS dim, round(avg(v::DOUBLE), 5) AS mean FROM x GROUP BY cluster, p""")
def cluster_centroids(spark, d):
    return clusters(spark, d).select("cluster", F.posexplode("embedding").alias("dim", "v")).groupBy("cluster", "dim").agg(F.round(F.avg(c("v").cast("double")), 5).alias("mean"))


@query(f"""WITH {CL}, r AS (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY id) AS r FROM cl) SELECT cluster, id, r::INTEGER AS rank FROM r WHERE r <= 5""")
def cluster_representatives(spark, d):
    w = Window.partitionBy("cluster").orderBy("id")
    return clusters(spark, d).select("cluster", "id", F.row_number().over(w).alias("rank")).where(c("rank") <= 5)


@query(f"""WITH {CL}, x AS (SELECT cluster, d.source AS cat, count(*) AS n FROM cl JOIN documents d ON d.doc_id = cl.id WHERE cluster >= 0 GROUP BY ALL), p AS (SELECT cluster, max(n) * 1.0 / sum(n) AS purity, sum(n) AS size FROM x GROUP BY cluster)
SELECT cluster, round(purity, 4)::DOUBLE AS purity, CASE WHEN purity >= 0.8 THEN 'high' WHEN purity >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM p WHERE size >= 2""")
def cluster_purity(spark, d):
    docs = read(spark, d, "documents").select(c("doc_id").alias("id"), c("source").alias("cat"))
    x = clusters(spark, d).where(c("cluster") >= 0).select("id", "cluster").join(docs, "id").groupBy("cluster", "cat").agg(F.count(F.lit(1)).alias("n"))
    p = x.groupBy("cluster").agg((F.max("n") / F.sum("n")).alias("p"), F.sum("n").alias("size")).where(c("size") >= 2)
    return p.select("cluster", F.round("p", 4).alias("purity"), F.when(c("p") >= 0.8, "high").when(c("p") >= 0.6, "medium").otherwise("low").alias("band"))


@query(f"""WITH {CL}, s AS (SELECT cluster, count(*) AS n FROM cl WHERE cluster >= 0 GROUP BY 1) SELECT round((SELECT sum(n) FROM s) * 1.0 / (SELECT count(*) FROM cl), 4)::DOUBLE AS coverage, round(max(n) * 1.0 / min(n), 4)::DOUBLE AS balance FROM s""")
def cluster_coverage(spark, d):
    s = clusters(spark, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    real = F.when(c("cluster") >= 0, c("n"))
    return s.agg(F.round(F.sum(real) / F.sum("n"), 4).alias("coverage"), F.round(F.max(real) / F.min(real), 4).alias("balance"))


@query(f"""WITH {CL}, u AS (SELECT cluster, id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM cl), m AS (SELECT cluster, p, sum(v / nullif(norm, 0)) AS s FROM u GROUP BY ALL),
n AS (SELECT cluster, count(*) AS n FROM cl GROUP BY 1), s AS (SELECT m.cluster, any_value(n.n) AS n, (sum(s * s) - any_value(n.n)) / (any_value(n.n) * (any_value(n.n) - 1.0)) AS coherence FROM m JOIN n USING (cluster) GROUP BY m.cluster)
SELECT count(*) AS clusters, round(avg(n), 4) AS avg_size, min(n) AS min_size, max(n) AS max_size, round(avg(coherence), 4)::DOUBLE AS avg_coherence, count(*) FILTER (WHERE n = 1) AS singletons, count(*) FILTER (WHERE n >= 5) AS large,
count(*) FILTER (WHERE coherence >= 0.7) AS high, count(*) FILTER (WHERE coherence >= 0.4 AND coherence < 0.7) AS medium, count(*) FILTER (WHERE coherence < 0.4) AS low FROM s""")
def cluster_quality(spark, d):
    """Coherence of a cluster: mean cosine of its pairs, from the sum of its unit vectors, so no pair is made."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    parts = clusters(spark, d).withColumn("norm", F.nullif(norm, F.lit(0.0))).select("cluster", "norm", F.posexplode("embedding").alias("p", "v"))
    sums = parts.groupBy("cluster", "p").agg(F.sum(c("v").cast("double") / c("norm")).alias("s"), F.count(F.lit(1)).alias("n"))
    s = sums.groupBy("cluster").agg(F.max("n").alias("n"), F.sum(c("s") * c("s")).alias("q"))
    s = s.withColumn("k", F.try_divide(c("q") - c("n"), c("n") * (c("n") - 1)))
    k = c("k")
    return s.agg(F.count(F.lit(1)).alias("clusters"), F.round(F.avg("n"), 4).alias("avg_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.round(F.avg(k), 4).alias("avg_coherence"), F.count_if(c("n") == 1).alias("singletons"), F.count_if(c("n") >= 5).alias("large"),
                 F.count_if(k >= 0.7).alias("high"), F.count_if((k >= 0.4) & (k < 0.7)).alias("medium"), F.count_if(k < 0.4).alias("low"))


# ---- story validation: candidate stories are groups of ten vectors --------------------------------------------------

STORY = """cand AS (SELECT cluster_id, list(vec_id ORDER BY vec_id) AS ids, (cluster_id // 10) % 5 AS v FROM (SELECT vec_id, (vec_id // 7) * 10 + CASE WHEN (vec_id // 7) % 4 = 0 THEN vec_id % 3 ELSE 9 END AS cluster_id FROM embeddings) GROUP BY cluster_id)"""


def candidates(spark, d):
    """Clusters of at most seven vectors with a verdict: 0 single story, 1 collection, 2 noise, 3 none, 4 single with outliers; every fourth is split in three small ones."""
    q = F.expr("vec_id div 7")
    e = read(spark, d, "embeddings").select("vec_id", (q * 10 + F.when(q % 4 == 0, c("vec_id") % 3).otherwise(9)).alias("cluster_id"))
    return e.groupBy("cluster_id").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("v", F.expr("(cluster_id div 10) % 5").cast("int"))


def validated(cand):
    """(accepted stories, rejected clusters) from clusters with verdicts."""
    answer = F.when(F.size("ids") < 3, "too_small").when(c("v").isin(0, 4), "single_story").when(c("v") == 1, "collection").when(c("v") == 2, "pure_noise").otherwise("no_stories")
    t = cand.withColumns({"answer": answer, "outliers": F.when(c("v") == 4, F.slice("ids", 1, 1)).otherwise(F.slice("ids", 1, 0))})
    left = F.filter("ids", lambda x: ~F.array_contains("outliers", x))
    t = t.withColumn("left", left)
    single = t.where((c("answer") == "single_story") & (F.size("left") >= 2)).select("cluster_id", F.lit(0).alias("part"), c("left").alias("ids"), F.lit("single_story").alias("story_type"))
    parts = F.array(F.slice("ids", 1, 2), F.slice("ids", 3, 1), F.slice("ids", 4, 4))
    several = t.where(c("answer") == "collection").select("cluster_id", F.posexplode(parts).alias("part", "ids")).where(F.size("ids") >= 2).select("cluster_id", "part", "ids", F.lit("collection_of_stories").alias("story_type"))
    why = F.when((c("answer") == "too_small") | ((c("answer") == "single_story") & (F.size("left") < 2)), "INSUFFICIENT_ARTICLES").when(c("answer") == "pure_noise", "PURE_NOISE").when(c("answer") == "no_stories", "NO_STORIES")
    rejected = t.where(why.isNotNull()).select("cluster_id", why.alias("reason"), c("ids"))
    score = F.least(F.greatest(F.coalesce(F.nullif((c("cluster_id") * 3 + c("part")) % 12, F.lit(0)), F.lit(5)), F.lit(1)), F.lit(10)).cast("int")
    return single.unionByName(several).withColumn("importance", score), rejected


VALID = f"""{STORY}, x AS (SELECT *, CASE WHEN len(ids) < 3 THEN 'too_small' WHEN v IN (0, 4) THEN 'single_story' WHEN v = 1 THEN 'collection' WHEN v = 2 THEN 'pure_noise' ELSE 'no_stories' END AS answer, CASE WHEN v = 4 THEN ids[2:] ELSE ids END AS lft FROM cand),
acc AS (SELECT *, least(greatest(coalesce(nullif((cluster_id * 3 + part) % 12, 0), 5), 1), 10)::INTEGER AS importance FROM (SELECT cluster_id, 0 AS part, lft AS ids, 'single_story' AS story_type FROM x WHERE answer = 'single_story' AND len(lft) >= 2
 UNION ALL SELECT cluster_id, p AS part, CASE p WHEN 0 THEN ids[1:2] ELSE ids[4:7] END, 'collection_of_stories' FROM x, (VALUES (0), (2)) t(p) WHERE answer = 'collection' AND len(CASE p WHEN 0 THEN ids[1:2] ELSE ids[4:7] END) >= 2)),
rej AS (SELECT cluster_id, ids, CASE WHEN answer IN ('too_small', 'single_story') THEN 'INSUFFICIENT_ARTICLES' WHEN answer = 'pure_noise' THEN 'PURE_NOISE' ELSE 'NO_STORIES' END AS reason FROM x WHERE answer IN ('too_small', 'pure_noise', 'no_stories') OR (answer = 'single_story' AND len(lft) < 2))"""


@query(f"WITH {VALID} SELECT cluster_id, part, ids, story_type, importance FROM acc")
def story_validation(spark, d):
    return validated(candidates(spark, d))[0].select("cluster_id", "part", "ids", "story_type", "importance")


@query(f"WITH {VALID} SELECT reason, count(*) AS n, sum(len(ids))::BIGINT AS articles FROM rej GROUP BY reason")
def rejection_histogram(spark, d):
    return validated(candidates(spark, d))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("articles"))


@query(f"WITH {VALID} SELECT round(avg(importance), 4) AS avg_importance, count(*) FILTER (WHERE importance >= 8) AS high, count(*) FILTER (WHERE importance >= 5 AND importance < 8) AS medium, count(*) FILTER (WHERE importance < 5) AS low, sum(len(ids))::BIGINT AS articles FROM acc")
def story_quality(spark, d):
    i = c("importance")
    return validated(candidates(spark, d))[0].agg(F.round(F.avg(i), 4).alias("avg_importance"), F.count_if(i >= 8).alias("high"), F.count_if((i >= 5) & (i < 8)).alias("medium"), F.count_if(i < 5).alias("low"), F.sum(F.size("ids")).alias("articles"))


@query(f"""WITH {VALID}, b AS (SELECT cluster_id, part, importance, importance >= 5 AS ok FROM acc UNION ALL SELECT cluster_id, 0, 0, false FROM rej) SELECT cluster_id // 1000 AS brief_id, row_number() OVER (PARTITION BY cluster_id // 1000 ORDER BY ok DESC, cluster_id, part)::INTEGER AS story_id, cluster_id, importance, importance - 5 AS margin, ok AS selected,
CASE WHEN importance >= 7 THEN 'high' WHEN importance >= 5 THEN 'borderline' ELSE 'failed' END AS band FROM b""")
def story_breakdown(spark, d):
    """Stories are numbered inside their brief, which is made of 1,000 cluster numbers."""
    ok, bad = validated(candidates(spark, d))
    b = ok.select("cluster_id", "part", "importance", (c("importance") >= 5).alias("selected")).unionByName(bad.select("cluster_id", F.lit(0).alias("part"), F.lit(0).alias("importance"), F.lit(False).alias("selected")))
    band = F.when(c("importance") >= 7, "high").when(c("importance") >= 5, "borderline").otherwise("failed")
    return b.select(F.expr("cluster_id div 1000").alias("brief_id"), F.row_number().over(Window.partitionBy(F.expr("cluster_id div 1000")).orderBy(F.desc("selected"), "cluster_id", "part")).alias("story_id"), "cluster_id", "importance", (c("importance") - 5).alias("margin"), "selected", band.alias("band"))


@query(f"WITH {VALID}, u AS (SELECT DISTINCT unnest(ids) AS id FROM acc) SELECT count(*) AS used_articles, count(DISTINCT d.source) AS used_sources, (SELECT count(DISTINCT source) FROM documents) AS total_sources FROM documents d SEMI JOIN u ON u.id = d.doc_id")
def used_sources(spark, d):
    used = validated(candidates(spark, d))[0].select(F.explode("ids").alias("doc_id"))
    docs = read(spark, d, "documents").select("doc_id", "source")
    return docs.join(used, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("used_articles"), F.count_distinct("source").alias("used_sources")).crossJoin(docs.agg(F.count_distinct("source").alias("total_sources")))


@query("""WITH u AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings), m AS (SELECT label, p, avg(v) AS m FROM u GROUP BY ALL), s AS (SELECT u.label, vec_id, round(sum(v * m), 6) AS s FROM u JOIN m USING (label, p) GROUP BY ALL)
SELECT label, vec_id FROM s WHERE s >= 0""")
def outlier_removal(spark, d):
    """Members less their cluster's list of outliers (vectors that point away from the mean), by an anti join: no list of a cluster in one row."""
    e = read(spark, d, "embeddings").select("label", "vec_id", "embedding")
    u = e.select("label", "vec_id", F.posexplode("embedding").alias("p", "v")).withColumn("v", c("v").cast("double"))
    mean = u.groupBy("label", "p").agg(F.avg("v").alias("m"))
    named = u.join(mean, ["label", "p"]).groupBy("label", "vec_id").agg(F.round(F.sum(c("v") * c("m")), 6).alias("s")).where(c("s") < 0)
    return e.select("label", "vec_id").join(named, ["label", "vec_id"], "left_anti")


@query(f"""WITH {STORY}, m AS (SELECT cluster_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM cand) SELECT m.cluster_id, string_agg(coalesce('- ' || a.lang || ' ' || m.id::VARCHAR, '- missing ' || m.id::VARCHAR), chr(10) ORDER BY p) AS listing FROM m LEFT JOIN documents a ON a.doc_id = m.id AND a.source <> 'src3' GROUP BY m.cluster_id""")
def cluster_articles(spark, d):
    m = candidates(spark, d).select("cluster_id", F.posexplode("ids").alias("p", "id"))
    a = read(spark, d, "documents").where(c("source") != "src3").select(c("doc_id").alias("id"), "lang")
    line = F.coalesce(F.concat(F.lit("- "), "lang", F.lit(" "), c("id").cast("string")), F.concat(F.lit("- missing "), c("id").cast("string")))
    g = m.join(a, "id", "left").groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("p", line.alias("t")))).alias("x"))
    return g.select("cluster_id", F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("listing"))


@query(f"""WITH {VALID}, m AS (SELECT cluster_id, part, unnest(ids) AS id FROM acc) SELECT cluster_id, part, count(d.doc_id) AS matched, CASE WHEN count(d.doc_id) = 0 THEN 'No matching articles' END AS error FROM m LEFT JOIN documents d ON d.doc_id = m.id AND d.lang = 'en' GROUP BY ALL""")
def story_articles(spark, d):
    """English articles of each story; a story without any stays, as an error."""
    m = validated(candidates(spark, d))[0].select("cluster_id", "part", F.explode("ids").alias("id"))
    docs = read(spark, d, "documents").where(c("lang") == "en").select("doc_id")
    n = F.count("doc_id")
    return m.join(docs, c("id") == c("doc_id"), "left").groupBy("cluster_id", "part").agg(n.alias("matched"), F.when(n == 0, "No matching articles").alias("error"))


@query(f"""WITH {VALID}, m AS (SELECT cluster_id, part, unnest(ids) AS id FROM acc), t AS (SELECT m.*, d.source, d.text FROM m LEFT JOIN documents d ON d.doc_id = m.id), r AS (SELECT cluster_id, part, CASE WHEN bool_and(coalesce(source <> 'src3' AND text <> '', false)) THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS status FROM t GROUP BY ALL)
SELECT count(*) AS total_articles, count(DISTINCT source) AS total_sources, count(*) FILTER (WHERE status = 'COMPLETE') AS used_articles, count(DISTINCT source) FILTER (WHERE status = 'COMPLETE') AS used_sources FROM t JOIN r USING (cluster_id, part)""")
def brief_statistics(spark, d):
    """Articles and sources of all stories, and of those whose report is COMPLETE (no article is without text or from a source that can't be read, here src3)."""
    t = validated(candidates(spark, d))[0].select("cluster_id", "part", F.explode("ids").alias("doc_id")).join(read(spark, d, "documents").select("doc_id", "source", (c("text") != "").alias("has")), "doc_id", "left")
    r = t.groupBy("cluster_id", "part").agg(F.every(F.coalesce((c("source") != "src3") & c("has"), F.lit(False))).alias("used"))
    m = t.join(r, ["cluster_id", "part"])
    return m.agg(F.count(F.lit(1)).alias("total_articles"), F.count_distinct("source").alias("total_sources"), F.count_if("used").alias("used_articles"), F.count_distinct(F.when(c("used"), c("source"))).alias("used_sources"))
