"""Counts, rates and dashboards over articles, sources and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.bridge import ARTICLES, REPORTS, SOURCES, T, articles, hours_ago, now, read, reports, sources, text_of
from tidewire.operators.tables import FAILED
from tidewire.plans.registry import query

c = F.col
N = lambda cond: F.count_if(cond)


def pct(part, whole, scale: int = 1):
    return F.round(F.try_divide(part * 100.0, whole), scale)


LABELS = """CASE WHEN status LIKE '%FAILED' THEN 'failed' WHEN status = 'PROCESSED' THEN 'done' WHEN status = 'PENDING_FETCH' THEN 'waiting' WHEN status = 'SKIPPED_TOO_OLD' THEN 'skipped' ELSE 'other' END"""


@query(f"""WITH {ARTICLES} SELECT status, {LABELS} AS label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1)::DOUBLE AS share FROM articles GROUP BY status""")
def status_distribution(spark, d):
    by = articles(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    label = F.when(c("status").like("%FAILED"), "failed").when(c("status") == "PROCESSED", "done").when(c("status") == "PENDING_FETCH", "waiting").when(c("status") == "SKIPPED_TOO_OLD", "skipped").otherwise("other")
    return by.select("status", label.alias("label"), "n", pct(c("n"), F.sum("n").over(Window.partitionBy())).alias("share"))


@query(f"""WITH {ARTICLES}, {SOURCES}, {REPORTS} SELECT 'articles' AS metric, count(*)::VARCHAR AS value FROM articles UNION ALL SELECT 'processed', count(*)::VARCHAR FROM articles WHERE status = 'PROCESSED'
UNION ALL SELECT 'sources', count(*)::VARCHAR FROM sources UNION ALL SELECT 'reports', count(*)::VARCHAR FROM reports UNION ALL SELECT 'newsletter', count(DISTINCT c_custkey // 3)::VARCHAR FROM customer""")
def core_counts(spark, d):
    a = articles(spark, d).agg(F.count(F.lit(1)).alias("articles"), N(c("status") == "PROCESSED").alias("processed"))
    wide = a.select(F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in a.columns]), F.array(*[c(x) for x in a.columns]))).alias("metric", "v"))
    out = wide.select("metric", c("v").cast("string").alias("value"))
    subscribers = read(spark, d, "customer").select(F.expr("c_custkey div 3").alias("n")).distinct()
    for name, t in (("sources", sources(spark, d)), ("reports", reports(spark, d)), ("newsletter", subscribers)):
        out = out.unionByName(t.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(name).alias("metric"), "value"))
    return out


@query(f"""WITH {ARTICLES}, t AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PROCESSED') AS ok, count(*) FILTER (WHERE status LIKE '%FAILED') AS bad FROM articles)
SELECT 'success' AS metric, round(ok * 100.0 / nullif(total, 0), 1)::DECIMAL(10,1)::VARCHAR || '%' AS rate, ok::VARCHAR || '/' || total::VARCHAR AS detail FROM t UNION ALL
SELECT 'failure', round(bad * 100.0 / nullif(total, 0), 1)::DECIMAL(10,1)::VARCHAR || '%', bad::VARCHAR || '/' || total::VARCHAR FROM t""")
def processing_rates(spark, d):
    t = articles(spark, d).agg(F.count(F.lit(1)).alias("total"), N(c("status") == "PROCESSED").alias("ok"), N(c("status").like("%FAILED")).alias("bad"))
    rows = t.select("total", F.explode(F.array(F.struct(F.lit("success").alias("metric"), c("ok").alias("p")), F.struct(F.lit("failure").alias("metric"), c("bad").alias("p")))).alias("x"))
    return rows.select("x.metric", F.concat(pct(c("x.p"), c("total")).cast("decimal(10,1)").cast("string"), F.lit("%")).alias("rate"), F.concat(c("x.p").cast("string"), F.lit("/"), c("total").cast("string")).alias("detail"))


@query(f"""WITH {ARTICLES}, {REPORTS} SELECT 'created' AS metric, count(*) AS n FROM articles WHERE created_at >= {T} - INTERVAL 7 DAY UNION ALL SELECT 'processed', count(*) FROM articles WHERE processed_at >= {T} - INTERVAL 7 DAY
UNION ALL SELECT 'briefs', count(*) FROM reports WHERE created_at >= {T} - INTERVAL 7 DAY""")
def activity_7d(spark, d):
    since = hours_ago(168)
    a = articles(spark, d).agg(N(c("created_at") >= since).alias("created"), N(c("processed_at") >= since).alias("processed"))
    b = reports(spark, d).agg(N(c("created_at") >= since).alias("n")).select(F.lit("briefs").alias("metric"), "n")
    return a.unpivot([], ["created", "processed"], "metric", "n").unionByName(b)


@query(f"""WITH {ARTICLES}, {SOURCES}, t AS (SELECT 'failures' AS metric, count(*) FILTER (WHERE status LIKE '%FAILED') AS n, 10 AS hi FROM articles UNION ALL SELECT 'stale', count(*) FILTER (WHERE last_checked IS NULL OR last_checked < {T} - INTERVAL 2 DAY), 2 FROM sources)
SELECT metric, n, CASE WHEN n = 0 THEN 'ok' WHEN n < hi THEN 'warning' ELSE 'critical' END AS level FROM t""")
def diagnosis(spark, d):
    bad = articles(spark, d).agg(N(c("status").like("%FAILED")).alias("n")).select(F.lit("failures").alias("metric"), "n", F.lit(10).alias("hi"))
    old = sources(spark, d).agg(N(c("last_checked").isNull() | (c("last_checked") < hours_ago(48))).alias("n")).select(F.lit("stale").alias("metric"), "n", F.lit(2).alias("hi"))
    return bad.unionByName(old).select("metric", "n", F.when(c("n") == 0, "ok").when(c("n") < c("hi"), "warning").otherwise("critical").alias("level"))


@query(f"""WITH {ARTICLES}, {SOURCES}, {REPORTS} SELECT * FROM (SELECT count(*) AS sources_total, count(last_checked) AS sources_active FROM sources),
(SELECT count(*) AS articles_total, count(*) FILTER (WHERE status = 'PROCESSED') AS processed, count(*) FILTER (WHERE status = 'PENDING_FETCH') AS pending, count(*) FILTER (WHERE status LIKE '%FAILED') AS failed FROM articles),
(SELECT count(*) FILTER (WHERE created_at > {T} - INTERVAL 30 DAY) AS briefs_30d FROM reports)""")
def overview(spark, d):
    s = sources(spark, d).agg(F.count(F.lit(1)).alias("sources_total"), F.count("last_checked").alias("sources_active"))
    a = articles(spark, d).agg(F.count(F.lit(1)).alias("articles_total"), N(c("status") == "PROCESSED").alias("processed"), N(c("status") == "PENDING_FETCH").alias("pending"), N(c("status").endswith("_FAILED")).alias("failed"))
    r = reports(spark, d).agg(N(c("created_at") > hours_ago(720)).alias("briefs_30d"))
    return s.crossJoin(a).crossJoin(r)  # one row each


@query(f"""WITH {ARTICLES} SELECT status, count(*) OVER (PARTITION BY status) AS n, id, CASE WHEN length(fail_reason) > 100 THEN substr(fail_reason, 1, 100) || '...' ELSE fail_reason END AS reason FROM articles WHERE status LIKE '%FAILED'""")
def failed_stats_by_status(spark, d):
    """A row for each failed article with its status's count (a row for each name of a fixed list): no list of all ids in one row."""
    short = F.when(F.length("fail_reason") > 100, F.concat(F.substring("fail_reason", 1, 100), F.lit("..."))).otherwise(c("fail_reason"))
    bad = articles(spark, d).where(c("status").isin(FAILED))
    return bad.select("status", "id", short.alias("reason")).join(F.broadcast(bad.groupBy("status").agg(F.count(F.lit(1)).alias("n"))), "status").select("status", "n", "id", "reason")


@query(f"""WITH {ARTICLES} SELECT coalesce(split_part(fail_reason, ':', 1), 'Unknown') AS reason, count(*) AS n FROM articles WHERE status LIKE '%FAILED' GROUP BY 1""")
def failed_by_reason(spark, d):
    return articles(spark, d).where(c("status").endswith("_FAILED")).groupBy(F.coalesce(F.split_part("fail_reason", F.lit(":"), F.lit(1)), F.lit("Unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ARTICLES} SELECT count(*) FILTER (WHERE publish_date >= {T} - INTERVAL 1 DAY) AS last_24h, count(*) FILTER (WHERE publish_date >= {T} - INTERVAL 7 DAY) AS last_7d,
count(*) FILTER (WHERE publish_date >= {T} - INTERVAL 30 DAY) AS last_30d, count(*) FILTER (WHERE publish_date >= {T} - INTERVAL 2 DAY) AS retryable FROM articles WHERE status LIKE '%FAILED'""")
def failed_time_windows(spark, d):
    p = c("publish_date")
    return articles(spark, d).where(c("status").endswith("_FAILED")).agg(*[N(p >= hours_ago(h)).alias(n) for n, h in (("last_24h", 24), ("last_7d", 168), ("last_30d", 720), ("retryable", 48))])


@query(f"""WITH {ARTICLES} SELECT status, count(*) AS n FROM articles WHERE status IN ('FETCH_FAILED','RENDER_FAILED','AI_ANALYSIS_FAILED','EMBEDDING_FAILED','R2_UPLOAD_FAILED') AND id % 3 = 0 GROUP BY status""")
def retry_breakdown(spark, d):
    return articles(spark, d).where(c("status").isin(FAILED) & (c("id") % 3 == 0)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ARTICLES} SELECT count(*) AS total, count(embedding) AS with_vector, count(content_file_key) AS with_key, count(*) FILTER (WHERE status = 'PROCESSED') AS processed FROM articles""")
def debug_counts(spark, d):
    return articles(spark, d, vectors=True).agg(F.count(F.lit(1)).alias("total"), F.count("embedding").alias("with_vector"), F.count("content_file_key").alias("with_key"), N(c("status") == "PROCESSED").alias("processed"))


# The article states that the monitor counts.
MONITORED = ["PENDING_FETCH", "CONTENT_FETCHED", "PROCESSED", "SKIPPED_PDF", "FETCH_FAILED", "RENDER_FAILED", "AI_ANALYSIS_FAILED", "EMBEDDING_FAILED", "R2_UPLOAD_FAILED", "SKIPPED_TOO_OLD"]


@query(f"""WITH {ARTICLES}, {SOURCES}, a AS (SELECT count(*) AS total_articles, {", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in MONITORED)}, count(*) FILTER (WHERE created_at > {T} - INTERVAL 24 HOUR) AS recent_articles,
count(*) FILTER (WHERE processed_at > {T} - INTERVAL 1 HOUR) AS processed_recently, count(*) FILTER (WHERE source_name IN ('src1', 'src2')) AS used_browser, count(content_file_key) AS has_content_file, count(embedding) AS has_embedding FROM articles)
SELECT a.*, (SELECT count(*) FROM sources) AS total_sources, round(processed * 100.0 / nullif(total_articles, 0), 1)::DOUBLE AS processed_pct, round(has_content_file * 100.0 / nullif(total_articles, 0), 1)::DOUBLE AS content_pct, round(has_embedding * 100.0 / nullif(total_articles, 0), 1)::DOUBLE AS embedding_pct FROM a""")
def monitor_counters(spark, d):
    """The monitor's 17 counters and its progress; the articles of two sources stand for those fetched by a browser."""
    a = articles(spark, d, vectors=True).agg(
        F.count(F.lit(1)).alias("total_articles"), *[N(c("status") == s).alias(s.lower()) for s in MONITORED], N(c("created_at") > hours_ago(24)).alias("recent_articles"), N(c("processed_at") > hours_ago(1)).alias("processed_recently"),
        N(c("source_name").isin("src1", "src2")).alias("used_browser"), F.count("content_file_key").alias("has_content_file"), F.count("embedding").alias("has_embedding"))
    n = sources(spark, d).agg(F.count(F.lit(1)).alias("total_sources"))
    return a.crossJoin(n).select("*", *[pct(c(x), c("total_articles")).alias(y) for x, y in (("processed", "processed_pct"), ("has_content_file", "content_pct"), ("has_embedding", "embedding_pct"))])  # one row each


@query(f"""WITH {ARTICLES}, {SOURCES} SELECT s.name, count(a.id) AS articles, count(a.id) FILTER (WHERE a.status = 'PROCESSED') AS processed,
CASE WHEN s.last_checked IS NULL THEN 'never' WHEN s.last_checked < {T} - INTERVAL 1 DAY THEN 'over a day' WHEN s.last_checked < {T} - INTERVAL 6 HOUR THEN 'over six hours' ELSE 'recent' END AS freshness FROM sources s LEFT JOIN articles a ON a.source_name = s.name GROUP BY s.name, s.last_checked""")
def source_join_counts(spark, d):
    # Articles are counted before the join: the join then meets one row a source.
    a = articles(spark, d).groupBy(c("source_name").alias("name")).agg(F.count(F.lit(1)).alias("articles"), N(c("status") == "PROCESSED").alias("processed"))
    fresh = F.when(c("last_checked").isNull(), "never").when(c("last_checked") < hours_ago(24), "over a day").when(c("last_checked") < hours_ago(6), "over six hours").otherwise("recent")
    zero = lambda x: F.coalesce(c(x), F.lit(0)).alias(x)
    return sources(spark, d).join(a, "name", "left").select("name", zero("articles"), zero("processed"), fresh.alias("freshness")).orderBy(F.desc("articles"), "name")


HEALTH = f"""health AS (SELECT s.id, s.name, s.last_checked, count(a.id) AS total, round(count(a.id) FILTER (WHERE a.created_at > {T} - INTERVAL 1 DAY) / 24.0, 4)::DOUBLE AS per_hour_24h, round(count(a.id) / 7.0, 4)::DOUBLE AS per_day,
round(count(a.id) FILTER (WHERE a.status = 'PROCESSED') * 100.0 / nullif(count(a.id), 0), 1)::DOUBLE AS success_rate, round(count(a.id) FILTER (WHERE a.status LIKE '%FAILED') * 100.0 / nullif(count(a.id), 0), 1)::DOUBLE AS error_rate,
round(count(a.id) FILTER (WHERE a.status = 'PROCESSED' AND a.content_quality = 'LOW_QUALITY') * 100.0 / nullif(count(a.id) FILTER (WHERE a.status = 'PROCESSED'), 0), 1)::DOUBLE AS low_quality_rate,
floor(avg(CASE WHEN a.status = 'PROCESSED' THEN epoch(a.processed_at) - epoch(a.created_at) END) + 0.5)::BIGINT AS avg_seconds
FROM sources s LEFT JOIN articles a ON a.source_name = s.name AND a.created_at > {T} - INTERVAL 7 DAY GROUP BY ALL)"""


def health(spark, d):
    """Last week's figures of every source; articles are aggregated by source before they meet the sources."""
    a = articles(spark, d, labels=True).where(c("created_at") > hours_ago(168))
    done, took = c("status") == "PROCESSED", F.unix_timestamp("processed_at") - F.unix_timestamp("created_at")
    g = a.groupBy(c("source_name").alias("name")).agg(
        F.count(F.lit(1)).alias("total"), N(c("created_at") > hours_ago(24)).alias("day"), N(done).alias("done"), N(c("status").endswith("_FAILED")).alias("bad"),
        N(done & (c("content_quality") == "LOW_QUALITY")).alias("low"), F.avg(F.when(done, took)).alias("took"))
    z = lambda x: F.coalesce(c(x), F.lit(0))
    return sources(spark, d).join(g, "name", "left").select(
        "id", "name", "last_checked", "scrape_frequency", "category", "paywall", z("total").alias("total"), F.round(z("day") / 24.0, 4).alias("per_hour_24h"), F.round(z("total") / 7.0, 4).alias("per_day"),
        pct(c("done"), F.nullif(c("total"), F.lit(0))).alias("success_rate"), pct(c("bad"), F.nullif(c("total"), F.lit(0))).alias("error_rate"),
        pct(c("low"), F.nullif(c("done"), F.lit(0))).alias("low_quality_rate"), F.floor(c("took") + 0.5).alias("avg_seconds"))


@query(f"WITH {ARTICLES}, {SOURCES}, {HEALTH} SELECT id, name, total, per_hour_24h, per_day, success_rate, error_rate, low_quality_rate, avg_seconds FROM health")
def source_health(spark, d):
    return health(spark, d).drop("last_checked", "scrape_frequency", "category", "paywall")


@query(f"""WITH {ARTICLES}, {SOURCES}, {HEALTH} SELECT name, CASE WHEN error_rate > 10 OR last_checked IS NULL OR last_checked < {T} - INTERVAL 1 DAY THEN 'red' WHEN error_rate > 0 OR low_quality_rate > 15 THEN 'yellow' ELSE 'green' END AS color FROM health""")
def source_health_color(spark, d):
    stale = c("last_checked").isNull() | (c("last_checked") < hours_ago(24))
    return health(spark, d).select("name", F.when((c("error_rate") > 10) | stale, "red").when((c("error_rate") > 0) | (c("low_quality_rate") > 15), "yellow").otherwise("green").alias("color"))


@query(f"""WITH {ARTICLES}, {SOURCES}, {HEALTH} SELECT h.name, h.total, h.error_rate FROM health h JOIN sources s USING (name) WHERE s.scrape_frequency IN (1, 2) AND s.category = 'tech' AND NOT s.paywall AND h.error_rate > 5 AND h.last_checked > {T} - INTERVAL 24 HOUR AND h.total > 2""")
def dashboard_filters(spark, d):
    h = health(spark, d).where(c("scrape_frequency").isin(1, 2) & (c("category") == "tech") & ~c("paywall") & (c("error_rate") > 5) & (c("last_checked") > hours_ago(24)) & (c("total") > 2))
    return h.select("name", "total", "error_rate").orderBy(F.desc(F.expr("try_cast(error_rate AS double)")), "name")


@query(f"""WITH {ARTICLES}, {SOURCES}, {HEALTH} SELECT floor(avg(coalesce(success_rate, 0)) + 0.5)::BIGINT AS success, floor(avg(coalesce(error_rate, 0)) + 0.5)::BIGINT AS error, floor(avg(coalesce(avg_seconds, 0)) + 0.5)::BIGINT AS seconds, count(*) AS sources FROM health""")
def dashboard_averages(spark, d):
    r = lambda x: F.floor(F.avg(F.coalesce(c(x), F.lit(0))) + 0.5)
    return health(spark, d).agg(r("success_rate").alias("success"), r("error_rate").alias("error"), r("avg_seconds").alias("seconds"), F.count(F.lit(1)).alias("sources"))


TIER_HOURS = {1: 2, 2: 8, 3: 12, 4: 48}  # fixed values: hours after which a source of each tier is stale
TIER_EVERY = {1: 1, 2: 4, 3: 6, 4: 24}  # fixed values: hours between checks


@query(f"""WITH {SOURCES} SELECT name, scrape_frequency, CASE scrape_frequency WHEN 1 THEN 'Hourly' WHEN 2 THEN '4 Hours' WHEN 3 THEN '6 Hours' ELSE 'Daily' END AS label FROM sources
WHERE last_checked < {T} - to_hours(CASE scrape_frequency WHEN 1 THEN 2 WHEN 2 THEN 8 WHEN 3 THEN 12 ELSE 48 END)""")
def stale_sources(spark, d):
    f = c("scrape_frequency")
    late = F.when(f == 1, hours_ago(2)).when(f == 2, hours_ago(8)).when(f == 3, hours_ago(12)).otherwise(hours_ago(48))
    return sources(spark, d).where(c("last_checked") < late).select("name", "scrape_frequency", F.when(f == 1, "Hourly").when(f == 2, "4 Hours").when(f == 3, "6 Hours").otherwise("Daily").alias("label"))


@query(f"""WITH {SOURCES} SELECT id, name, CASE WHEN scrape_frequency IN (1,2,3,4) THEN scrape_frequency ELSE 2 END AS tier FROM sources WHERE last_checked IS NULL OR last_checked + to_hours(CASE scrape_frequency WHEN 1 THEN 1 WHEN 3 THEN 6 WHEN 4 THEN 24 ELSE 4 END) <= {T}""")
def due_sources(spark, d):
    tier = F.when(c("scrape_frequency").isin(1, 2, 3, 4), c("scrape_frequency")).otherwise(2)
    s = sources(spark, d).withColumn("tier", tier)
    every = F.element_at(F.create_map(*[F.lit(x) for kv in TIER_EVERY.items() for x in kv]), c("tier"))
    return s.where(c("last_checked").isNull() | (F.unix_timestamp("last_checked") + every * 3600 <= F.unix_timestamp(now()))).select("id", "name", "tier")


@query(f"WITH {SOURCES} SELECT id, url, name, scrape_frequency, paywall, category FROM sources")
def source_scan(spark, d):
    return sources(spark, d).select("id", "url", "name", "scrape_frequency", "paywall", "category").orderBy("id")


@query(f"WITH {SOURCES} SELECT id, name FROM sources WHERE do_initialized_at IS NULL")
def uninitialized_sources(spark, d):
    return sources(spark, d).where(c("do_initialized_at").isNull()).select("id", "name")


@query(f"""WITH {ARTICLES}, {SOURCES} SELECT * FROM (SELECT count(*) FILTER (WHERE status = 'PROCESSED' AND processed_at >= date_trunc('day', {T})) AS processed, count(*) FILTER (WHERE created_at >= date_trunc('day', {T})) AS fetched,
count(*) FILTER (WHERE status LIKE '%FAILED' AND created_at >= date_trunc('day', {T})) AS errors, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_fetched, strftime(max(processed_at), '%Y-%m-%d %H:%M:%S') AS last_processed FROM articles),
(SELECT count(*) FILTER (WHERE last_checked < {T} - to_hours(CASE scrape_frequency WHEN 1 THEN 2 WHEN 2 THEN 8 WHEN 3 THEN 12 ELSE 48 END)) AS stale FROM sources)""")
def today_overview(spark, d):
    day = F.date_trunc("day", now())
    a = articles(spark, d).agg(
        N((c("status") == "PROCESSED") & (c("processed_at") >= day)).alias("processed"), N(c("created_at") >= day).alias("fetched"), N(c("status").endswith("_FAILED") & (c("created_at") >= day)).alias("errors"),
        text_of(F.max("created_at")).alias("last_fetched"), text_of(F.max("processed_at")).alias("last_processed"))
    return a.crossJoin(stale_sources(spark, d).agg(F.count(F.lit(1)).alias("stale")))


@query(f"""WITH {REPORTS} SELECT 'averages' AS part, NULL AS name, count(*) AS n, round(avg(total_articles), 4) AS x, round(avg(CASE WHEN coalesce(total_articles, 0) = 0 OR coalesce(used_articles, 0) = 0 THEN 0 ELSE used_articles * 100.0 / total_articles END), 4)::DOUBLE AS y FROM reports WHERE created_at >= {T} - INTERVAL 30 DAY
UNION ALL SELECT 'model', coalesce(model_author, 'Unknown'), count(*), NULL, NULL FROM reports WHERE created_at >= {T} - INTERVAL 30 DAY GROUP BY 2
UNION ALL SELECT 'day', strftime(created_at, '%Y-%m-%d'), count(*), NULL, NULL FROM reports WHERE created_at >= {T} - INTERVAL 30 DAY GROUP BY 2""")
def brief_stats(spark, d):
    r = reports(spark, d).where(c("created_at") >= hours_ago(720))
    usage = F.when((F.coalesce("total_articles", F.lit(0)) == 0) | (F.coalesce("used_articles", F.lit(0)) == 0), 0.0).otherwise(c("used_articles") * 100.0 / c("total_articles"))
    none = F.lit(None).cast("double")
    avg = r.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total_articles"), 4).alias("x"), F.round(F.avg(usage), 4).alias("y")).select(F.lit("averages").alias("part"), F.lit(None).cast("string").alias("name"), "n", "x", "y")
    part = lambda p, col: r.groupBy(col.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "name", "n", none.alias("x"), none.alias("y"))
    return avg.unionByName(part("model", F.coalesce("model_author", F.lit("Unknown")))).unionByName(part("day", F.date_format("created_at", "yyyy-MM-dd")))


@query(f"""WITH {REPORTS} SELECT id, CASE WHEN m = 0 THEN 'ai_worker_generated' WHEN m = 1 THEN 'hybrid' ELSE 'unknown' END AS strategy, round(CASE WHEN m = 0 THEN 0.5 WHEN m = 1 THEN (id % 10) / 10.0 ELSE 0.3 END, 4)::DOUBLE AS min_quality FROM reports""")
def brief_trend(spark, d):
    p = c("clustering_params")
    wf = F.get_json_object(p, "$.workflowId").isNotNull()
    return reports(spark, d).select(
        "id", F.when(wf, "ai_worker_generated").otherwise(F.coalesce(F.get_json_object(p, "$.strategy"), F.lit("unknown"))).alias("strategy"),
        F.round(F.when(wf, 0.5).otherwise(F.coalesce(F.get_json_object(p, "$.min_quality").cast("double"), F.lit(0.3))), 4).alias("min_quality"))


@query(f"""WITH {REPORTS} SELECT id, title, lower(strftime(created_at, '%B')) || '-' || day(created_at)::VARCHAR || '-' || year(created_at)::VARCHAR AS slug, coalesce(total_articles, 0) AS total_articles FROM reports ORDER BY created_at DESC, id LIMIT 5""")
def latest_reports(spark, d):
    slug = F.concat_ws("-", F.lower(F.date_format("created_at", "MMMM")), F.dayofmonth("created_at").cast("string"), F.year("created_at").cast("string"))
    return reports(spark, d).orderBy(F.desc_nulls_last("created_at"), "id").limit(5).select("id", "title", slug.alias("slug"), F.coalesce("total_articles", F.lit(0)).alias("total_articles"))


@query(f"""WITH {REPORTS}, p AS (SELECT id, created_at, lag(id) OVER w AS pid, lag(created_at) OVER w AS pt FROM reports WINDOW w AS (ORDER BY created_at, id)) SELECT id, CASE WHEN pt >= created_at - INTERVAL 24 HOUR THEN pid END AS previous_id FROM p""")
def previous_brief(spark, d):
    """The latest earlier brief within 24 hours.  It lies on the same day or the day before, so each brief is also dealt to the next day and windows hold two days."""
    day = F.floor(F.unix_timestamp("created_at") / 86400)
    r = reports(spark, d).select("id", "created_at", day.alias("own")).withColumn("day", F.explode(F.array(c("own"), c("own") + 1)))
    w = Window.partitionBy("day").orderBy("created_at", "id")
    r = r.withColumns({"p": F.lag("id").over(w), "t": F.lag("created_at").over(w)}).where(c("day") == c("own"))
    return r.select("id", F.when(F.unix_timestamp("created_at") - F.unix_timestamp("t") <= 86400, c("p")).alias("previous_id"))
