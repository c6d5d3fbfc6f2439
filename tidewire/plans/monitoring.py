"""Monitoring reports, list filters and response shapes over the article, report and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidewire.bridge import ARTICLES, DIM, METRICS, REPORTS, T, articles, hours_ago, metrics, now, read, reports, text_of
from tidewire.operators import tables
from tidewire.plans.observability import DEC, decisions
from tidewire.plans.registry import query
from tidewire.plans.vectors import VALID, candidates, validated

c = F.col
S = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def n_rows() -> Column:
    return F.count(F.lit(1))


def percent(part: Column, whole: Column) -> Column:
    """Percentage with one decimal; 0 where there is nothing."""
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), 1)


# ---- the data flow of a run: one row for each recorder ---------------------------------------------------------------

@query(f"""WITH {ARTICLES}, {METRICS}, {REPORTS}, {DEC}, lab AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), s AS (
SELECT 'article_processing' AS stage, count(*) AS total, count(embedding) AS used, count(content_file_key) * 100.0 / count(*) AS detail, NULL::BIGINT AS stories, NULL::BIGINT AS chars FROM articles
UNION ALL SELECT 'clustering_analysis', count(*), count(*) FILTER (WHERE n >= 3), avg(n), NULL, NULL FROM lab
UNION ALL SELECT 'story_selection', sum(candidates)::BIGINT, sum(selected)::BIGINT, avg(5 + margin), NULL, NULL FROM dec
UNION ALL SELECT 'ai_analysis', count(*), count(*) FILTER (WHERE status = 'completed'), avg(duration), NULL, NULL FROM metrics
UNION ALL SELECT 'brief_generation', sum(total_articles)::BIGINT, sum(used_articles)::BIGINT, avg(total_sources), (SELECT sum(selected) FROM dec)::BIGINT, sum(length(title))::BIGINT FROM reports
UNION ALL SELECT 'stages', count(*) FILTER (WHERE status <> 'started'), count(*) FILTER (WHERE status = 'completed'), sum(duration) FILTER (WHERE status <> 'started'), NULL, NULL FROM metrics),
r AS (SELECT stage, total, used, coalesce(round(used * 100.0 / nullif(total, 0), 1), 0)::DOUBLE AS rate, round(coalesce(detail, 0), 1)::DOUBLE AS detail, stories, chars FROM s)
SELECT *, CASE WHEN stage = 'article_processing' AND rate < 80 THEN 'few vectors' WHEN stage = 'clustering_analysis' AND rate < 50 THEN 'few valid clusters' WHEN stage = 'ai_analysis' AND rate < 90 THEN 'analysis fails' WHEN stage = 'stages' AND detail > 120000 THEN 'slow' END AS advice FROM r""")
def dataflow_report(spark, d):
    """What each recorder counts, its rate in percent and its own detail: content rate, mean size, importance, duration, sources, total duration; for briefs also the stories and the length of the text."""
    m = metrics(spark, d)
    ended = c("status") != "started"
    none = F.lit(None).cast("bigint")
    row = lambda t, stage, total, used, detail, chars=none: t.agg(total.alias("total"), used.alias("used"), detail.cast("double").alias("detail"), chars.alias("chars")).select(F.lit(stage).alias("stage"), "total", "used", "detail", none.alias("stories"), "chars")
    parts = [
        row(articles(spark, d, vectors=True), "article_processing", n_rows(), F.count("embedding"), F.try_divide(F.count("content_file_key") * 100.0, n_rows())),
        row(read(spark, d, "embeddings").groupBy("label").agg(n_rows().alias("n")), "clustering_analysis", n_rows(), F.count_if(c("n") >= 3), F.avg("n")),
        row(decisions(spark, d), "story_selection", F.sum("candidates"), F.sum("selected"), F.avg(5 + c("margin"))),
        row(m, "ai_analysis", n_rows(), F.count_if(c("status") == "completed"), F.avg("duration")),
        row(reports(spark, d), "brief_generation", F.sum("total_articles"), F.sum("used_articles"), F.avg("total_sources"), F.sum(F.length("title"))).drop("stories").crossJoin(decisions(spark, d).agg(F.sum("selected").alias("stories"))),  # one row each
        row(m, "stages", F.count_if(ended), F.count_if(c("status") == "completed"), F.sum(F.when(ended, c("duration")))),
    ]
    s = parts[0]
    for p in parts[1:]:
        s = s.unionByName(p)
    rate, detail = percent(c("used"), c("total")), F.round(F.coalesce("detail", F.lit(0.0)), 1)
    is_ = lambda stage: c("stage") == stage
    advice = F.when(is_("article_processing") & (c("rate") < 80), "few vectors").when(is_("clustering_analysis") & (c("rate") < 50), "few valid clusters").when(is_("ai_analysis") & (c("rate") < 90), "analysis fails").when(is_("stages") & (c("detail") > 120000), "slow")
    return s.select("stage", "total", "used", rate.alias("rate"), detail.alias("detail"), "stories", "chars").withColumn("advice", advice)


@query(f"""WITH {REPORTS} SELECT id, title, {S.format('created_at')} AS created, total_articles, used_articles FROM reports WHERE created_at >= {T} - INTERVAL 24 HOUR ORDER BY created_at DESC, id LIMIT 10""")
def recent_briefs(spark, d):
    """The ten newest briefs since a day before now."""
    r = reports(spark, d).where(c("created_at") >= hours_ago(24)).orderBy(F.desc("created_at"), "id").limit(10)
    return r.select("id", "title", text_of(c("created_at")).alias("created"), "total_articles", "used_articles")


@query(f"""WITH {REPORTS}, {METRICS}, b AS (SELECT least(count(*), 10) AS briefs, {S.format('max(created_at)')} AS last_brief FROM reports WHERE created_at >= {T} - INTERVAL 24 HOUR),
w AS (SELECT workflow_id, sum(duration) AS ms, count(*) AS steps, count(*) FILTER (WHERE status = 'failed') AS bad, max((ts, event_id)) AS last FROM metrics GROUP BY 1), l AS (SELECT * FROM w ORDER BY last DESC LIMIT 1)
SELECT briefs, last_brief, round(ms / 1000, 1) AS seconds, round(bad * 1.0 / steps, 4)::DOUBLE AS error_rate, list_filter([CASE WHEN briefs = 0 THEN 'no brief in a day' END, CASE WHEN bad * 1.0 / steps > 0.1 THEN 'many errors' END], lambda x: x IS NOT NULL) AS advice FROM b, l""")
def dashboard_day(spark, d):
    """The day's briefs and the summary of the workflow that wrote last; both sides of the join have one row."""
    b = reports(spark, d).where(c("created_at") >= hours_ago(24)).agg(F.least(n_rows(), F.lit(10)).alias("briefs"), text_of(F.max("created_at")).alias("last_brief"))
    w = metrics(spark, d).groupBy("workflow_id").agg(F.sum("duration").alias("ms"), n_rows().alias("steps"), F.count_if(c("status") == "failed").alias("bad"), F.max(F.struct("ts", "event_id")).alias("last"))
    last = w.agg(F.max_by(F.struct("ms", "steps", "bad"), "last").alias("l")).select("l.*")
    share = F.try_divide(c("bad"), c("steps"))
    advice = F.array_compact(F.array(F.when(c("briefs") == 0, "no brief in a day"), F.when(share > 0.1, "many errors")))
    return b.crossJoin(last).select("briefs", "last_brief", F.round(c("ms") / 1000, 1).alias("seconds"), F.round(share, 4).alias("error_rate"), advice.alias("advice"))


@query(f"""WITH {METRICS}, s AS (SELECT date_trunc('day', ts) AS day, step_name, CASE WHEN day(date_trunc('day', ts)) % 7 = 0 THEN -1 ELSE count(*) END AS n FROM metrics GROUP BY 1, 2),
p AS (SELECT *, lag(n) OVER (PARTITION BY step_name ORDER BY day) AS was FROM s) SELECT strftime(day, '%Y-%m-%d') AS day, step_name, was, n, n - was AS delta FROM p WHERE was <> n AND was <> -1 AND n <> -1 ORDER BY p.day DESC, step_name LIMIT 50""")
def snapshot_changes(spark, d):
    """The last 50 changes of a daily count; -1 (every seventh day here) stands for a count that failed and makes no change."""
    s = metrics(spark, d).groupBy(F.date_trunc("day", "ts").alias("day"), "step_name").agg(n_rows().alias("n"))
    s = s.withColumn("n", F.when(F.dayofmonth("day") % 7 == 0, F.lit(-1).cast("bigint")).otherwise(c("n")))
    p = s.withColumn("was", F.lag("n").over(Window.partitionBy("step_name").orderBy("day")))
    p = p.where((c("was") != c("n")) & (c("was") != -1) & (c("n") != -1)).orderBy(F.desc("day"), "step_name").limit(50)
    return p.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "step_name", "was", "n", (c("n") - c("was")).alias("delta"))


@query(f"WITH {VALID}, a AS (SELECT DISTINCT (cluster_id // 10) % 5 AS run FROM acc), r AS (SELECT (cluster_id // 10) % 5 AS run, reason, len(ids) AS n FROM rej) SELECT run::INTEGER AS run, reason, count(*) AS clusters, sum(n)::BIGINT AS articles, 'INSUFFICIENT_QUALITY_STORIES' AS outcome FROM r WHERE run NOT IN (SELECT run FROM a) GROUP BY 1, 2")
def termination_report(spark, d):
    """Runs (the clusters of one verdict) that end without a story: their clusters and articles by the reason of rejection."""
    accepted, rejected = validated(candidates(spark, d))
    run = F.expr("(cluster_id div 10) % 5").cast("int").alias("run")
    r = rejected.select(run, "reason", F.size("ids").alias("n")).groupBy("run", "reason").agg(n_rows().alias("clusters"), F.sum("n").alias("articles"))
    return r.join(accepted.select(run).distinct(), "run", "left_anti").withColumn("outcome", F.lit("INSUFFICIENT_QUALITY_STORIES"))


# ---- lists and shapes -------------------------------------------------------------------------------------------------

ENUMS = {  # fixed values
    "status": ["PENDING_FETCH", "CONTENT_FETCHED", "PROCESSED", "SKIPPED_PDF", "FETCH_FAILED", "RENDER_FAILED", "AI_ANALYSIS_FAILED", "EMBEDDING_FAILED", "R2_UPLOAD_FAILED", "SKIPPED_TOO_OLD"],
    "completeness": ["COMPLETE", "PARTIAL_USEFUL", "PARTIAL_USELESS"],
    "content_quality": ["OK", "LOW_QUALITY", "JUNK"],
}


def optional_filters(**asked: str | None) -> Column:
    """A condition on each column whose value is a member of its list; other values are ignored."""
    cond = F.lit(True)
    for name, value in asked.items():
        if value in ENUMS[name]:
            cond = cond & F.coalesce(c(name) == value, F.lit(False))
    return cond


@query(f"""WITH {ARTICLES} SELECT source_name, count(*) FILTER (WHERE status = 'PROCESSED' AND completeness = 'COMPLETE' AND content_quality = 'OK') AS all_three, count(*) FILTER (WHERE status = 'FETCH_FAILED') AS one, count(*) AS ignored FROM articles GROUP BY 1""")
def source_filters(spark, d):
    a = articles(spark, d, labels=True)
    n = lambda **asked: F.count_if(optional_filters(**asked))
    return a.groupBy("source_name").agg(
        n(status="PROCESSED", completeness="COMPLETE", content_quality="OK").alias("all_three"),
        n(status="FETCH_FAILED", completeness="whole", content_quality=None).alias("one"), n(status="processed").alias("ignored"))


@query(f"WITH {ARTICLES} SELECT id, coalesce(event_summary_points[1], title) AS summary, {S.format(f'coalesce(CASE WHEN id % 13 <> 0 THEN publish_date END, {T})')} AS published FROM articles")
def brief_articles(spark, d):
    """A brief's articles; a date that is missing (every thirteenth here) is now."""
    date = F.coalesce(F.when(c("id") % 13 != 0, c("publish_date")), now())
    return articles(spark, d).select("id", F.coalesce(F.try_element_at("event_summary_points", F.lit(1)), c("title")).alias("summary"), text_of(date).alias("published"))


@query(f"""WITH {ARTICLES} SELECT source_name, count(*) FILTER (WHERE len(embedding) = {DIM}) AS valid, count(*) FILTER (WHERE len(embedding) = {DIM}) >= 2 AS enough FROM articles WHERE status = 'PROCESSED' GROUP BY 1""")
def dataset_sizes(spark, d):
    """Rows with a vector of the right width for each source, and whether they are the two that a dataset needs."""
    n = F.count_if(F.size("embedding") == DIM)
    return articles(spark, d, vectors=True).where(c("status") == "PROCESSED").groupBy("source_name").agg(n.alias("valid"), (n >= 2).alias("enough"))


@query(f"""WITH {REPORTS} SELECT id, coalesce(CASE WHEN id % 11 <> 0 THEN epoch_ms(created_at) END, 0) AS order_ms FROM reports""")
def report_list(spark, d):
    """All reports, newest first; one without a date (every eleventh here) counts as of 1970.  A range sort, not one task."""
    ms = F.coalesce(F.when(c("id") % 11 != 0, F.unix_millis("created_at")), F.lit(0).cast("bigint"))
    return reports(spark, d).select("id", ms.alias("order_ms")).orderBy(F.desc("order_ms"), "id")


@query("""WITH s AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label) SELECT e.label::BIGINT AS cluster_id, CASE WHEN vec_id % 3 = 0 THEN 'a' || vec_id::VARCHAR ELSE vec_id::VARCHAR END AS article_id, size FROM embeddings e JOIN s USING (label) WHERE e.label <> 0""")
def cluster_response(spark, d):
    """A clustering's answer as (cluster, article) rows: the id of an item's metadata counts, if it has one (every third here), else its own; label 0 is noise."""
    e = read(spark, d, "embeddings").where(c("label") != 0)
    meta = F.create_map(F.lit("id"), F.when(c("vec_id") % 3 == 0, F.concat(F.lit("a"), c("vec_id").cast("string"))).otherwise(""))
    items = e.select(c("label").cast("bigint").alias("cluster_id"), F.coalesce(F.nullif(meta["id"], F.lit("")), c("vec_id").cast("string")).alias("article_id"))
    return tables.join_groups(items, items.groupBy("cluster_id").agg(n_rows().alias("size")), "cluster_id", "article_id")
