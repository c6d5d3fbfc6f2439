"""Article selections, routing, paging, writes and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.bridge import ARTICLES, NOW, REPORTS, SOURCES, T, articles, hours_ago, now, read, reports, sources, text_of
from tidewire.functions import text as X
from tidewire.operators import tables
from tidewire.plans.registry import query

c = F.col
S = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query(f"""WITH {ARTICLES} SELECT id, url FROM articles WHERE processed_at IS NULL AND publish_date >= {T} - INTERVAL 48 HOUR AND fail_reason IS NULL AND id IN (SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings)""")
def process_candidates(spark, d):
    ids = read(spark, d, "labels").select(c("doc_id").alias("id")).unionByName(read(spark, d, "embeddings").select(c("vec_id").alias("id")))
    a = articles(spark, d).where(c("processed_at").isNull() & (c("publish_date") >= hours_ago(48)) & c("fail_reason").isNull())
    return a.join(ids, "id", "left_semi").select("id", "url")


def dataset(spark, d, ids: list[int] | None = None, since: str | None = None, until: str | None = None, days: int | None = 7):
    """Articles for a brief.  Ids win; else from/to, both inclusive; else the last days."""
    a = articles(spark, d, labels=True, vectors=True).where(c("embedding").isNotNull() & (c("status") == "PROCESSED") & c("content_file_key").isNotNull())
    if ids:
        return a.where(c("id").isin(ids))
    if since or until:
        if since:
            a = a.where(c("publish_date") >= F.lit(since).cast("timestamp"))
        return a.where(c("publish_date") <= F.lit(until).cast("timestamp")) if until else a
    return a.where(c("publish_date") >= hours_ago(24 * days)) if days else a


@query(f"""WITH {ARTICLES} SELECT id, title FROM articles WHERE embedding IS NOT NULL AND status = 'PROCESSED' AND content_file_key IS NOT NULL AND publish_date >= {T} - INTERVAL 7 DAY AND len(embedding) = 64 ORDER BY id LIMIT 30""")
def brief_dataset(spark, d):
    return dataset(spark, d).where(F.size("embedding") == 64).orderBy("id").limit(30).select("id", "title")


@query(f"""WITH {ARTICLES} SELECT id FROM articles WHERE embedding IS NOT NULL AND status = 'PROCESSED' AND content_file_key IS NOT NULL AND publish_date BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""")
def brief_dataset_range(spark, d):
    return dataset(spark, d, since="2024-01-10 00:00:00", until="2024-01-20 00:00:00").select("id")


@query(f"""WITH {ARTICLES} SELECT CASE WHEN publish_date > {T} - INTERVAL 48 HOUR THEN 'process' ELSE 'skip' END AS route, CASE WHEN publish_date > {T} - INTERVAL 48 HOUR THEN 'PENDING_FETCH' ELSE 'SKIPPED_TOO_OLD' END AS new_status, id FROM articles""")
def age_router(spark, d):
    fresh = F.coalesce(c("publish_date"), F.lit(0).cast("timestamp")) > hours_ago(48)
    return articles(spark, d).select(F.when(fresh, "process").otherwise("skip").alias("route"), F.when(fresh, "PENDING_FETCH").otherwise("SKIPPED_TOO_OLD").alias("new_status"), "id")


QUALITY = """CASE WHEN coalesce(content, '') = '' THEN 'EMPTY_CONTENT' WHEN length(content) < 2 * length(title) THEN 'INSUFFICIENT_LENGTH' WHEN trim(content) = trim(title) THEN 'TITLE_ONLY' WHEN content_quality IN ('LOW_QUALITY', 'JUNK') THEN 'MARKED_LOW_QUALITY' WHEN completeness = 'PARTIAL_USELESS' THEN 'MARKED_INCOMPLETE' END"""


def quality_reason():
    """Why an article is left out of a brief; null: it is valid.  The first match wins."""
    return (F.when(F.coalesce("content", F.lit("")) == "", "EMPTY_CONTENT").when(F.length("content") < 2 * F.length("title"), "INSUFFICIENT_LENGTH").when(F.trim("content") == F.trim("title"), "TITLE_ONLY")
            .when(c("content_quality").isin("LOW_QUALITY", "JUNK"), "MARKED_LOW_QUALITY").when(c("completeness") == "PARTIAL_USELESS", "MARKED_INCOMPLETE"))


@query(f"WITH {ARTICLES} SELECT coalesce('QUALITY_FILTER_' || {QUALITY}, 'VALID') AS reason, count(*) AS n FROM articles GROUP BY 1")
def quality_cascade(spark, d):
    reason = F.coalesce(F.concat(F.lit("QUALITY_FILTER_"), quality_reason()), F.lit("VALID"))
    return articles(spark, d, labels=True).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ARTICLES}, t AS (SELECT {QUALITY} AS r FROM articles WHERE status = 'PROCESSED') SELECT count(*) AS total, count(*) FILTER (WHERE r IS NULL) AS valid, round(count(*) FILTER (WHERE r IS NULL) * 100.0 / nullif(count(*), 0), 1)::DOUBLE AS pass_rate, count(*) FILTER (WHERE r = 'MARKED_INCOMPLETE') AS incomplete FROM t")
def dataset_failures(spark, d):
    t = articles(spark, d, labels=True).where(c("status") == "PROCESSED").select(quality_reason().alias("r"))
    ok = F.count_if(c("r").isNull())
    return t.agg(F.count(F.lit(1)).alias("total"), ok.alias("valid"), F.round(F.try_divide(ok * 100.0, F.count(F.lit(1))), 1).alias("pass_rate"), F.count_if(c("r") == "MARKED_INCOMPLETE").alias("incomplete"))


@query(f"""WITH {ARTICLES}, {SOURCES} SELECT a.id, CASE content_quality WHEN 'OK' THEN 'high' WHEN 'LOW_QUALITY' THEN 'low' ELSE 'medium' END AS relevance, 'N/A' AS location, lower(completeness) AS completeness, array_to_string(event_summary_points, chr(10)) AS summary,
coalesce(nullif(CASE WHEN s.id % 6 = 0 THEN '' ELSE a.source_name END, ''), 'Source ' || s.id::VARCHAR) AS source FROM articles a LEFT JOIN sources s ON s.name = a.source_name""")
def events_projection(spark, d):
    """A source without a name (every sixth here) is called by the source's own id."""
    own = sources(spark, d).select(c("name").alias("source_name"), c("id").alias("source_id"))
    a = articles(spark, d, labels=True).join(own, "source_name", "left").withColumn("source_name", F.when(c("source_id") % 6 == 0, "").otherwise(c("source_name")))
    return a.select(
        "id", F.when(c("content_quality") == "OK", "high").when(c("content_quality") == "LOW_QUALITY", "low").otherwise("medium").alias("relevance"), F.lit("N/A").alias("location"),
        F.coalesce(F.lower("completeness"), F.lit("null")).alias("completeness"), F.array_join("event_summary_points", "\n").alias("summary"),
        F.coalesce(F.nullif(c("source_name"), F.lit("")), F.concat(F.lit("Source "), c("source_id").cast("string"))).alias("source"))


def page(df, number: int, size: int, *order, most: int = 100):
    """Page from 1; size 1 to `most`, default 20."""
    size = min(max(size or 20, 1), most)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


@query(f"""WITH {ARTICLES}, p AS (SELECT id, title, status FROM articles ORDER BY created_at DESC, id LIMIT 20 OFFSET 20) SELECT *, (SELECT count(*) FROM p) AS total, (SELECT count(*) FROM articles) AS table_total FROM p""")
def paged_articles(spark, d):
    a = articles(spark, d)
    p = page(a, 2, 20, F.desc_nulls_last("created_at"), "id").select("id", "title", "status")
    return p.crossJoin(p.agg(F.count(F.lit(1)).alias("total"))).crossJoin(a.agg(F.count(F.lit(1)).alias("table_total")))


@query(f"""WITH {ARTICLES} SELECT id, (SELECT count(*) FROM articles WHERE status = 'PROCESSED') AS total, (SELECT ceil(count(*) / 500.0)::BIGINT FROM articles WHERE status = 'PROCESSED') AS pages FROM articles WHERE status = 'PROCESSED' ORDER BY publish_date DESC, id LIMIT 500""")
def events_page(spark, d):
    a = articles(spark, d).where(c("status") == "PROCESSED")
    n = a.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(c("total") / 500))
    return page(a, 1, 500, F.desc_nulls_last("publish_date"), "id", most=1000).select("id").crossJoin(n)


@query(f"""WITH {ARTICLES} SELECT id, title, status FROM articles WHERE source_name = 'src3' ORDER BY processed_at ASC NULLS LAST, id LIMIT 50""")
def source_articles_page(spark, d):
    return page(articles(spark, d).where(c("source_name") == "src3"), 1, 50, F.asc_nulls_last("processed_at"), "id").select("id", "title", "status")


@query(f"""WITH {ARTICLES} SELECT id, status FROM articles WHERE status IN ('FETCH_FAILED','RENDER_FAILED','AI_ANALYSIS_FAILED','EMBEDDING_FAILED','R2_UPLOAD_FAILED') ORDER BY publish_date DESC, id LIMIT 100""")
def failed_latest(spark, d):
    return articles(spark, d).where(c("status").isin(tables.FAILED)).orderBy(F.desc_nulls_last("publish_date"), "id").limit(100).select("id", "status")


@query(f"""WITH {ARTICLES} SELECT id, {S.format('created_at')} AS created FROM articles ORDER BY created_at DESC, id LIMIT 10""")
def latest_top_k(spark, d):
    return articles(spark, d).orderBy(F.desc_nulls_last("created_at"), "id").limit(10).select("id", text_of(c("created_at")).alias("created"))


@query(f"""WITH {ARTICLES} SELECT id FROM articles WHERE status = 'PROCESSED' AND embedding IS NOT NULL AND publish_date >= {T} - INTERVAL 7 DAY ORDER BY publish_date DESC, id LIMIT 10""")
def recent_embedded(spark, d):
    return dataset(spark, d).orderBy(F.desc_nulls_last("publish_date"), "id").limit(10).select("id")


@query(f"""WITH {ARTICLES} SELECT id FROM articles WHERE publish_date::DATE = DATE '2024-01-15' AND status = 'PROCESSED'""")
def day_articles(spark, d):
    p = c("publish_date")
    return articles(spark, d).where((p >= F.lit("2024-01-15").cast("timestamp")) & (p < F.lit("2024-01-16").cast("timestamp")) & (c("status") == "PROCESSED")).select("id")


@query(f"""WITH {REPORTS} SELECT id FROM reports WHERE created_at BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-16'""")
def day_reports(spark, d):
    return reports(spark, d).where(c("created_at").between(F.lit("2024-01-15").cast("timestamp"), F.lit("2024-01-16").cast("timestamp"))).select("id")


ENUM = ["PENDING_FETCH", "CONTENT_FETCHED", "PROCESSED", "SKIPPED_PDF", "FETCH_FAILED", "RENDER_FAILED", "AI_ANALYSIS_FAILED", "EMBEDDING_FAILED", "R2_UPLOAD_FAILED", "SKIPPED_TOO_OLD"]


def with_status(df, status: str | None):
    """Filter by status; a value that is no status is ignored."""
    return df.where(c("status") == status) if status in ENUM else df


@query(f"""WITH {ARTICLES} SELECT (SELECT count(*) FROM articles WHERE status = 'PROCESSED') AS valid, (SELECT count(*) FROM articles) AS ignored""")
def status_filter(spark, d):
    a = articles(spark, d)
    n = lambda s, name: with_status(a, s).agg(F.count(F.lit(1)).alias(name))
    return n("PROCESSED", "valid").crossJoin(n("no-such-status", "ignored"))


# Hosts that are fetched by a browser at once.
TRICKY = ["reuters.com", "nytimes.com", "politico.com", "science.org", "alarabiya.net", "reason.com", "telegraph.co.uk", "lawfaremedia", "liberation.fr", "france24.com"]


@query("""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, lower(url) LIKE '%.pdf' AS is_pdf, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) IN ('reuters.com','nytimes.com','politico.com','science.org','alarabiya.net','reason.com','telegraph.co.uk','lawfaremedia','liberation.fr','france24.com') AS use_browser FROM pages""")
def url_predicates(spark, d):
    return read(spark, d, "pages").select("page_id", X.host(c("url")).alias("host"), F.lower("url").endswith(".pdf").alias("is_pdf"), F.coalesce(X.host(c("url")).isin(TRICKY), F.lit(False)).alias("use_browser"))


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS b, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q, regexp_extract(url, '(#.*)$', 1) AS f FROM pages),
k AS (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid'], split_part(x, '=', 1))) AS kept FROM p)
SELECT page_id, b || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END || f AS url FROM k""")
def clean_urls(spark, d):
    return read(spark, d, "pages").select("page_id", X.clean_url(c("url")).alias("url"))


@query(f"WITH {ARTICLES} SELECT id, substr(content, 1, 500) AS preview, coalesce(event_summary_points[1], title) AS summary, CASE WHEN len(event_summary_points) > 0 THEN event_summary_points ELSE [title] END AS points FROM articles")
def article_preview(spark, d):
    p = c("event_summary_points")
    return articles(spark, d).select("id", F.substring("content", 1, 500).alias("preview"), F.coalesce(F.try_element_at(p, F.lit(1)), c("title")).alias("summary"), F.when(F.size(p) > 0, p).otherwise(F.array("title")).alias("points"))


BLOBS = "blobs AS (SELECT content_file_key AS key, CASE WHEN id % 4 = 1 THEN '' ELSE content END AS body FROM articles WHERE content_file_key IS NOT NULL AND id % 6 <> 2)"


def blobs(spark, d):
    """Stored texts: some are missing and some are empty."""
    return articles(spark, d).where(c("content_file_key").isNotNull() & (c("id") % 6 != 2)).select(c("content_file_key").alias("key"), F.when(c("id") % 4 == 1, "").otherwise(c("content")).alias("body"))


@query(f"""WITH {ARTICLES}, {BLOBS} SELECT a.id, CASE WHEN a.content_file_key IS NULL THEN 'NO_KEY' WHEN b.key IS NULL THEN 'R2_CONTENT_MISSING' WHEN b.body = '' THEN 'EMPTY_R2_CONTENT' ELSE 'FOUND' END AS state, length(b.body) AS size FROM articles a LEFT JOIN blobs b ON b.key = a.content_file_key""")
def blob_join(spark, d):
    j = articles(spark, d).select("id", "content_file_key").join(blobs(spark, d), c("content_file_key") == c("key"), "left")
    state = F.when(c("content_file_key").isNull(), "NO_KEY").when(c("key").isNull(), "R2_CONTENT_MISSING").when(c("body") == "", "EMPTY_R2_CONTENT").otherwise("FOUND")
    return j.select("id", state.alias("state"), F.length("body").cast("bigint").alias("size"))


@query(f"""WITH {ARTICLES}, {BLOBS}, t AS (SELECT id, content_file_key FROM articles ORDER BY created_at DESC, id LIMIT 10) SELECT count(*) FILTER (WHERE b.body <> '') AS found, count(*) FILTER (WHERE t.content_file_key IS NOT NULL AND b.key IS NULL) AS not_found, count(*) FILTER (WHERE t.content_file_key IS NULL) AS no_key, coalesce(sum(length(b.body)), 0)::BIGINT AS chars FROM t LEFT JOIN blobs b ON b.key = t.content_file_key""")
def content_availability(spark, d):
    t = articles(spark, d).orderBy(F.desc_nulls_last("created_at"), "id").limit(10).select("id", "content_file_key")
    j = t.join(blobs(spark, d), c("content_file_key") == c("key"), "left")
    return j.agg(F.count_if(c("body") != "").alias("found"), F.count_if(c("content_file_key").isNotNull() & c("key").isNull()).alias("not_found"), F.count_if(c("content_file_key").isNull()).alias("no_key"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("chars"))


@query(f"""WITH {ARTICLES}, r AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 100 AS batch FROM articles WHERE status = 'PENDING_FETCH') SELECT batch::BIGINT AS batch, list(id ORDER BY id) AS ids FROM r GROUP BY 1""")
def queue_batches(spark, d):
    return tables.batches(articles(spark, d).where(c("status") == "PENDING_FETCH").select("id"))


@query(f"""WITH {ARTICLES} SELECT id FROM articles WHERE status = 'PENDING_FETCH'""")
def queue_flatten(spark, d):
    return queue_batches(spark, d).select(F.explode("ids").alias("id"))


INCOMING = "incoming AS (SELECT page_id, 'https://src' || (page_id % 25)::VARCHAR || '.example.com/' || (page_id * 5 % 400)::VARCHAR AS url FROM pages UNION ALL SELECT page_id + 100000, 'https://new.example.com/' || (page_id % 60)::VARCHAR FROM pages)"


def incoming(spark, d):
    p = read(spark, d, "pages").select("page_id")
    old = p.select("page_id", F.concat(F.lit("https://src"), (c("page_id") % 25).cast("string"), F.lit(".example.com/"), (c("page_id") * 5 % 400).cast("string")).alias("url"))
    return old.unionByName(p.select((c("page_id") + 100000).alias("page_id"), F.concat(F.lit("https://new.example.com/"), (c("page_id") % 60).cast("string")).alias("url")))


@query(f"""WITH {ARTICLES}, {INCOMING} SELECT min(page_id) AS page_id, url FROM incoming WHERE url NOT IN (SELECT url FROM articles) GROUP BY url""")
def insert_ignore(spark, d):
    return tables.insert_ignore(articles(spark, d).select("url"), incoming(spark, d), "url", "page_id").select("page_id", "url")


@query(f"""WITH {ARTICLES}, {INCOMING}, ins AS (SELECT url FROM incoming WHERE url NOT IN (SELECT url FROM articles) GROUP BY url) SELECT page_id FROM incoming WHERE page_id % 2 = 0 AND url IN (SELECT url FROM ins)""")
def inserted_to_process(spark, d):
    return incoming(spark, d).where(c("page_id") % 2 == 0).join(insert_ignore(spark, d).select("url"), "url", "left_semi").select("page_id")


@query("""WITH k AS (SELECT c_custkey AS id, 'reader' || (c_custkey // 3)::VARCHAR || '@example.com' AS email, c_custkey % 4 = 1 AS old FROM customer) SELECT min(id) AS id, email FROM k WHERE NOT old AND email NOT IN (SELECT email FROM k WHERE old) GROUP BY email""")
def newsletter_signup(spark, d):
    """Every fourth address is subscribed already; addresses that try again, or twice, are inserted once or not at all."""
    i = c("c_custkey")
    k = read(spark, d, "customer").select(i.alias("id"), F.concat(F.lit("reader"), F.expr("c_custkey div 3").cast("string"), F.lit("@example.com")).alias("email"))
    return tables.insert_ignore(k.where(c("id") % 4 == 1), k.where(c("id") % 4 != 1), "email", "id")


@query(f"""WITH {ARTICLES} SELECT id, CASE WHEN id % 11 = 0 THEN 'SKIPPED_PDF' WHEN id % 7 = 0 THEN 'FETCH_FAILED' WHEN id % 5 = 0 THEN 'CONTENT_FETCHED' WHEN id % 13 = 0 THEN 'AI_ANALYSIS_FAILED' WHEN id % 17 = 0 THEN 'EMBEDDING_FAILED' WHEN id % 19 = 0 THEN 'R2_UPLOAD_FAILED' ELSE 'PROCESSED' END AS status FROM articles WHERE status = 'PENDING_FETCH'""")
def status_transitions(spark, d):
    i = c("id")
    s = tables.next_status(i % 11 == 0, i % 7 != 0, F.when(i % 5 != 0, i % 13 != 0), i % 17 != 0, i % 19 != 0)
    return articles(spark, d).where(c("status") == "PENDING_FETCH").select("id", s.alias("status"))


@query(f"""WITH {ARTICLES}, r AS (SELECT id, CASE WHEN hit THEN 'PENDING_FETCH' ELSE status END AS status, CASE WHEN NOT hit THEN fail_reason END AS fail_reason, CASE WHEN NOT hit THEN {S.format('processed_at')} END AS processed FROM (SELECT *, status LIKE '%FAILED' AND id % 3 = 0 AS hit FROM articles))
SELECT status, count(*) AS n, count(fail_reason) AS reasons, count(processed) AS processed FROM r GROUP BY status""")
def retry_reset(spark, d):
    a = articles(spark, d)
    done = tables.reset_failed(a, a.where(c("status").endswith("_FAILED") & (c("id") % 3 == 0)).select("id"))
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("fail_reason").alias("reasons"), F.count("processed_at").alias("processed"))


@query(f"""WITH {SOURCES}, new AS (SELECT 'https://n' || n_nationkey::VARCHAR || '.example.com/feed' AS url FROM nation UNION ALL SELECT url FROM sources WHERE id <= 3)
SELECT url, CASE WHEN url IN (SELECT url FROM sources) THEN 409 ELSE 201 END AS code, 'Unknown' AS name, 'unknown' AS category, 1 AS scrape_frequency FROM new""")
def source_create(spark, d):
    s = sources(spark, d)
    new = read(spark, d, "nation").select(F.concat(F.lit("https://n"), c("n_nationkey").cast("string"), F.lit(".example.com/feed")).alias("url")).unionByName(s.where(c("id") <= 3).select("url"))
    have = s.select("url", F.lit(1).alias("_h"))
    return new.join(have, "url", "left").select("url", F.when(c("_h").isNotNull(), 409).otherwise(201).alias("code"), F.lit("Unknown").alias("name"), F.lit("unknown").alias("category"), F.lit(1).alias("scrape_frequency"))


@query(f"""WITH {SOURCES} SELECT id, CASE WHEN id % 2 = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN id % 3 = 0 THEN 4 ELSE scrape_frequency END AS scrape_frequency FROM sources""")
def source_update(spark, d):
    """Falsy fields of an update are ignored."""
    s = sources(spark, d).withColumns({"_name": F.when(c("id") % 2 == 0, "renamed").otherwise(""), "_freq": F.when(c("id") % 3 == 0, 4).otherwise(0)})
    pick = lambda new, old: F.when(new.cast("string").isin("", "0"), old).otherwise(new)
    return s.select("id", pick(c("_name"), c("name")).alias("name"), pick(c("_freq"), c("scrape_frequency")).alias("scrape_frequency"))


@query(f"""WITH {ARTICLES}, {SOURCES} SELECT (SELECT count(*) FROM sources WHERE id % 4 <> 0) AS sources, (SELECT count(*) FROM articles WHERE source_name NOT IN (SELECT name FROM sources WHERE id % 4 = 0)) AS articles""")
def cascade_delete(spark, d):
    s = sources(spark, d)
    left, kept = tables.cascade_delete(s, articles(spark, d), s.where(c("id") % 4 == 0))
    return left.agg(F.count(F.lit(1)).alias("sources")).crossJoin(kept.agg(F.count(F.lit(1)).alias("articles")))


# ---- text functions over whole tables -------------------------------------------------------------------------------

_END = "CASE WHEN {0} = '' OR {0} LIKE '%.' THEN {0} ELSE {0} || '.' END"


@query(f"""WITH {ARTICLES}, p AS (SELECT id, trim(title, ' ' || chr(9) || chr(13) || chr(160)) AS t, array_to_string(list_transform(list_filter(list_transform(event_summary_points, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(160))), lambda x: x <> ''), lambda x: CASE WHEN x LIKE '%.' THEN x ELSE x || '.' END), ' ') AS p, CASE WHEN id % 3 = 0 THEN 'Paris' ELSE '' END AS w, array_to_string(topic_tags, ' ') AS g FROM articles),
j AS (SELECT id, list_reduce(list_filter([t, w, p, g], lambda x: x <> ''), lambda a, x: a || CASE WHEN a LIKE '%.' THEN ' ' ELSE '. ' END || x) AS s FROM p) SELECT id, CASE WHEN s LIKE '%.' THEN s ELSE s || '.' END AS search_text FROM j""")
def search_text(spark, d):
    none = F.array().cast("array<string>")
    place = F.when(c("id") % 3 == 0, " Paris ").otherwise("global")
    return articles(spark, d).select("id", X.search_text(c("title"), place, c("event_summary_points"), none, none, c("topic_tags"), none).alias("search_text"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n[\s\x{00a0}\x{feff}]+', chr(10), 'g'), '[\s\x{00a0}\x{feff}]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x{00a0}\x{feff}]+|[\s\x{00a0}\x{feff}]+$', '', 'g') AS cleaned FROM documents""")
def clean_strings(spark, d):
    return read(spark, d, "documents").select("doc_id", X.clean_string(c("text")).alias("cleaned"))


@query(f"""WITH {ARTICLES}, {REPORTS} SELECT 'story' AS kind, id, 'story-' || regexp_replace(lower(title), '[^a-z0-9]', '-', 'g') AS v FROM articles UNION ALL SELECT 'heading', id, substr(regexp_replace(trim(regexp_replace(lower(title), '[^a-z0-9\\s-]', '', 'g'), ' ' || chr(9) || chr(13)), '\\s+', '-', 'g'), 1, 50) FROM articles
UNION ALL SELECT 'report', id, lower(strftime(created_at, '%B')) || '-' || day(created_at)::VARCHAR || '-' || year(created_at)::VARCHAR FROM reports UNION ALL SELECT 'key', id, year(created_at)::VARCHAR || '/' || month(created_at)::VARCHAR || '/' || day(created_at)::VARCHAR || '/' || id::VARCHAR || '.txt' FROM articles""".replace("\\\\", "\\"))
def slugs(spark, d):
    a = articles(spark, d)
    part = lambda k, t, v: t.select(F.lit(k).alias("kind"), "id", v.alias("v"))
    return part("story", a, X.story_id(c("title"), strict=True)).unionByName(part("heading", a, X.heading_slug(c("title")))).unionByName(part("report", reports(spark, d), X.report_slug(c("created_at")))).unionByName(part("key", a, X.content_key(c("created_at"), c("id"))))


@query("""SELECT c_custkey AS id, CASE WHEN length(c_name) <= 8 THEN substr(c_name, 1, 2) || '***' ELSE substr(c_name, 1, 4) || '***' || right(c_name, 4) END AS name, CASE WHEN length(c_mktsegment) <= 8 THEN substr(c_mktsegment, 1, 2) || '***' ELSE substr(c_mktsegment, 1, 4) || '***' || right(c_mktsegment, 4) END AS segment FROM customer""")
def redaction(spark, d):
    return read(spark, d, "customer").select(c("c_custkey").alias("id"), X.redact(c("c_name")).alias("name"), X.redact(c("c_mktsegment")).alias("segment"))


MESSAGES = ["Request timeout after 30s", "Network connection lost", "401 Unauthorized", "429 rate limit reached", "Invalid body", "boom 503", "duplicate key value", "no such table", "quota exceeded 429", "", "Forbidden: permission denied", "Too Many Requests", "author unknown", "unique index, not found", "unauthorized user", "sequence length over 4096"]


@query("""WITH m AS (SELECT event_id, ['Request timeout after 30s', 'Network connection lost', '401 Unauthorized', '429 rate limit reached', 'Invalid body', 'boom 503', 'duplicate key value', 'no such table', 'quota exceeded 429', '', 'Forbidden: permission denied', 'Too Many Requests', 'author unknown', 'unique index, not found', 'unauthorized user', 'sequence length over 4096'][event_id % 16 + 1] AS m FROM events),
x AS (SELECT event_id, m, lower(m) AS l, nullif(regexp_extract(m, '([0-9]{3})', 1), '')::INTEGER AS code FROM m)
SELECT event_id, CASE WHEN contains(l, 'timeout') THEN 'timeout' WHEN contains(l, 'network') OR contains(l, 'connection') THEN 'network' WHEN contains(l, 'unauthorized') OR contains(l, 'forbidden') THEN 'authentication' WHEN contains(l, 'rate limit') OR contains(l, 'too many') THEN 'rate_limit' WHEN contains(l, 'invalid') OR contains(l, 'validation') THEN 'validation' ELSE 'unknown' END AS class, code,
coalesce(code IN (408, 429) OR code BETWEEN 500 AND 599, false) AS retry, CASE WHEN contains(m, 'duplicate') OR contains(m, 'unique constraint') THEN 409 WHEN contains(m, 'not found') OR contains(m, 'no such') THEN 404 WHEN contains(m, 'unauthorized') OR contains(m, 'permission') THEN 401 ELSE 500 END AS http,
regexp_matches(l, 'quota|limit|throttle|resource exhausted|429|too many requests|exceeded|context window|max_output_tokens must be positive|billing') AS quota, regexp_matches(l, 'context window|context length|token limit|exceeded|input and maximum output tokens|sequence length') AS beyond_window FROM x""")
def error_class(spark, d):
    m = F.element_at(F.array(*[F.lit(x) for x in MESSAGES]), (c("event_id") % 16 + 1).cast("int"))
    e = read(spark, d, "events").select("event_id", m.alias("m"))
    return e.select("event_id", X.error_class(c("m")).alias("class"), X.status_code(c("m")).alias("code"), F.coalesce(X.retryable(X.status_code(c("m"))), F.lit(False)).alias("retry"), X.db_status(c("m")).alias("http"), X.mentions(c("m"), X.QUOTA).alias("quota"), X.mentions(c("m"), X.WINDOW).alias("beyond_window"))


@query(f"""WITH {ARTICLES}, s AS (SELECT id, epoch({T})::BIGINT - epoch(publish_date)::BIGINT AS s FROM articles) SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60)::VARCHAR || 'm ago' WHEN s < 86400 THEN (s // 3600)::VARCHAR || 'h ago' ELSE (s // 86400)::VARCHAR || 'd ago' END AS age, least(greatest(coalesce(nullif(id % 14, 0), 5), 1), 10) AS importance FROM s""")
def ages(spark, d):
    return articles(spark, d).select("id", X.age_text(F.unix_timestamp(now()) - F.unix_timestamp("publish_date")).alias("age"), X.importance(c("id") % 14).alias("importance"))


# Names of the levels.
STORY_STATUS = {"developing": "DEVELOPING", "escalating": "ESCALATING", "de-escalating": "DE_ESCALATING", "concluding": "CONCLUDING", "static": "STATIC"}


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'ESCALATING' WHEN 'purchase' THEN 'DE_ESCALATING' WHEN 'signup' THEN 'CONCLUDING' WHEN 'error' THEN 'STATIC' ELSE 'DEVELOPING' END AS story_status FROM events""")
def enum_maps(spark, d):
    kind = c("event_type")
    raw = F.when(kind == "view", F.when(c("event_id") % 2 == 0, "Developing").otherwise("no such level")).when(kind == "click", "ESCALATING").when(kind == "purchase", "De-Escalating").when(kind == "signup", "concluding").when(kind == "error", "static")
    return read(spark, d, "events").select("event_id", X.mapped(raw, STORY_STATUS, "DEVELOPING").alias("story_status"))


@query("""SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN '{"a":' || turn::VARCHAR || '}' WHEN 1 THEN '{"a":' || turn::VARCHAR || '}' WHEN 2 THEN '{"a":' || turn::VARCHAR || '}' END AS json FROM conversations""")
def llm_json(spark, d):
    body = F.concat(F.lit('{"a":'), c("turn").cast("string"), F.lit("}"))
    k = (c("conv_id") + c("turn")) % 4
    said = F.when(k == 0, F.concat(F.lit("so <final_json>"), body, F.lit("</final_json> ok"))).when(k == 1, F.concat(F.lit("x ```json\n"), body, F.lit("\n``` y"))).when(k == 2, F.concat(F.lit("well "), body, F.lit(" done"))).otherwise(F.lit("no json {here"))
    return read(spark, d, "conversations").select("conv_id", "turn", X.llm_json(said).alias("json"))


@query(f"""WITH {ARTICLES} SELECT id, length(substr(content, 1, 2000)) AS capped, length(CASE WHEN length(content) > 5000 THEN substr(content, 1, 5000) || '...[truncated]' ELSE content END) AS shortened, title || chr(10) || chr(10) || substr(content, 1, 500) || '...' AS article, '## [' || title || '](' || url || ') (#' || id::VARCHAR || ')' || chr(10) || chr(10) || '> ' || strftime(publish_date, '%Y-%m-%d %H:%M:%S') || chr(10) || chr(10) || '```' || chr(10) || substr(content, 1, 200) || chr(10) || '```' || chr(10) || chr(10) AS block,
 CASE WHEN id % 3 = 0 THEN 'own text' WHEN trim(coalesce(content, '')) <> '' THEN title || chr(10) || substr(content, 1, 50) ELSE title END AS chosen FROM articles""")
def text_limits(spark, d):
    a = articles(spark, d)
    return a.select("id", F.length(X.limit_tokens(c("content"), 500)).cast("bigint").alias("capped"), F.length(X.truncated(c("content"), 5000)).cast("bigint").alias("shortened"), F.concat("title", F.lit("\n\n"), F.substring("content", 1, 500), F.lit("...")).alias("article"), X.article_block(c("title"), c("url"), c("id"), text_of(c("publish_date")), F.substring("content", 1, 200)).alias("block"),
                    X.text_or(F.when(c("id") % 3 == 0, "own text").when(c("id") % 3 == 1, "  "), c("title"), F.substring("content", 1, 50)).alias("chosen"))


@query("""SELECT o_orderkey AS id, greatest(1, least(coalesce(nullif(o_custkey, 0), 1024), 1024))::BIGINT AS tokens, round(greatest(1, least(coalesce(nullif(o_custkey, 0), 1024), 1024)) * CASE o_orderstatus WHEN 'O' THEN 0.00002 WHEN 'F' THEN 0.00005 ELSE 0.0 END, 6)::DOUBLE AS cost FROM orders""")
def token_cost(spark, d):
    prices = spark.createDataFrame([("O", 0.00002), ("F", 0.00005)], "o_orderstatus string, price double")  # fixed values
    o = read(spark, d, "orders").withColumn("tokens", F.greatest(F.lit(1), F.least(F.coalesce(F.nullif(c("o_custkey"), F.lit(0)), F.lit(1024)), F.lit(1024))).cast("bigint"))
    return o.join(F.broadcast(prices), "o_orderstatus", "left").select(c("o_orderkey").alias("id"), "tokens", F.round(c("tokens") * F.coalesce("price", F.lit(0.0)), 6).alias("cost"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'embedding' ELSE 'image' END AS capability, CASE WHEN event_id % 2 = 0 THEN 'model-' || (event_id % 5)::VARCHAR END AS model, CASE event_id % 4 WHEN 0 THEN '0.0' WHEN 1 THEN '0.7' END AS temperature, event_type AS content FROM events)
SELECT event_id, 'aig_cache:' || capability || ':auto:' || coalesce(model, 'default') || ':' || substr(sha256('{"capability":"' || capability || '"' || coalesce(',"model":"' || model || '"', '') || coalesce(',"temperature":' || temperature, '') || ',"max_tokens":256,"content":"' || content || '"}'), 1, 16) AS cache_key,
CASE capability WHEN 'embedding' THEN 7200 WHEN 'image' THEN 86400 ELSE CASE WHEN coalesce(temperature, '0.0') = '0.0' THEN 3600 ELSE 1800 END END AS seconds FROM r""")
def cache_key(spark, d):
    i = c("event_id")
    capability = F.when(i % 3 == 0, "chat").when(i % 3 == 1, "embedding").otherwise("image")
    model, temperature = F.when(i % 2 == 0, F.concat(F.lit("model-"), (i % 5).cast("string"))), F.when(i % 4 == 0, 0.0).when(i % 4 == 1, 0.7)
    key = X.cache_key(capability, F.lit(None).cast("string"), model, temperature, F.lit(256), c("event_type"))
    return read(spark, d, "events").select(i, key.alias("cache_key"), X.cache_seconds(capability, temperature).alias("seconds"))
