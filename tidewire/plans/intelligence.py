"""Article analysis, story reports and briefs by rules that stand for a model."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidewire.bridge import ARTICLES, articles, read
from tidewire.operators import models
from tidewire.operators.ladder import ONCE, SERVICE, SPENT_QUOTA, Refused, Step, ladder
from tidewire.plans.registry import query
from tidewire.plans.vectors import VALID, candidates, validated

c = F.col


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM documents), n AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS k FROM n), a AS (SELECT doc_id, sum(n)::BIGINT AS words, count(*) AS kinds, string_agg(word, ',' ORDER BY k) FILTER (k <= 5) AS keywords FROM r GROUP BY doc_id)
SELECT d.doc_id AS id, lang AS language, coalesce(words, 0) AS words, coalesce(keywords, '') AS keywords, CASE WHEN length(text) >= 500 THEN 'COMPLETE' WHEN length(text) >= 100 THEN 'PARTIAL_USEFUL' ELSE 'PARTIAL_USELESS' END AS completeness,
CASE WHEN words IS NULL THEN 'JUNK' WHEN kinds * 5 < words THEN 'LOW_QUALITY' ELSE 'OK' END AS content_quality FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id""")
def article_analysis(spark, d):
    """Frequent long words of each article; counts are taken before the shuffle by article."""
    docs = read(spark, d, "documents").select("doc_id", "text", "lang")
    n = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    ranked = n.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word")))
    top = F.sort_array(F.collect_list(F.when(c("k") <= 5, F.struct("k", "word"))))
    a = ranked.groupBy("doc_id").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("kinds"), F.array_join(F.transform(top, lambda x: x["word"]), ",").alias("keywords"))
    size = F.length("text")
    return docs.join(a, "doc_id", "left").select(
        c("doc_id").alias("id"), c("lang").alias("language"), F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("keywords", F.lit("")).alias("keywords"),
        F.when(size >= 500, "COMPLETE").when(size >= 100, "PARTIAL_USEFUL").otherwise("PARTIAL_USELESS").alias("completeness"),
        F.when(c("words").isNull(), "JUNK").when(c("kinds") * 5 < c("words"), "LOW_QUALITY").otherwise("OK").alias("content_quality"))


def rungs() -> list[Step]:
    """Three providers: two that fail by the length of the text, for good or for a while, and one that is off for even lengths."""
    long = lambda k, r=0: lambda q: len(q["content"]) % k == r
    large = models.failing(models.analyst, [(long(5), 2, Refused("429 rate limit", 429)), (long(7), 9, Refused("context length of the model", 400)), (long(3, 1), 9, "I can't say.")])
    small = models.failing(models.analyst, [(long(11), 9, Refused("503 busy", 503))])
    return [Step("large", large, SPENT_QUOTA), Step("small", small, SERVICE), Step("rules", models.failing(models.analyst, [(long(2), 9, Refused("offline"))]), ONCE)]


@query(f"""WITH {ARTICLES}, a AS (SELECT id, title, content, length(content) AS n, coalesce(title, '') <> '' AND coalesce(content, '') <> '' AS asked FROM articles),
r AS (SELECT *, CASE WHEN NOT asked THEN 0 WHEN n % 7 <> 0 AND n % 3 <> 1 THEN 1 WHEN n % 11 <> 0 THEN 2 ELSE 3 END AS rung, CASE WHEN n % 5 = 0 THEN 3 ELSE 1 END AS first FROM a),
o AS (SELECT *, CASE rung WHEN 0 THEN 0 WHEN 1 THEN first WHEN 2 THEN first + 1 ELSE first + 4 END AS calls, CASE WHEN rung = 0 THEN 'title and content are required' WHEN rung = 3 AND n % 2 = 0 THEN 'offline' END AS error FROM r),
w AS (SELECT id, unnest(regexp_extract_all(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]{{6,}}')) AS word FROM a), f AS (SELECT id, word, count(*) AS n FROM w GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, word) AS k FROM f),
t AS (SELECT id, sum(n) AS words, count(*) AS kinds, string_agg(word, ',' ORDER BY k) FILTER (k <= 5) AS keywords FROM k GROUP BY id)
SELECT o.id, rung::INTEGER AS rung, calls::INTEGER AS calls, error, CASE WHEN error IS NULL THEN ['large', 'small', 'rules'][rung] END AS provider,
CASE WHEN error IS NULL THEN CASE WHEN o.n >= 500 THEN 'COMPLETE' WHEN o.n >= 100 THEN 'PARTIAL_USEFUL' ELSE 'PARTIAL_USELESS' END END AS completeness,
CASE WHEN error IS NULL THEN CASE WHEN words IS NULL THEN 'JUNK' WHEN kinds * 5 < words THEN 'LOW_QUALITY' ELSE 'OK' END END AS content_quality,
CASE WHEN error IS NULL THEN coalesce(keywords, '') END AS keywords, CASE WHEN error IS NULL THEN title END AS points FROM o LEFT JOIN t ON t.id = o.id""")
def article_ladder(spark, d):
    """Every article asks one provider after the other until an answer can be read; rows without title or content are not asked."""
    a = ladder(articles(spark, d).select("id", "title", "content"), models.analysis(), rungs(), wait=lambda seconds: None)
    v = "answer.value."
    return a.select("id", "answer.rung", "answer.calls", "answer.error", "answer.provider", v + "completeness", v + "content_quality", F.array_join(v + "thematic_keywords", ",").alias("keywords"), F.array_join(v + "event_summary_points", ",").alias("points"))


REPORT = f"""{VALID}, st AS (SELECT cluster_id, part, importance, unnest(ids) AS id FROM acc),
rep AS (SELECT cluster_id, part, 'Story ' || cluster_id::VARCHAR || '-' || part::VARCHAR AS title, any_value(importance) AS importance, count(*) AS articles, count(*) FILTER (text IS NOT NULL AND text <> '') AS found FROM st LEFT JOIN documents ON doc_id = id GROUP BY cluster_id, part),
repo AS (SELECT *, CASE WHEN found = articles THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS status FROM rep)"""


def story_reports(spark, d):
    """One report for each accepted story; a story that lacks an article's text is incomplete, not an error."""
    st = validated(candidates(spark, d))[0].select("cluster_id", "part", "importance", F.explode("ids").alias("doc_id"))
    text = read(spark, d, "documents").select("doc_id", (c("text") != "").alias("has"))
    g = st.join(text, "doc_id", "left").groupBy("cluster_id", "part").agg(F.first("importance").alias("importance"), F.count(F.lit(1)).alias("articles"), F.count_if("has").alias("found"))
    title = F.concat(F.lit("Story "), c("cluster_id").cast("string"), F.lit("-"), c("part").cast("string"))
    return g.withColumns({"title": title, "status": F.when(c("found") == c("articles"), "COMPLETE").otherwise("INCOMPLETE")})


@query(f"WITH {REPORT} SELECT cluster_id, part, importance, articles, found, title, status, 'Executive summary for ' || title AS executive_summary FROM repo")
def story_intelligence(spark, d):
    return story_reports(spark, d).select("cluster_id", "part", "importance", "articles", "found", "title", "status", F.concat(F.lit("Executive summary for "), "title").alias("executive_summary"))


@query(f"WITH {REPORT} SELECT count(*) AS total, count(*) FILTER (status = 'COMPLETE') AS completed, count(*) FILTER (status <> 'COMPLETE') AS failed, bool_and(status = 'COMPLETE') AS success FROM repo")
def intelligence_batch(spark, d):
    done = c("status") == "COMPLETE"
    return story_reports(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"), F.count_if(~done).alias("failed"), F.every(done).alias("success"))


@query(f"WITH {ARTICLES} SELECT id, title, 5 AS importance, substr(coalesce(content, ''), 1, 200) || '...' AS summary FROM articles")
def legacy_analysis(spark, d):
    return articles(spark, d).select("id", "title", F.lit(5).alias("importance"), F.concat(F.substring(F.coalesce("content", F.lit("")), 1, 200), F.lit("...")).alias("summary"))


# Names of a model's answers and what stands for missing ones.
STATUS = {"developing": "DEVELOPING", "escalating": "ESCALATING", "de-escalating": "DE_ESCALATING", "concluding": "CONCLUDING", "static": "STATIC"}
LEVEL = {"critical": "CRITICAL", "high": "HIGH", "moderate": "MODERATE", "medium": "MODERATE", "low": "LOW"}
RELIABILITY = {"very high": "VERY_HIGH", "high": "HIGH", "moderate": "MODERATE", "medium": "MODERATE", "low": "LOW", "very low": "VERY_LOW"}
ANALYSIS = ("status STRING, executiveSummary STRING, availableInfo STRING, storyStatus STRING, reason STRING, significance STRUCT<assessment: STRING, reasoning: STRING>, signalStrength STRUCT<assessment: STRING, reasoning: STRING>, "
            "entities ARRAY<STRUCT<name: STRING, type: STRING, role: STRING, positions: ARRAY<STRING>>>, factualBasis ARRAY<STRING>, informationGaps ARRAY<STRING>, gaps ARRAY<STRING>, contradictions ARRAY<STRUCT<issue: STRING, conflictingClaims: ARRAY<STRING>>>")


def _name(x: Column, table: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(x)), F.lit(default))


def _text(*options) -> Column:
    return F.coalesce(*[F.when(o != "", o) for o in options[:-1]], options[-1] if isinstance(options[-1], Column) else F.lit(options[-1]))


def report(title: Column, analysis: Column) -> Column:
    """A model's JSON answer as a full report; an unreadable answer or one marked incomplete gives null."""
    a = F.from_json(analysis, ANALYSIS)
    none = F.array().cast("array<string>")
    entity = lambda e: F.struct(_text(e["name"], "Unknown Entity").alias("name"), _text(e["type"], "Unknown").alias("type"), _text(e["role"], "Unknown Role").alias("role"), F.coalesce(e["positions"], none).alias("positions"))
    stand_in = F.array(F.struct(F.lit("Entity 1").alias("name"), F.lit("Organization").alias("type"), F.lit("Primary actor").alias("role"), F.array(F.lit("Position 1")).alias("positions")))
    clash = lambda x: F.struct(_text(x["issue"], "Contradiction").alias("issue"), F.coalesce(x["conflictingClaims"], none).alias("claims"))
    full = F.struct(
        _text(a["executiveSummary"], a["availableInfo"], F.concat(F.lit("Executive summary for "), title)).alias("executive_summary"), _name(a["storyStatus"], STATUS, "DEVELOPING").alias("story_status"),
        _name(a["significance"]["assessment"], LEVEL, "MODERATE").alias("level"), _text(a["significance"]["reasoning"], a["reason"], "Moderate impact on regional affairs").alias("reasoning"),
        _name(a["signalStrength"]["assessment"], RELIABILITY, "MODERATE").alias("reliability"), _text(a["signalStrength"]["reasoning"], "Minimal bias detected").alias("bias"),
        F.coalesce(F.transform(a["entities"], entity), stand_in).alias("entities"), F.coalesce(a["factualBasis"], F.array(F.lit("Fact 1"), F.lit("Fact 2"))).alias("facts"),
        F.coalesce(a["informationGaps"], a["gaps"], F.array(F.lit("Gap 1"))).alias("gaps"), F.coalesce(F.transform(a["contradictions"], clash), F.array().cast("array<struct<issue: string, claims: array<string>>>")).alias("contradictions"))
    return F.when(a.isNotNull() & F.coalesce(a["status"] != "incomplete", F.lit(True)), full)


@query("""SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'S' || doc_id::VARCHAR WHEN 1 THEN 'A' || doc_id::VARCHAR ELSE 'Executive summary for T' || doc_id::VARCHAR END AS executive_summary,
CASE doc_id % 4 WHEN 0 THEN 'ESCALATING' WHEN 1 THEN 'DE_ESCALATING' ELSE 'DEVELOPING' END AS story_status, CASE doc_id % 5 WHEN 0 THEN 'CRITICAL' ELSE 'MODERATE' END AS level,
CASE WHEN doc_id % 2 = 0 THEN 'Unknown' ELSE 'Organization' END AS entity_type, CASE WHEN doc_id % 2 = 0 THEN 'g' ELSE 'Gap 1' END AS gap, 2 AS facts FROM documents WHERE doc_id % 7 <> 6""")
def report_defaults(spark, d):
    i = c("doc_id")
    answer = F.to_json(F.struct(
        F.when(i % 7 == 6, "incomplete").alias("status"), F.when(i % 3 == 0, F.concat(F.lit("S"), i.cast("string"))).alias("executiveSummary"), F.when(i % 3 == 1, F.concat(F.lit("A"), i.cast("string"))).alias("availableInfo"),
        F.when(i % 4 == 0, "Escalating").when(i % 4 == 1, "de-escalating").when(i % 4 == 2, "odd").alias("storyStatus"), F.struct(F.when(i % 5 == 0, "critical").when(i % 5 == 1, "medium").alias("assessment")).alias("significance"),
        F.when(i % 2 == 0, F.array(F.struct(F.lit("E").alias("name")))).alias("entities"), F.when(i % 2 == 0, F.array(F.lit("g"))).alias("gaps")))
    r = read(spark, d, "documents").select(i.alias("id"), report(F.concat(F.lit("T"), i.cast("string")), answer).alias("r")).where("r is not null")
    return r.select("id", "r.executive_summary", "r.story_status", "r.level", F.get("r.entities", 0)["type"].alias("entity_type"), F.get("r.gaps", 0).alias("gap"), F.size("r.facts").alias("facts"))


@query(f"""WITH {REPORT}, b AS (SELECT cluster_id // 20 AS brief_id, count(*) AS reports, count(*) FILTER (status = 'COMPLETE') AS used, max(importance) FILTER (status = 'COMPLETE') AS top,
 string_agg('- ' || title || ' (' || importance::VARCHAR || ')', chr(10) ORDER BY importance DESC, cluster_id, part) FILTER (status = 'COMPLETE') AS body, list(title ORDER BY importance DESC, cluster_id, part) FILTER (status = 'COMPLETE') AS titles FROM repo GROUP BY 1)
SELECT brief_id, reports, used, CASE WHEN used > 0 THEN 'Brief ' || brief_id::VARCHAR || ': ' || titles[1] END AS title, CASE WHEN used > 0 THEN '## Stories' || chr(10) || body END AS content, CASE WHEN used > 0 THEN array_to_string(titles[1:3], '; ') END AS tldr, CASE WHEN used = 0 THEN 'NO_COMPLETE_REPORTS' END AS error FROM b""")
def brief_generation(spark, d):
    """A brief of 20 clusters' stories, so what is gathered for one is bounded; without a complete report it is an error."""
    r = story_reports(spark, d).withColumn("brief_id", F.expr("cluster_id div 20"))
    done = c("status") == "COMPLETE"
    g = r.groupBy("brief_id").agg(F.count(F.lit(1)).alias("reports"), F.count_if(done).alias("used"), F.sort_array(F.collect_list(F.when(done, F.struct((-c("importance")).alias("k"), "cluster_id", "part", "title")))).alias("s"))
    lines = F.array_join(F.transform("s", lambda x: F.concat(F.lit("- "), x["title"], F.lit(" ("), (-x["k"]).cast("string"), F.lit(")"))), "\n")
    some = c("used") > 0
    return g.select("brief_id", "reports", "used", F.when(some, F.concat(F.lit("Brief "), c("brief_id").cast("string"), F.lit(": "), F.get("s", 0)["title"])).alias("title"), F.when(some, F.concat(F.lit("## Stories\n"), lines)).alias("content"),
                    F.when(some, F.array_join(F.transform(F.slice("s", 1, 3), lambda x: x["title"]), "; ")).alias("tldr"), F.when(~some, "NO_COMPLETE_REPORTS").alias("error"))
