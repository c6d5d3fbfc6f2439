"""Model answers, briefs and records: extraction, rendering, masking, checked inserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidewire.bridge import ARTICLES, METRICS, articles, metrics, read
from tidewire.functions import answers as A
from tidewire.plans.registry import query

c = F.col


def _said(*forms):
    """One of the forms for each turn of a conversation, by (conv_id + turn) modulo their number."""
    k, out = (c("conv_id") + c("turn")) % len(forms), None
    for i, f in enumerate(forms):
        out = F.when(k == i, f) if out is None else out.when(k == i, f)
    return out


N = object()  # the place of the turn's number


def _text(*parts):
    return F.concat(*[c("turn").cast("string") if p is N else F.lit(p) for p in parts])


BAD = '{"status":"incomplete","reason":"响应格式解析失败","availableInfo":"技术错误：无法解析AI响应格式"}'


@query(f"""SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN '{{"status": "ok", "n": ' || turn || '}}' WHEN 1 THEN '{{"status":"open","n":' || turn || '}}' WHEN 2 THEN '{{"n":' || turn || '}}' WHEN 3 THEN '{{"a": {{"n":' || turn || '}}}}' WHEN 4 THEN '{BAD}' ELSE '{BAD}' END AS json FROM conversations""")
def intelligence_json(spark, d):
    said = _said(
        _text("so <final_json>\n{\"status\": \"ok\",\n \"n\": ", N, "}\n</final_json> {\"x\": 1}"), _text("<final_json>{\"status\":\"open\",\"n\":", N, "}"), _text("x ```json\n{\"n\":", N, "}\n``` y {"),
        _text("well {\"a\": {\"n\":", N, "}} done"), _text("no json {here", N), _text("```json\n{\"n\": } ```", N))
    return read(spark, d, "conversations").select("conv_id", "turn", A.intelligence_json(said).alias("json"))


@query("""SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN '{"n":' || turn || '}' WHEN 1 THEN '{"n":' || turn || '}' END AS json FROM conversations""")
def two_way_json(spark, d):
    said = _said(_text("x ```json\n{\"n\":", N, "}\n``` y"), _text("{\"n\":", N, "}"), _text("```json {\"n\":", N, "} ```"), _text("```json\n{\"n\":\n``` {\"n\":", N, "}"), _text("text {\"n\":", N, "}"))
    return read(spark, d, "conversations").select("conv_id", "turn", A.two_way_json(said).alias("json"))


@query("""SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'brief ' || turn WHEN 1 THEN 'open ' || turn WHEN 2 THEN '<final_brief> </final_brief> rest ' || turn ELSE 'plain ' || turn END AS brief, CASE (conv_id + turn) % 2 WHEN 0 THEN 'a' || chr(10) || chr(10) || ' b ' || turn ELSE 'c ' || turn || '```' END AS tldr,
CASE (conv_id + turn) % 2 WHEN 0 THEN 2 ELSE 1 END AS stories FROM conversations""")
def brief_extracts(spark, d):
    said = _said(_text("x <final_brief>\nbrief ", N, "\n</final_brief> y"), _text("<final_brief>open ", N), _text("<final_brief> </final_brief> rest ", N), _text("plain ", N))
    tldr = A.bare(_said(_text(" ```\na\n\n b ", N, "\n```\n"), _text("c ", N, "```")))
    return read(spark, d, "conversations").select("conv_id", "turn", A.final_brief(said).alias("brief"), tldr.alias("tldr"), A.story_count(tldr).alias("stories"))


REPORT_MD = f"""md AS (SELECT doc_id, doc_id // 20 AS brief_id, '# Summary ' || doc_id || chr(10) || chr(10) || CASE WHEN doc_id % 3 > 0 THEN '## {A.DEVELOPMENTS}' || chr(10) || array_to_string(list_transform(range(doc_id % 3), lambda k: '* fact ' || k || chr(10)), '') || chr(10) ELSE '' END
 || CASE WHEN doc_id % 2 > 0 THEN '## {A.PARTIES}' || chr(10) || '* ' || source || ' (' || lang || ')' || chr(10) || chr(10) ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN '## {A.IMPACT}' || chr(10) || '* gap' || chr(10) || chr(10) ELSE '' END
 || CASE WHEN doc_id % 5 <> 0 THEN '## {A.OUTLOOK}' || chr(10) || 'outlook ' || doc_id || chr(10) || chr(10) ELSE '' END AS text FROM documents)"""


@query(f"WITH {REPORT_MD} SELECT brief_id, count(*) AS reports, string_agg(text, chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id) AS markdown FROM md GROUP BY brief_id")
def report_markdown(spark, d):
    """Every report of a brief (20 documents) is rendered, with a rule between."""
    i, k = c("doc_id"), (c("doc_id") % 3).cast("int")
    none = F.array().cast("array<string>")
    facts = F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda x: F.concat(F.lit("fact "), x.cast("string")))).otherwise(none)
    entities = F.filter(F.array(F.struct(c("source").alias("name"), c("lang").alias("role"))), lambda e: i % 2 > 0)
    gaps = F.when(i % 4 == 0, F.array(F.lit("gap"))).otherwise(none)
    outlook = F.when(i % 5 != 0, F.concat(F.lit("outlook "), i.cast("string")))
    one = A.markdown(F.concat(F.lit("Summary "), i.cast("string")), facts, entities, gaps, outlook)
    g = read(spark, d, "documents").select(i, F.expr("doc_id div 20").alias("brief_id"), one.alias("text")).groupBy("brief_id")
    rows = F.sort_array(F.collect_list(F.struct("doc_id", "text")))  # at most 20
    return g.agg(F.count(F.lit(1)).alias("reports"), F.array_join(F.transform(rows, lambda x: x["text"]), A.BETWEEN).alias("markdown"))


@query(f"""SELECT doc_id, length(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '{A.CUT_NOTE}' ELSE text END) AS n, CASE WHEN embedding IS NOT NULL THEN '{A.VECTOR_NOTE}' || len(embedding) || ']' END AS vector,
CASE WHEN doc_id % 4 < 3 THEN '[REDACTED]' ELSE 'v' || doc_id END AS named, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS plain FROM documents LEFT JOIN embeddings ON vec_id = doc_id""")
def masked_records(spark, d):
    """Records before they are logged: long texts cut, vectors noted by length, values of sensitive keys hidden."""
    e = read(spark, d, "embeddings").select(c("vec_id").alias("doc_id"), "embedding")
    key = F.get(F.array(*[F.lit(x) for x in ("API_Key", "user_password", "AuthHeader", "title")]), (c("doc_id") % 4).cast("int"))
    t = read(spark, d, "documents").select("doc_id", "text").join(e, "doc_id", "left").withColumn("key", key)
    t = t.withColumn("m", A.masked(F.create_map(c("key"), F.concat(F.lit("v"), c("doc_id").cast("string")), F.lit("name"), c("text"))))
    return t.select("doc_id", F.length(A.loggable(c("text"))).cast("bigint").alias("n"), A.vector_note(c("embedding")).alias("vector"), F.try_element_at("m", c("key")).alias("named"), F.try_element_at("m", F.lit("name")).alias("plain"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'Invalid dateFrom format' WHEN o_orderkey % 7 = 0 THEN 'Invalid dateTo format' WHEN o_orderkey % 6 <> 0 AND o_orderdate > TIMESTAMP '1996-01-01' THEN 'dateFrom cannot be after dateTo' END AS error FROM orders""")
def date_ranges(spark, d):
    i = c("o_orderkey")
    first = F.when(i % 5 == 0, "2024-13-45").when(i % 6 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    last = F.when(i % 7 == 0, "soon").otherwise("1996-01-01")
    return read(spark, d, "orders").select(i.alias("id"), A.date_range_error(first, last).alias("error"))


@query("""SELECT c_custkey AS id, c_custkey % 3 = 0 AS email, c_custkey % 2 = 0 AS url, c_custkey % 4 < 2 AS origin FROM customer""")
def request_shapes(spark, d):
    """Shapes of addresses and URLs, and whether an origin is on the list."""
    i = c("c_custkey")
    mail = F.when(i % 3 == 0, F.concat(F.lit("a"), i.cast("string"), F.lit("@b.example"))).when(i % 3 == 1, "a@b").otherwise("a b@c.d")
    url = F.when(i % 2 == 0, "https://host.example/x?y").otherwise("ftp:/host")
    origin = F.get(F.array(*[F.lit(x) for x in ("https://one.example", "https://two.example", "https://one.example.evil", "")]), (i % 4).cast("int"))
    return read(spark, d, "customer").select(i.alias("id"), mail.rlike(A.EMAIL_SHAPE).alias("email"), url.rlike(A.URL_SHAPE).alias("url"), origin.isin("https://one.example", "https://two.example").alias("origin"))


@query(f"""WITH {ARTICLES}, ds AS (SELECT id, title, url, substr(content, 1, 80) AS summary FROM articles WHERE embedding IS NOT NULL), m AS (SELECT id, event_summary_points AS p FROM articles WHERE status = 'PROCESSED' AND embedding IS NOT NULL)
SELECT ds.id, ds.title, ds.url, array_to_string(CASE WHEN len(p) > 0 THEN p ELSE [summary] END, chr(10)) AS points, coalesce(len(p), 0) = 0 AS fallback FROM ds LEFT JOIN m ON m.id = ds.id""")
def summary_fallback(spark, d):
    """Dataset articles with the stored summary points, or else with their own summary; no limit on the stored ones."""
    a = articles(spark, d, vectors=True).where(c("embedding").isNotNull())
    ds = a.select("id", "title", "url", F.substring("content", 1, 80).alias("summary"))
    stored = a.where(c("status") == "PROCESSED").select("id", c("event_summary_points").alias("p"))
    has = F.coalesce(F.size("p") > 0, F.lit(False))
    return ds.join(stored, "id", "left").select("id", "title", "url", F.array_join(F.when(has, c("p")).otherwise(F.array("summary")), "\n").alias("points"), (~has).alias("fallback"))


# The fields that a posted report must have, text first, then numbers.
REPORT_TEXTS, REPORT_NUMBERS = ["title", "content", "tldr", "createdAt", "model_author"], ["totalArticles", "totalSources", "usedArticles", "usedSources"]


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'title' WHEN o_orderkey % 7 = 0 THEN 'totalArticles' WHEN o_orderkey % 11 = 0 THEN 'createdAt' END AS refused, CASE WHEN o_orderkey % 6 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN (o_orderkey % 40)::DOUBLE END AS total_articles FROM orders""")
def checked_reports(spark, d):
    """Posted reports: the first field that is missing or of the wrong kind refuses one; the others can be inserted."""
    i = c("o_orderkey")
    q = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    text = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    fields = [F.when(i % 6 != 0, q("title", text(F.concat(F.lit("Brief "), i.cast("string"))))), q("content", text(F.lit("c"))), q("tldr", text(F.lit("t"))), q("model_author", text(F.lit("m"))),
              q("createdAt", text(F.when(i % 11 == 0, "never").otherwise("2024-01-05T00:00:00Z"))), q("totalArticles", F.when(i % 7 == 0, F.lit('"many"')).otherwise((i % 40).cast("string"))), *[q(n, F.lit("1")) for n in REPORT_NUMBERS[1:]]]
    posted = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    kind = StructType([*[StructField(n, StringType()) for n in REPORT_TEXTS], *[StructField(n, DoubleType()) for n in REPORT_NUMBERS]])
    r = read(spark, d, "orders").select(i.alias("id"), F.from_json(posted, kind).alias("r"))
    wrong = lambda n: F.try_to_timestamp(c(f"r.{n}")).isNull() if n == "createdAt" else c(f"r.{n}").isNull()
    refused = F.coalesce(*[F.when(wrong(n), n) for n in ("title", "totalArticles", "createdAt", *[x for x in REPORT_TEXTS + REPORT_NUMBERS if x not in ("title", "totalArticles", "createdAt")])])
    return r.withColumn("refused", refused).select("id", "refused", F.when(c("refused").isNull(), c("r.totalArticles")).alias("total_articles"))


@query(f"""WITH {METRICS}, r AS (SELECT step_name, event_id, duration, row_number() OVER (PARTITION BY step_name ORDER BY duration DESC, event_id) AS rank FROM metrics) SELECT step_name, rank, event_id, round(duration, 3) AS duration FROM r WHERE rank <= 10""")
def slowest_steps(spark, d):
    """The ten slowest events of each step; rows beyond ten are dropped before the shuffle."""
    w = Window.partitionBy("step_name").orderBy(F.desc("duration"), "event_id")
    return metrics(spark, d).select("step_name", "event_id", "duration", F.row_number().over(w).cast("bigint").alias("rank")).where(c("rank") <= 10).select("step_name", "rank", "event_id", F.round("duration", 3).alias("duration"))


@query(f"""WITH {ARTICLES} SELECT id, 'Title: ' || title || chr(10) || 'Source: ' || source_name || chr(10) || 'Reason: ' || coalesce(fail_reason, '') || chr(10) AS prompt FROM articles""")
def prompts(spark, d):
    """A template filled from each row."""
    return articles(spark, d).select("id", A.template("Title: {title}\nSource: {source}\nReason: {reason}\n", title=c("title"), source=c("source_name"), reason=c("fail_reason")).alias("prompt"))
