"""Web pages: main text, clean-up, contents lists and fetch rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.bridge import read
from tidewire.functions import html as H
from tidewire.functions import text as X
from tidewire.operators import providers
from tidewire.plans.registry import query

c = F.col


@query()
def page_articles(spark, d):
    r = read(spark, d, "pages").select("page_id", "url", H.article(c("html")).alias("a"))
    return r.select("page_id", "url", "a.title", "a.text", "a.published", "a.error")


@query()
def clean_pages(spark, d):
    return read(spark, d, "pages").select("page_id", F.length("html").alias("before"), H.clean_page("html").alias("html"))


@query("""SELECT doc_id AS id, 1 AS position, 2 AS level, coalesce(lang, 'none') AS title, coalesce(lang, 'none') AS section FROM documents UNION ALL SELECT doc_id, 2, 3, coalesce(source, 'none'), coalesce(lang, 'none') FROM documents
UNION ALL SELECT doc_id, 3, 5, 'topic ' || doc_id::VARCHAR, coalesce(lang, 'none') FROM documents""")
def brief_contents(spark, d):
    lang, source = F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none"))
    page = F.concat(F.lit("<h3>orphan</h3><h2 id='a'>"), lang, F.lit("</h2><p>x</p><h3>"), source, F.lit("</h3><u> <strong>topic "), c("doc_id").cast("string"), F.lit("</strong></u>"))
    rows = read(spark, d, "documents").select(c("doc_id").alias("id"), F.inline(H.contents(page)))
    return rows.select("id", "position", "level", "title", "section")


@query()
def fetch_rounds(spark, d):
    """Queues of 100 pages, the most that one batch of messages holds."""
    p = read(spark, d, "pages").select(F.expr("page_id div 100").alias("queue"), c("page_id").alias("id"), X.host(c("url")).alias("host"))
    return providers.fetch_rounds(p)
