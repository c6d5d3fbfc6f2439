"""RSS, Atom and RDF feeds as rows, by from_xml with declared layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text as X

ITEM = "title STRING, link STRING, guid STRING, pubDate STRING, published STRING, updated STRING"
RSS = f"channel STRUCT<item: ARRAY<STRUCT<{ITEM.replace(' STRING', ': STRING')}>>>"
ATOM_ITEM = "title: STRING, link: ARRAY<STRUCT<_href: STRING, _VALUE: STRING>>, id: STRING, pubDate: STRING, published: STRING, updated: STRING"
ATOM = f"entry ARRAY<STRUCT<{ATOM_ITEM}>>"
RDF = f"item ARRAY<STRUCT<{ITEM.replace(' STRING', ': STRING')}>>"


def every_item(x: Column) -> Column:
    """array of struct(title, link, date) of a feed's items, whichever layout it has; null for text that is no feed."""
    opts = {"mode": "PERMISSIVE"}
    plain = lambda a: F.transform(a, lambda i: F.struct(i["title"].alias("title"), F.coalesce(i["link"], i["guid"]).alias("link"), F.coalesce(i["pubDate"], i["published"], i["updated"]).alias("date")))
    atom = lambda a: F.transform(a, lambda i: F.struct(i["title"].alias("title"), F.coalesce(F.get(i["link"], 0)["_href"], F.get(i["link"], 0)["_VALUE"], i["id"]).alias("link"), F.coalesce(i["pubDate"], i["published"], i["updated"]).alias("date")))
    return F.coalesce(plain(F.from_xml(x, RSS, opts)["channel"]["item"]), atom(F.from_xml(x, ATOM, opts)["entry"]), plain(F.from_xml(x, RDF, opts)["item"]))


def items(feeds: DataFrame, xml_col: str = "xml") -> DataFrame:
    """feeds' other columns, title, link, pub_date, rejected: one row for each item; text that is no feed has none.

    A missing title is UNKNOWN and a link that is no URL is null; bad items are marked, not thrown, so one of them doesn't lose its feed.
    """
    own = [c for c in feeds.columns if c != xml_col]
    one = feeds.select(*own, F.explode(every_item(F.col(xml_col))).alias("_i"))
    title = X.clean_string(F.coalesce("_i.title", F.lit("UNKNOWN")))
    link = X.clean_url(F.col("_i.link"))
    return one.select(*own, title.alias("title"), link.alias("link"), X.feed_date(F.col("_i.date")).alias("pub_date"), ((title == "") | X.host(link).isNull()).alias("rejected"))
