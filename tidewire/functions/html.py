"""Page clean-up, main text of a page, and the contents list of a brief."""

from __future__ import annotations

import html as entities
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewire.functions import text as X

# Elements and classes whose whole content goes, roles, void elements, attributes that stay, elements that go when blank.
DROPPED = {"script", "style", "iframe", "aside", "nav", "form"}
DROPPED_CLASSES = {"ad", "ads", "advertisement", "share", "comments", "related", "recommended", "newsletter", "subscription", "modal", "modal-backdrop"}
DROPPED_ROLES = {"complementary", "banner", "navigation"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
KEPT_ATTRIBUTES = {"href", "src", "alt", "title"}
BLANKED = {"div", "span", "p", "section", "article"}
BLOCKS = {"p", "div", "article", "main", "section", "li", "ul", "ol", "td", "tr", "table", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "header", "body"}
LEAVES = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "td", "blockquote"}
UNREAD = {"noscript", "template"}  # beside the dropped ones, where a text is read


CLOSES = {"p": BLOCKS - {"td", "body"}, "li": {"li"}, "td": {"td", "tr"}, "th": {"td", "tr"}, "tr": {"tr"}, "option": {"option"}, "dt": {"dd", "dt"}, "dd": {"dd", "dt"}}  # what ends an element without an end tag


def _unwanted(tag: str, attrs: dict, open_: list[str]) -> bool:
    """Whether an element goes with all that it holds; open_: the elements around it.  Headers and footers stay inside articles."""
    classes, ident = attrs.get("class") or "", attrs.get("id") or ""
    if tag in DROPPED or DROPPED_CLASSES & set(classes.split()) or attrs.get("role") in DROPPED_ROLES or "social" in classes or "social" in ident:
        return True
    if tag in ("header", "footer"):
        return "article" not in open_
    names = f"{classes} {ident}".lower()
    fixed = tag == "div" and open_[-1:] == ["body"] and "position: fixed" in (attrs.get("style") or "")
    return fixed or tag in ("div", "section") and ("paywall" in names or "subscribe" in names)


class _Cleaner(HTMLParser):
    """Writes the page again without what is dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.skip: list[str] = []
        self.open: list[str] = []  # elements written and not yet ended
        self.begun: list[int] = []  # where each of them begins in out
        self.said: list[bool] = []  # whether it holds more than white space

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        while self.skip and tag in CLOSES.get(self.skip[-1], ()):
            self.skip.pop()
        while not self.skip and self.open and tag in CLOSES.get(self.open[-1], ()):
            self._end()
        if self.skip or _unwanted(tag, a, self.open):
            if tag not in VOID:
                self.skip.append(tag)
            return
        stay = {k: v for k, v in a.items() if k in KEPT_ATTRIBUTES}
        if tag == "meta" and len(stay) < 2:
            return
        if tag not in VOID:
            self.open.append(tag)
            self.begun.append(len(self.out))
            self.said.append(False)
        self.out.append("<" + tag + "".join(f' {k}="{entities.escape(v or "")}"' for k, v in stay.items()) + ">")

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def _end(self) -> tuple[str, bool]:
        """Closes the innermost element; it goes if it is blank.  (its name, whether it stays)"""
        tag, at, said = self.open.pop(), self.begun.pop(), self.said.pop()
        if said and self.said:
            self.said[-1] = True
        blank = tag in BLANKED and not said
        if blank:
            del self.out[at:]
        return tag, not blank

    def handle_endtag(self, tag):
        if tag in self.skip:
            while self.skip.pop() != tag:
                pass
        elif tag not in VOID and (not self.skip or tag in self.open):
            self.skip.clear()  # the end of what it lies in ends a dropped element, too
            if tag in self.open:
                while (ended := self._end())[0] != tag:
                    pass
                if ended[1]:
                    self.out.append(f"</{tag}>")

    def close(self):
        super().close()
        while self.open:
            self._end()

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)
            if self.said and entities.unescape(data).strip():
                self.said[-1] = True

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def clean_one(page: str | None) -> str | None:
    if page is None:
        return None
    p = _Cleaner()
    p.feed(page)
    p.close()
    return "".join(p.out)


class _Reader(HTMLParser):
    """Text runs with the blocks that they lie in."""

    def __init__(self):
        super().__init__()
        self.open: list[tuple[str, int]] = []
        self.parent: dict[int, int] = {}
        self.tag: dict[int, str] = {}
        self.runs: list[tuple[int, str]] = []
        self.score: dict[int, float] = {}
        self.title, self.heading, self.published = "", "", None

    def at(self) -> int:
        return next((n for t, n in reversed(self.open) if t in BLOCKS), -1)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta":
            name = a.get("property") or a.get("name") or ""
            if name == "og:title" and not self.title:
                self.title = a.get("content") or ""
            if name in ("article:published_time", "date", "pubdate") and not self.published:
                self.published = a.get("content")
        if tag == "time" and not self.published:
            self.published = a.get("datetime")
        if tag in VOID:
            if tag == "br":
                self.runs.append((self.at(), "\n"))
            return
        if tag in BLOCKS and self.open and any(t == "p" for t, _ in self.open):
            while self.open.pop()[0] != "p":
                pass
        n = len(self.tag)
        self.parent[n], self.tag[n] = self.at(), tag
        self.open.append(("drop" if tag in UNREAD or _unwanted(tag, a, [t for t, _ in self.open]) else tag, n))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.tag[self.open[i][1]] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if "title" in tags:
            self.title += data
        elif "drop" not in tags:
            if "h1" in tags:
                self.heading += data
            n = self.at()
            self.runs.append((n, data))
            holder = self.parent[n] if n >= 0 and self.tag[n] in LEAVES else n
            worth = len(data.strip()) * (-0.5 if "a" in tags else 1.0)
            self.score[holder] = self.score.get(holder, 0.0) + worth
            if holder >= 0 and self.parent[holder] >= 0:
                up = self.parent[holder]
                self.score[up] = self.score.get(up, 0.0) + worth / 2


def read_one(page: str | None) -> tuple:
    """(title, text, published, error): the text of the block with the most running text."""
    p = _Reader()
    p.feed(page or "")
    p.close()
    named = [n for n, s in p.score.items() if n >= 0 and p.tag[n] in ("article", "main") and s > 0]
    best = max(named or p.score, key=lambda n: (p.score[n], -n), default=None)
    title = (p.title or p.heading).strip()
    if best is None:
        return title or None, None, p.published, "NO_ARTICLE"

    def under(n: int) -> bool:
        while n >= 0 and n != best:
            n = p.parent[n]
        return n == best

    within: dict[int, bool] = {}
    parts, last = [], None
    for n, run in p.runs:
        if within.setdefault(n, under(n)):
            parts.append(run if n == last or last is None else "\n" + run)
            last = n
    text = "".join(parts).strip()
    return title or None, text or None, p.published, "NO_TITLE" if not title else None if text else "NO_TEXT"


@F.pandas_udf(StringType())
def clean_page(pages: pd.Series) -> pd.Series:
    return pages.map(clean_one, na_action="ignore")


@F.pandas_udf(StructType([StructField(n, StringType()) for n in ("title", "text", "published", "error")]))
def _read(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_one(p) for p in pages], columns=["title", "text", "published", "error"])


def article(page: Column) -> Column:
    """struct title, text, published, error; null or empty pages have the error NO_ARTICLE."""
    r = _read(page)
    return F.struct(r["title"].alias("title"), X.clean_string(r["text"]).alias("text"), r["published"].alias("published"), r["error"].alias("error"))


def contents(page: Column) -> Column:
    """Headings as array of struct(position, level, title, section): h2 opens a section, h3 and underlined strong text are
    topics of the section before them; topics before any section go.  Works within the row, without a shuffle."""
    found = F.regexp_extract_all(page, F.lit(r"(?is)<h2\b[^>]*>.*?</h2>|<h3\b[^>]*>.*?</h3>|<u\b[^>]*>\s*<strong\b[^>]*>.*?</strong>"), F.lit(0))
    level = lambda x: F.when(F.lower(F.substring(x, 1, 3)) == "<h2", 2).when(F.lower(F.substring(x, 1, 3)) == "<h3", 3).otherwise(5)
    items = F.transform(found, lambda x, i: F.struct(i.alias("position"), level(x).alias("level"), F.trim(F.regexp_replace(x, "<[^>]*>", "")).alias("title")))
    section = lambda x: F.get(F.reverse(F.filter(items, lambda y: (y["level"] == 2) & (y["position"] <= x["position"]))), 0)["title"]
    nested = F.transform(items, lambda x: F.struct(x["position"].alias("position"), x["level"].alias("level"), x["title"].alias("title"), section(x).alias("section")))
    return F.filter(nested, lambda x: x["section"].isNotNull())
