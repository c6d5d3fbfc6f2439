"""What models answer, and what is made of it: JSON, briefs, Markdown, masked records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import WS, trim

# The stand-in for an answer that can't be read, headings of a report, notes and names of sensitive keys.
UNREADABLE = {"status": "incomplete", "reason": "响应格式解析失败", "availableInfo": "技术错误：无法解析AI响应格式"}
DEVELOPMENTS, PARTIES, IMPACT, OUTLOOK = "关键发展", "相关方", "影响评估", "前景展望"
BETWEEN = "\n---\n\n"
CUT_NOTE, VECTOR_NOTE = "...[截断]", "[向量数组,长度:"
SENSITIVE = r"(?i)api.*key|password|secret|token|credential|auth"
EMAIL_SHAPE, URL_SHAPE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$", r"^https?://[^\s/$.?#].[^\s]*$"


def intelligence_json(x: Column) -> Column:
    """Tag, else fence (open ends run to the end), else outer braces, else all; white space collapsed; the stand-in if it isn't JSON."""
    t = trim(x)
    part = (F.when(t.contains("<final_json>"), F.regexp_extract(t, r"(?s)<final_json>(.*?)(?:</final_json>|\z)", 1))
            .when(t.contains("```json"), F.regexp_extract(t, r"(?s)```json(.*?)(?:```|\z)", 1))
            .when(t.rlike(r"(?s)\{.*\}"), F.regexp_extract(t, r"(?s)(\{.*\})", 1)).otherwise(t))
    flat = trim(F.regexp_replace(part, rf"{WS}+", " "))
    stand_in = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in UNREADABLE.items()]))
    return F.when(F.try_parse_json(flat).isNotNull(), flat).otherwise(stand_in)


def two_way_json(x: Column) -> Column:
    """The JSON of an exact fenced block, whose failure is final, else of the whole text; null if it doesn't parse."""
    fence = r"(?s)```json\n(.*?)\n```"
    part = F.when(x.rlike(fence), F.regexp_extract(x, fence, 1)).otherwise(x)
    return F.when(F.try_parse_json(part).isNotNull(), part)


def final_brief(x: Column) -> Column:
    """What stands in the tag (open ends run to the end or the next tag); the whole answer if that is empty or there is no tag."""
    inside = trim(F.substring_index(F.get(F.split(x, "<final_brief>"), 1), "</final_brief>", 1))
    return F.when(x.contains("<final_brief>") & (inside != ""), inside).otherwise(x)


def bare(x: Column) -> Column:
    """A text without a fence of three backticks around all of it."""
    t = trim(x)
    return F.when(t.startswith("```") & t.endswith("```") & (F.length(t) >= 6), trim(F.substring(t, F.lit(4), F.length(t) - 6))).otherwise(t)


def story_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, "\n"), lambda line: trim(line) != ""))


def markdown(summary: Column, facts: Column, entities: Column, gaps: Column, outlook: Column) -> Column:
    """One report; entities: array of struct(name, role).  Empty and null parts are left out."""

    def listed(title: str, lines: Column) -> Column:
        text = F.concat(F.lit(f"## {title}\n"), F.array_join(F.transform(lines, lambda s: F.concat(F.lit("* "), s, F.lit("\n"))), ""), F.lit("\n"))
        return F.when(F.size(lines) > 0, text).otherwise("")

    people = F.transform(entities, lambda e: F.concat(e["name"], F.lit(" ("), e["role"], F.lit(")")))
    last = F.when(outlook.isNotNull(), F.concat(F.lit(f"## {OUTLOOK}\n"), outlook, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("# "), summary, F.lit("\n\n"), listed(DEVELOPMENTS, facts), listed(PARTIES, people), listed(IMPACT, gaps), last)


def masked(record: Column) -> Column:
    """map<string, string> with the values of sensitive keys hidden and others cut at 100 characters."""
    cut = lambda v: F.when(F.length(v) > 100, F.concat(F.substring(v, 1, 100), F.lit("..."))).otherwise(v)
    return F.transform_values(record, lambda k, v: F.when(k.rlike(SENSITIVE), F.lit("[REDACTED]")).otherwise(cut(v)))


def loggable(content: Column, most: int = 500) -> Column:
    return F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit(CUT_NOTE))).otherwise(content)


def vector_note(vector: Column) -> Column:
    return F.when(vector.isNotNull(), F.concat(F.lit(VECTOR_NOTE), F.size(vector).cast("string"), F.lit("]")))


def date_range_error(first: Column, last: Column) -> Column:
    """Why a pair of date texts is refused; null if it isn't.  Missing ends are open."""
    a, b = F.try_to_timestamp(first), F.try_to_timestamp(last)
    given = lambda x: x.isNotNull() & (x != "")
    return (F.when(given(first) & a.isNull(), "Invalid dateFrom format").when(given(last) & b.isNull(), "Invalid dateTo format").when(a > b, "dateFrom cannot be after dateTo"))


def template(text: str, **columns: Column) -> Column:
    """A prompt: text with {name} places filled by columns (null: empty)."""
    out = F.lit(text)
    for name, col in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(col.cast("string"), F.lit("")))
    return out
