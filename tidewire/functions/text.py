"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import url

# White space as the reference's language has it, also for Java's (?U)\s.
WS = r"[\s ﻿]"
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid"]
GENERIC_PLACES = ["GLOBAL", "WORLD", "", "NONE", "N/A"]


def js_or(x: Column, default) -> Column:
    """x || default: null, '', 0 and false count as missing."""
    text = x.cast("string")
    return F.when(x.isNull() | text.isin("", "0", "0.0", "false", "NaN"), F.lit(default)).otherwise(x)


def trim(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{WS}+|{WS}+$", "")


def clean_string(x: Column) -> Column:
    """Runs of blanks to one, white space around line breaks away, ends trimmed."""
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, rf"\n{WS}+", "\n")
    x = F.regexp_replace(x, rf"{WS}+\n", "\n")
    return trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def clean_url(x: Column) -> Column:
    """The URL as a browser writes it, without tracking parameters; null if it is none."""
    return url.serialised(x, TRACKING)


def host(x: Column) -> Column:
    return F.lower(F.try_parse_url(x, F.lit("HOST")))


def search_text(title: Column, place: Column, points: Column, entities: Column, keywords: Column, tags: Column, focus: Column) -> Column:
    """Text to embed: the parts in fixed order, each ended by a period."""

    def cleaned(a: Column) -> Column:
        return F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), trim), lambda s: s != "")

    ended = F.transform(cleaned(points), lambda s: F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit("."))))
    where = trim(F.coalesce(place, F.lit("")))
    where = F.when(F.upper(where).isin(GENERIC_PLACES), "").otherwise(where)
    listed = F.array(trim(F.coalesce(title, F.lit(""))), where, F.array_join(ended, " "), *[F.array_join(cleaned(a), " ") for a in (entities, keywords, tags, focus)])
    parts = F.filter(listed, lambda s: s != "")
    joined = F.aggregate(parts, F.lit(""), lambda acc, s: F.when(acc == "", s).when(acc.endswith("."), F.concat(acc, F.lit(" "), s)).otherwise(F.concat(acc, F.lit(". "), s)))
    return F.when(joined == "", "").when(joined.endswith("."), joined).otherwise(F.concat(joined, F.lit(".")))


def story_id(title: Column, strict: bool = False) -> Column:
    """strict: every character but a-z and 0-9 becomes a dash; else runs of white space do."""
    low = F.lower(title)
    return F.concat(F.lit("story-"), F.regexp_replace(low, "[^a-z0-9]", "-") if strict else F.regexp_replace(low, rf"{WS}+", "-"))


def heading_slug(x: Column) -> Column:
    x = F.regexp_replace(F.lower(x), r"[^a-z0-9\s-]", "")
    return F.substring(F.regexp_replace(F.trim(x), r"\s+", "-"), 1, 50)


def report_slug(ts: Column) -> Column:
    return F.concat_ws("-", F.lower(F.date_format(ts, "MMMM")), F.dayofmonth(ts).cast("string"), F.year(ts).cast("string"))


def content_key(ts: Column, i: Column) -> Column:
    return F.concat_ws("/", F.year(ts).cast("string"), F.month(ts).cast("string"), F.dayofmonth(ts).cast("string"), F.concat(i.cast("string"), F.lit(".txt")))


def redact(x: Column) -> Column:
    return F.when(F.length(x) <= 8, F.concat(F.substring(x, 1, 2), F.lit("***"))).otherwise(F.concat(F.substring(x, 1, 4), F.lit("***"), F.right(x, F.lit(4))))


def limit_tokens(x: Column, most: int) -> Column:
    """Four characters count as a token."""
    return F.substring(x, 1, most * 4)


def truncated(x: Column, most: int = 20_000, marker: str = "...[truncated]") -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(marker))).otherwise(x)


def error_class(message: Column) -> Column:
    """First match of the fixed word lists."""
    m = F.lower(message)
    has = lambda *ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(m, w))
    return (F.when(has("timeout"), "timeout").when(has("network", "connection"), "network").when(has("unauthorized", "forbidden"), "authentication")
            .when(has("rate limit", "too many"), "rate_limit").when(has("invalid", "validation"), "validation").otherwise("unknown"))


def status_code(message: Column) -> Column:
    """The first run of three digits."""
    return F.nullif(F.regexp_extract(message, r"([0-9]{3})", 1), F.lit("")).cast("int")


def retryable(code: Column) -> Column:
    return (code.isin(408, 429) | code.between(500, 599))


def db_status(message: Column) -> Column:
    """HTTP status for a database error's message; letters count as they stand."""
    has = lambda *ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(message, w))
    return F.when(has("unique constraint", "duplicate"), 409).when(has("not found", "no such"), 404).when(has("permission", "unauthorized"), 401).otherwise(500)


# What tells a spent quota, and a request beyond the model's window.
QUOTA = ["quota", "limit", "rate limit", "throttle", "resource exhausted", "429", "too many requests", "exceeded", "context window", "token limit", "max_output_tokens must be positive", "insufficient quota", "billing", "usage limit"]
WINDOW = ["context window", "context length", "token limit", "exceeded", "input and maximum output tokens", "model context window limit", "sequence length", "maximum context length"]


def mentions(message: Column, words: list[str]) -> Column:
    """Whether the message holds one of the words, in any case; null: it doesn't."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(m, w))


def importance(x: Column) -> Column:
    """1 to 10; null and 0 mean 5."""
    return F.least(F.greatest(F.coalesce(F.nullif(x, F.lit(0)), F.lit(5)), F.lit(1)), F.lit(10))


def age_text(seconds: Column) -> Column:
    t = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    return F.when(seconds < 60, "just now").when(seconds < 3600, t(60, "m ago")).when(seconds < 86400, t(3600, "h ago")).otherwise(t(86400, "d ago"))


def mapped(x: Column, table: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(x)), F.lit(default))


def feed_date(x: Column) -> Column:
    """RFC 822 or ISO 8601 date, UTC; null if it is neither."""
    bare = F.regexp_replace(F.trim(x), r"^[A-Za-z]{3,9},\s*", "")
    formats = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in formats])


def llm_json(x: Column) -> Column:
    """JSON text in a model's answer: tag, fence, outer braces, whole text; null if none parses."""
    valid = lambda s: F.when(F.try_parse_json(s).isNotNull() & trim(s).rlike(r"^[\[{]"), trim(s))
    ways = [r"(?s)<final_json>(.*?)</final_json>", r"(?s)```json\s*(.*?)```", r"(?s)(\{.*\})"]
    return F.coalesce(*[valid(F.nullif(F.regexp_extract(x, w, 1), F.lit(""))) for w in ways], valid(x))


def article_block(title: Column, url: Column, number: Column, date: Column, content: Column) -> Column:
    """Linked heading with the number, quoted date, fenced text; a story's blocks are joined without a separator."""
    return F.concat(F.lit("## ["), title, F.lit("]("), url, F.lit(") (#"), number.cast("string"), F.lit(")\n\n> "), date, F.lit("\n\n```\n"), content, F.lit("\n```\n\n"))


# Seconds that a result stays, by capability.
KEPT_SECONDS = {"embedding": 7200, "image": 86_400, "vision": 3600, "audio": 7200}


def cache_key(capability: Column, provider: Column, model: Column, temperature: Column, max_tokens: Column, content: Column) -> Column:
    """Key of a request: the named parts and the first 16 digits of the hash of all that shapes its answer."""
    request = F.to_json(F.struct(capability.alias("capability"), model.alias("model"), temperature.alias("temperature"), max_tokens.alias("max_tokens"), content.alias("content")))
    return F.concat_ws(":", F.lit("aig_cache"), capability, F.coalesce(provider, F.lit("auto")), F.coalesce(model, F.lit("default")), F.substring(F.sha2(request, 256), 1, 16))


def cache_seconds(capability: Column, temperature: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in KEPT_SECONDS.items() for x in kv])
    chat = F.when(temperature.isNull() | (temperature < 0.1), 3600).otherwise(1800)
    return F.when(capability == "chat", chat).otherwise(F.coalesce(F.try_element_at(known, capability), F.lit(3600)))


def text_or(text: Column, title: Column, content: Column) -> Column:
    filled = lambda s: s.isNotNull() & (F.trim(s) != "")
    return F.when(filled(text), text).when(filled(content), F.concat(title, F.lit("\n"), content)).otherwise(title)
