"""URLs by the rules of browsers: parse, check and write again.

Schemes with hosts (http, https, ftp, ws, wss) are parsed in full: white space at the ends and line breaks go, scheme
and host are lower-cased, back-slashes are slashes, default ports go, dot segments are resolved, and each part's unsafe
characters are percent-encoded.  Other schemes keep what follows the colon.  What can't be parsed is null.  Hosts keep
their Unicode letters (no Punycode), and numbers in other bases aren't read as addresses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default ports by scheme.
PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}


def _part(x: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(x, pattern, group)


def encoded(x: Column, unsafe: str) -> Column:
    """Percent-encodes controls, what isn't ASCII, and the characters of `unsafe` (a class without brackets)."""
    whole = rf"[\x00-\x20\x7f{unsafe}]|[^\x00-\x7f]"
    one = lambda ch: F.when(ch.rlike(f"(?s)^(?:{whole})$"), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(ch)
    return F.when(x.rlike(whole), F.array_join(F.transform(F.regexp_extract_all(x, F.lit("(?s).|\\n"), F.lit(0)), one), "")).otherwise(x)


def without_dots(path: Column) -> Column:
    """An absolute path with its `.` and `..` segments resolved."""
    low = lambda s: F.replace(F.lower(s), F.lit("%2e"), F.lit("."))
    parts = F.slice(F.split(path, "/"), 2, 1_000_000)
    step = lambda acc, s: F.when(low(s) == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(low(s) == ".", acc).otherwise(F.concat(acc, F.array(s)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    open_end = low(F.element_at(parts, -1)).isin(".", "..")
    return F.concat(F.lit("/"), F.array_join(F.when(open_end, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def parts(x: Column) -> dict[str, Column]:
    """scheme, login, host, port, path, query, fragment (null where absent), rest (other schemes), ok."""
    t = F.regexp_replace(F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    scheme = F.lower(_part(t, r"^([A-Za-z][A-Za-z0-9+.\-]*):"))
    special = scheme.isin(*PORTS)
    rest = F.regexp_replace(t, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    fragment = F.when(rest.contains("#"), _part(rest, r"(?s)^[^#]*#(.*)$"))
    bare = _part(rest, r"(?s)^([^#]*)")
    query = F.when(bare.contains("?"), _part(bare, r"(?s)^[^?]*\?(.*)$"))
    place = F.regexp_replace(F.replace(_part(bare, r"(?s)^([^?]*)"), F.lit("\\"), F.lit("/")), "^/+", "")
    authority, path = _part(place, r"^([^/]*)"), _part(place, r"(?s)^[^/]*(/.*)$")
    login = F.when(authority.contains("@"), _part(authority, r"^(.*)@"))
    address = _part(authority, r"([^@]*)$")
    raw = F.lower(_part(address, r"^(\[[^\]]*\]|[^:]*)"))
    host = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    port = _part(address, r"^(?:\[[^\]]*\]|[^:]*):(.*)$")
    number = F.coalesce(F.try_to_number(port, F.lit("99999")).cast("int"), F.lit(0))
    good = (host != "") & (host.rlike(r"^\[[0-9a-f:.]+\]$") | ~host.rlike(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")) & port.rlike(r"^[0-9]*$") & (F.length(port) < 6) & (number <= 65535)
    return {
        "scheme": scheme, "login": login, "host": host, "port": F.when((port != "") & (number.cast("string") != F.coalesce(_default(scheme), F.lit(""))), number.cast("string")),
        "path": encoded(without_dots(F.when(path == "", "/").otherwise(path)), '"<>`{}^'), "query": encoded(query, "\"<>'"), "fragment": encoded(fragment, '"<>`'), "special": special, "rest": rest,
        "ok": F.when(special, good).otherwise(scheme != "")}


def _default(scheme: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PORTS.items() for x in kv]), scheme)


def without_parameters(query: Column, gone: list[str]) -> Column:
    """The query less the named parameters, written as form data; null if none is left."""
    plain = lambda s: F.coalesce(F.try_url_decode(s), s)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    kept = F.filter(pairs, lambda p: ~plain(F.substring_index(p, "=", 1)).isin(gone))
    value = lambda p: F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")
    text = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(plain(F.substring_index(p, "=", 1))), F.lit("="), F.url_encode(plain(value(p))))), "&")
    return F.nullif(text, F.lit(""))


def serialised(x: Column, gone: list[str] | None = None) -> Column:
    """The URL as a browser writes it, less the query parameters in `gone`; null if it is none."""
    p = parts(x)
    query = without_parameters(p["query"], gone) if gone is not None else p["query"]
    tail = lambda mark, part: F.coalesce(F.concat(F.lit(mark), part), F.lit(""))
    whole = F.concat(p["scheme"], F.lit("://"), F.coalesce(F.concat(p["login"], F.lit("@")), F.lit("")), p["host"], tail(":", p["port"]), p["path"], tail("?", query), tail("#", p["fragment"]))
    return F.when(F.coalesce(p["ok"], F.lit(False)), F.when(p["special"], whole).otherwise(F.concat(p["scheme"], F.lit(":"), p["rest"])))
