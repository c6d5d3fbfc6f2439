"""Secret scan through a trigram inverted index, in DataFrame functions alone.

Each rule's regular expression is read once on the driver and turned into a Boolean query: an OR of ANDs of trigrams
that any match must contain (lower case on both sides).  The index has a posting (trigram, document) for every
trigram that some query names; postings are intersected per conjunction, joined per rule, and the candidates are
verified by the expression itself.  A rule without mandatory trigrams (bare hexadecimal runs) scans every document.

Cases: a null text counts as empty; rows with equal or null ids share their candidate rules, which are verified on
each row's own text; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # understood alike by java.util.regex and by the analysis below
    group: int = 0  # whose length counts
    least: int = 1  # code points of that group


# The base rules, then the rules that the method adds.
BASE_RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
]
MORE_RULES = [
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
]

MOST_STRINGS = 64


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i:i + 3] for i in range(len(s) - 2))


def _any(queries: list[list[frozenset]] | None) -> list[frozenset] | None:
    """OR of DNFs; None means that nothing is mandatory."""
    if any(q is None for q in queries):
        return None
    return list(dict.fromkeys(c for q in queries for c in q))


def _all(a, b):
    if a is None or b is None:
        return b if a is None else a
    return list(dict.fromkeys(x | y for x in a for y in b))


def _of_strings(strings: set[str]) -> list[frozenset] | None:
    return None if any(len(s) < 3 for s in strings) else _any([[_grams(s)] for s in sorted(strings)])


def _walk(nodes) -> tuple[set[str] | None, list[frozenset] | None]:
    """(the strings that the nodes can match if they are few, the trigram query)."""
    exact: set[str] | None = {""}
    query, run = None, {""}  # run: the strings that end the part read so far
    for op, arg in nodes:
        name, part, own = str(op), None, None
        if name == "LITERAL":
            part = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            part = {chr(x).lower() for _, x in arg}
        elif name == "SUBPATTERN":
            part, own = _walk(arg[3])
        elif name == "BRANCH":
            both = [_walk(b) for b in arg[1]]
            part = set().union(*(e for e, _ in both)) if all(e is not None for e, _ in both) else None
            own = _any([q if q is not None else (_of_strings(e) if e else None) for e, q in both])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            e, q = _walk(inner)
            if e is not None and most == 1 and least == 0:
                part = e | {""}
            elif e is not None and least == most and least <= 8:
                part = {""}
                for _ in range(least):
                    part = {x + y for x in part for y in e}
            else:
                own = q if least else None
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            part = {""}
        if part is not None and len(run) * len(part) <= MOST_STRINGS:
            run = {x + y for x in run for y in part}
            exact = None if exact is None else {x + y for x in exact for y in part}
            continue
        query = _all(_all(query, _of_strings(run)), own if part is None else _of_strings(part))
        exact, run = None, {""}
    query = _all(query, _of_strings(run))
    return exact, query


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of conjunctions of trigrams that every match contains in lower case; None: no trigram is mandatory."""
    return _walk(sre.parse(pattern))[1]


def postings(df: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, _key) for each of the trigrams and each row that holds it."""
    low = df.select("_key", F.lower("_t").alias("_low"))
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("_low"), t))
    return low.select("_key", F.explode(held).alias("trigram"))


def candidates(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(_key, rules): the indexed rules whose trigram query the row meets."""
    clauses = [(r.kind, i, t, len(c)) for r in rules for i, c in enumerate(trigram_query(r.pattern) or []) for t in sorted(c)]
    need = df.sparkSession.createDataFrame(clauses, "kind string, clause int, trigram string, need int")  # fixed by the rules
    hits = postings(df, sorted({c[2] for c in clauses})).distinct().join(F.broadcast(need), "trigram")
    met = hits.groupBy("_key", "kind", "clause", "need").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.col("need"))
    return met.groupBy("_key").agg(F.collect_set("kind").alias("_rules"))


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """array<struct<s, k, e>> of a rule's matches that are long enough: starts from the lengths between matches."""
    pattern, lit = rule.pattern, F.lit
    found = F.regexp_extract_all(text, lit(pattern), lit(0))
    sizes = F.regexp_extract_all(text, lit(pattern), lit(rule.group)) if rule.group else found
    between = F.split(text, pattern, -1)
    kind = "array<struct<s:int,k:int,e:int,n:int>>"
    none = F.array().cast(kind)
    start = F.struct(lit(0).alias("i"), lit(0).alias("at"), none.alias("out"))
    parts_ = F.zip_with(between, F.zip_with(found, sizes, lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g"))), lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m")))

    def step(acc: Column, p: Column) -> Column:
        s = acc["at"] + p["b"]
        e = s + p["m"]["m"]
        one = F.struct(s.alias("s"), lit(place).alias("k"), e.alias("e"), p["m"]["g"].alias("n"))
        return F.struct((acc["i"] + 1).alias("i"), F.coalesce(e, s).alias("at"), F.when(p["m"].isNull() | (p["m"]["g"] < rule.least), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    return F.transform(F.aggregate(parts_, start, step)["out"], lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def scan(df: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, spans: array<struct<s, k, e>> sorted by start, then rule; k is the rule's place in the list."""
    base = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col), F.lit(-(1 << 63))).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    indexed = [r for r in rules if trigram_query(r.pattern) is not None]
    rows = base.join(candidates(base, indexed), "_key", "left") if indexed else base.withColumn("_rules", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    per_rule = []
    for place, r in enumerate(rules):
        asked = F.col("_t").rlike(r.pattern)
        if r in indexed:
            asked = F.coalesce(F.array_contains("_rules", r.kind), F.lit(False)) & asked
        rows = rows.withColumn(f"_s{place}", F.when(asked, _spans(F.col("_t"), r, place)).otherwise(none))
        per_rule.append(F.col(f"_s{place}"))
    return rows.select(F.col("_id").alias(id_col), F.array_sort(F.concat(*per_rule)).alias("spans"))


def listed(spans: Column, rules: list[Rule]) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def counted(spans: Column, place: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == place)).cast("bigint")


def all_trigrams(rules: list[Rule]) -> set[str]:
    return reduce(set.union, (set(c) for r in rules for c in trigram_query(r.pattern) or []), set())
