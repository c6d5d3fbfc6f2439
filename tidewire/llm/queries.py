"""The queries opN_<name> over the whole tables, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import exact_dedup, language_id, mixing, near_dedup, order_minhash, pii, piece_sampling, secret_scan, sharding, simhash_ball, toxicity, turn_trie, word_runs
from tidewire.llm.common import table

SHARDS = 40
RULES = secret_scan.BASE_RULES + secret_scan.MORE_RULES
NEAR = near_dedup.Plan(words=3, percent=85)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), n_shards=SHARDS)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mixing.mix(docs, labels, lift={"good": 1.25, "low": 0.75, "toxic": 0.5})


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels)).select("doc_id", "held_out", "score", "predicted", "passages")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")  # noqa: E731

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), RULES)
    base = F.filter("spans", lambda s: s["k"] < len(secret_scan.BASE_RULES))
    return found.select(
        "doc_id", *[secret_scan.counted(F.col("spans"), i).alias(f"n_{r.kind}") for i, r in enumerate(secret_scan.BASE_RULES)],
        F.sha2(secret_scan.listed(base, RULES), 256).alias("base_sha256"), secret_scan.listed(F.col("spans"), RULES).alias("spans"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), NEAR)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), stays="max")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.training_sample(docs))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != "")
    some = docs.select("doc_id", "text", crc.alias("h"), F.when(crc % 10 == 0, words).alias("w")).withColumn("g", F.expr("h div 10")).withColumn("n", F.size("w"))
    placed = some.withColumn("a", F.expr("g % nullif(n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    made = placed.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
    found = word_runs.find_runs(made, periods=4, least=6)
    top = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    best = found.withColumn("top", F.when(F.size("runs") > 0, top))
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("top.s").alias("start"), (-F.col("top.l")).alias("length"), F.col("top.p").alias("period"),
        F.expr("(1000 * -top.l) div top.p").alias("exponent_milli"), F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = turn_trie.turn_lists(table(spark, sf_dir, "conversations"))
    share = F.crc32(F.col("_c").cast("string")) % 6
    return turn_trie.prefix_trie(turn_trie.with_shared_head(lists, F.col("_c") - F.col("_c") % 100, share))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ball.near_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_sharding, op2_mixing, op3_toxicity, op4_pii, op5_secrets, op6_near_dedup, op7_exact_dedup, op8_language, op9_pieces, op10_fingerprints, op11_runs, op12_trie, op13_simhash]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def _best_shard(n: int) -> str:
    draw = "('0x' || md5(doc_id::VARCHAR || ':' || s::VARCHAR)[1:15])::BIGINT"
    return f"(SELECT arg_max(s, {draw}) FROM range({n}) t(s))"


_CRC_TABLE = """(SELECT list(c ORDER BY n) FROM (SELECT n, list_reduce(list_prepend(n::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
 lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(n)))"""

OP1_SQL = f"""
WITH tab AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT doc_id, text, md5(doc_id::VARCHAR)[1:2] AS sub, {_best_shard(SHARDS)}::INTEGER AS shard, {_best_shard(SHARDS + 1)}::INTEGER AS grown_shard FROM documents),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT) AS bytes FROM h),
c AS (SELECT doc_id, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, y: xor(t[xor(c & 255, y) + 1], c >> 8))) AS crc FROM b, tab)
SELECT d.doc_id, (coalesce(octet_length(encode(text)), 0) + 16)::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard,
 (row_number() OVER (PARTITION BY shard ORDER BY sub, d.doc_id) - 1)::BIGINT AS slot, grown_shard
FROM d JOIN c ON c.doc_id = d.doc_id
"""

OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def _rule_sql(rule: secret_scan.Rule, place: int) -> str:
    pattern = rule.pattern.replace("(?<![0-9a-f])", "").replace("'", "''").replace(r"\x20", " ")
    return f"""
SELECT doc_id, {place} AS k, '{rule.kind}' AS kind, i, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0) AS s, length(found[i]) AS n
FROM (SELECT doc_id, gaps, found, sizes, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{pattern}') AS gaps,
 regexp_extract_all(coalesce(text, ''), '{pattern}') AS found, regexp_extract_all(coalesce(text, ''), '{pattern}', {rule.group}) AS sizes FROM documents) q) p WHERE length(sizes[i]) >= {rule.least}"""


OP5_SQL = f"""
WITH hit AS ({" UNION ALL ".join(_rule_sql(r, i) for i, r in enumerate(RULES))}),
named AS (SELECT *, kind || ':' || s::BIGINT::VARCHAR || ':' || (s + n)::BIGINT::VARCHAR AS part FROM hit),
per AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS a, count(*) FILTER (WHERE k = 1) AS b, count(*) FILTER (WHERE k = 2) AS c,
 string_agg(part, ',' ORDER BY s, k) FILTER (WHERE k < {len(secret_scan.BASE_RULES)}) AS base, string_agg(part, ',' ORDER BY s, k) AS spans FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
 ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n, hash(list_sort(s)) AS h FROM sets),
reps AS (SELECT min(doc_id) AS doc_id, n, h FROM n WHERE n > 0 GROUP BY n, h),
e AS (SELECT doc_id, unnest(s) AS g FROM sets SEMI JOIN reps USING (doc_id)),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN reps p ON p.doc_id = a JOIN reps q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM reps UNION SELECT reach.a, sym.b FROM reach JOIN sym ON sym.a = reach.b),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(comp.c, n.doc_id) AS component_id, n.doc_id = coalesce(comp.c, n.doc_id) AS kept
FROM n LEFT JOIN reps ON reps.n = n.n AND reps.h = n.h LEFT JOIN comp ON comp.a = reps.doc_id
"""


def _crc_sql(text: str) -> str:
    """crc32 of a short text; needs tab(t)."""
    x = f"hex(encode({text}))"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({x}), 2), lambda i: ('0x' || {x}[i:i + 1])::BIGINT)), lambda c, y: xor(t[xor(c & 255, y) + 1], c >> 8)))"


OP11_SQL = rf"""
WITH tab AS (SELECT {_CRC_TABLE} AS t),
w AS (SELECT doc_id, {_crc_sql("doc_id::VARCHAR")} AS h, list_filter(string_split_regex(coalesce(text, ''), '[ 	
]+'), lambda x: x <> '') AS ws FROM documents, tab),
m AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS again, (h // 10) % greatest(1, len(ws)) AS a, h // 10 AS g FROM w),
p AS (SELECT doc_id, n, ws, again, a, 1 + (n - a) // (3 + g % 8) AS p FROM m),
i AS (SELECT doc_id, n, k AS i, CASE WHEN again AND k >= a THEN ws[a + (k - a) % p + 1] ELSE ws[k + 1] END AS word FROM (SELECT *, unnest(range(0, n)) AS k FROM p) q),
pair AS (SELECT x.doc_id, x.i AS b, y.i - x.i AS q FROM i x JOIN i y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
island AS (SELECT doc_id, q, b - row_number() OVER (PARTITION BY doc_id, q ORDER BY b) AS z, b FROM pair),
stretch AS (SELECT doc_id, q, min(b) AS start, count(*) + q AS length FROM island GROUP BY doc_id, q, z),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
digest AS (SELECT doc_id, count(*) AS n_runs, string_agg(start::VARCHAR || ',' || length::VARCHAR || ',' || period::VARCHAR || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY doc_id),
top AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT i.doc_id, string_agg(word, ' ' ORDER BY i.i) AS t FROM i ANTI JOIN gone USING (doc_id, i) GROUP BY i.doc_id)
SELECT m.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM m LEFT JOIN digest USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP12_SQL = f"""
WITH tab AS (SELECT {_CRC_TABLE} AS t),
o AS (SELECT conv_id AS c, list(struct_pack(d := sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), n := length(coalesce(text, ''))) ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (SELECT o.c, {_crc_sql("o.c::VARCHAR")} % 6 AS h, o.ts, p.ts AS first FROM tab, o LEFT JOIN o p ON p.c = o.c - o.c % 100),
b AS (SELECT c, list_concat(coalesce(first, [])[1:h], ts[h + 1:]) AS ts FROM r),
x AS (SELECT c, len(ts) AS m, d, CASE WHEN d > 0 THEN ts[d].n ELSE 0 END AS size, sha256(array_to_string(list_transform(ts[1:d], lambda y: y.d), ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(ts[1:d - 1], lambda y: y.d), ',')) END AS up
 FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM b) q),
n AS (SELECT node, d, any_value(up) AS up, any_value(size) AS size, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE m = d) AS ends FROM x GROUP BY node, d),
k AS (SELECT up AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.node = n.node AND k.d = n.d),
s AS (SELECT x.node, x.d, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.size)::BIGINT AS saved_tokens FROM f JOIN x ON x.c = f.conv_id AND x.d <= f.d GROUP BY x.node, x.d)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN s ON s.node = f.node AND s.d = f.d LEFT JOIN f p ON p.node = f.up AND p.d = f.d - 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1_SQL, "op5_secrets": OP5_SQL, "op6_near_dedup": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op11_runs": OP11_SQL, "op12_trie": OP12_SQL}
