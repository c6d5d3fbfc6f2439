"""Queries against their oracle, the text functions' hard strings, feeds and the ingestion stream."""

import json
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


def plain(v):
    if hasattr(v, "asDict"):
        v = list(v.asDict().values())
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return f"{float(v):.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    sql = duck.sql(catalog.oracle_sql()[name])
    place = [sql.columns.index(c) for c in cols]
    assert got == sorted(str([plain(r[p]) for p in place]) for r in sql.fetchall())


def test_scan_is_pruned(spark):
    plan = catalog.queries()["failed_latest"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_cosine_topk_of_many_queries(spark, tmp_path):
    """More queries than one block holds: every one gets its five nearest."""
    n = 4200
    x = np.random.default_rng(5).normal(size=(n, 4))
    spark.createDataFrame([(100 * i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.queries()["cosine_topk"](spark, str(tmp_path)).toPandas()
    assert len(got) == 5 * n and set(got.groupby("query_id").size()) == {5}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scores = x @ x.T
    np.fill_diagonal(scores, -2)
    want = -np.sort(-scores, axis=1)[:, :5]
    assert np.abs(got.sort_values(["query_id", "rank"]).score.to_numpy().reshape(n, 5) - want).max() < 1e-4


def test_runs_without_training_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    code = f"import sys; sys.path.insert(0, {str(root)!r}); import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n == 'tidewire.llm' else f(n, *a); import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0


def test_strings(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).head().x
    lit, none = F.lit, F.array().cast("array<string>")
    assert one(X.search_text(lit(" Title. "), lit("Global"), F.array(lit("a"), lit(" b. "), lit("")), none, F.array(lit("k")), none, none)) == "Title. a. b. k."
    assert one(X.search_text(lit(None).cast("string"), lit(""), none, none, none, none, none)) == ""
    assert one(X.clean_url(lit("https://A.b/c?utm_source=x&id=1&fbclid=2#f"))) == "https://a.b/c?id=1#f"
    assert one(X.clean_string(lit(" a \t b\n\n\n  c \n d  "))) == "a b\nc\nd"
    assert one(X.llm_json(lit('x {"a": {"b": 1}} y'))) == '{"a": {"b": 1}}' and one(X.llm_json(lit("{bad"))) is None
    assert one(X.redact(lit("abc"))) == "ab***" and one(X.host(lit("not a url"))) is None
    assert str(one(X.feed_date(lit("Mon, 15 Jan 2024 10:00:00 +0800")))) == "2024-01-15 02:00:00" and one(X.feed_date(lit("soon"))) is None


RSS = "<rss><channel><title>t</title><item><title>A &amp; B</title><link>https://x.example.com/1?utm_source=a</link><pubDate>Tue, 30 Jan 2024 10:00:00 GMT</pubDate></item><item><title>Old</title><guid>https://x.example.com/2</guid><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item></channel></rss>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title>E</title><link href="https://y.example.com/e"/><updated>2024-01-30T08:00:00Z</updated></entry></feed>'


def test_feed_stream(spark, tmp_path):
    from tidewire.streaming import ingest

    (tmp_path / "in").mkdir()
    write = lambda n, xs: (tmp_path / "in" / n).write_text("\n".join(json.dumps({"source_name": "s", "xml": x}) for x in xs))
    go = lambda: ingest.start(spark, f"{tmp_path}/in", f"{tmp_path}/t", f"{tmp_path}/bad", f"{tmp_path}/ck", F.lit("2024-01-31 00:00:00").cast("timestamp"))
    write("a.json", [RSS, ATOM, "no feed"])
    assert all(q.awaitTermination(120) for q in go())
    import pandas as pd

    def rows(name):
        found = [pd.read_parquet(f) for f in (tmp_path / name).glob("*.parquet")]
        return sorted(zip(pd.concat(found).link, pd.concat(found).status, strict=True)) if found else []

    first = rows("t")
    for f in (tmp_path / "t").glob("*.parquet"):  # the state alone knows what was seen
        f.unlink()
    write("b.json", [RSS, RSS.replace("/1?", "/3?"), "<rss><channel><item><title>x</title><link>no url</link></item></channel></rss>"])
    assert all(q.awaitTermination(120) for q in go())  # a restart
    second = rows("t")
    assert second == [("https://x.example.com/3", "PENDING_FETCH")] and len(rows("bad")) == 1
    write("c.json", [RSS, ATOM])
    assert all(q.awaitTermination(120) for q in go())  # a replay inserts nothing
    assert rows("t") == second
    got = set(first + second)
    assert got == {("https://x.example.com/1", "PENDING_FETCH"), ("https://x.example.com/2", "SKIPPED_TOO_OLD"), ("https://y.example.com/e", "PENDING_FETCH"), ("https://x.example.com/3", "PENDING_FETCH")}
