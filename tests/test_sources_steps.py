"""The feed source, durable steps, the result cache and the indexed search."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.operators import journal
from tidewire.plans import catalog
from tidewire.sources import feed_source

D = "/root/testdata/sf0.001"


def test_feed_source(spark, tmp_path):
    feeds = tmp_path / "feeds"
    feeds.mkdir()
    for n in range(40):
        (feeds / f"f{n:02d}.xml").write_text(f"<rss>{n}</rss>")
    (feeds / "bad.xml").write_bytes(b"\xff\xfe\xfa")
    feed_source.register(spark)
    rows = spark.read.format("feeds").option("path", str(feeds)).load().collect()
    assert len(rows) == 41 and {r.source_name for r in rows if r.error} == {"bad"} and sum(r.xml is not None for r in rows) == 40

    def go():
        q = (spark.readStream.format("feeds").option("path", str(feeds)).option("most", 15).load().writeStream.format("parquet")
             .option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(processingTime="1 second").start())
        for _ in range(60):
            q.awaitTermination(2)
            if not q.isActive or q.lastProgress and q.lastProgress.numInputRows == 0 and len(q.recentProgress) > 1:
                break
        assert q.exception() is None
        q.stop()
        return spark.read.parquet(f"{tmp_path}/out").collect()

    assert sorted(r.source_name for r in go()) == sorted(r.source_name for r in rows)
    (feeds / "new.xml").write_text("<rss>new</rss>")
    again = go()  # a restart goes on behind the last file
    assert len(again) == 42 and sum(r.source_name == "new" for r in again) == 1


def test_durable_steps(spark, tmp_path):
    root, calls = f"{tmp_path}/runs", []
    source = f"{tmp_path}/source"
    spark.range(10).write.parquet(source)

    def doubled(t, by):
        calls.append("doubled")
        return t.select((F.col("id") * by).alias("id"))

    def failing(t):
        calls.append("failing")
        raise RuntimeError("killed")

    def summed(t):
        calls.append("summed")
        return t.agg(F.sum("id").alias("s"))

    def go(second, by=2):
        run = journal.Run(spark, root, "r1")
        a = run.step("double", doubled, spark.read.parquet(source), by=by)
        return run, run.step("sum", second, a).head()[0]

    with pytest.raises(RuntimeError):
        go(failing)
    run, total = go(summed)
    assert total == 90 and run.skipped == ["double"] and run.done == ["sum"] and calls == ["doubled", "failing", "summed"]
    run, total = go(summed)
    assert total == 90 and run.skipped == ["double", "sum"] and len(calls) == 3
    run, total = go(summed, by=3)  # other inputs: done again, and so is what follows
    assert total == 135 and run.done == ["double", "sum"]
    assert journal.Run(spark, root, "r2").journal().count() == 0


def test_result_cache(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    now = F.lit("2024-01-01 10:00:00").cast("timestamp")
    cache = spark.createDataFrame([("a", "old", at(9)), ("b", "kept", at(11)), ("b", "longer", at(12)), ("c", "kept", at(11))], "cache_key string, result string, expires timestamp")
    requests = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "d"), (5, "d"), (6, None)], "id int, cache_key string")
    hits, misses = journal.split(requests, cache, now)
    assert sorted((r.id, r.result) for r in hits.collect()) == [(2, "longer"), (3, "longer")]
    assert sorted(str(r.cache_key) for r in misses.collect()) == ["None", "a", "d"]
    new = journal.renewed(cache, misses.where("cache_key is not null").select("cache_key", F.lit("answer").alias("result")), F.lit(3600), now)
    assert {(r.cache_key, r.result, r.expires.hour) for r in new.collect()} == {("a", "answer", 11), ("d", "answer", 11), ("b", "kept", 11), ("b", "longer", 12), ("c", "kept", 11)}


def test_indexed_search_reaches_its_recall(spark):
    exact = catalog.queries()["cosine_topk"](spark, D).collect()
    found = catalog.queries()["indexed_topk"](spark, D).collect()
    assert {r.query_id for r in found} == {r.query_id for r in exact} and found[0].recall >= 0.9
    hit = {(r.query_id, r.id) for r in exact} & {(r.query_id, r.id) for r in found}
    assert len(hit) >= 0.85 * len(exact)
