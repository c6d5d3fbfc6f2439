"""Source state and step summaries as streams; blobs and listings."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.sources import blobs
from tidewire.streaming import scraper


def write(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def run(stream, sink, mode="append"):
    path, mark = sink
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_source_state(spark, tmp_path):
    feeds = tmp_path / "in"
    feeds.mkdir()
    at = lambda minute: f"2024-01-01T00:{minute:02d}:00Z"
    check = lambda s, minute, ok, f=1: {"source_id": s, "frequency": f, "checked_at": at(minute), "ok": ok, "error": None if ok else "down"}
    write(feeds, "a.json", [check(1, 0, True), check(1, 1, False), check(2, 0, False), check(3, 0, True, 60)])
    sink = (f"{tmp_path}/out", f"{tmp_path}/mark")
    make = lambda: scraper.states(spark.readStream.schema(scraper.CHECK).json(str(feeds)))
    run(make(), sink)
    write(feeds, "b.json", [check(1, m, False) for m in range(2, 6)] + [check(1, 6, False), check(2, 9, True)])
    run(make(), sink)
    rows = spark.read.parquet(sink[0]).orderBy("source_id", "next_check").collect()
    one = [(r.outcome, r.failures, r.last_checked) for r in sorted((r for r in rows if r.source_id == 1), key=lambda r: (r.outcome != "ok", r.next_check if r.outcome != "dead" else r.last_checked, r.failures))]
    assert all(t == datetime(2024, 1, 1) for _, _, t in one)  # failures never move it
    assert sorted(o for o, _, _ in one) == ["dead"] + ["ok"] + ["retry"] * 5  # the fifth in a row, then counting starts anew
    assert {(r.outcome, r.failures, r.last_checked) for r in rows if r.source_id == 2} == {("retry", 1, None), ("ok", 0, datetime(2024, 1, 1, 0, 9))}
    assert [(r.outcome, (r.next_check - r.last_checked).total_seconds()) for r in rows if r.source_id == 3] == [("ok", 4 * 3600)]  # an invalid tier counts as 2
    waits = [(r.next_check - datetime(2024, 1, 1)).total_seconds() for r in rows if r.source_id == 1 and r.outcome == "retry" and r.failures == 2]
    assert waits == [2 * 60 + 2 * scraper.WAIT]


def test_step_summary(spark, tmp_path):
    feeds = tmp_path / "in"
    feeds.mkdir()
    event = lambda h, step, status, ms: {"step_name": step, "status": status, "duration": ms, "ts": f"2024-01-01T{h:02d}:30:00Z"}
    write(feeds, "a.json", [event(0, "fetch", "completed", 10.0), event(0, "fetch", "failed", 30.0), event(9, "fetch", "completed", 5.0)])
    sink = (f"{tmp_path}/out", f"{tmp_path}/mark")
    make = lambda: scraper.step_summary(spark.readStream.schema("step_name string, status string, duration double, ts timestamp").json(str(feeds)))
    run(make(), sink)
    write(feeds, "b.json", [event(1, "fetch", "completed", 1.0), event(15, "fetch", "completed", 2.0)])  # hour 1 is too late
    run(make(), sink)
    got = sorted(tuple(r) for r in spark.read.parquet(sink[0]).select(F.hour("began"), "step_name", "events", "completed", "failed", "avg_duration").collect())
    assert got == [(0, "fetch", 2, 1, 1, 20.0), (9, "fetch", 1, 1, 0, 5.0)]


def test_chunks(spark):
    rows = [(i, None if i % 2 else datetime(2024, 1, 1)) for i in range(450)]
    got = scraper.uninitialised_batches(spark.createDataFrame(rows, "id bigint, do_initialized_at timestamp"), 100).collect()
    assert sorted(len(r.ids) for r in got) == [25, 100, 100] and {i for r in got for i in r.ids} == set(range(1, 450, 2))


def test_due_checks(spark, tmp_path):
    """The first check after the first wait, then by tier; an invalid tier counts as 2; a restart keeps the timers."""
    feeds = tmp_path / "in"
    feeds.mkdir()
    write(feeds, "a.json", [{"source_id": 1, "frequency": 1}, {"source_id": 2, "frequency": 60}])
    sink = f"{tmp_path}/out"

    def go(seconds):
        stream = scraper.due_checks(spark.readStream.schema("source_id bigint, frequency int").json(str(feeds)), hour_ms=4000, first_ms=1000)
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{tmp_path}/mark").trigger(processingTime="1 second").start()
        q.awaitTermination(seconds)
        q.stop()
        return spark.read.parquet(sink).orderBy("source_id", "due_ms").collect()

    first = go(25)
    assert {r.source_id for r in first} == {1, 2} and all(r.next_ms - r.due_ms >= (4000 if r.source_id == 1 else 16_000) for r in first)
    assert sum(r.source_id == 1 for r in first) > sum(r.source_id == 2 for r in first)
    write(feeds, "b.json", [{"source_id": 3, "frequency": 4}])  # after a restart the first new row sets the clock going
    again = go(30)
    assert sum(r.source_id == 1 for r in again) > sum(r.source_id == 1 for r in first) and {r.source_id for r in again} == {1, 2, 3}
    assert len(again) > len(first) and len({(r.source_id, r.due_ms) for r in again}) == len(again)


def test_rows_that_fail(spark, tmp_path):
    """One row always fails, one fails twice: the others are done once, the first becomes a dead letter after five tries."""
    from tidewire.streaming import ingest

    done, calls = [], []

    def work(rows):
        ids = sorted(r.id for r in rows.collect())
        calls.append(ids)
        if 13 in ids or 7 in ids and sum(7 in c and len(c) == 1 for c in calls) <= 2:
            raise ValueError(f"bad row among {len(ids)}")
        done.extend(ids)

    run = ingest.careful(work, f"{tmp_path}/retries", f"{tmp_path}/dead")
    batches = [spark.createDataFrame([(i,) for i in ids], "id bigint") for ids in (range(20), [100], [101], [102], [103], [104])]
    for n, b in enumerate(batches):
        run(b, n)
    assert sorted(done) == sorted([i for i in range(20) if i != 13] + [100, 101, 102, 103, 104])
    dead = spark.read.parquet(f"{tmp_path}/dead").collect()
    assert [(r.id, r._tries, r.batch) for r in dead] == [(13, 5, 4)] and dead[0]._error == "bad row among 1"
    run(batches[4], 4)  # a batch that is run again
    assert [(r.id, r.batch) for r in spark.read.parquet(f"{tmp_path}/dead").collect()] == [(13, 4)]


def test_checks_of_feeds(spark):
    from tidewire.streaming import ingest

    rows = [(1, 1, datetime(2024, 1, 1), "<rss><channel><item><title>t</title><link>https://a.example.com/1</link></item></channel></rss>"), (2, 2, datetime(2024, 1, 1), "no feed"), (3, 2, None, None)]
    got = ingest.checks(spark.createDataFrame(rows, "source_id bigint, frequency int, checked_at timestamp, xml string")).collect()
    assert [(r.source_id, r.ok, r.error is None) for r in got] == [(1, True, True), (2, False, False), (3, False, False)]


def test_texts_under_keys(spark, tmp_path):
    """Writing one text of a day leaves the others; a batch that is run again changes nothing; no key is refused."""
    root, day = f"{tmp_path}/texts", datetime(2024, 1, 5)
    rows = lambda *r: spark.createDataFrame(list(r), "id bigint, content string, created_at timestamp")
    at = lambda h: day.replace(hour=h)
    have = lambda: sorted((r.id, r.content, r.d) for r in spark.read.parquet(root).collect())
    blobs.put_texts(rows((1, "a", at(1)), (3, "c", at(2)), (4, "other day", datetime(2024, 1, 6))), root)
    blobs.put_texts(rows((9, "i", at(3)), (1, "old", at(1)), (1, "new", at(4))), root)
    want = [(1, "new", 5), (3, "c", 5), (4, "other day", 6), (9, "i", 5)]
    assert have() == want
    blobs.put_texts(rows((9, "i", at(3)), (1, "old", at(1)), (1, "new", at(4))), root)
    assert have() == want
    assert [tuple(r) for r in blobs.get_text(spark, root, "2024/1/5/3.txt").collect()] == [(3, "c")]
    with pytest.raises(ValueError):
        blobs.put_texts(rows((None, "x", day)), root)
    reports = spark.createDataFrame([(1, "r"), (2, "s"), (2, "s")], "id bigint, title string")
    assert blobs.append_new(reports, f"{tmp_path}/reports").count() == 2 and blobs.append_new(reports.unionByName(spark.createDataFrame([(3, "t")], "id bigint, title string")), f"{tmp_path}/reports").count() == 1
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/reports").collect()) == [1, 2, 3]


def test_blobs(spark, tmp_path):
    root = f"{tmp_path}/store"
    a = spark.createDataFrame([(1, "x", datetime(2024, 1, 5)), (2, "y", datetime(2024, 2, 6))], "id bigint, content string, created_at timestamp")
    blobs.put_texts(a, f"{root}/texts")
    blobs.put_texts(a.where("id = 2").withColumn("content", F.lit("z")), f"{root}/texts")
    assert sorted((r.id, r.content, r.m) for r in spark.read.parquet(f"{root}/texts").collect()) == [(1, "x", 1), (2, "z", 2)]
    for k in range(3):
        blobs.put_metrics(spark.createDataFrame([(f"wf{k}", k)], "workflow_id string, steps int").coalesce(1), root, f"observability/{k}")
    found = blobs.newest(spark, root, "observability/", 2).collect()
    assert len(found) == 2 and all(r.key.startswith("observability/") and r.size > 0 for r in found) and found[0].uploaded >= found[1].uploaded
    assert blobs.listing(spark, root, "texts/y=2024/m=1").count() == 1
    (tmp_path / "f.json").write_text(json.dumps([{"id": 1, "title": "a"}, {"id": 2, "title": "b"}]))
    assert blobs.json_fixture(spark, f"{tmp_path}/f.json", "id bigint, title string").count() == 2
    (tmp_path / "g.json").write_text(json.dumps({"articles": [{"id": 3, "title": "c"}, "broken", {"id": "x", "title": "d"}]}))
    got = blobs.json_fixture(spark, f"{tmp_path}/g.json", "id bigint, title string").collect()
    assert [(r.id, r.title, r._error is None) for r in got][0] == (3, "c", True) and [r._error is None for r in got] == [True, False, False]
    assert blobs.seed(spark).count() == 1
