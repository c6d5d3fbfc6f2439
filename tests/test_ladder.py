"""The ladder of providers: who is asked how often, waits, pooled windows, formats of records; hand-worked cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import models, providers
from tidewire.operators.ladder import ONCE, SERVICE, SPENT_QUOTA, UNREADABLE, Capability, Refused, Retry, Step, climb, each, ladder, quota_delay

PLAIN = Capability(("x",), lambda r: None if r["x"] is None else r, lambda a: {"y": a} if isinstance(a, int) else None, "y bigint", "no x")


def double(asked, attempt):
    return [q["x"] * 2 for q in asked]


def outcome(o):
    return [o[k] for k in ("value", "provider", "rung", "calls", "error")]


def test_only_failed_rows_climb():
    seen = []

    def first(asked, attempt):
        seen.append((attempt, [q["x"] for q in asked]))
        answers = {1: 2, 2: "prose", 3: Refused("bad", 400), 4: Refused("busy", 503) if attempt < 3 else 8, 5: Refused("busy", 503)}
        return [answers[q["x"]] for q in asked]

    waits = []
    asked = [{"x": 1}, None, {"x": 2}, {"x": 3}, {"x": 4}, {"x": 5}]
    got = climb(asked, [Step("a", first, Retry(3, SERVICE.passes, lambda n: n * 10.0)), Step("b", double)], PLAIN, waits.append)
    assert [outcome(o) for o in got] == [
        [{"y": 2}, "a", 1, 1, None], [None, None, 0, 0, "no x"], [{"y": 4}, "b", 2, 2, None], [{"y": 6}, "b", 2, 2, None], [{"y": 8}, "a", 1, 3, None], [{"y": 10}, "b", 2, 4, None]]
    assert seen == [(1, [1, 2, 3, 4, 5]), (2, [4, 5]), (3, [4, 5])] and waits == [10.0, 20.0]


def test_last_error_stays():
    got = climb([{"x": 1}], [Step("a", lambda a, n: [Refused("one")]), Step("b", lambda a, n: ["prose"])], PLAIN)
    assert outcome(got[0]) == [None, None, 2, 2, UNREADABLE]
    assert climb([], [Step("a", double)], PLAIN) == [] and outcome(climb([{"x": 1}], [], PLAIN)[0]) == [None, None, 0, 0, None]


def test_whole_call_fails_by_its_own_batch():
    def call(asked, attempt):
        if any(q["x"] == 3 for q in asked):
            raise Refused("down", 500)
        return double(asked, attempt) if asked[0]["x"] != 5 else [1]

    got = climb([{"x": i} for i in range(1, 7)], [Step("a", call, size=2)], PLAIN)
    assert [o["error"] for o in got] == [None, None, "down", "down", "1 answers for 2 requests", "1 answers for 2 requests"]


def test_retry_rules():
    assert SPENT_QUOTA.passes(Refused("Resource EXHAUSTED")) and SPENT_QUOTA.passes(Refused("code 429")) and not SPENT_QUOTA.passes(Refused("503 busy", 503))
    assert SERVICE.passes(Refused("x", 503)) and not SERVICE.passes(Refused("x", 400)) and not ONCE.passes(Refused("quota", 429))
    assert [quota_delay(n, draw=lambda: 0.5) for n in (1, 2, 3)] == [1.5, 2.5, 4.5]
    waits = []
    got = climb([{"x": 1}], [Step("a", lambda a, n: [Refused("quota")], Retry(4, SPENT_QUOTA.passes, lambda n: quota_delay(n, draw=lambda: 0.0)))], PLAIN, waits.append)
    assert got[0]["calls"] == 4 and waits == [1.0, 2.0, 4.0]


def test_ladder_keeps_rows_and_columns(spark):
    t = spark.createDataFrame([(1, "a", 5, [1, None]), (2, None, None, None), (2, None, None, None), (None, "", 2**40, [])], "id bigint, value string, x bigint, more array<bigint>")
    got = ladder(t, PLAIN, [Step("p", double)], size=2)
    assert got.columns == ["id", "value", "x", "more", "answer"] and sorted(map(str, got.drop("answer").collect())) == sorted(map(str, t.collect()))
    assert sorted((r.x or 0, r.answer.value and r.answer.value.y, r.answer.calls, r.answer.error) for r in got.collect()) == [(0, None, 0, "no x"), (0, None, 0, "no x"), (5, 10, 1, None), (2**40, 2**41, 1, None)]
    assert ladder(t.where("false"), PLAIN, [Step("p", double)]).count() == 0
    with pytest.raises(ValueError):
        ladder(t, PLAIN, [], out="value")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_each_keeps_failures(spark):
    t = spark.createDataFrame([(i,) for i in range(-2, 9)], "x bigint")
    got = {r.x: (r.result.value and r.result.value.y, r.result.error) for r in each(t, lambda r: {"y": 12 // r["x"]} if r["x"] >= 0 else {}["gone"], "y bigint").collect()}
    assert len(got) == 11 and got[4] == (3, None) and got[0][0] is None and "zero" in got[0][1] and got[-1] == (None, "'gone'")


def test_pooled_windows():
    ids, mask = models.windows(list(range(1, 8)), 3)
    assert ids.tolist() == [[1, 2, 3], [4, 5, 6], [7, 0, 0]] and mask.sum(axis=1).tolist() == [3, 3, 1]
    states = np.zeros((3, 3, 384))
    for w in range(3):
        for t in range(3):
            states[w, t, ids[w, t] % 384] = 1 - 2 * (ids[w, t] // 384 % 2)
    assert np.allclose(models.pooled(states, mask), models.hashed_pool(ids, mask))
    none, empty = models.windows([], 3)
    assert none.shape == (0, 3) and models.hashed_pool(none, empty).shape == (0, 384)
    assert not models.pooled(np.ones((1, 2, 4)), np.zeros((1, 2), dtype=bool)).any()


def test_windows_are_weighed_by_their_tokens():
    words = " ".join(f"w{i % 37}" for i in range(1300))
    whole = np.array(models.Embedder(width=5000).vector(words))
    for width, batch in ((512, 32), (7, 2), (1, 100)):
        assert np.allclose(models.Embedder(width=width, batch=batch).vector(words), whole)
    first = models.Embedder(most_windows=1).vector(words)
    assert np.allclose(first, models.Embedder().vector(" ".join(words.split()[:512]))) and not np.allclose(first, whole)
    assert np.linalg.norm(whole) == pytest.approx(1) and not any(models.Embedder().vector(" \n "))
    assert models.Embedder(prefix="query: ").vector("A b") == models.Embedder().vector("QUERY: a B")


def test_embedding_service(spark):
    t = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, ["", None])], "id int, text array<string>")
    got = {r.id: r.answer for r in ladder(t, models.embedding(), [Step("hashed", models.Embedder())]).collect()}
    assert [len(v) for v in got[1].value.embeddings] == [384, 384] and got[1].value.dimensions == 384
    assert (got[2].value.embeddings, got[2].value.dimensions) == ([], 0) and got[3].value is None and "required" in got[3].error and not any(got[4].value.embeddings[1])
    one = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "id int, text string")
    wrong = Step("small", models.Embedder(pool=lambda ids, mask: models.hashed_pool(ids, mask, 8), dim=8))
    got = {r.id: r.answer for r in ladder(one, models.embedding(), [wrong, Step("hashed", models.Embedder())]).collect()}
    assert (got[1].provider, got[1].calls) == ("hashed", 2) and got[2].error == got[3].error


def test_analysis():
    assert models.first_object('so: {x} {"a": {"b": 1}} {"c": 2}') == {"a": {"b": 1}} and models.first_object("none {") is None
    c = models.analysis(most=3)
    assert c.build({"title": "t", "content": "abcd"})["content"] == "abc...[truncated]" and c.build({"title": "t", "content": "abc"})["content"] == "abc"
    assert c.build({"title": "", "content": "a"}) is None and c.build({"title": "a", "content": None}) is None and c.parse("") is None and c.parse("[1]") is None
    assert c.parse('{"completeness": 3, "thematic_keywords": "x"}') == {"completeness": "3", "content_quality": None, "event_summary_points": [], "thematic_keywords": []}
    answer = c.parse(models.analyst([{"title": "T", "content": "Harbour harbour, bridge; short"}], 1)[0])
    assert answer == {"completeness": "PARTIAL_USELESS", "content_quality": "OK", "event_summary_points": ["T"], "thematic_keywords": ["harbour", "bridge"]}


def test_formats(spark):
    cases = [({"id", "embedding"}, "embedding_item"), ({"id", "embedding", "text"}, "extended_item"), ({"id", "title", "content", "embedding", "publishDate"}, "extended_item"),
             ({"id", "title", "content", "embedding", "publishDate", "url", "status", "lang"}, "article_item"), ({"text", "embedding"}, "vector_item"),
             ({"text", "embedding", "id", "a", "b", "c", "d", "e"}, "vector_item"), ({"text"}, "text_item"), ({"embedding"}, "unknown"), (set(), "unknown")]
    rows = spark.createDataFrame([(i, "{" + ", ".join(f'"{k}": 1' for k in sorted(keys)) + "}", kind) for i, (keys, kind) in enumerate(cases)] + [(90, "[1]", "unknown"), (91, None, "unknown"), (92, "{", "unknown")], "i int, record string, kind string")
    assert [(r.i, r.got) for r in rows.select("i", "kind", providers.record_format(F.col("record")).alias("got")).where("got is distinct from kind").collect()] == []
    assert [k for keys, k in cases if providers.item_format(list(keys)) != k] == []
