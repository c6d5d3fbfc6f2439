"""Operators on small tables: brute force, hard cases (nulls, empty and long texts, ties, repeats, empty tables, clashing columns)."""

import hashlib
import itertools
import math
import re
import struct
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewire.llm import components, exact_dedup, language_id, mixing, near_dedup, order_minhash, pii, piece_sampling, secret_scan, sharding, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
LONG = " ".join(WORDS[i * i % 19] + str(i % 97) for i in range(20_000))
BASE = " ".join(WORDS[i * 7 % 19] + str(i % 31) for i in range(200))
ROWS = [(1, "hello world"), (2, "hello world"), (3, None), (4, ""), (5, LONG), (6, BASE), (7, BASE + " one more"), (7, "repeated id"), (7, "repeated id"), (None, "no id"), (8, "mail a.b@c.example.com token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" ip 1.2.3.4"), (9, "ünï ▁ 日本 🎉")]


@pytest.fixture(scope="module")
def docs(spark):
    """Hard rows, with columns whose names clash with the operators' own."""
    plain = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    return plain.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(1).alias("score"), F.lit(2).alias("_id"), F.lit("x").alias("_t"), F.lit(3).alias("kept"), F.lit(4).alias("shard"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where(F.lit(False))


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_exact_dedup(docs, empty):
    for stays, pick in (("min", min), ("max", max)):
        got = exact_dedup.exact_dedup(docs, stays=stays).collect()
        assert len(got) == len(ROWS)
        groups = {}
        for i, t in ROWS:
            groups.setdefault(t or "", []).append(i)
        want = sorted((str(i), len(groups[t or ""]), str(pick([x for x in groups[t or ""] if x is not None], default=None)), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
        assert sorted((str(r.doc_id), r.group_size, str(r.keep_id), r.text_sha256) for r in got) == want
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_compares_bytes(docs):
    """A hash under which most texts collide gives the same groups."""
    weak = exact_dedup.exact_dedup(docs, stays="max", hash_of=lambda c: F.length(c) % 2)
    assert rows_of(weak, "doc_id", "keep_id", "group_size") == rows_of(exact_dedup.exact_dedup(docs, stays="max"), "doc_id", "keep_id", "group_size")


def test_sharding(docs, empty):
    got = sharding.shard(docs, n_shards=5).collect()
    by = {}
    for r in got:
        key = "null" if r.doc_id is None else str(r.doc_id)
        draw = lambda s: int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        assert r["shard"] == max(range(5), key=draw) and r.grown_shard == max(range(6), key=draw)
        assert r.grown_shard in (r["shard"], 5)
        by.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t in ROWS)
    assert sharding.shard(empty).count() == 0


def test_weighted_shards(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = Counter(r["shard"] for r in sharding.shard(ids, n_shards=3, weights=[1, 2, 1]).collect())
    assert abs(n[1] / 4000 - 0.5) < 0.04 and abs(n[0] / 4000 - 0.25) < 0.04


def test_secret_scan_brute_force(docs, empty):
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    got = Counter((r.doc_id, tuple((x.s, x.k, x.e) for x in r.spans)) for r in secret_scan.scan(docs, rules).collect())
    want = Counter((i, tuple(sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.pattern, t or "") if len(m.group(r.group)) >= r.least))) for i, t in ROWS)
    assert got == want
    assert secret_scan.scan(empty, rules).count() == 0


def test_trigram_queries():
    for rule in secret_scan.BASE_RULES + secret_scan.MORE_RULES:
        q = secret_scan.trigram_query(rule.pattern)
        assert (q is None) == (rule.kind == "hex")
    q = secret_scan.trigram_query(secret_scan.BASE_RULES[0].pattern)
    for hit in ("PassWord = 'abcdefg'", "api_key:ABCDEFG", "apikey=1234567", "TOKEN\"=xxxxxx", "secret: zzzzzz", "passwd=aaaaaa"):
        assert any(all(t in hit.lower() for t in clause) for clause in q)


def brute_components(rows, k, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[ \t-\r]+", (t or "").translate(low)) if x]
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] > label[j]:
                    label[i], changed = label[j], True
    return {i: (len(s), label[i]) for i, s in sets.items()}


def test_near_dedup_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, i = [(0, None), (1, ""), (2, " \t"), (3, "one"), (4, "ONE"), (5, "one two"), (6, LONG), (7, LONG + " x")], 8
    for _ in range(12):
        base = [str(x) for x in rng.choice(4000, rng.integers(4, 200))]
        for _ in range(int(rng.integers(1, 9))):
            copy = [w if rng.random() > rng.choice([0.0, 0.02, 0.05]) else "edit" + str(rng.integers(99)) for w in base]
            rows.append((i, " ".join(copy)))
            i += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    plan = near_dedup.Plan(words=3, percent=85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(df, plan).collect()}
    assert got == brute_components(rows, 3, 85)


def test_near_dedup_hard_rows(spark, docs, empty):
    got = near_dedup.near_dedup(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and by[3].n_shingles == 0 and by[4].kept and by[None].component_id is None
    # The three rows of id 7 are one document: that of the longest text, a near copy of document 6.
    assert {(r.n_shingles, r.component_id) for r in got if r.doc_id == 7} == {(198, 6)}
    assert near_dedup.near_dedup(empty).count() == 0


def chain(n, seed=5, words=60):
    """n texts, each the last one with a word changed, in shuffled order: neighbours are similar, distant ones are not."""
    rng = np.random.default_rng(seed)
    text, out = [f"w{x}" for x in rng.integers(0, 10**6, words)], []
    for i in range(n):
        text[i % words] = f"n{i}"
        out.append(" ".join(text))
    return [(int(k), out[i]) for i, k in enumerate(rng.permutation(n))]


def test_near_dedup_chain(spark):
    """2,000 near copies in a chain: one component, though hardly a pair is alike."""
    rows = chain(2000)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), near_dedup.Plan(words=3, percent=85))
    assert {r.component_id for r in got.collect()} == {0}


def test_near_dedup_across(spark):
    """Best candidates of each other component, each pair once in its first shared band; `more` where some were left."""
    plan = near_dedup.Plan()
    sig, oph = bytes(plan.bands * plan.rows), bytes([1]) * near_dedup.BINS
    kind = "_key bigint, _id bigint, _c bigint, _n bigint, _sig binary, _oph binary, _bands array<bigint>, _out boolean"
    bands = lambda i: [7 if b == 3 else 8 if b == 5 else 100 * i + b for b in range(plan.bands)]
    made = [(key, i, 1 if i > 1 else 0, 1000, sig, oph, bands(i), i < 2) for key in (7, 8) for i in range(1, 5)]
    found = near_dedup._across(spark.createDataFrame(made, kind), plan, 2)
    assert rows_of(found, "_key", "a", "b", "more") == [(7, 1, 2, True), (7, 1, 3, True)]
    assert rows_of(near_dedup._across(spark.createDataFrame(made, kind), plan, 16), "a", "b", "more") == [(1, 2, False), (1, 3, False), (1, 4, False)]
    assert near_dedup._across(spark.createDataFrame(made, kind).where("_key = 8"), plan, 2).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (20, 21)] + [(100, 100 + k) for k in range(1, 50)] + [(149, 5)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got[4] == 1 and got[12] == 10 and got[21] == 20 and got[149] == 5 and got[130] == 5
    odd = spark.createDataFrame([(1, 1), (3, 2), (2, 3), (3, 2), (None, 4), (5, None)], "a bigint, b bigint")
    assert rows_of(components.components(odd), "node", "label") == [(1, 1), (2, 2), (3, 2)]
    assert components.components(odd.where(F.lit(False))).count() == 0


def brute_fingerprint(text, k=2, keep_n=2):
    """Order MinHash in plain Python, with the hash that xxhash64 stands for."""
    mask, n_pos = (1 << 33) - 1, 30
    of_text = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    of = lambda *xs: reduce(lambda seed, x: xxhash.xxh64_intdigest(x, seed), xs, 42)
    long, small = lambda x: struct.pack("<Q", x & (2**64 - 1)), lambda x: struct.pack("<i", x)
    hashes = [of_text(w) for w in re.split("[ \\t\\n\\v\\f\\r]+", text or "") if w]
    if not hashes:
        return ""
    if len(hashes) < k:
        kmers = [reduce(lambda s, h: of(long(s), long(h)), hashes, 0)]
    else:
        kmers = [reduce(lambda s, h: of(long(s), long(h)), hashes[i + 1:i + k], hashes[i]) for i in range(len(hashes) - k + 1)]
    seen, bins = Counter(), {}
    for pos, h in enumerate(kmers):
        item = of(long(h & mask), small(seen[h & mask])) & mask
        seen[h & mask] += 1
        bins.setdefault(item >> 27, []).append((item, pos))
    out = []
    for b in sorted(bins):
        chosen = sorted(sorted(bins[b])[:keep_n], key=lambda x: x[1])
        out.append(f"{b:02x}{reduce(lambda s, x: of(long(s), long(x[0])), chosen, 7) & 0xFFFFFFFF:08x}")
    return ",".join(out)


def test_fingerprints_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = [None, "", "  ", "one", "one two", "a a a a a b a a", "x  y\n\tz", "é\u00a0ü ▁ 🎉 ok", LONG, BASE] + [" ".join(rng.choice(WORDS, int(rng.integers(1, 300)))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for k, keep_n in ((2, 2), (3, 4), (1, 1)):
        got = {r.doc_id: r.fingerprint for r in order_minhash.fingerprints(df, k=k, keep_n=keep_n).collect()}
        assert got == {i: brute_fingerprint(t, k, keep_n) for i, t in enumerate(texts)}


def test_likeness_brute_force(spark):
    rng = np.random.default_rng(7)
    made = [",".join(f"{b:02x}{rng.integers(0, 3):08x}" for b in sorted(rng.choice(64, int(rng.integers(0, 9)), False))) for _ in range(60)]
    pairs = list(zip(made[::2], made[1::2], strict=True))
    df = spark.createDataFrame(pairs, "a string, b string")
    want = []
    for a, b in pairs:
        x, y = ({e[:2]: e for e in s.split(",") if e} for s in (a, b))
        bins = set(x) | set(y)
        want.append(sum(x.get(k) == y.get(k) for k in bins) / len(bins) if bins else 1.0)
    assert [r.x for r in df.coalesce(1).select(order_minhash.likeness(F.col("a"), F.col("b")).alias("x")).collect()] == want


def test_order_minhash(spark, docs, empty):
    got = order_minhash.edited_fingerprints(docs).collect()
    assert len(got) == len(ROWS)
    order = sorted(ROWS, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((str(d), len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    f = {(r.doc_id, r.n_chars): r for r in got}
    assert f[(1, 11)].fingerprint == f[(2, 11)].fingerprint and f[(4, 0)].fingerprint == ""
    assert order_minhash.edited_fingerprints(empty).count() == 0
    texts = [BASE, BASE + " tail", " ".join(reversed(BASE.split())), "a b a b a b a b", "a b a b", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    fp = {r.doc_id: r.fingerprint for r in order_minhash.fingerprints(df).collect()}
    pairs = spark.createDataFrame([(fp[0], fp[1]), (fp[0], fp[2]), (fp[0], fp[0]), (fp[5], fp[5]), (fp[0], fp[5])], "a string, b string")
    close, reversed_, same, none, one = [r.x for r in pairs.select(order_minhash.likeness(F.col("a"), F.col("b")).alias("x")).collect()]
    assert close > 0.9 and reversed_ < 0.3 and same == 1.0 and none == 1.0 and one == 0.0
    assert fp[3] != fp[4]  # occurrence numbers tell repeats apart


def test_mixing_reaches_targets(spark):
    rows = [(i, ("fine words in prose here and there " * 5) if i % 3 else "AAA!! BBB!! $$$ ### %%% " * 5) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)], "doc_id bigint, quality int, toxic int")
    post = mixing.posteriors(df, mixing.fit(df, labels))
    _, report = mixing.rates(post, lift={"good": 1.5, "low": 0.5})
    for got, want, natural in zip(report["reached"], report["target"], report["natural"], strict=True):
        assert natural <= 1e-3 * sum(report["natural"]) or abs(got - want) / natural < 0.01
    got = mixing.mix(df, labels, lift={"good": 1.5, "low": 0.5}).collect()
    assert all(r.rate >= 0 and math.floor(r.rate) <= r.copies <= math.floor(r.rate) + 1 for r in got)


def test_mixing_classifier(spark):
    """Features, weights and posteriors against numpy; held-out documents are told apart."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    k, m = len(mixing.DOMAINS), mixing.fit(d, labels)
    docs, lab = {r.doc_id: r.text or "" for r in d.collect()}, {r.doc_id: 2 if r.toxic else 0 if r.quality else 1 for r in labels.collect()}
    words = lambda t: [w for w in re.split(r"[ \t\n\v\f\r.,]+", t.lower()) if w]
    bucket = lambda w: np.int64(np.uint64(xxhash.xxh64_intdigest(w.encode(), 42))) % mixing.BUCKETS
    held = {i: {int(bucket(w)) for w in set(words(t))} for i, t in docs.items()}
    size, count = np.bincount(list(lab.values()), minlength=k).astype(float), {}
    for i, y in lab.items():
        for b in held[i]:
            count.setdefault(b, np.zeros(k))[y] += 1
    count = {b: c for b, c in count.items() if c.sum() >= mixing.HELD}

    def ratio(c):
        return 2 * sum(x * math.log(x / (part.sum() * n / size.sum())) for part in (c, size - c) for x, n in zip(part, size, strict=True) if x > 0)

    want = sorted(count, key=lambda b: (-round(ratio(count[b]), 6), b))[:mixing.TOLD]
    assert len(set(want) & set(m.buckets.tolist())) >= len(want) - 2  # the last places may be ties
    place = {b: i for i, b in enumerate(m.buckets.tolist())}
    x = np.zeros((len(docs), len(place)))
    for row, i in enumerate(docs):
        x[row, [place[b] for b in held[i] if b in place]] = 1
    logit = x @ m.weights + m.offset
    p = np.exp(logit - logit.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    got = {r["_id"]: r for r in mixing.posteriors(d, m).collect()}
    assert all(np.allclose(got[i]["_p"], p[row], atol=2e-5) and got[i]["_n"] == len(words(docs[i])) for row, i in enumerate(docs) if words(docs[i]))
    own = np.array([row for row, i in enumerate(docs) if i in lab])
    y = np.array([lab[i] for i in docs if i in lab])
    grad = x[own].T @ (p[own] - np.eye(k)[y]) + m.weights
    assert np.abs(grad).max() < 3e-4 * len(y)  # the fitted weights are a minimum
    train = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    rest = {r["_id"]: r["_p"] for r in mixing.posteriors(d, mixing.fit(d, train)).collect()}
    test = [i for i in lab if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([int(np.argmax(rest[i])) == lab[i] for i in test]) > 0.8


def descent(p, n, target, low, steps, high=8.0):
    """Projected gradient steps in numpy: the rates after so many of them."""
    natural, r, length = n @ p, np.ones(len(n)), 1.0
    for _ in range(steps):
        e = ((n * r) @ p - target) / natural
        d = np.clip(r - length * (p @ e), low, high) - r
        change = (n * d) @ p
        curve = (change**2 / natural).sum()
        r = r + min(1.0, -(e @ change) / curve) * d
        length = max(1.0, (n * d * d).sum() / curve)
    return r


def test_mixing_soft_posteriors(spark):
    """Rates equal numpy's, step for step; targets are met, and where bounds forbid that, totals are those of a long plain descent."""
    g = np.random.default_rng(3)
    p = np.round(g.dirichlet([6, 5, 0.6], 400), 6)
    n = g.integers(20, 200, 400)
    post = spark.createDataFrame([(i, int(t), x.tolist()) for i, (t, x) in enumerate(zip(n, p, strict=True))], "_id bigint, _n bigint, _p array<double>").coalesce(1)
    natural = n @ p
    for lift, low in (({"good": 1.25, "low": 0.75, "toxic": 0.5}, 0.0), ({"good": 1.25}, 1.0)):
        target = natural * [lift.get(d, 1.0) for d in mixing.DOMAINS]
        r = np.ones(400)
        for _ in range(30_000):
            r = np.clip(r - p @ (((n * r) @ p - target) / natural), low, 8.0)
        rated, report = mixing.rates(post, lift=lift, low=low)
        got = rated.orderBy("_id").toPandas()["_r"].to_numpy()
        assert np.allclose(got, descent(p, n, target, low, report["steps"]), atol=1e-6) and report["steps"] > mixing.STEPS
        assert got.min() >= low and np.allclose((n * got) @ p, report["reached"]) and report["away"] <= 1e-2
        assert (np.abs((n * got) @ p - (n * r) @ p) / natural).max() < 1e-2


def test_mixing_fits_small_domains(spark):
    """A domain with a few hundred-thousandths of all tokens reaches its target too."""
    rows = [(i, 100, [1.0, 0.0, 0.0]) for i in range(200)] + [(200 + i, 1, [0.0, 0.5, 0.5]) for i in range(2)] + [(300, 1, [0.0, 0.0, 1.0])]
    post = spark.createDataFrame(rows, "_id bigint, _n bigint, _p array<double>").coalesce(1)
    _, report = mixing.rates(post, lift={"toxic": 2.0})
    assert np.allclose(report["reached"], report["target"], rtol=2e-3)


def test_mixing_hard_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    got = mixing.mix(docs, labels, low=1.0).collect()
    assert len(got) == len(ROWS) and all(r.copies >= 1 for r in got)
    assert mixing.mix(empty, labels).count() == 0
    assert mixing.mix(docs, labels.where(F.lit(False))).count() == len(ROWS)


def phrases(text, corpus):
    """Longest-match parsing by brute force."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in corpus:
            j += 1
        i, n = max(j - 1, i + 1), n + 1
    return n


def test_language_phrases_brute_force():
    samples = {"a": "the cat sat on the mat and the dog", "b": "le chat est sur le tapis et le chien"}
    m = language_id.Model(samples)
    for text in ("the dog sat on a chat", "tapis le the mat", "x", "zzz qqq"):
        name = lambda t: "".join(chr(int(x) + 33) for x in m.normal(t))
        want = [phrases(name(text), name(samples[k])) for k in "ab"]
        assert m.phrases([m.normal(text)])[0].tolist() == want, text


def test_language_phrases_of_long_texts():
    """Texts of several blocks, alphabets of hundreds of letters, texts that a sample holds whole."""
    g = np.random.default_rng(8)
    letters = [chr(x) for x in range(0x4E00, 0x4E00 + 300)]
    many = "".join(g.choice(letters, 3000))
    few = "".join(g.choice(list("abc "), 4000))
    m = language_id.Model({"few": few, "many": many})
    name = lambda t: "".join(chr(int(x) + 33) for x in m.normal(t))
    texts = [many[100:2900], few[:3500], few[700:1400] + many[:900] + few[5:1500], "".join(g.choice(list("abcd "), 2600)), "".join(g.choice(letters + ["x", "é"], 1500)), "", "a" * 5000]
    got = m.phrases([m.normal(t) for t in texts])
    for t, row in zip(texts, got.tolist(), strict=True):
        assert row == [phrases(name(t), name(few)), phrases(name(t), name(many))]


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(d, language_id.training_sample(d)).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_language_hard_rows(docs, empty):
    samples = language_id.training_sample(docs)
    by = {r.doc_id: r for r in language_id.identify(docs, samples).collect()}
    assert by[3].lang_pred == by[4].lang_pred == "und" and by[3].score == 0.0 and by[1].lang_pred == "en"
    assert language_id.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(empty, samples).count() == 0


def test_segments_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        s = rng.normal(-0.2, 1, rng.integers(1, 40)).round(2)
        got = toxicity.segments(s)
        best = max((s[i:j].sum() for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        assert abs(max((x[2] for x in got), default=0) - max(best, 0)) < 1e-9
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False)) and all(abs(s[b:e].sum() - x) < 1e-9 for b, e, x in got)


def test_all_segments_by_their_definition():
    """The whole set: the best segment, then the same to both sides of it."""

    def parted(s, at=0):
        if not (s > 0).any():
            return []
        total = np.concatenate([[0], np.cumsum(s)])
        gain = total[None, :] - total[:, None]
        i, j = np.unravel_index(np.where(np.triu(np.ones_like(gain), 1) > 0, gain, -np.inf).argmax(), gain.shape)
        return [*parted(s[:i], at), (at + int(i), at + int(j)), *parted(s[j:], at + int(j))]

    rng = np.random.default_rng(9)
    for _ in range(300):
        s = rng.normal(-0.3, 1, rng.integers(0, 60))
        assert [(b, e) for b, e, _ in toxicity.segments(s)] == parted(s)


def test_toxicity_statistics_by_hand():
    """Log-odds, lambda, K and the logistic curve against their definitions, on small rows."""
    rows = [(["bad", "x"], 1)] * 30 + [(["fine", "x"], 0)] * 40
    odds = toxicity._log_odds(rows)
    every, n = 140, [80, 60]
    a = {w: 0.5 + toxicity.PRIOR * m / every for w, m in (("bad", 30), ("fine", 40))}
    want = math.log((30 + a["bad"]) / (60 + toxicity.PRIOR - 30 - a["bad"])) - math.log(a["bad"] / (80 + toxicity.PRIOR - a["bad"]))
    assert odds["bad"] == pytest.approx(max(-1.0, want) - toxicity.DRIFT) and odds["fine"] < 0 and "x" not in odds
    m = toxicity.Model({"bad": 1.0, "fine": -0.5})
    clean = [["fine"] * 9 + ["bad"], ["fine"] * 5, ["bad", "fine", "fine"]]
    lam, log_k = toxicity._gumbel(m, clean)
    s = np.array([-0.5] * 9 + [1.0] + [-0.5] * 5 + [1.0, -0.5, -0.5])
    assert np.exp(lam * s).mean() == pytest.approx(1, abs=1e-6)
    assert log_k == pytest.approx(math.log(3 / sum(k * math.exp(-lam * t) for k, t in ((10, 1.0), (5, 0.0), (3, 1.0)))))
    m.lam, m.log_k = lam, log_k
    assert m.evidence(2.0, 7) == pytest.approx(lam * 2.0 - log_k - math.log(7))
    x, y = np.array([-2.0, -1.0, 0.5, 1.0, 2.5, 0.0]), np.array([0, 0, 1, 0, 1, 1])
    slope, bias = toxicity._logistic(x, y)
    z = (x - x.mean()) / x.std()
    w = np.array([slope * x.std(), bias + slope * x.mean()])
    p = 1 / (1 + np.exp(-(z * w[0] + w[1])))
    assert np.abs(np.stack([z, np.ones(6)]) @ (y - p) - 1e-2 * w).max() < 1e-6


def test_toxicity_positions(spark):
    m = toxicity.Model({"bad": 2.0}, lam=1.0, log_k=-3.0, slope=1.0)
    texts = ["İstanbul ok bad bad bad ok", "x\u2003BAD, (bad)\nbad y", "bad " * 50_000, "ok", None]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])], "doc_id int, text string")
    got = toxicity.score(docs, m).collect()
    spans = {r.doc_id: [(x.start, x.end) for x in r.passages] for r in got}
    assert [texts[0][b:e] for b, e in spans[0]] == ["bad bad bad"] == [texts[0][b:e] for b, e in spans[None]]
    assert [texts[1][b:e] for b, e in spans[1]] == ["BAD, (bad)\nbad"] and spans[2] == [(0, 199_999)] and spans[3] == spans[4] == []
    assert all(r.held_out is False for r in got if r.doc_id is None)


def test_toxicity_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(d, toxicity.train(d, labels)).join(labels, "doc_id").where("held_out").toPandas()
    hit = got[got.predicted == 1].toxic
    assert hit.mean() > 0.9 and hit.sum() / got.toxic.sum() > 0.85


def test_toxicity_hard_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1)], "doc_id bigint, quality int, toxic int")
    m = toxicity.train(docs, labels)
    got = toxicity.score(docs, m).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, m).count() == 0


BASE_PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def test_pii_base_brute_force():
    rng = np.random.default_rng(4)
    for n in range(400):
        t = "".join(rng.choice(list("aZ9@@..-+% ()0123456789255"), 60)) if n else "a@b.c@d.e 1.2.3.4.5.6.7.8 4111 1111 1111 1111 +1 (743) 555-3824"
        want = []
        for k, p in enumerate(BASE_PATTERNS):
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m.group())
                ok = [True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else False, 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15][k]
                if ok:
                    want.append((m.start(), k, m.end()))
        assert pii.base_spans(t) == sorted(want), t


def test_pii_network_and_gradient():
    net = pii.Net.new(1, h=3)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, pii.CLASSES, (7, 4)), rng.integers(0, 5, (7, 4))
    _, grad = net.gradient(x, y)
    for name in ("gf", "ub", "w", "a", "cb"):
        at = tuple(np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape))
        e = 1e-2
        old = net.p[name][at]
        net.p[name][at] = old + e
        up = net.gradient(x, y)[0]
        net.p[name][at] = old - e
        down = net.gradient(x, y)[0]
        net.p[name][at] = old
        assert abs((up - down) / (2 * e) - grad[name][at]) < 2e-3
    text, tags = pii.labelled_text(np.random.default_rng(77), 40_000)
    found = set(pii.method_spans([text], pii.trained())[0])
    cut = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]])))
    gold = {(int(b), int(tags[b]) - 1, int(e)) for b, e in zip(cut[:-1], cut[1:], strict=True) if tags[b]}
    base = set(pii.base_spans(text))
    for kind in range(4):
        of = lambda spans: {x for x in spans if x[1] == kind}  # noqa: B023, E731
        assert len(of(gold - base) & found) / len(of(gold - base)) > 0.8, pii.KINDS[kind]
        assert len(of(gold) & found) / len(of(found)) > 0.9, pii.KINDS[kind]


def test_pii_viterbi_brute_force():
    """Tags of short windows against all paths; also where the search is left out."""
    rng = np.random.default_rng(2)
    for scale in (0.3, 1.0, 4.0):
        net = pii.Net.new(3, h=4)
        net.p["w"], net.p["b"] = net.p["w"] * np.float32(4 * scale), np.array([scale, 0, 0, 0, 0], np.float32)
        net.p["a"] = rng.normal(0, 1, (5, 5)).astype(np.float32)
        x = rng.integers(0, pii.CLASSES, (5, 60))
        e, got = net.emissions(x)[0], net.decode(x)
        paths = np.array(list(itertools.product(range(5), repeat=5)))
        for r in range(60):
            value = lambda y: sum(e[t, r, y[t]] for t in range(5)) + sum(net.p["a"][y[t - 1], y[t]] for t in range(1, 5))  # noqa: B023, E731
            assert abs(value(got[:, r]) - max(map(value, paths))) < 1e-4


def test_pii_windows_are_reconciled():
    """Spans against a walk over all windows one by one: the middle of a window decides."""
    net = pii.trained()
    text = pii.labelled_text(np.random.default_rng(9), 2000)[0]
    texts = [text[:n] for n in (0, 1, 90, 191, 192, 193, 352, 353, 900, 2000)] + ["", text[500:1300]]
    margin = (pii.WINDOW - pii.STRIDE) // 2
    for t, got in zip(texts, pii.method_spans(texts, net), strict=True):
        tags, last = np.zeros(len(t), int), max(0, -(-(len(t) - pii.WINDOW) // pii.STRIDE))
        for k in range(last + 1 if t else 0):
            begin = k * pii.STRIDE
            part = pii.classes_of(t[begin:begin + pii.WINDOW])
            own = net.decode(np.concatenate([part, np.zeros(pii.WINDOW - len(part), np.uint8)])[:, None])[:, 0]
            lo, hi = (0 if k == 0 else begin + margin), (len(t) if k == last else begin + pii.WINDOW - margin)
            tags[lo:hi] = own[lo - begin:hi - begin]
        want, i = [], 0
        while i < len(t):
            j = i
            while j < len(t) and tags[j] == tags[i]:
                j += 1
            piece = t[i:j]
            b, e = i + len(piece) - len(piece.lstrip(" \n.,:;")), j - (len(piece) - len(piece.rstrip(" \n.,:;")))
            if tags[i] and e > b and pii._holds(int(tags[i]) - 1, t[b:e]):
                want.append((b, int(tags[i]) - 1, e))
            i = j
        assert got == want


def test_pii_rows(docs, empty):
    """Every row's spans: the base ones by the patterns, the others by the method where they meet no base one."""
    net = pii.trained()
    got = Counter((r.doc_id, tuple((x.start, x.kind, x.end, x.base) for x in r.spans)) for r in pii.find(docs).collect())
    want = Counter()
    for i, t in ROWS:
        base = pii.base_spans(t or "")
        more = [x for x in pii.method_spans([t or ""], net)[0] if all(x[2] <= b[0] or x[0] >= b[2] for b in base)]
        want[i, tuple((s, pii.KINDS[k], e, (s, k, e) in base) for s, k, e in sorted(base + more))] += 1
    assert got == want
    assert sum(n for (i, spans), n in got.items() if i == 8 and len(spans) >= 2) == 1
    assert pii.find(empty).count() == 0


def test_pieces_round_trip_and_hard_rows(docs, empty):
    got = piece_sampling.encode(docs, k=3).collect()
    assert all(r.round_trip for r in got)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.log_prob if r.doc_id == 7 else 0), []).append(r)
    assert [r.n_pieces for r in by[(3, 0)]] == [0] and len({tuple(r.ids) for r in by[(6, 0)]}) == 3
    assert all(r.log_inclusion <= 0 for r in got)
    back = piece_sampling.decode(piece_sampling.encode(docs.where("doc_id < 7"), k=1)).collect()
    assert {(r.doc_id, r.text) for r in back} == {(i, t or "") for i, t in ROWS if i is not None and i < 7}
    assert piece_sampling.encode(empty).count() == 0


def test_pieces_without_replacement():
    """First and second sample of many draws follow the exact probabilities."""
    v = piece_sampling.vocabulary(piece_sampling.MODEL, 1.0)
    n = 6000
    got = piece_sampling.encode_batch(list(range(n)), ["hello"] * n, v, 2, 3)
    first, p, second = Counter(), {}, Counter()
    for s in got:
        a, b = tuple(s[0][0]), tuple(s[1][0])
        assert a != b and s[0][2] >= s[1][2]
        p[a], p[b] = math.exp(s[0][1]), math.exp(s[1][1])
        first[a] += 1
        second[a, b] += 1
    for a, m in first.most_common(2):
        assert abs(m / n - p[a]) < 0.03
    for (a, b), m in second.most_common(2):
        assert abs(m / n - p[a] * p[b] / (1 - p[a])) < 0.03


def segmentations(text, v):
    """Every segmentation of a text with its probability, by enumeration: pieces, or the bytes of characters that are none."""
    s = (piece_sampling.SPACE + text.replace(" ", piece_sampling.SPACE)) if text else ""
    number = dict(zip(v.keys.tolist(), range(len(v.keys)), strict=True))
    known = lambda p: number.get(v.hash_of(p))

    def go(i):
        if i == len(s):
            return [((), 0.0)]
        options = [(j, (int(v.ids[n]),), v.weights[n]) for j in range(i + 1, min(len(s), i + v.longest) + 1) if (n := known(s[i:j])) is not None]
        if known(s[i]) is None:
            raw = s[i].encode()
            options.append((i + 1, tuple(v.byte_id[x] for x in raw), v.weights[len(v.ids) + len(raw) - 1]))
        return [(ids + rest, w + x) for j, ids, w in options for rest, x in go(j)]

    every = go(0)
    top = np.logaddexp.reduce([w for _, w in every])
    return {ids: math.exp(w - top) for ids, w in every}


def test_pieces_enumeration():
    """All segmentations of short texts: ids, probabilities, and inclusion probabilities that weigh samples without bias."""
    v = piece_sampling.vocabulary(piece_sampling.MODEL, 1.0)
    for text in ("it's", "a_{b", "  x", "né日", "}_{ ._"):
        want = segmentations(text, v)
        got = piece_sampling.encode_batch([1], [text], v, len(want) + 5, 3)[0]
        assert len(got) == len(want)
        assert {tuple(x[0].tolist()): pytest.approx(math.exp(x[1]), rel=1e-3, abs=1e-9) for x in got} == want
        assert all(a[2] >= b[2] for a, b in zip(got, got[1:], strict=False))
    want, n = segmentations("hell", v), 4000
    draws = piece_sampling.encode_batch(list(range(n)), ["hell"] * n, v, 3, 5)
    weighed = Counter()
    for d in draws:
        for ids, lp, _, inc in d:
            weighed[tuple(ids.tolist())] += math.exp(lp - inc) / n
    assert abs(sum(weighed.values()) - 1) < 0.03
    for ids, p in sorted(want.items(), key=lambda x: -x[1])[:4]:
        assert abs(weighed[ids] - p) < 0.03
    third = Counter(tuple(d[2][0].tolist()) for d in draws)
    exact = Counter()
    for a, pa in want.items():
        for b, pb in want.items():
            for c, pc in want.items():
                if len({a, b, c}) == 3:
                    exact[c] += pa * pb / (1 - pa) * pc / (1 - pa - pb)
    for ids, p in exact.most_common(3):
        assert abs(third[ids] / n - p) < 0.03


def test_pieces_no_cut_through_pieces():
    """Every piece of the vocabulary lies in one unit and is an edge of it; long runs are one lattice."""
    v = piece_sampling.vocabulary(piece_sampling.MODEL, 1.0)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_sampling.MODEL)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    units, many = v.units(pieces)
    assert set(many) == {1} and units == pieces and all(v.word.findall(p) == [p] for p in pieces)
    lat = piece_sampling.Lattice(units, v)
    for i in range(0, len(units), 97):
        edges = range(lat.begin[lat.first[i]], lat.begin[lat.first[i] + 1])
        assert any(lat.length[e] == len(units[i]) for e in edges)
    run = "b" * 3000
    assert len(v.units([run])[0]) == 1
    got = piece_sampling.encode_batch([0], [run], v, 2, 3)[0]
    assert all(v.decode(x[0]) == run for x in got) and got[0][0].tolist() != got[1][0].tolist()


def test_pieces_look_up_only_what_may_be_a_piece(monkeypatch):
    """Strings that begin no piece are not lengthened; texts give the same samples alone and together."""
    v = piece_sampling.vocabulary(piece_sampling.MODEL, 1.0)
    r = np.random.default_rng(4)
    texts = [" ".join("".join(r.choice(list("etaoinshrdlu"), n)) for n in r.integers(6, 15, 60)) for _ in range(40)]
    looked, find = [], piece_sampling.Vocabulary.find
    monkeypatch.setattr(piece_sampling.Vocabulary, "find", lambda self, h: (looked.append(h.size), find(self, h))[1])
    got = piece_sampling.encode_batch(list(range(40)), texts, v, 2, 3)
    assert sum(looked) < 4.5 * len("".join(set(" ".join(texts).split())))
    alone = [piece_sampling.encode_batch([i], [t], v, 2, 3)[0] for i, t in enumerate(texts)]
    assert [[x[0].tolist() for x in s] for s in got] == [[x[0].tolist() for x in s] for s in alone]


def test_pieces_words_and_cuts(monkeypatch):
    """Texts with any spaces fall into the words of the expression; cuts by classes are those by pairs."""
    v = piece_sampling.vocabulary(piece_sampling.MODEL, 1.0)
    texts = ["a b", " a", "a ", "a  b", "  ", "▁a ▁", "x ▁▁ y", "né\n  日本 b", "it's\t so,  then. "]
    held = []
    cuts = piece_sampling.Vocabulary.cuts
    monkeypatch.setattr(piece_sampling.Vocabulary, "cuts", lambda self, code, ends: (held.extend("".join(map(chr, x)) for x in np.split(code, ends)[:-1]), cuts(self, code, ends))[1])
    piece_sampling.encode_batch(list(range(len(texts))), texts, v, 1, 3)
    spelled = [piece_sampling.SPACE + t.replace(piece_sampling.SPACE, piece_sampling.MARK).replace(" ", piece_sampling.SPACE) for t in texts]
    words = list(dict.fromkeys(w for s in spelled for w in v.word.findall(s)))
    assert held == words
    by_class = v.units(words)
    monkeypatch.setattr(v, "classes", None)
    by_pair = v.units(words)
    assert by_class[0] == by_pair[0] and by_class[1].tolist() == by_pair[1].tolist() and len(by_pair[0]) > len(words)


def test_pieces_decode_replaces_a_column(spark):
    rows = spark.createDataFrame([("old", [1, 2])], "text string, ids array<int>")
    assert piece_sampling.decode(rows).columns == ["ids", "text"]


def test_pii_windows_left_out_of_the_search_have_no_tags():
    """Whatever rows the proof leaves out have tag 0 throughout as their best path; rows it once searched for nothing are left out."""
    r = np.random.default_rng(8)
    left = 0
    for _ in range(40):
        e, a = r.normal(0, 1, (5, 3, 20)).astype(np.float32), r.normal(0, 1, (3, 3)).astype(np.float32)
        e[:, 0] += 1.5
        searched = set(pii.unsure(e, a).tolist())
        for row in set(range(20)) - searched:
            score = lambda p, x=e[:, :, row], a=a: sum(x[t, k] for t, k in enumerate(p)) + sum(a[i, j] for i, j in zip(p, p[1:], strict=False))
            assert max(itertools.product(range(3), repeat=5), key=score) == (0,) * 5
        lead = (e[:, :1] - e[:, 1:]).min(axis=(0, 1))
        left += sum(lead[row] <= 2 * (a.max() - a[0, 0]) for row in set(range(20)) - searched)
    assert left > 50
