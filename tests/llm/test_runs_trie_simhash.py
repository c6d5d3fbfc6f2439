"""Runs, the prefix trie and ball hashing against brute force, on small hard tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewire.llm import queries, simhash_ball, turn_trie, word_runs


def brute_runs(s, periods):
    out = {}
    for q in range(1, len(s) // periods + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i + q >= periods * q:
                out.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((b, e, q) for (b, e), q in out.items())


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(4000):
        n, k = rng.randint(0, 40), rng.choice([1, 2, 2, 3, 4])
        s = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.4 and n > 4:
            a, p = rng.randrange(n), rng.randint(1, 5)
            s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
        s = s + s[: rng.randint(0, n)] + s if rng.random() < 0.3 else s
        for periods in (2, 3, 4):
            assert sorted(word_runs.runs(s, periods)) == brute_runs(s, periods)


def test_factors_are_the_longest_earlier_words():
    rng = random.Random(6)
    for _ in range(500):
        s = [rng.randrange(3) for _ in range(rng.randint(1, 30))]
        at = 0
        for b, e, far in word_runs.factors(s):
            assert b == at
            earlier = [e2 - b for e2 in range(b + 1, len(s) + 1) if any(s[k:k + e2 - b] == s[b:e2] for k in range(b))]
            assert e - b == max(earlier, default=0) or (not earlier and e - b == 1 and far == 0)
            assert not far or s[b - far:e - far] == s[b:e]
            at = e
        assert at == len(s)


def test_rare_words_end_runs():
    rng = random.Random(7)
    for _ in range(500):
        s = np.array([rng.choice([0, 0, 0, 1, 1, 2, 9]) for _ in range(rng.randint(0, 60))], np.int64)
        whole = sorted((b, e - b, q) for b, e, q in brute_runs(s.tolist(), 4) if e - b >= 6)
        assert sorted(word_runs.runs_of_text(s, 4, 6)) == whole


def test_runs_of_hard_rows(spark):
    long = " ".join(["x", "y"] * 30_000)
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\x0b ", "c"), (4, "a b a b a b a b c", "d"), (5, long, "e"), (None, "z z z z z z", "f"), (4, "a b a b a b a b c", "d"), (6, "z z z z z z z z z z", "g")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    got = {(r[0], r[1]): r for r in word_runs.find_runs(docs, periods=4, least=6).collect()}
    assert [tuple(x) for x in got[4, 9].runs] == [(0, 8, 2)] and got[4, 9].collapsed == "a b c"
    assert [tuple(x) for x in got[5, 60_000].runs] == [(0, 60_000, 2)] and got[5, 60_000].collapsed == "x y"
    assert [tuple(x) for x in got[None, 6].runs] == [(0, 6, 1)] and got[None, 6].collapsed == "z"
    assert [tuple(x) for x in got[6, 8].runs] == [(2, 6, 1)] and got[6, 8].collapsed == "z z z z z"
    assert all(got[k].runs == [] and got[k].collapsed == "" for k in [(1, 0), (2, 0), (3, 0)])
    assert word_runs.find_runs(docs).count() == 8 and word_runs.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        word_runs.find_runs(docs, periods=1)


def test_op11_of_texts_without_words(spark, tmp_path):
    """Ids whose crc32 ends in 0 build their text anew: a text without words has nothing to build from."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    spark.createDataFrame(list(zip(ids, [None, "", " \n\x0b ", "a"], strict=True)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_runs(spark, str(tmp_path)).collect()}
    assert all(got[i].n_runs == 0 and got[i].start is None for i in ids)
    assert [got[i].collapsed_sha256 for i in ids] == [hashlib.sha256(x).hexdigest() for x in (b"", b"", b"", b"a")]


def brute_trie(convs):
    """convs: id -> list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        out, todo = [], [p]
        while todo:
            x = todo.pop()
            out.append(x)
            todo += children[x]
        return out

    rows = []
    for p, m in members.items():
        sub = below(p)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in sub if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[x] for x in sub), saved, digest))
    return sorted(rows)


def lists(spark, convs):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return turn_trie.turn_lists(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_over_many_tasks(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(turn_trie, "PACK", 3)
    turns = [("u", "a"), ("s", "bé"), ("u", "ccc"), ("", "")]
    convs = {c * rng.choice([1, 7]) + 10_000 * (c % 3): [rng.choice(turns) for _ in range(rng.choice([1, 2, 3, 3, 9]))] for c in range(120)}
    convs |= {c: [turns[0], turns[1]] for c in range(50_000, 50_040)}  # a group of copies
    for share in (100_000, 5):
        got = turn_trie.prefix_trie(lists(spark, convs), share=share).select(COLS).collect()
        assert sorted(map(tuple, got), key=str) == sorted(brute_trie(convs), key=str)


def test_loser_tree_merges_with_shared_turns():
    rng = random.Random(3)
    unit = [bytes([k]) * turn_trie.UNIT for k in range(3)]
    for _ in range(300):
        keys = sorted({b"".join(rng.choice(unit) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 30))})
        runs = [[] for _ in range(rng.randint(1, 5))]
        for k in keys:
            rng.choice(runs).append((k,))
        got = list(turn_trie.merged([turn_trie.sorted_run(r) for r in runs]))
        assert [r[0] for _, r in got] == keys
        assert [n for n, _ in got][1:] == [turn_trie.shared(a, b) for a, b in zip(keys, keys[1:], strict=False)]


def test_trie_shared_heads_and_hard_rows(spark):
    rows = [(100, None, "u", "x"), (100, 0, None, "y"), (100, 0, "", "y"), (101, 5, "u", None), (101, 1, "u", "q"), (7, 0, "u", "long " * 50_000), (None, 0, "u", "lost"), (205, 0, "u", "z"), (-101, 0, "u", "n")]
    table = spark.createDataFrame([(*r, "n") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth string")
    orig = {100: [("u", "x"), ("", "y"), ("", "y")], 101: [("u", "q"), ("u", "")], 7: [("u", "long " * 50_000)], 205: [("u", "z")], -101: [("u", "n")]}
    share = {c: zlib.crc32(str(c).encode()) % 6 for c in orig}
    head = {c: orig.get(c - int(np.fmod(c, 100)), []) for c in orig}
    convs = {c: head[c][: share[c]] + t[share[c]:] for c, t in orig.items()}
    made = turn_trie.with_shared_head(turn_trie.turn_lists(table), F.col("_c") - F.col("_c") % 100, F.crc32(F.col("_c").cast("string")) % 6)
    got = turn_trie.prefix_trie(made).select(COLS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_trie(convs), key=str)
    assert any(not t for t in convs.values())  # one is left without turns
    assert turn_trie.prefix_trie(turn_trie.turn_lists(table.limit(0))).count() == 0


def brute_fingerprint(text, words=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        low = low.replace(c, " ")
    ws = [w for w in low.split(" ") if w]
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i:i + words]).encode(), 42) for i in range(max(1, len(ws) - words + 1))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, ids, radius=4):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, c in enumerate(ids):
        if c is not None:
            least[root(i)] = min(c, least.get(root(i), c))
    return [least.get(root(i)) for i in range(len(fps))]


def test_fingerprints_and_components_of_hard_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [None, "", " \t\n", "One", "one", "a b", base, base + " more", base.upper(), base.replace("w7 ", "x7 "), "ä b C d E", "x " * 70_000, base]
    rows = [(40 - i, t, i) for i, t in enumerate(texts)] + [(None, base, 0), (40 - 12, base, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint int")
    got = simhash_ball.near_dedup(docs).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], brute_components(fps, [r[0] for r in rows]), strict=True), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert simhash_ball.near_dedup(docs.limit(0)).count() == 0


def balls(rng, n):
    out = []
    for _ in range(n):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 9])):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            out.append(x)
    x = 0
    for b in range(0, 64, 4):  # a chain whose ends are far apart
        x ^= 15 << b
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("most", [1_000_000, 9_000, 30])
def test_links_lose_nothing_however_long_the_prefixes(spark, most):
    fps = balls(random.Random(11), 60)
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "_f bigint")
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash_ball.links(table, most=most).collect()]
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[root(a)] = root(b)
    want = brute_components(fps, fps)
    groups = defaultdict(set)
    for x, c in zip(fps, want, strict=True):
        groups[c].add(root(x))
    assert all(len(g) == 1 for g in groups.values()) and len({root(x) for x in fps}) == len(groups)


def test_op13_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in docs]
    want = {(r.doc_id, f"{f:016x}", c) for r, f, c in zip(docs, fps, brute_components(fps, [r.doc_id for r in docs]), strict=True)}
    assert {tuple(r) for r in queries.op13_simhash(spark, sf_dir).collect()} == want
