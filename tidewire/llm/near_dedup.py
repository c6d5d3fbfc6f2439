"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes its set of word shingles (64-bit hashes), a signature of bands x rows MinHash values and a
   128-bit hash of the set.  Documents with the same set are one class; only class representatives go on.
   The number of bands follows from the threshold and the chosen miss probability at the threshold.
2. Candidates share a band.  In a band's bucket everybody is compared with the bucket's hub, not with each other, and
   only where they aren't in one component yet: a sixth of the buckets goes first and links most copies.  Those
   outside their hub's component get a new hub as long as that halves their number.
3. Buckets that still hold several components are compared across them in blocks of 256 rows on signatures alone.
   Rows of a bucket's largest component aren't compared with each other.  A row hands on its few most alike
   candidates of each other component; while some row has more than were handed on and its component hasn't changed
   that, the next turn hands on eight times as many.  So no link is lost, and a group of copies makes few rows.
4. A candidate pair's signatures are compared batch by batch (blocks add a one-permutation sketch of 1024 bins).  After
   each batch the posterior probability (uniform prior, so a Beta law) that the similarity reaches the threshold is
   looked up in a table of the least number of agreements; a pair whose probability falls under the miss probability
   is pruned.
5. Survivors are verified exactly on their full shingle sets: 100 * intersection >= percent * union.
6. Components are merged in tables (no driver, no localCheckpoint).

Cases: a null text, or one without words, has an empty set and is linked with nothing; with fewer words than a
shingle the whole sequence is the one shingle; equal sets are linked; rows that repeat an id are one document, whose
text with the largest set counts (ties: by the set's hash), and all of them get its number and component; null ids are
not linked and come back as their own; ids are whole numbers of at most 64 bits (others raise Spark's cast error); an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import chunks, forget, keep, release, ship
from tidewire.llm.components import components

MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Plan:
    words: int = 5
    percent: int = 80
    rows: int = 6
    miss: float = 1e-6
    batch: int = 30

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * MIX2
    return x ^ (x >> np.uint64(29))


def shingles(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.  Words: runs of anything but ASCII white space, A-Z lower-cased."""
    low = pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string()))
    split = pc.split_pattern_regex(low, "[ \t\n\v\f\r]+")
    flat = split.flatten()
    ends = split.offsets.to_numpy()
    code = pc.dictionary_encode(flat)
    names = code.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
    empty = np.fromiter((w == "" for w in names), bool, len(names))
    idx = code.indices.to_numpy()
    value, blank = hashes[idx], empty[idx]
    out = []
    for i in range(len(texts)):
        b, e = ends[i], ends[i + 1]
        while b < e and blank[b]:
            b += 1
        while e > b and blank[e - 1]:
            e -= 1
        w = value[b:e]
        n = len(w)
        if n == 0:
            out.append(w)
            continue
        k = min(words, n)
        h = w[: n - k + 1] * MIX1
        for j in range(1, k):
            h = _mix(h) + w[j: n - k + 1 + j] * MIX1
        out.append(np.unique(_mix(h)))
    return out


@lru_cache(4)
def _salts(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240131)
    return r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def signature(s: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values (32 bits) of a set."""
    a, b = _salts(n)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 4096):
        x = s[i:i + 4096, None] * a
        x ^= b
        out = np.minimum(out, (x >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return out


@lru_cache(16)
def least_agreements(percent: int, total: int, batch: int, miss: float, bits: int = 8) -> tuple[tuple[int, int], ...]:
    """(values compared, least agreements) after each batch: fewer, and P(similarity >= threshold) < miss.

    Uniform prior on the similarity s; a value of `bits` bits agrees with probability s + (1 - s) / 2 ** bits.  The
    posterior is summed on a grid.
    """
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 2**bits
    out = []
    for n in range(batch, total + 1, batch):
        least = 0
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[s >= percent / 100].sum() / w.sum() >= miss:
                least = m
                break
        out.append((n, least))
    return tuple(out)


BINS, BIN_SHIFT = 1024, 54


def one_permutation(s: np.ndarray) -> bytes:
    """A byte for each of 1024 bins of a sorted set of hashes: from the smallest hash of the bin, 0 if it has none."""
    out = np.zeros(BINS, np.uint8)
    bins, first = np.unique((s >> np.uint64(BIN_SHIFT)).astype(np.int64), return_index=True)
    out[bins] = 1 + (s[first] % np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def least_of_bins(percent: int, used: np.ndarray, union: np.ndarray, miss: float) -> np.ndarray:
    """Least share of agreeing bins: below it P(similarity >= threshold) < miss.

    The bins in use are a sample of the union without replacement, so the deviation shrinks with the part left out.
    """
    t = percent / 100
    z = NormalDist().inv_cdf(1 - miss / 2)
    left_out = np.maximum(0.02, 1 - used / np.maximum(union, used))
    return t - z * np.sqrt(t * (1 - t) / np.maximum(1, used) * left_out) - 1 / np.maximum(1, used)


def _half(raw: bytes, which: int) -> int:
    """One of the two halves of a set's hash."""
    return xxhash.xxh3_64_intdigest(raw, which) - (1 << 63)


def sketches(docs: DataFrame, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    """_id, _n, _k1, _k2 (hash of the set), _sig (a byte of each value), _oph (1024 bins), _bands; null for empty sets."""
    ship(docs.sparkSession)
    total = plan.bands * plan.rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(frames, "_t", 2_000_000):
            rows = []
            for s in shingles(part["_t"].tolist(), plan.words):
                if not len(s):
                    rows.append((0, None, None, None, None, None))
                    continue
                sig = signature(s, total)
                bands = sig.reshape(plan.bands, plan.rows)
                keys = [xxhash.xxh3_64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(bands)]
                raw = s.tobytes()
                rows.append((len(s), _half(raw, 1), _half(raw, 2), (sig & 0xFF).astype(np.uint8).tobytes(), one_permutation(s), keys))
            out = pd.DataFrame(rows, columns=["_n", "_k1", "_k2", "_sig", "_oph", "_bands"]).astype({"_k1": "Int64", "_k2": "Int64"})
            out.insert(0, "_id", part["_id"].to_numpy())
            yield out
        release()

    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_t")).where(F.col("_id").isNotNull())
    return rows.mapInPandas(run, "_id bigint, _n bigint, _k1 bigint, _k2 bigint, _sig binary, _oph binary, _bands array<bigint>")


def _survivors(pairs: DataFrame, reps: DataFrame, plan: Plan) -> DataFrame:
    """Candidate pairs (a, b) that the sequential test keeps."""
    total = plan.bands * plan.rows
    steps = least_agreements(plan.percent, total, plan.batch, plan.miss)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            x = np.frombuffer(b"".join(f["sa"]), np.uint8).reshape(len(f), total)
            y = np.frombuffer(b"".join(f["sb"]), np.uint8).reshape(len(f), total)
            alive, agreed, before = np.arange(len(f)), np.zeros(len(f), np.int64), 0
            for n, least in steps:
                agreed = agreed + (x[alive, before:n] == y[alive, before:n]).sum(axis=1)
                stay = agreed >= least
                alive, agreed, before = alive[stay], agreed[stay], n
                if not len(alive):
                    break
            yield f.iloc[alive][["a", "b"]]

    side = lambda k: reps.select(F.col("_id").alias(k), F.col("_sig").alias(f"s{k}"), F.col("_n").alias(f"n{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = joined.where((F.col("na") * 100 >= F.col("nb") * plan.percent) & (F.col("nb") * 100 >= F.col("na") * plan.percent))
    return sized.select("a", "b", "sa", "sb").mapInPandas(run, "a bigint, b bigint")


def _sets(ids: DataFrame, docs: DataFrame, plan: Plan, id_col: str, text_col: str, again: DataFrame | None) -> DataFrame:
    """Full shingle sets of the listed documents, written once; again: which set counts, for ids of several rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(frames, "_t", 2_000_000):
            got = [s.tobytes() for s in shingles(part["_t"].tolist(), plan.words)]
            yield pd.DataFrame({"_id": part["_id"].to_numpy(), "_k1": [_half(x, 1) for x in got], "_k2": [_half(x, 2) for x in got], "_set": got})
        release()

    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_t"))
    sets = texts.join(ids, "_id", "left_semi").mapInPandas(run, "_id bigint, _k1 bigint, _k2 bigint, _set binary")
    if again is None:
        return keep(sets.select("_id", "_set"), "sets")
    chosen = sets.join(again.select("_id", "_top"), "_id", "left").where(F.col("_top").isNull() | (F.col("_k1") == F.col("_top._k1")) & (F.col("_k2") == F.col("_top._k2")))
    return keep(chosen.select("_id", "_set").dropDuplicates(["_id"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Pairs whose full sets are similar enough."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = []
            for p, q in zip(f["sa"], f["sb"], strict=True):
                both = np.concatenate([np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inter >= plan.percent * (len(both) - inter))
            yield f.loc[np.array(ok, bool), ["a", "b"]]

    side = lambda k: sets.select(F.col("_id").alias(k), F.col("_set").alias(f"s{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInPandas(check, "a bigint, b bigint").distinct()


def _across(rows: DataFrame, plan: Plan, best: int, block: int = 256) -> DataFrame:
    """(_key, a, b, more): for each row and each other component of a task its `best` most alike candidates; more: there were others.

    rows: _key, _id, _c, _n, _sig, _oph, _bands, _out (the row is outside the bucket's largest component).  Rows outside
    are compared with all rows of the bucket, those inside not with each other.  Both are dealt into blocks by a hash,
    and a run of sorted rows (one bucket and pair of blocks, so at most 2 * block rows on average) is compared at once.
    """
    total = plan.bands * plan.rows
    steps = least_agreements(plan.percent, total, plan.batch, plan.miss)

    def compare(f: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        sig = np.frombuffer(b"".join(f["_sig"]), np.uint8).reshape(len(f), total)
        oph = np.frombuffer(b"".join(f["_oph"]), np.uint8).reshape(len(f), BINS)
        bands = np.stack(f["_bands"].to_numpy())
        key, p, q, out, asks, c, n, own = (f[k].to_numpy() for k in ("_key", "_p", "_q", "_out", "_asks", "_c", "_n", "_id"))
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(f)], strict=True):
            ask, rest = np.flatnonzero(asks[lo:hi]) + lo, np.flatnonzero(~asks[lo:hi]) + lo
            for i in ask:
                # Of two rows outside, the one with the smaller id asks.
                j = rest[(c[rest] != c[i]) & (~out[rest] | (own[rest] > own[i])) & (100 * np.minimum(n[rest], n[i]) >= plan.percent * np.maximum(n[rest], n[i]))]
                agreed, before = np.zeros(len(j), np.int64), 0
                for to, least in steps:
                    if not len(j):
                        break
                    agreed = agreed + (sig[j, before:to] == sig[i, before:to]).sum(axis=1)
                    stay = agreed >= least
                    j, agreed, before = j[stay], agreed[stay], to
                if not len(j):
                    continue
                # Each pair once: in the first band that it shares, by the bands' full keys (signatures hold bytes alone).
                j = j[(bands[j] == bands[i]).argmax(axis=1) == (bands[i] == key[lo]).argmax()]
                used = (oph[j] > 0) | (oph[i] > 0)
                same, many = ((oph[j] == oph[i]) & used).sum(axis=1), used.sum(axis=1)
                union = (n[j] + n[i]) / (1 + plan.percent / 100)
                ok = same >= least_of_bins(plan.percent, many, union, plan.miss) * many
                j, like = j[ok], (same / np.maximum(1, many))[ok]
                order = np.lexsort((own[j], -like, c[j]))
                j = j[order]
                first = np.concatenate([[True], c[j][1:] != c[j][:-1]]) if len(j) else np.zeros(0, bool)
                place = np.arange(len(j)) - np.maximum.accumulate(np.where(first, np.arange(len(j)), 0)) if len(j) else j
                size = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1] if len(j) else j
                top = place < best
                yield np.full(top.sum(), key[lo]), np.minimum(own[j[top]], own[i]), np.maximum(own[j[top]], own[i]), size[top] > best

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            last = f.iloc[-1] if len(f) else None
            open_ = (f["_key"] == last["_key"]) & (f["_p"] == last["_p"]) & (f["_q"] == last["_q"]) if len(f) else None
            held = f[open_] if len(f) else None
            yield table(f[~open_] if len(f) else f)
        if held is not None:
            yield table(held)
        release()

    def table(f: pd.DataFrame) -> pd.DataFrame:
        got = list(compare(f)) if len(f) else []
        key, a, b, more = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        return pd.DataFrame({"_key": key, "a": a, "b": b, "more": more})

    sizes = keep(rows.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_mq"), F.ceil(F.sum(F.col("_out").cast("int")) / block).cast("int").alias("_mp")), "sizes")
    placed = rows.join(sizes, "_key").withColumn("_h", F.xxhash64("_id", F.lit(3)))
    each = lambda n: F.sequence(F.lit(0), n - 1)
    asking = placed.where("_out").select("*", F.pmod("_h", "_mp").cast("int").alias("_p"), F.explode(each(F.col("_mq"))).alias("_q"), F.lit(True).alias("_asks"))
    asked = placed.select("*", F.explode(each(F.col("_mp"))).alias("_p"), F.pmod("_h", "_mq").cast("int").alias("_q"), F.lit(False).alias("_asks"))
    dealt = asking.select(*asked.columns).unionByName(asked).drop("_h", "_mp", "_mq")
    return dealt.repartition("_key", "_p", "_q").sortWithinPartitions("_key", "_p", "_q").mapInPandas(run, "_key bigint, a bigint, b bigint, more boolean")


def one_row_an_id(own: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(sketches with an id once, table of _id and _rows for ids of several rows or None): the largest set counts, ties by hash."""
    best = F.max(F.struct("_n", F.coalesce("_k1", F.lit(0)).alias("_k1"), F.coalesce("_k2", F.lit(0)).alias("_k2"))).alias("_top")
    again = keep(own.groupBy("_id").agg(F.count(F.lit(1)).alias("_rows"), best).where(F.col("_rows") > 1), "again")
    if again.isEmpty():
        return own, None
    cols = own.columns
    some = own.join(again, "_id").where((F.col("_n") == F.col("_top._n")) & (F.coalesce("_k1", F.lit(0)) == F.col("_top._k1")) & (F.coalesce("_k2", F.lit(0)) == F.col("_top._k2")))
    return keep(own.join(again, "_id", "left_anti").unionByName(some.select(*cols).dropDuplicates(["_id"])), "sketches"), again


def near_dedup(docs: DataFrame, plan: Plan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (smallest id reachable), kept; a row for each row of docs."""
    plan = plan or Plan()
    own, again = one_row_an_id(keep(sketches(docs, plan, id_col, text_col), "sketches"))
    filled = own.where(F.col("_n") > 0)
    classes = keep(filled.groupBy("_k1", "_k2").agg(F.min("_id").alias("_rep")), "classes")
    bands = keep(filled.select("_id", "_bands").join(classes.select(F.col("_rep").alias("_id")), "_id", "left_semi"), "bands")
    banded = bands.select("_id", F.explode("_bands").alias("_key"))
    # The hub: the id that is smallest when xor-ed with a hash of the bucket (and xor gives the id back).
    salt = F.xxhash64("_key")
    hubs = banded.groupBy("_key").agg(F.count(F.lit(1)).alias("_m"), F.min(F.col("_id").bitwiseXOR(salt)).alias("_x")).where(F.col("_m") > 1)
    hubs = keep(hubs.select("_key", F.col("_x").bitwiseXOR(salt).alias("_hub")), "hubs")
    buckets = keep(banded.join(hubs, "_key").select("_key", "_id", "_hub"), "buckets")
    forget(bands, hubs)
    ids = keep(buckets.select("_id").distinct(), "ids")
    reps = keep(filled.select("_id", "_n", "_sig", "_oph", "_bands").join(ids, "_id", "left_semi"), "reps")
    sets = _sets(ids, docs, plan, id_col, text_col, again)
    label = ids.select("_id", F.col("_id").alias("_c"))

    def placed(rows: DataFrame, col: str = "_id", name: str = "_c") -> DataFrame:
        return rows.join(label.select(F.col("_id").alias(col), F.col("_c").alias(name)), col)

    def joined(pairs: DataFrame, seen: bool = False) -> None:
        """Verify pairs of representatives and merge the components that they link."""
        nonlocal label
        links = _verified(pairs if seen else _survivors(pairs, reps, plan), sets, plan)
        between = placed(placed(links, "a", "_ca"), "b", "_cb").where(F.col("_ca") != F.col("_cb"))
        edges = keep(between.select(F.least("_ca", "_cb").alias("a"), F.greatest("_ca", "_cb").alias("b")).distinct(), "links")
        if not edges.isEmpty():
            moved = components(edges)
            old, label = label, keep(label.join(moved, label["_c"] == moved["node"], "left").select("_id", F.coalesce("label", "_c").alias("_c")), "label")
            forget(old, moved)
        forget(edges, pairs)

    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    # Every bucket's rows against its hub; the first buckets link most copies, so later ones have few pairs left.
    share = F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(16))
    for low, high in ((0, 3), (3, 16)):
        some = buckets.where((share >= low) & (share < high) & (F.col("_id") != F.col("_hub")))
        apart = placed(placed(some), "_hub", "_hc").where(F.col("_c") != F.col("_hc"))
        joined(keep(apart.select(*ordered(F.col("_id"), F.col("_hub"))).distinct(), "pairs"))

    # Rows outside their hub's component get a hub of their own, as long as that halves their number.
    rest, before = keep(placed(placed(buckets), "_hub", "_hc").where(F.col("_c") != F.col("_hc")).select("_key", "_id"), "rest"), None
    for turn in range(1, 64):
        salt = F.xxhash64("_key", F.lit(turn))
        again_hub = keep(rest.groupBy("_key").agg(F.count(F.lit(1)).alias("_m"), F.min(F.col("_id").bitwiseXOR(salt)).alias("_x")).where(F.col("_m") > 1).select("_key", F.col("_x").bitwiseXOR(salt).alias("_hub")), "hubs")
        rest = keep(rest.join(again_hub, "_key"), "rest")
        left = rest.count()
        if not left or before is not None and 2 * left > before:
            break
        before = left
        apart = placed(placed(rest), "_hub", "_hc").where(F.col("_c") != F.col("_hc"))
        joined(keep(apart.select(*ordered(F.col("_id"), F.col("_hub"))).distinct(), "pairs"))
        rest = keep(placed(placed(rest), "_hub", "_hc").where(F.col("_c") != F.col("_hc")).select("_key", "_id"), "rest")

    # Buckets that still hold several components (their hub has met all others): compare across components.
    best, others = 2, buckets.where(F.col("_id") != F.col("_hub")).select("_key", "_id")
    while True:
        rows = keep(placed(others), "rest")
        parts_ = rows.groupBy("_key", "_c").agg(F.count(F.lit(1)).alias("_m"))
        mixed = keep(parts_.groupBy("_key").agg(F.count(F.lit(1)).alias("_k"), F.max(F.struct("_m", "_c")).alias("_top")).where(F.col("_k") > 1).select("_key", F.col("_top._c").alias("_big")), "mixed")
        if mixed.isEmpty():
            break
        outside = rows.join(mixed, "_key").select("_key", "_id", "_c", (F.col("_c") != F.col("_big")).alias("_out"))
        left_over = keep(outside.join(reps, "_id"), "left_over")
        found = keep(_across(left_over, plan, best), "across")
        forget(left_over)
        joined(keep(found.select("a", "b").distinct(), "pairs"), seen=True)
        unsure = keep(found.where("more").select("_key").distinct(), "unsure")
        if unsure.isEmpty():
            break
        best, others = best * 8, others.join(unsure, "_key", "left_semi")

    forget(reps, sets, buckets, rest)
    # A document's component: that of its class; the label is the smallest representative, which is the smallest id.
    member = filled.select("_id", "_n", "_k1", "_k2").join(classes, ["_k1", "_k2"]).select("_id", "_n", "_rep")
    done = member.join(label.select(F.col("_id").alias("_rep"), "_c"), "_rep", "left").select("_id", "_n", F.coalesce("_c", "_rep").alias("_c"))
    done = done.unionByName(own.where(F.col("_n") == 0).select("_id", "_n", F.col("_id").alias("_c")))
    if again is not None:
        done = done.join(again.select("_id", "_rows"), "_id", "left").select("_id", "_n", "_c", F.explode(F.sequence(F.lit(1), F.coalesce("_rows", F.lit(1)))).alias("_each"))
    nameless = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("bigint").alias("_id"), F.lit(0).cast("bigint").alias("_n"), F.lit(None).cast("bigint").alias("_c"))
    return done.select("_id", "_n", "_c").unionByName(nameless).select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_c").alias("component_id"), F.col("_id").eqNullSafe(F.col("_c")).alias("kept"))
