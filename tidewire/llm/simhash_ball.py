"""SimHash near-duplicates by meet-in-the-middle ball hashing.

1. A text's fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 hashes of its word shingles.
   Rows with one fingerprint are one class; from here on only distinct fingerprints move.
2. Every fingerprint stands for all variants within half the radius: at radius 4 its 2,081 values with at most two
   bits flipped.  Two fingerprints are within the radius exactly if they have a variant in common.
3. Variants are shuffled by their leading bits.  A fingerprint is sent once to each prefix that some of its variants
   have (those within half the radius of its own prefix), and the task that owns a prefix writes the variants with it
   out.  So a variant meets all its fingerprints in one task, while the shuffle carries tens of rows a fingerprint
   instead of 2,081.  Prefixes get longer as long as one holds more than `most` variants: no variant is shared by more
   than 2,081 fingerprints, so every crowded prefix (a ball full of near copies) can be split.
4. In a task the variants are sorted; those with several fingerprints give pairs (the smallest with each other one),
   which are deduplicated, verified by counting the bits that differ, and merged into the task's own components.  So a
   group of copies gives as many links as it has members, not pairs of all.
5. Components are merged in tables.

Cases: a null text, or one without words, has fingerprint zero and is linked like any other; with fewer words than a
shingle the whole sequence is the one shingle; texts of any length are read whole, in blocks of 65,536 shingles; rows
that repeat an id each get their own fingerprint and the component of that fingerprint; rows with a null id have a
fingerprint, link others and take their component's smallest id (null where all of its ids are null); an empty table gives an empty table;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import chunks, forget, keep, release, ship
from tidewire.llm.components import components

BITS, BLOCK, SPACE = 64, 65_536, " \t\n\v\f\r"


def word_lists(texts: list[str | None]) -> pa.LargeListArray:
    """The words (runs of anything but ASCII white space) of each text, A-Z lower-cased; [""] for a text without words."""
    low = pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string()))
    return pc.split_pattern_regex(pc.utf8_trim(low, characters=SPACE), "[ \t\n\v\f\r]+")


def fingerprints(texts: list[str | None], words: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text as an unsigned 64-bit number."""
    split = word_lists(texts)
    joined = pc.binary_join(split, pa.scalar(" ", pa.large_string())).cast(pa.large_binary()).to_pylist()
    sizes, ends = pc.binary_length(split.flatten().cast(pa.large_binary())).to_numpy(), split.offsets.to_numpy()
    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64)
    for i, raw in enumerate(joined):
        if not raw:
            continue
        own = sizes[ends[i]:ends[i + 1]]
        stop = np.cumsum(own + 1) - 1  # a word's end in raw
        start, k = stop - own, min(words, len(own))
        begin, end, ones = start[: len(own) - k + 1].tolist(), stop[k - 1:].tolist(), np.zeros(BITS, np.int64)
        for at in range(0, len(begin), BLOCK):
            part = [digest(raw[a:b], seed) for a, b in zip(begin[at:at + BLOCK], end[at:at + BLOCK], strict=True)]
            bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(begin), bitorder="little").view("<u8")[0]
    return out


def with_fingerprint(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """_id, _f: the fingerprint of every row as a signed 64-bit number."""
    ship(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(frames, "_t", 2_000_000):
            yield pd.DataFrame({"_id": part["_id"], "_f": fingerprints(part["_t"].tolist(), words).view(np.int64)})
        release()

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInPandas(run, f"_id {docs.schema[id_col].dataType.simpleString()}, _f bigint")


@lru_cache(128)
def masks(bits: int, flips: int) -> np.ndarray:
    """All numbers of so many bits with at most so many ones."""
    return np.array([sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(bits), k)], np.uint64)


def ball_size(bits: int, flips: int) -> int:
    return sum(comb(bits, k) for k in range(flips + 1))


def _prefixes(fps: DataFrame, bits: int, flips: int) -> DataFrame:
    """_f, _p (the prefix of `bits` bits as a number), _left (flips that its variants may still have)."""
    of = [F.struct(F.lit(int(m)).cast("bigint").alias("m"), F.lit(flips - int(m).bit_count()).alias("l")) for m in masks(bits, flips)]
    own = F.shiftrightunsigned("_f", BITS - bits) if bits else F.lit(0).cast("bigint")
    return fps.select("_f", own.alias("_own"), F.explode(F.array(*of)).alias("_m")).select("_f", F.col("_own").bitwiseXOR(F.col("_m.m")).alias("_p"), F.col("_m.l").alias("_left"))


def _longer(rows: DataFrame, bits: int, more: int, flips: int) -> DataFrame:
    """The same with prefixes that are `more` bits longer."""
    of = [F.struct(F.lit(int(m)).cast("bigint").alias("m"), F.lit(int(m).bit_count()).alias("w")) for m in masks(more, flips)]
    own = F.shiftrightunsigned("_f", BITS - bits - more).bitwiseAND(F.lit((1 << more) - 1))
    wide = rows.select("_f", "_p", "_left", own.alias("_own"), F.explode(F.filter(F.array(*of), lambda x: x["w"] <= F.col("_left"))).alias("_m"))
    return wide.select("_f", F.shiftleft("_p", more).bitwiseOR(F.col("_own").bitwiseXOR(F.col("_m.m"))).alias("_p"), (F.col("_left") - F.col("_m.w")).cast("int").alias("_left"))


def local_links(fps: np.ndarray, left: np.ndarray, tail: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) of the components that the variants of one prefix show; fps and variants are unsigned.

    left: flips that each fingerprint has left in the `tail` bits behind the prefix.
    """
    keep_bits = np.uint64((1 << tail) - 1)
    value, who = [], []
    for flips in np.unique(left):
        at = np.flatnonzero(left == flips)
        m = masks(tail, int(flips))
        value.append(((fps[at] & keep_bits)[:, None] ^ m).ravel())
        who.append(np.repeat(at.astype(np.int32), len(m)))
    value, who = np.concatenate(value), np.concatenate(who)
    order = np.argsort(value, kind="stable")
    value, who = value[order], who[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    rank = np.empty(len(fps), np.int32)  # fingerprints in their order, so that the smallest of a group is its least rank
    by_size = np.argsort(fps)
    rank[by_size] = np.arange(len(fps), dtype=np.int32)
    own = rank[who]
    least = np.minimum.reduceat(own, heads)[group]
    other = own != least
    pairs = np.unique(least[other].astype(np.int64) * len(fps) + own[other])
    a, b = pairs // max(1, len(fps)), pairs % max(1, len(fps))
    sorted_fps = fps[by_size]
    near = np.bitwise_count(sorted_fps[a] ^ sorted_fps[b]) <= radius
    a, b = a[near], b[near]
    label = np.arange(len(fps))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return sorted_fps[moved], sorted_fps[label[moved]]


def links(fps: DataFrame, radius: int = 4, most: int = 1_000_000) -> DataFrame:
    """(a, b) of distinct fingerprints (column _f): pairs that join all those within the radius, as few as each task needs."""
    flips, spark = radius // 2, fps.sparkSession
    if radius % 2:
        raise ValueError("the radius must be even: its halves meet in the middle")
    bits, step = 0, 8
    known = fps.count()
    while bits < 16 and known * ball_size(BITS, flips) >> bits > most // 2:
        bits += 1
    rows, done = keep(_prefixes(fps, bits, flips), "prefixes"), None
    while True:
        tail = BITS - bits
        size = F.element_at(F.array(*[F.lit(ball_size(tail, k)) for k in range(flips + 1)]), F.col("_left") + 1)
        sizes = rows.groupBy("_p").agg(F.sum(size).alias("_v"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        crowded = keep(sizes.where(F.col("_v") > most).select("_p"), "crowded")
        here = rows if tail <= step or crowded.isEmpty() else rows.join(crowded, "_p", "left_anti")
        found = keep(_met(here, tail, radius), "met")
        done = found if done is None else done.unionByName(found)
        if here is rows:
            return done
        rows, old = keep(_longer(rows.join(crowded, "_p", "left_semi"), bits, step, flips), "prefixes"), (rows, crowded)
        forget(*old)
        bits += step


def _met(rows: DataFrame, tail: int, radius: int) -> DataFrame:
    """Links of the fingerprints that meet under each prefix; a task holds one prefix at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def shown() -> pd.DataFrame:
            f = pd.concat(held, ignore_index=True)
            a, b = local_links(f["_f"].to_numpy().view(np.uint64), f["_left"].to_numpy(), tail, radius)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for f in frames:
            at = f["_p"].to_numpy()
            cut = np.flatnonzero(np.diff(at)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(f)], strict=True):
                if hi > lo and held and held[-1]["_p"].iat[0] != at[lo]:
                    if len(held) > 1 or len(held[0]) > 1:
                        yield shown()
                    held.clear()
                if hi > lo:
                    held.append(f.iloc[lo:hi])
        if held:
            yield shown()
        release()

    return rows.repartition("_p").sortWithinPartitions("_p").mapInPandas(run, "a bigint, b bigint")


def near_dedup(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id (smallest id reachable); a row for each row of docs."""
    own = keep(with_fingerprint(docs, words, id_col, text_col), "fingerprints")
    classes = keep(own.groupBy("_f").agg(F.min("_id").alias("_least")), "classes")
    edges = keep(links(classes.select("_f"), radius).distinct(), "edges")
    label = components(edges)
    placed = classes.join(label.select(F.col("node").alias("_f"), F.col("label").alias("_l")), "_f", "left").select("_f", "_least", F.coalesce("_l", "_f").alias("_l"))
    least = placed.groupBy("_l").agg(F.min("_least").alias("_c"))
    named = placed.join(least, "_l").select("_f", "_c")
    return own.join(named, "_f").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_f"), 16, "0")).alias("fingerprint"), F.col("_c").alias("component_id"))
