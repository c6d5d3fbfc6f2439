"""Order MinHash: fingerprints sensitive to the order of a text, in DataFrame functions alone.

A text's word k-mers are numbered by occurrence, so a repeated k-mer counts as different items.  Every numbered
k-mer gets a hash whose leading bits deal it to one of the bins; each bin selects its `keep_n` smallest, puts them
back in the order of the text and hashes that tuple.  The fingerprint lists bin and tuple hash of each bin in use;
likeness is the share of bins in use by either text whose tuples agree, which falls with edit distance because
moved as well as changed k-mers break tuples.

Everything is done inside the row: two sorts of packed longs (33 bits of hash above, 30 of word position below, enough
for any text that Spark can hold), no shuffle, no rows made.

Cases: words are split at white space; a text of fewer than k words is one k-mer; an empty or null text has an empty
fingerprint, and two empty fingerprints are alike (1.0), an empty and another are not (0.0); rows of equal ids follow
each other in order of their texts, null ids come first; one row alone is its own next; an empty table gives an empty
table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import let, parts

POS_BITS = 30  # a Spark string holds at most 2 ** 30 words
HASH_BITS = 63 - POS_BITS
MASK = (1 << HASH_BITS) - 1
BIN_BITS = 6
LOWEST = -(1 << 63)


def _high(x: Column) -> Column:
    return F.shiftright(x, POS_BITS)


def _pack(h: Column, pos: Column) -> Column:
    return F.shiftleft(h.bitwiseAND(F.lit(MASK)), POS_BITS).bitwiseOR(pos)


def _pos(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << POS_BITS) - 1))


def _kmers(text: Column, k: int) -> Column:
    """Packed (k-mer hash, position) of every k-mer."""

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        joined = hashes
        for j in range(1, k):
            joined = F.zip_with(F.slice(joined, 1, F.greatest(n - j, F.lit(0))), F.slice(hashes, j + 1, F.greatest(n - j, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        short = F.array(F.aggregate(hashes, F.lit(0).cast("bigint"), lambda s, h: F.xxhash64(s, h)))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, short).otherwise(joined)

    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    listed = let(F.transform(words, lambda w: F.xxhash64(w)), of)
    return F.transform(listed, lambda h, i: _pack(h, i.cast("bigint")))


def _numbered(packed: Column) -> Column:
    """Packed (hash of k-mer and occurrence number, position).  First occurrences are most; only repeats need runs."""

    def of(z: Column) -> Column:
        again = lambda x, i: (i > 0) & (_high(F.get(z, i - 1)) == _high(x))
        firsts = F.transform(F.filter(z, lambda x, i: ~again(x, i)), lambda x: _pack(F.xxhash64(_high(x), F.lit(0)), _pos(x)))

        def runs(r: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (i == 0) | (_high(F.get(r, i - 1)) != _high(F.get(r, i))))
            return let(starts, lambda st: F.flatten(F.transform(st, lambda s, j: F.transform(
                F.slice(r, s + 1, F.coalesce(F.get(st, j + 1), F.size(r)) - s), lambda x, o: _pack(F.xxhash64(_high(x), o + 1), _pos(x))))))

        rest = let(F.filter(z, again), lambda r: F.when(F.size(r) > 0, runs(r)).otherwise(F.array().cast("array<bigint>")))
        return F.concat(firsts, rest)

    return let(F.sort_array(packed), of)


def fingerprint(text: Column, k: int = 2, keep_n: int = 2) -> Column:
    """Comma-joined bin (two hex digits) and tuple hash (eight) of each bin in use, in order of the bins."""
    bin_of = lambda x: F.shiftright(x, 63 - BIN_BITS)

    def entries(sel: Column) -> Column:
        def entry(x: Column, i: Column) -> Column:
            mates = F.slice(sel, i + 1, F.lit(keep_n))
            own = F.filter(mates, lambda y: bin_of(y) == bin_of(x))
            order = F.array_sort(F.transform(own, lambda y: F.struct(_pos(y).alias("p"), _high(y).alias("h"))))
            tup = F.aggregate(order, F.lit(7).cast("bigint"), lambda s, y: F.xxhash64(s, y["h"]))
            return F.concat(F.lpad(F.lower(F.hex(bin_of(x))), 2, "0"), F.lpad(F.lower(F.hex(tup.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))

        first = lambda x, i: (i == 0) | (bin_of(F.get(sel, i - 1)) != bin_of(x))
        return F.filter(F.transform(sel, lambda x, i: F.when(first(x, i), entry(x, i))), lambda e: e.isNotNull())

    chosen = let(F.sort_array(_numbered(_kmers(text, k))), lambda z: F.filter(z, lambda x, i: (i < keep_n) | (bin_of(F.get(z, i - keep_n)) != bin_of(x))))
    return F.array_join(let(chosen, entries), ",")


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins in use by either fingerprint that hold equal tuples."""
    split = lambda c: F.filter(F.split(c, ","), lambda e: e != "")
    bins = F.size(F.array_union(F.transform(split(a), lambda e: F.substring(e, 1, 2)), F.transform(split(b), lambda e: F.substring(e, 1, 2))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(split(a), split(b))) / bins)


def _bounds(df: DataFrame, n: int) -> list[int]:
    """At most n - 1 cut points of the ids, near their quantiles."""
    got = df.approxQuantile("_o", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    return sorted({math.ceil(x) for x in got})


def with_next(df: DataFrame, carried: list[str], order: str = "_o", tie: str = "_t") -> DataFrame:
    """Adds next_<c> of the following row in order of (order, tie), cyclically, without a global window.

    The id range is cut into buckets.  The first row of each bucket is also dealt, as a ghost, to the bucket before
    it, so a window inside each bucket sees every successor; the ghosts go afterwards.  Only one long for each bucket
    reaches the driver.
    """
    n = max(2, 4 * parts(df.sparkSession))
    cuts = _bounds(df, n)
    step = max(1, math.isqrt(len(cuts)))
    coarse, fine = cuts[::step], [cuts[i:i + step] for i in range(0, len(cuts), step)]
    longs = lambda xs: F.array(*[F.lit(int(x)) for x in xs]).cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col(order)))
    if cuts:
        g = below(longs(coarse))
        bucket = F.when(g == 0, F.lit(0)).otherwise((g - 1) * step + below(F.get(F.array(*[longs(f) for f in fine]), g - 1)))
    else:
        bucket = F.lit(0)
    rows = df.withColumn("_b", bucket.cast("int"))
    firsts = {r["_b"]: r["m"] for r in rows.groupBy("_b").agg(F.min(order).alias("m")).collect()}
    used = sorted(firsts)
    if not used:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    heads = F.get(longs([firsts.get(b, 0) for b in range(used[-1] + 1)]), F.col("_b"))
    before = F.get(longs([used[(used.index(b) - 1) % len(used)] if b in firsts else -1 for b in range(used[-1] + 1)]), F.col("_b")).cast("int")
    deal = lambda b, ghost: F.struct(b.alias("b"), F.lit(ghost).alias("ghost"))
    dealt = rows.withColumn("_d", F.explode(F.when(F.col(order) == heads, F.array(deal(F.col("_b"), False), deal(before, True))).otherwise(F.array(deal(F.col("_b"), False)))))
    w = Window.partitionBy("_bb").orderBy("_ghost", order, tie)
    dealt = dealt.select(*df.columns, F.col("_d.b").alias("_bb"), F.col("_d.ghost").alias("_ghost"))
    led = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return led.where(~F.col("_ghost")).drop("_bb", "_ghost")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, keep_n: int = 2) -> DataFrame:
    """id_col, fingerprint of each row's text."""
    return df.select(F.col(id_col), fingerprint(F.col(text_col), k, keep_n).alias("fingerprint"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, keep_n: int = 2) -> DataFrame:
    """Fingerprints of each text and of the text whose last half is replaced by the start of the next one's.

    The next document is the one with the next id (rows with equal ids in order of their texts, null ids first), the
    first after the last.
    """
    base = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOWEST)).alias("_o"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    own = base.withColumn("_f", fingerprint(F.col("_t"), k, keep_n))
    led = with_next(own, ["_t", "_f"])
    n = F.length("_t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("_t"), F.lit(1), n - half), F.substring(F.col("next__t"), F.lit(1), half))
    out = led.select("_id", "_f", "next__f", n.cast("bigint").alias("n_chars"), edited.alias("_e"))
    out = out.select("_id", "_f", "next__f", "n_chars", F.sha2("_e", 256).alias("edited_sha256"), fingerprint(F.col("_e"), k, keep_n).alias("_g"))
    return out.select(
        F.col("_id").alias(id_col), "n_chars", "edited_sha256", F.col("_f").alias("fingerprint"), F.col("_g").alias("edited_fingerprint"),
        likeness(F.col("_f"), F.col("_g")).alias("near_edited"), likeness(F.col("_f"), F.col("next__f")).alias("near_next"),
    )
