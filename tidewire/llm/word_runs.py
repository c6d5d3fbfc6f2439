"""Periodic runs of words by the method of Kolpakov and Kucherov.

A run is a stretch with smallest period q (words q apart are equal), at least `exponent` periods and `least` words
long, that no neighbour extends.  For each text:

1. A word of a run with exponent e occurs at least floor(e) times, so rarer words end every run.  They cut the text
   into stretches, and the rest works on each of them.
2. A suffix automaton that knows the first end of each state's words gives the LZ factorisation: each factor is a new
   word or the longest one that has begun before (overlaps are allowed).
3. Runs that cross or touch a border between factors are found by Main's algorithm: common extensions to both sides
   (Z functions) for every period, within the last factor and a window of twice the one before and the next.  Such a
   run begins less than a period before the factor ahead of the one it ends in, which bounds the window.
4. A run strictly inside a factor is a copy of one inside the factor's earlier occurrence.

Time is linear in the words up to the runs found; memory is about 400 bytes for each word of the longest stretch.
Rows never leave their partition: there is no shuffle.

Cases: null and empty texts have no words and no runs; texts of any length are read whole; overlapping runs are all
listed; repeated rows have equal results; the table's own columns pass untouched, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidewire.llm.common import annotate

SPACE = " \t\n\v\f\r"


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """The LZ factorisation: (begin, end, distance to an earlier occurrence or 0 for a new word)."""
    step: list[dict[int, int]] = [{}]
    size, link, first = [0], [-1], [-1]
    last = 0
    for i, c in enumerate(s):
        now = len(step)
        step.append({})
        size.append(i + 1)
        link.append(0)
        first.append(i)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p != -1:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(step[q].copy())
                size.append(size[p] + 1)
                link.append(link[q])
                first.append(first[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    out, i, n = [], 0, len(s)
    while i < n:
        state, j, seen = 0, i, -1
        while j < n:
            state = step[state][s[j]]
            if first[state] >= j:
                break
            seen = first[state]
            j += 1
        if j == i:
            out.append((i, i + 1, 0))
            i += 1
        else:
            out.append((i, j, j - 1 - seen))
            i = j
    return out


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of s and what begins there."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _touching(s: list[int], lo: int, x: int, hi: int, periods: int, found: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    """Main's step: runs [b, e) of at least `periods` periods with lo <= b <= x <= e <= hi, if they end in the window."""
    left, right, new = s[lo:x][::-1], s[x:hi], []
    a, c = len(left), len(right)
    most = (a + c) // periods  # a run in the window has no longer period
    if not most:
        return new
    z_left, z_right = z_function(left), z_function(right)
    back = z_function([*left, -1, *s[lo:min(hi, x + most)][::-1]])  # common suffixes with what ends right of x
    ahead = z_function([*right, -1, *s[max(lo, x - most):hi]])  # common prefixes with what begins left of x
    width, before = min(hi, x + most) - lo, max(lo, x - most)
    n = len(s)
    for q in range(1, most + 1):
        if q <= c:  # a period right of x
            behind = back[a + 1 + width - (x + q - lo)]
            after = z_right[q] if q < c else 0
            if behind + after >= (periods - 1) * q:
                _add(s, x - behind, x + q + after, q, n, lo, hi, found, new)
        if q <= a:  # a period left of x
            after = ahead[c + 1 + x - q - before]
            behind = z_left[q] if q < a else 0
            if behind + after >= (periods - 1) * q:
                _add(s, x - q - behind, x + after, q, n, lo, hi, found, new)
    return new


def _add(s, b: int, e: int, q: int, n: int, lo: int, hi: int, found: dict, new: list) -> None:
    """Note a stretch unless it goes on beyond the window (another border has it) or is known, maybe by a smaller period."""
    if b == lo and lo and s[lo - 1] == s[lo - 1 + q] or e == hi and hi < n and s[hi] == s[hi - q]:
        return
    known = found.get((b, e))
    if known is None or q < known:
        found[b, e] = q
        new.append((b, e, q))


def runs(s: list[int], periods: int = 2) -> list[tuple[int, int, int]]:
    """All maximal (begin, end, smallest period) of at least `periods` (2 or more) periods in a list of numbers of 0 or more."""
    found: dict[tuple[int, int], int] = {}
    at: dict[int, list[tuple[int, int]]] = {}  # by begin: end and period

    def noted(new: list[tuple[int, int, int]]) -> None:
        for u, v, q in new:
            at.setdefault(u, []).append((v, q))

    before = 0
    for b, e, far in factors(s):
        noted(_touching(s, max(0, b - 2 * before - (e - b)), b, e, periods, found))
        if far and at:
            last = e - far
            for u in range(b - far + 1, last):  # runs inside the earlier occurrence
                for v, q in at.get(u, ()):
                    if v < last and (u + far, v + far) not in found:
                        found[u + far, v + far] = q
                        at.setdefault(u + far, []).append((v + far, q))
        before = e - b
    noted(_touching(s, len(s) - before, len(s), len(s), periods, found))
    return [(b, e, q) for (b, e), q in found.items()]


def runs_of_text(codes: np.ndarray, periods: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) by start, then period, of a text's words given as small numbers."""
    if len(codes) < least:
        return []
    often = np.bincount(codes)[codes] >= periods
    edge = np.flatnonzero(np.diff(np.concatenate([[0], often.view(np.int8), [0]])))
    out = []
    for b, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if e - b >= least:
            out += [(b + u, v - u, q) for u, v, q in runs(codes[b:e].tolist(), periods) if v - u >= least]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], own: list[tuple[int, int, int]]) -> str:
    """The words less those that some run holds after its first period, joined by spaces."""
    stays = bytearray(b"\1") * len(words)
    for start, length, q in own:
        stays[start + q:start + length] = bytes(length - q)
    return " ".join(w for w, s in zip(words, stays, strict=True) if s)


def of_texts(texts: list[str | None], periods: int, least: int) -> tuple[list, list, list]:
    """For each text the number of words, its runs and its collapsed text."""
    split = pc.split_pattern_regex(pc.utf8_trim(pa.array([t or "" for t in texts], pa.large_string()), characters=SPACE), "[ \t\n\v\f\r]+")
    joined, ends = pc.binary_join(split, pa.scalar(" ", pa.large_string())).to_pylist(), split.offsets.to_numpy()
    codes = pc.dictionary_encode(split.flatten()).indices.to_numpy()
    sizes, found = [], []
    for i, whole in enumerate(joined):
        n = int(ends[i + 1] - ends[i]) if whole else 0
        own = []
        if n >= least:
            own = runs_of_text(np.unique(codes[ends[i]:ends[i + 1]], return_inverse=True)[1], periods, least)
        if own:
            joined[i] = collapsed(whole.split(" "), own)
        sizes.append(n)
        found.append([{"start": b, "length": k, "period": q} for b, k, q in own])
    return sizes, found, joined


def find_runs(docs: DataFrame, periods: int = 2, least: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, runs (start, length, period by start, then period), collapsed; a row for each row of docs."""
    if periods < 2:
        raise ValueError("a run has two periods or more")
    fields = [("n_words", "bigint"), ("runs", "array<struct<start:bigint,length:bigint,period:bigint>>"), ("collapsed", "string")]
    own = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_t"))
    found = annotate(own, "_t", lambda: lambda texts: of_texts(texts, periods, least), fields, most_chars=2_000_000)
    return found.withColumnRenamed("_id", id_col).drop("_t")
