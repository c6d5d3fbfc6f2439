"""SentencePiece encoding by sampling without replacement, and decoding.

A text's lattice has an edge for every vocabulary piece that fits and, for characters that are no piece, their UTF-8
bytes.  Its segmentations have probabilities in proportion to the product of their pieces' weights.  The k sampled
segmentations are those with the largest Gumbel-perturbed log-probabilities, which is sampling without replacement.

They are found by A* search over the lattice from the left.  A frontier entry is the set of all continuations that
leave a known path at one of its nodes; its exact bound is the maximum of the set's perturbed values, a Gumbel
variable truncated at the path's own value.  Taking the largest entry, drawing the edge by which it leaves the path
and sampling the rest yields the next segmentation; nothing is enumerated.  The threshold kappa, the bound of the best
entry left, gives each sample its inclusion probability 1 - exp(-exp(log p - kappa)), returned as a logarithm.

A text is cut into units only between characters that no vocabulary piece holds next to each other, so no piece can
cross a cut and the lattice is that of the whole text: its probabilities are the products of the units'.  Arrow
numbers the distinct words and units of a batch; each unit is looked up once, in numpy tables, and only strings with
which some piece begins are lengthened.  A unit takes about 200 bytes a character.  Piece weights follow the
vocabulary's ranks by Zipf's law, raised to `alpha`.
All random numbers are hashes of (seed, row key, sample, place), so results don't depend on batches or tasks.

Cases: a null or empty text has one segmentation, without pieces; a text with fewer than k segmentations yields
those; rows with equal keys and texts get the same samples; a null key is a key; any character round-trips; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import release, ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, MARK = "▁", "\ud800"  # MARK stands for a SPACE that is in the text itself
WORD, WHOLE = re.compile("▁*[^▁]+|▁+"), re.compile("(?s).+")
WIDE = 1 << 21  # added to a code point that is written as several bytes
BASE = np.uint64(1099511628211)
M64 = 2**64 - 1
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Hash to (0, 1)."""
    y = x >> np.uint64(30)
    y ^= x
    y *= C2
    y ^= y >> np.uint64(27)
    y *= C3
    y ^= y >> np.uint64(31)
    y >>= np.uint64(11)
    u = y.astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


def points(s: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def strings(ends: np.ndarray, data: np.ndarray) -> pa.LargeBinaryArray:
    """Arrow's array of the byte strings of data that end (in elements of data) at `ends`; nothing is copied."""
    at = np.concatenate([[0], ends * data.itemsize])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(data)])


def content(x: pa.LargeBinaryArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """(ends, data) of such an array."""
    at = np.frombuffer(x.buffers()[1], np.int64)[x.offset:x.offset + len(x) + 1]
    size = np.dtype(kind).itemsize
    data = np.frombuffer(x.buffers()[2] or b"", np.uint8)[at[0]:at[-1]].view(kind)
    return (at[1:] - at[0]) // size, data


class Vocabulary:
    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of, pieces, self.byte_id = [], [], {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                pieces.append((p, i))
                self.bytes_of.append(p.replace(SPACE, " ").encode())
        self.longest = max(len(p) for p, _ in pieces)
        self.neighbours = np.array(sorted({ord(a) << 21 | ord(b) for p, _ in pieces for a, b in zip(p, p[1:])}), np.int64)
        # The same as a table by the characters' classes, where they are few; class 0 is that of all others.
        first, second = self.neighbours >> 21, self.neighbours & (1 << 21) - 1
        known = np.union1d(first, second)
        self.classes, self.beside = None, None
        if len(known) < 1 << 11:
            self.classes = np.zeros(int(known.max(initial=0)) + 2, np.int32)
            self.classes[known] = np.arange(1, len(known) + 1)
            self.beside = np.zeros((len(known) + 1, len(known) + 1), bool)
            self.beside[self.classes[first], self.classes[second]] = True
        # Where no piece has a space after something else, texts are taken apart at spaces first.
        self.word = WHOLE if any(p[i] == SPACE != p[i - 1] for p, _ in pieces for i in range(1, len(p))) else WORD
        flat = math.log(math.log(len(pieces) + 1))
        own: dict[int, list] = defaultdict(list)
        begun: set[int] = set()
        for rank, (p, i) in enumerate(sorted(pieces, key=lambda x: (-sp.get_score(x[1]), x[1]))):
            *shorter, whole = self.hashes_of(p)
            begun.update(shorter)
            own[len(p)].append((whole, i, -alpha * (math.log(rank + 2.0) + flat)))
        rows = [r for n in sorted(own) for r in own[n]]
        self.size_of = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.begin_of = np.cumsum(self.size_of) - self.size_of
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.keys, self.ids, self.weights = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows])
        # Two hash tables: keys that lose their slot of the first are in the second (its load is tiny).
        small = np.int16 if len(rows) < 1 << 15 else np.int32
        self.slots = [np.full(1 << 20, -1, small), np.full(1 << 20, -1, small)]
        late = []
        for i, slot in enumerate(self.slot_of(self.keys, 0)):
            if self.slots[0][slot] < 0:
                self.slots[0][slot] = i
            else:
                late.append(i)
        for i, slot in zip(late, self.slot_of(self.keys[late], 1), strict=True):
            if self.slots[1][slot] >= 0:
                raise ValueError("two pieces share both slots")
            self.slots[1][slot] = i
        # Slots of strings with which a longer piece begins; others that share a slot are only looked up in vain.
        self.begins = np.zeros(1 << 20, bool)
        self.begins[self.slot_of(np.fromiter(begun, np.uint64, len(begun)), 0)] = True
        # After the pieces: characters that are none, of one to four bytes; the last entry, number -1, is no edge.
        byte_weight = -alpha * (math.log(len(pieces)) + flat)
        self.weights = np.concatenate([self.weights, byte_weight * np.arange(1, 5), [-np.inf]])

    @staticmethod
    def slot_of(h: np.ndarray, which: int) -> np.ndarray:
        return ((h * (C1 if which == 0 else C3)) >> np.uint64(44)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in h that are pieces, their numbers, for all whether a longer piece may begin so)."""
        slot = self.slot_of(h, 0)
        got = self.slots[0].take(slot)
        full = np.flatnonzero(got >= 0)
        no = got[full]
        same = self.keys.take(no) == h.take(full)
        other = full[~same]
        second = self.slots[1].take(self.slot_of(h[other], 1))
        ok = (second >= 0) & (self.keys[second] == h[other])
        return np.concatenate([full[same], other[ok]]), np.concatenate([no[same], second[ok]]), self.begins.take(slot)

    @staticmethod
    def hashes_of(s: str) -> list[int]:
        """Of every beginning of s, itself last."""
        h, out, base = 0, [], int(BASE)
        for c in s:
            h = (h * base + ord(c) + 7) & M64
            out.append(h)
        return out

    @classmethod
    def hash_of(cls, s: str) -> int:
        return cls.hashes_of(s)[-1] if s else 0

    def cuts(self, code: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ends of the units of the words that end at `ends`: cut where no piece holds the two characters together."""
        apart = np.ones(len(code), bool)
        if self.classes is not None:
            kind = self.classes.take(code, mode="clip")
            np.logical_not(self.beside.ravel().take(kind[:-1] * np.int32(len(self.beside)) + kind[1:]), out=apart[:-1])
        else:
            pair = code[:-1].astype(np.int64) << 21 | code[1:]
            apart[:-1] = self.neighbours.take(np.searchsorted(self.neighbours, pair), mode="clip") != pair
        apart[ends - 1] = True
        return np.flatnonzero(apart) + 1

    def units(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """(units of all words in order, units of each word)."""
        whole = "".join(words)
        ends = np.cumsum([len(w) for w in words])
        cuts = self.cuts(points(whole), ends)
        upto = cuts.tolist()
        return [whole[b:e] for b, e in zip([0, *upto], upto)], np.diff(np.searchsorted(cuts, ends, side="right"), prepend=0)

    def decode_all(self, ids: np.ndarray, ends: np.ndarray, step: int = 500_000) -> list[bytes]:
        """The UTF-8 text of each run of ids; run i ends before ids[ends[i]]."""
        out, b = [], 0
        while b < len(ends):
            lo = int(ends[b - 1]) if b else 0
            e = max(b + 1, int(np.searchsorted(ends, lo + step, side="right")))
            part = ids[lo:int(ends[e - 1])]
            sizes = self.size_of.take(part)
            to = np.cumsum(sizes)
            data = self.all_bytes.take(np.repeat(self.begin_of.take(part) - to + sizes, sizes) + np.arange(to[-1] if len(to) else 0)).tobytes()
            cuts = np.concatenate([[0], to]).take(np.concatenate([[lo], ends[b:e]]) - lo).tolist()
            out += [data[x + (data[x:x + 1] == b" " and x < y):y] for x, y in zip(cuts, cuts[1:])]
            b = e
        return out

    def decode(self, ids) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.array([len(ids)]))[0].decode("utf-8", "surrogatepass")


@lru_cache(2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


class Lattice:
    """Nodes and edges of a list of distinct units; nodes nearer to their unit's end come first, edges are sorted by node and length."""

    def __init__(self, units: list[str] | pa.LargeBinaryArray, v: Vocabulary):
        """units: as strings, or as Arrow's byte strings of their code points."""
        ends, code = (np.cumsum([len(u) for u in units], dtype=np.int64), points("".join(units))) if isinstance(units, list) else content(units, np.uint32)
        n, size = len(code), np.diff(ends, prepend=0)
        left = np.repeat(ends, size) - np.arange(n)  # characters from a place to its unit's end
        order = np.argsort(left.astype(np.int16) if size.max(initial=0) < 1 << 15 else left, kind="stable")
        node = np.empty(n, np.int64)
        node[order] = np.arange(n)
        self.first = node.take(ends - size)
        found = self._found(code, left, v)
        many = np.zeros(n, np.int64)
        for place, _ in found:
            many[place] += 1
        many = many.take(order)
        self.begin = np.concatenate([[0], np.cumsum(many)])
        edges = int(self.begin[-1])
        number, self.length, self.to = np.empty(edges, np.int32), np.empty(edges, np.int8), np.empty(edges, np.int32 if n < 1 << 31 else np.int64)
        free = self.begin.take(node)
        for m, (place, no) in enumerate(found, 1):
            at = free.take(place)
            free[place] = at + 1
            number[at], self.length[at] = no, m
            self.to[at] = np.where(left.take(place) > m, node.take(place + m, mode="clip"), -1)  # -1 is the end
        self.piece = v.ids.take(number, mode="clip")
        odd = np.flatnonzero(number >= len(v.ids))
        if len(odd):
            own = code.take(order.take(np.searchsorted(self.begin, odd, side="right") - 1)).astype(np.int64)
            own = np.where(own == 0xD800, 0x2581, own)
            self.piece[odd] = np.where(own < 0x80, np.array([v.byte_id[x] for x in range(128)], np.int64).take(own, mode="clip"), own + WIDE)
        self.prob = self._prob(v.weights.take(number), many, np.bincount(left)[1:])
        # Sums within each node, edge by edge.
        self.cdf = self.prob.copy()
        at = self.begin[:-1]
        stop = at + many
        while len(at):
            on = at + 1 < stop
            at, stop = at[on] + 1, stop[on]
            self.cdf[at] += self.cdf.take(at - 1)
        self.cdf[self.begin[1:] - 1] = 2.0

    @staticmethod
    def _found(code: np.ndarray, left: np.ndarray, v: Vocabulary) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1 the places where a piece (or one character that is none) lies, and its number."""
        place, h, out = np.arange(len(code)), code.astype(np.uint64) + np.uint64(7), []
        while len(place):
            at, no, on = v.find(h)
            if not out:  # characters that are no piece
                bare = np.ones(len(code), bool)
                bare[at] = False
                bare = np.flatnonzero(bare)
                own = code.take(bare)
                own[own == 0xD800] = 0x2581
                at, no = np.concatenate([at, bare]), np.concatenate([no, len(v.ids) + np.select([own < 0x80, own < 0x800, own < 0x10000], [0, 1, 2], 3)])
            out.append((place.take(at), no))
            on = np.flatnonzero(on & (left.take(place) > len(out)))
            place = place.take(on)
            h = h.take(on) * BASE + code.take(place + len(out)) + np.uint64(7)
        return out

    def _prob(self, weight: np.ndarray, many: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """Each edge's share of its node; wide: the number of nodes at each distance from the end."""
        beta = np.zeros(len(many) + 1)  # the last entry is the end's
        a = b = 0
        for w in wide.tolist():
            a, b = b, b + w
            lo, hi, n = self.begin[a], self.begin[b], many[a:b]
            x = weight[lo:hi]
            x += beta.take(self.to[lo:hi], mode="wrap")
            top = np.maximum.reduceat(x, self.begin[a:b] - lo)
            owner = np.repeat(np.arange(w), n)
            beta[a:b] = top + np.log(np.bincount(owner, weights=np.exp(x - top.take(owner))))
            x -= beta[a:b].take(owner)
        return np.exp(weight, out=weight)

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node at quantile u."""
        e = self.begin.take(node)
        todo = np.flatnonzero(u >= self.cdf.take(e))
        u, at = u.take(todo), e.take(todo)
        while len(todo):
            at += 1
            more = np.flatnonzero(u >= self.cdf.take(at))
            e[todo] = at  # the last word stands
            todo, u, at = todo.take(more), u.take(more), at.take(more)
        return e


def sample_paths(lat: Lattice, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A path through every unit occurrence: (edges, begin of each occurrence's edges)."""
    node, live, steps, who = lat.first.take(unit), np.arange(len(unit)), [], []
    t = 0
    while len(live):
        e = lat.pick(node, _uniform(key + np.uint64(t * int(C1) & M64)))
        steps.append(e)
        who.append(live)
        node = lat.to.take(e)
        on = np.flatnonzero(node >= 0)
        live, node, key = live.take(on), node.take(on), key.take(on)
        t += 1
    count = np.zeros(len(unit), np.int64)
    for w in who:
        count[w] += 1
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(begin[-1], np.int64)
    for t, (w, e) in enumerate(zip(who, steps, strict=True)):
        out[begin.take(w) + t] = e
    return out, begin


def _scalar(x: int) -> float:
    """_uniform of one number."""
    x = ((x ^ (x >> 30)) * int(C2)) & M64
    x = ((x ^ (x >> 27)) * int(C3)) & M64
    x ^= x >> 31
    return ((x >> 11) + 0.5) * 2.0**-53


class Search:
    """The samples found and the frontier of one text: occurrences lo..hi of the batch."""

    def __init__(self, lat: Lattice, lo: int, hi: int, seed: int):
        self.lat, self.lo, self.hi, self.seed, self.draws = lat, lo, hi, seed, 0
        self.found: list[tuple[np.ndarray, float, float]] = []
        self.fronts: list[dict] = []
        none = np.zeros(0, np.int64)
        self.path, self.owner, self.fresh_from, self.since = none, none, 0, lo  # occurrences from `since` are still to be sampled
        self.top, self.kappa = -math.log(-math.log(self.draw())), -math.inf

    def draw(self) -> float:
        """The next uniform number of this text's own stream."""
        self.draws += 1
        return _scalar((self.seed + int(C3) * self.draws) & M64)

    def add(self, before: np.ndarray, total: float, bound: np.ndarray) -> None:
        """Take in the present path: log p before each of its edges and in all, and the bounds of the sets that leave it."""
        self.found.append((self.path, total, self.top))
        self.fronts.append({"path": self.path, "owner": self.owner, "before": before, "bound": bound, "used": {}})
        tops = [float(f["bound"].max()) for f in self.fronts]
        self.kappa = max(tops)
        self.best = tops.index(self.kappa)

    def go_on(self) -> bool:
        """Begin the next path from the largest frontier entry, up to the end of a unit; False if there is none."""
        if not math.isfinite(self.kappa):
            return False
        lat, f = self.lat, self.fronts[self.best]
        j, self.top = int(f["bound"].argmax()), self.kappa
        taken = f["used"].setdefault(j, [int(f["path"][j])])
        own = int(np.searchsorted(lat.begin, taken[0], side="right") - 1)
        options = [e for e in range(int(lat.begin[own]), int(lat.begin[own + 1])) if e not in taken]
        p = [float(lat.prob[e]) for e in options]
        u, e = self.draw() * sum(p), options[-1]
        for x, y in zip(options, p, strict=True):
            if u < y:
                e = x
                break
            u -= y
        taken.append(e)
        left = sum(y for x, y in zip(options, p, strict=True) if x != e)
        # What is still left of the set, below the value just taken.
        if left > 1e-12:
            loc = float(f["before"][j]) + math.log(left)
            f["bound"][j] = loc - np.logaddexp(loc - self.top, math.log(-math.log(self.draw())))
        else:
            f["bound"][j] = -math.inf
        occ, added, node = int(f["owner"][j]), [e], int(lat.to[e])
        while node >= 0:
            x, u = int(lat.begin[node]), self.draw()
            while u >= lat.cdf[x]:
                x += 1
            added.append(x)
            node = int(lat.to[x])
        self.path = np.concatenate([f["path"][:j], added]).astype(np.int64)
        self.owner = np.concatenate([f["owner"][:j], np.full(len(added), occ)])
        self.fresh_from, self.since = j + 1, occ + 1
        return True

    def finish(self, edges: np.ndarray, owner: np.ndarray) -> None:
        """Go on with the sample of this turn: the edges of the occurrences still open, and whose they are."""
        self.path, self.owner = (np.concatenate([self.path, edges]), np.concatenate([self.owner, owner])) if len(self.path) else (edges, owner)


def search_all(lat: Lattice, unit: np.ndarray, key: np.ndarray, live: list[Search], k: int) -> None:
    """Run the searches together: a turn adds one path to each text, and the bounds of all its sets are drawn at once."""
    for turn in range(k):
        open_ = np.array([s.hi - s.since for s in live], np.int64)
        upto = np.cumsum(open_)
        occ = np.arange(int(open_.sum())) + np.repeat(np.array([s.since for s in live], np.int64) - upto + open_, open_)
        edges, begin = sample_paths(lat, unit.take(occ), key.take(occ) ^ np.uint64((turn + 1) * 0x632BE59BD9B4E019 & M64))
        owner = np.repeat(occ, np.diff(begin))
        for s, a, b in zip(live, begin.take(upto - open_).tolist(), begin.take(upto).tolist(), strict=True):
            s.finish(edges[a:b], owner[a:b])
        sizes = np.array([len(s.path) for s in live], np.int64)
        ends = np.cumsum(sizes)
        path = np.concatenate([s.path for s in live]) if live else np.zeros(0, np.int64)
        prob = lat.prob.take(path)
        log = np.log(np.maximum(prob, 1e-300)).astype(np.float32)
        total = np.cumsum(log, dtype=np.float64)
        start = np.concatenate([[0.0], total])[ends - sizes]
        before = total - log - np.repeat(start, sizes)
        # Sets before fresh_from stay with the path they were made for.
        since = np.array([s.fresh_from for s in live], np.int64)
        fresh = sizes - since
        local = np.arange(int(fresh.sum())) - np.repeat(np.cumsum(fresh) - fresh - since, fresh)
        at = local + np.repeat(ends - sizes, fresh)
        rest = 1.0 - prob.take(at)
        some = np.flatnonzero(rest >= 1e-12)  # where the node's other edges have any mass
        at, local, who = at.take(some), local.take(some), np.repeat(np.arange(len(live)), fresh).take(some)
        seeds = np.array([s.seed for s in live], np.uint64) ^ np.uint64((turn + 1) * 0xA0761D6478BD642F & M64)
        u = _uniform(seeds.take(who) + C1 * (local.astype(np.uint64) + np.uint64(1)))
        loc = before.take(at) + np.log(rest.take(some)).astype(np.float32)
        bound = np.full(len(path), -np.inf)
        bound[at] = loc - np.logaddexp(loc - np.array([s.top for s in live]).take(who), np.log(-np.log(u)))
        for i, s in enumerate(live):
            b, e = ends[i] - sizes[i], ends[i]
            s.add(before[b:e], float(total[e - 1] - start[i]), bound[b:e])
        live = [s for s in live if s.go_on()] if turn + 1 < k else []


def _row_seed(key, seed: int) -> int:
    return xxhash.xxh64_intdigest(f"{key}", seed)


def units_of(texts: list[str | None], v: Vocabulary) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """(distinct units, the number of each unit of the texts in order, where each text's units begin and the last one's end)."""
    # Texts as their words without the SPACE that each begins with, set apart by one space.
    spelled = []
    for t in texts:
        s = t.replace(SPACE, MARK) if t and SPACE in t else t
        if s and (v.word is WHOLE or "  " in s or s[0] == " " or s[-1] == " "):
            s = " ".join([w[1:] for w in v.word.findall(SPACE + s.replace(" ", SPACE))])
        spelled.append(s.encode("utf-8", "surrogatepass") if s else None)
    lists = pc.split_pattern(pa.array(spelled, pa.large_binary()), " ")
    word_ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), dtype=np.int64)])
    held = lists.flatten().dictionary_encode()
    word = held.indices.to_numpy().astype(np.int64)
    upto, data = content(held.dictionary, np.uint8)
    bare = points(data.tobytes().decode("utf-8", "surrogatepass"))
    upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]).take(upto) + np.arange(1, len(upto) + 1)  # in code points, with the SPACE
    code = np.full(len(bare) + len(upto), ord(SPACE), np.uint32)
    inner = np.ones(len(code), bool)
    inner[np.concatenate([[0], upto])[:-1]] = False
    code[inner] = bare
    cuts = v.cuts(code, upto)
    many = np.diff(np.searchsorted(cuts, upto, side="right"), prepend=0)
    found = strings(cuts, code).dictionary_encode()
    unit_of_words = found.indices.to_numpy().astype(np.int64)
    # Every word's units, in the order of the texts.
    per = many.take(word)
    after = np.cumsum(per)
    own = unit_of_words.take(np.repeat((np.cumsum(many) - many).take(word) - after + per, per) + np.arange(int(per.sum())))
    return found.dictionary, own, np.concatenate([[0], after]).take(word_ends)


def encode_batch(keys: list, texts: list[str | None], v: Vocabulary, k: int, seed: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples (piece ids, log p, perturbed log p, log inclusion probability)."""
    distinct, unit_a, ends = units_of(texts, v)
    lat = Lattice(distinct, v)
    own = np.array([_row_seed(key, seed) for key in keys], np.uint64)
    sizes = np.diff(ends)
    occ_key = np.repeat(own, sizes) + C2 * (np.arange(len(unit_a), dtype=np.uint64) - np.repeat(ends[:-1].astype(np.uint64), sizes))
    searches = {i: Search(lat, int(ends[i]), int(ends[i + 1]), int(own[i] ^ C1)) for i in range(len(texts)) if sizes[i]}
    search_all(lat, unit_a, occ_key, list(searches.values()), k)
    out = []
    for i in range(len(texts)):
        if sizes[i] == 0:
            out.append([(np.zeros(0, np.int32), 0.0, 0.0, 0.0)])
            continue
        found, kappa = searches[i].found, searches[i].kappa
        rows = []
        for path, lp, g in found:
            ids = lat.piece[path]
            if (ids >= WIDE).any():
                ids = np.array([y for x in ids for y in ([v.byte_id[z] for z in chr(x - WIDE).encode("utf-8", "surrogatepass")] if x >= WIDE else [x])], np.int32)
            gap = lp - kappa
            rows.append((ids, lp, g, 0.0 if gap > 3.6 else gap if gap < -30 else math.log(-math.expm1(-math.exp(gap)))))
        out.append(rows)
    return out


def shipped(spark: SparkSession, model: str) -> str:
    """Send the vocabulary file to the executors; the name under which they find it."""
    spark.sparkContext.addFile(model)
    return os.path.basename(model)


def encode(docs: DataFrame, k: int = 2, seed: int = 17, alpha: float = 1.0, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", most_chars: int = 1_500_000) -> DataFrame:
    """A row for each sample: id_col, sample (from 0, largest perturbed value first), n_pieces, ids, log_prob, perturbed, log_inclusion, round_trip."""
    ship(docs.sparkSession)
    file = shipped(docs.sparkSession, model)

    def encoded(part: pa.RecordBatch, v: Vocabulary) -> pa.RecordBatch:
        texts, keys = part.column("_t").to_pylist(), part.column("_id").to_pylist()
        got = encode_batch(keys, texts, v, k, seed)
        rows = [(i, s, *x) for i, samples in enumerate(got) for s, x in enumerate(samples)]
        lens = np.array([len(r[2]) for r in rows], np.int64)
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(np.concatenate([r[2] for r in rows]), pa.int32()))
        ok = [x == (texts[r[0]] or "").encode() for r, x in zip(rows, v.decode_all(ids.values.to_numpy(), np.cumsum(lens)), strict=True)]
        return pa.RecordBatch.from_arrays([
            part.column("_id").take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int32()), pa.array(lens, pa.int32()), ids,
            *[pa.array([r[c] for r in rows], pa.float64()) for c in (3, 4, 5)], pa.array(ok, pa.bool_())],
            names=["_id", "sample", "n_pieces", "ids", "log_prob", "perturbed", "log_inclusion", "round_trip"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(SparkFiles.get(file), alpha)
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column("_t")), 0).to_numpy(zero_copy_only=False)
            begin = 0
            while begin < len(sizes):
                end, held = begin, 0
                while end < len(sizes) and (end == begin or held + sizes[end] <= most_chars):
                    held += sizes[end]
                    end += 1
                yield encoded(batch.slice(begin, end - begin), v)  # what a part took is free before the next
                begin = end
                release()

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = f"_id {kind}, sample int, n_pieces int, ids array<int>, log_prob double, perturbed double, log_inclusion double, round_trip boolean"
    return rows.mapInArrow(run, out).withColumnRenamed("_id", id_col)


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "text", model: str = MODEL) -> DataFrame:
    """rows with out_col: the text of the piece ids (null ids: null).  A column of rows with that name is replaced."""
    ship(rows.sparkSession)
    file = shipped(rows.sparkSession, model)
    fields = [f for f in rows.schema.fields if f.name != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(SparkFiles.get(file), 1.0)
        for b in batches:
            texts = [None if x is None else v.decode(x) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])

    from pyspark.sql.types import StringType, StructField, StructType

    return rows.select(*[f.name for f in fields]).mapInArrow(run, StructType([*fields, StructField(out_col, StringType())]))
