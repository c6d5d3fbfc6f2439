"""Personal data: exact base patterns plus a character-level bidirectional LSTM with CRF transitions.

The network is written and trained in numpy from labelled spans: a seeded generator of prose with spans of the four
kinds in usual and unusual spelling (addresses with [at], numbers with other separators), all of which obey their
kind's rules (cards pass Luhn), and of things that are none.  Gates are hard sigmoids and softsign stands for tanh.
Every text is read whole through overlapping windows of 192 characters; each window is decoded by Viterbi (where the
emissions and transitions prove that no tag can win, the search is left out), and the decodings are reconciled over the whole text: a
character takes the tag of the window in whose middle 160 it lies.  Runs of one tag are spans of the method.  They are
added where they overlap no base span and obey their kind's rules: an address has @, [at] or (at) and a dotted host;
an IP four numbers of at most 255; a card 13 to 19 digits that pass Luhn; a phone number 9 to 15 digits.

Base matching is linear in the text: each @ looks back over its own run alone, and digit runs are matched whole.

Cases: a null text counts as empty and has no spans; ties of start are ordered by kind; repeated rows are answered
alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import chunks, ship

KINDS = ["email", "ip", "card", "phone"]
WINDOW, STRIDE, HIDDEN = 192, 160, 12
LEARN = 80  # characters of a training window
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ADDRESS = re.compile(r"[^\s@]+ ?(?:@|[\[(]at[\])]) ?[^\s@]+?(?:(?:\.| dot |\[dot\])[A-Za-z0-9-]+)+", re.I)

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost non-overlapping for each kind, sorted by start and kind."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, 0, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] or 0) <= 255 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the network ----------------------------------------------------------------------------------------------------

_MARKS = "@.-_%+() \n:/,#$&*=\"'"
CLASSES = 6 + len(_MARKS)  # padding, lower, upper, digit, other letter, other, and the marks


@lru_cache(1)
def _class_table() -> np.ndarray:
    t = np.full(0x110000, 5, np.uint8)
    t[[i for i in range(0x110000) if chr(i).isalpha()]] = 4
    t[ord("a"):ord("z") + 1], t[ord("A"):ord("Z") + 1], t[ord("0"):ord("9") + 1] = 1, 2, 3
    for k, c in enumerate(_MARKS):
        t[ord(c)] = 6 + k
    return t


def classes_of(text: str) -> np.ndarray:
    return _class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _gate(z: np.ndarray) -> np.ndarray:
    """Hard sigmoid; its slope is 1/4 strictly between 0 and 1."""
    return np.clip(0.25 * z + 0.5, 0, 1)


def _soft(z: np.ndarray) -> np.ndarray:
    """Softsign in place of tanh, y = z / (1 + |z|); its slope is (1 - |y|) ** 2."""
    return z / (1 + np.abs(z))


def unsure(e: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Rows of emissions e [time, tag, row] where the best path may leave tag 0.

    A stretch of other tags gains at most its emissions' lead over tag 0 and its transitions' lead over staying there;
    where no stretch can gain (with room for rounding), tag 0 throughout is the best path.
    """
    enter, stay, leave = (part.max() - a[0, 0] for part in (a[0, 1:], a[1:, 1:], a[1:, 0]))
    gain = e[:, 1:].max(axis=1) - e[:, 0]
    now, most = gain[0], np.full(e.shape[2], -np.inf, np.float32)
    for t in range(1, len(e)):
        most = np.maximum(most, now + leave)
        now = gain[t] + np.maximum(now + stay, enter)
    return np.flatnonzero(np.maximum(most, now) > -0.1)


@dataclass
class Net:
    p: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 5, h: int = HIDDEN, tags: int = 1 + len(KINDS)) -> Net:
        r = np.random.default_rng(seed)
        f = lambda *s: r.normal(0, 0.3, s).astype(np.float32)
        p = {f"g{d}": f(CLASSES, 4 * h) for d in "fb"} | {f"u{d}": f(h, 4 * h) for d in "fb"} | {f"c{d}": np.zeros(4 * h, np.float32) for d in "fb"}
        for d in "fb":
            p[f"c{d}"][h:2 * h] = 1.0  # remember at first
        return Net(p | {"w": f(2 * h, tags), "b": np.zeros(tags, np.float32), "a": np.zeros((tags, tags), np.float32)})

    def one_way(self, x: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """Hidden states [time, row, hidden] of inputs x [time, row]."""
        g, u, c0 = self.p[f"g{d}"], self.p[f"u{d}"], self.p[f"c{d}"]
        n, h = x.shape[1], u.shape[0]
        hid, cell, out = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.empty((len(x), n, h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = g[x[t]] + hid @ u + c0
            i, f, o, m = _gate(z[:, :h]), _gate(z[:, h:2 * h]), _gate(z[:, 2 * h:3 * h]), _soft(z[:, 3 * h:])
            old, prev = cell, hid
            cell = f * old + i * m
            tc = _soft(cell)
            hid = o * tc
            out[t] = hid
            if trace is not None:
                trace.append((t, i, f, o, m, old, tc, prev))
        return out

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([self.one_way(x, "f"), self.one_way(x, "b")], axis=2)
        return both @ self.p["w"] + self.p["b"], both

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi tags [time, row].  Numbers lie with rows last, so every step runs along whole vectors."""
        T, n = x.shape
        h, k = self.p["uf"].shape[0], len(self.p["b"])
        e = np.zeros((T, k, n), np.float32) + self.p["b"][:, None]
        at = x.astype(np.intp)
        z, more = np.empty((4 * h, n), np.float32), np.empty((4 * h + k, n), np.float32)  # used again by every step
        for part, d in enumerate("fb"):
            # The gates' factor 1/4 and summand 1/2 go into their weights.
            part_of = np.concatenate([np.full(3 * h, 0.25, np.float32), np.ones(h, np.float32)])
            g = np.ascontiguousarray(((self.p[f"g{d}"] + self.p[f"c{d}"]) * part_of + np.where(part_of < 1, 0.5, 0.0).astype(np.float32)).T)
            u, w = np.ascontiguousarray((self.p[f"u{d}"] * part_of).T), np.ascontiguousarray(self.p["w"][part * h:(part + 1) * h].T)
            hid, cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
            both, last = np.concatenate([u, w]), None  # one product gives the next step's input and the last step's emissions
            for t in range(T) if d == "f" else range(T - 1, -1, -1):
                np.matmul(both, hid, out=more)
                if last is not None:
                    e[last] += more[4 * h:]
                last = t
                np.take(g, at[t], axis=1, out=z, mode="clip")
                z += more[:4 * h]
                gate = z[:3 * h]
                np.clip(gate, 0, 1, out=gate)
                cell = gate[h:2 * h] * cell + gate[:h] * _soft(z[3 * h:])
                hid = gate[2 * h:] * _soft(cell)
            if last is not None:
                e[last] += w @ hid
        a = self.p["a"]
        open_ = unsure(e, a)
        tags = np.zeros(x.shape, np.int8)
        if not len(open_):
            return tags
        e = e[:, :, open_]
        best, back = e[0], np.zeros((T, k, len(open_)), np.int8)
        for t in range(1, T):
            most, from_ = best[0] + a[0][:, None], back[t]
            for i in range(1, k):  # the first of equal ones stays
                s = best[i] + a[i][:, None]
                np.copyto(from_, i, where=s > most)
                np.maximum(most, s, out=most)
            best = most + e[t]
        path, rows = np.empty((T, len(open_)), np.int8), np.arange(len(open_))
        path[-1] = best.argmax(0)
        for t in range(T - 1, 0, -1):
            path[t - 1] = back[t][path[t], rows]
        tags[:, open_] = path
        return tags

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean CRF negative log-likelihood a character and its gradient."""
        p, h = self.p, self.p["uf"].shape[0]
        traces = {"f": [], "b": []}
        hs = {d: self.one_way(x, d, traces[d]) for d in "fb"}
        both = np.concatenate([hs["f"], hs["b"]], axis=2)
        e, a = both @ p["w"] + p["b"], p["a"]
        T, n = x.shape
        lse = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        alpha = [e[0]]
        for t in range(1, T):
            alpha.append(lse(alpha[-1][:, :, None] + a[None], 1) + e[t])
        beta = [np.zeros_like(e[0])]
        for t in range(T - 1, 0, -1):
            beta.append(lse(a[None] + (e[t] + beta[-1])[:, None, :], 2))
        beta = beta[::-1]
        z = lse(alpha[-1], 1)
        rows = np.arange(n)
        de, da = np.empty_like(e), np.zeros_like(a)
        gold = np.zeros(n)
        for t in range(T):
            de[t] = np.exp(alpha[t] + beta[t] - z[:, None])
            de[t][rows, y[t]] -= 1
            gold += e[t][rows, y[t]]
            if t:
                pair = np.exp(alpha[t - 1][:, :, None] + a[None] + (e[t] + beta[t])[:, None, :] - z[:, None, None])
                da += pair.sum(0)
                np.add.at(da, (y[t - 1], y[t]), -1)
                gold += a[y[t - 1], y[t]]
        scale = 1.0 / (T * n)
        de, da = de * scale, da * scale
        grad = {"w": np.einsum("tnh,tnk->hk", both, de), "b": de.sum((0, 1)), "a": da}
        dboth = de @ p["w"].T
        slope = lambda y: 0.25 * ((y > 0) & (y < 1))
        for k, d in enumerate("fb"):
            dh_out, u = dboth[:, :, k * h:(k + 1) * h], p[f"u{d}"]
            all_dz, all_prev = np.empty((T, n, 4 * h), np.float32), np.empty((T, n, h), np.float32)
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, i, f, o, m, old, tc, prev in reversed(traces[d]):
                dh = dh + dh_out[t]
                dc = dc + dh * o * (1 - np.abs(tc)) ** 2
                dz = np.concatenate([dc * m * slope(i), dc * old * slope(f), dh * tc * slope(o), dc * i * (1 - np.abs(m)) ** 2], axis=1)
                all_dz[t], all_prev[t] = dz, prev
                dh, dc = dz @ u.T, dc * f
            flat = all_dz.reshape(T * n, -1)
            grad |= {f"g{d}": np.eye(CLASSES, dtype=np.float32)[x.ravel()].T @ flat, f"u{d}": all_prev.reshape(T * n, h).T @ flat, f"c{d}": flat.sum(0)}
        return float((z - gold).sum() * scale), grad


def labelled_text(rng: np.random.Generator, length: int) -> tuple[str, np.ndarray]:
    """Prose of `length` characters with tagged spans: 0 none, else 1 + kind."""
    word = lambda: "".join(rng.choice(list("aeiourstnlmdchpgbvé"), rng.integers(1, 10)))
    num = lambda a, b: str(rng.integers(a, b))
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    pick = lambda *options: str(rng.choice(list(options)))

    def email():
        at, dot = pick("@", "@", "@", " @ ", " [at] ", "[at]", "(at)", " (at) "), pick(".", ".", ".", " dot ", "[dot]")
        return f"{word()}{pick('.', '_', '', '-')}{pick(word(), num(1, 99))}{at}{word()}{pick('', num(1, 99))}{dot}{pick('com', 'org', 'net', 'example.com', 'fr', 'co.uk')}"

    def ip():
        return pick(".", ".", ".", " . ", "[.]", "(.)").join(num(0, 256) for _ in range(4))

    def card():
        body = digits(int(rng.choice([12, 13, 14, 15, 15, 15, 15, 15])))
        whole = body + next(c for c in "0123456789" if luhn(body + c))
        gap = pick("", " ", "-", ".", "/", "_")
        cuts = [4, 10] if len(whole) == 15 else range(4, len(whole), 4)
        return gap.join(whole[a:b] for a, b in zip([0, *cuts], [*cuts, None], strict=True))

    def phone():
        return pick(f"+{num(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"00{num(10, 99)} {digits(3)} {digits(3)} {digits(3)}", f"+{num(10, 99)} {digits(3)} {digits(6)}")

    def none():
        return pick(num(1, 3000), f"{num(1, 99)}.{num(0, 99)}", f"{num(1, 29)}/{num(1, 13)}/{num(1990, 2030)}", f"{num(1, 9)}.{num(0, 20)}.{num(0, 20)}", f"{num(0, 24)}:{num(10, 60)}", "@" + word(), digits(9), "".join(rng.choice(list("0123456789abcdef"), 40)), f"{num(1990, 2030)}-{num(10, 13)}-{num(10, 29)}", f"${num(1, 900)},{digits(3)}", digits(int(rng.integers(4, 9))), f"({word()})", f"[{word()}]", f"{word()} at {word()}")

    makers, text, tags = [email, ip, card, phone], "", []
    while len(text) < length:
        roll = rng.random()
        if roll < 0.10:
            k = int(rng.integers(0, 4))
            piece = makers[k]()
            text, tags = text + piece, tags + [1 + k] * len(piece)
        else:
            piece = none() if roll < 0.17 else word()
            piece = piece.upper() if rng.random() < 0.05 else piece.capitalize() if rng.random() < 0.1 else piece
            text, tags = text + piece, tags + [0] * len(piece)
        gap = str(rng.choice([" "] * 8 + [", ", ".\n", "### ", ": ", "&&& "]))
        text, tags = text + gap, tags + [0] * len(gap)
    begin = int(rng.integers(0, len(text) - length + 1))
    return text[begin:begin + length], np.array(tags[begin:begin + length])


@lru_cache(2)
def trained(seed: int = 5, steps: int = 450, rows: int = 96) -> Net:
    """Train on generated windows by Adam; the same seed gives the same network."""
    rng, net = np.random.default_rng(seed), Net.new(seed)
    long = [labelled_text(rng, 6000) for _ in range(30)]
    xs, ys = [classes_of(t) for t, _ in long], [y for _, y in long]
    m, v = ({k: np.zeros_like(w) for k, w in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        which, at = rng.integers(0, len(xs), rows), rng.integers(0, 6000 - LEARN, rows)
        x = np.stack([xs[i][a:a + LEARN] for i, a in zip(which, at, strict=True)], 1)
        y = np.stack([ys[i][a:a + LEARN] for i, a in zip(which, at, strict=True)], 1)
        _, grad = net.gradient(x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.03 * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _holds(kind: int, piece: str) -> bool:
    n = sum(c in "0123456789" for c in piece)
    if kind == 0:
        return bool(ADDRESS.fullmatch(piece))
    if kind == 1:
        found = re.findall(r"[0-9]+", piece)
        return len(found) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in found)
    if kind == 2:
        digits = "".join(c for c in piece if c in "0123456789")
        return 13 <= n <= 19 and luhn(digits)
    return 9 <= n <= 15


def method_spans(texts: list[str], net: Net, batch: int = 2048) -> list[list[Span]]:
    """Spans of the network for each text: every window of every text is decoded."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    code = classes_of("".join(texts))
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)  # windows of each text
    owner = np.repeat(np.arange(len(texts)), count)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = (ends - sizes)[owner] + STRIDE * turn
    margin = (WINDOW - STRIDE) // 2
    # A character takes the tag of the window in whose middle it lies; the first and the last window have no outer margin.
    own_from = np.where(turn == 0, start, start + margin)
    own_to = np.where(turn == count[owner] - 1, ends[owner], start + WINDOW - margin)
    tags = np.zeros(len(code), np.int8)
    step = np.arange(WINDOW)
    for b in range(0, len(owner), batch):
        s = start[b:b + batch]
        at = s[:, None] + step
        inside = at < ends[owner[b:b + batch]][:, None]
        got = net.decode(np.ascontiguousarray(np.where(inside, code.take(at, mode="clip"), 0).T)).T
        mine = inside & (at >= own_from[b:b + batch][:, None]) & (at < own_to[b:b + batch][:, None])
        tags[at[mine]] = got[mine]
    # Runs of one tag inside one text.
    change = np.concatenate([[True], tags[1:] != tags[:-1]]) if len(tags) else np.zeros(0, bool)
    change[(ends - sizes)[sizes > 0]] = True
    begins = np.flatnonzero(change)
    stops = np.append(begins[1:], len(tags))
    out: list[list[Span]] = [[] for _ in texts]
    for r in np.flatnonzero(tags[begins] > 0).tolist():
        i = int(np.searchsorted(ends, begins[r], side="right"))
        first = int(ends[i] - sizes[i])
        b, e, kind = int(begins[r]) - first, int(stops[r]) - first, int(tags[begins[r]]) - 1
        piece = texts[i][b:e]
        e -= len(piece) - len(piece.rstrip(" \n.,:;"))
        b += len(piece) - len(piece.lstrip(" \n.,:;"))
        if e > b and _holds(kind, texts[i][b:e]):
            out[i].append((b, kind, e))
    return out


def merged(base: list[Span], more: list[Span]) -> list[Span]:
    free = [s for s in more if all(s[2] <= b[0] or s[0] >= b[2] for b in base)]
    return sorted(base + free)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, net: Net | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, spans: array<struct<kind, start, end, base>> sorted by start and kind."""
    net = net or trained()
    ship(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(frames, "_t"):
            texts = [t if isinstance(t, str) else "" for t in part["_t"]]
            spans = []
            for t, more in zip(texts, method_spans(texts, net), strict=True):
                base = base_spans(t)
                own = set(base)
                spans.append([{"kind": KINDS[k], "start": s, "end": e, "base": (s, k, e) in own} for s, k, e in merged(base, more)])
            yield pd.DataFrame({"_id": part["_id"], "spans": spans})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"_id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>").withColumnRenamed("_id", id_col)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
