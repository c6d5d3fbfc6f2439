"""Language ID by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text.  A document is parsed into
longest matches against it: walking the automaton from its root, a missing transition ends the phrase and starts the
next.  The bits per letter, phrases * log2(sample length) / letters, normalise the phrase counts of languages with
samples of different lengths; the language with the fewest wins.

Every letter of the samples is told apart; letters that no sample has share a class that no automaton knows, so each
is a phrase of its own.  Transitions lie in hash tables, whose size follows the sample's and not the alphabet's.
Blocks of 512 letters walk the automata together, each as if a phrase began with it.  Then every block's last phrase
is carried on into the following blocks until a phrase begins where one began there already; from that place on both
walks are the same, so the counts are those of the text parsed whole.

The sample is at most SAMPLE_ROWS rows and SAMPLE_CHARS letters of each language, rows with the smallest hash of the
id first.

Cases: a text that is null or has no letter gets `und` and score 0; with no labelled rows every row does; ties go to
the language first in order; with one language the score is 1; repeated rows are answered alike; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import annotate, bucket4, release

SAMPLE_ROWS, SAMPLE_CHARS = 64, 40_000
BLOCK = 512
ODD = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, train_only: bool = True, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """A bounded text for each language.  The ids are ranked without their texts, then the chosen texts are read."""
    lab = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_l")).where(F.col("_l").isNotNull() & F.col("_id").isNotNull())
    if train_only:
        lab = lab.where(bucket4("_id") != 2)
    ranked = lab.withColumn("_r", F.row_number().over(Window.partitionBy("_l").orderBy(F.xxhash64("_id"), "_id"))).where(F.col("_r") <= rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.substring(F.col(text_col), 1, chars).alias("_t"))
    got = texts.join(F.broadcast(ranked.select("_id", "_l").distinct()), "_id").select("_l", "_t").collect()  # at most rows x languages ids
    own: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["_l"], r["_t"] or "")):
        own.setdefault(r["_l"], []).append(r["_t"] or "")
    share = {lang: max(1, chars // len(texts)) for lang, texts in own.items()}
    out = {}
    for lang, texts in own.items():
        texts.sort(key=len)
        left, taken = chars, []
        for i, t in enumerate(texts):  # short texts leave their share to longer ones
            part = t[: max(share[lang], left // (len(texts) - i))]
            taken.append(part)
            left -= len(part)
        out[lang] = "\n".join(taken)[:chars]
    return out


def suffix_automaton(word: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in word:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Transitions:
    """(state, class) -> state, by a hash table and further ones for the keys that find their slot taken.

    States are kept times the alphabet's size, so that state + class is a transition's key.
    """

    def __init__(self, nxt: list[dict[int, int]], width: int):
        self.root = np.full(width, len(nxt) * width, np.int64)  # the last state is left by no letter
        self.root[list(nxt[0])] = np.array(list(nxt[0].values()), np.int64) * width
        keys = np.array([s * width + c for s, row in enumerate(nxt) for c in row], np.int64)
        goal = np.array([q * width for row in nxt for q in row.values()], np.int64)
        self.tables = []
        bits = max(4, (4 * len(keys)).bit_length())
        while len(keys):
            slot = self._slot(keys, bits, len(self.tables))
            _, first = np.unique(slot, return_index=True)
            held, to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
            held[slot[first]], to[slot[first]] = keys[first], goal[first]
            self.tables.append((bits, held, to))
            late = np.ones(len(keys), bool)
            late[first] = False
            keys, goal = keys[late], goal[late]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, turn: int) -> np.ndarray:
        return (keys.view(np.uint64) * (ODD + np.uint64(2 * turn)) >> np.uint64(64 - bits)).view(np.int64)

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase begins with the letter)."""
        key = state + letter
        out, new, left = None, np.ones(len(key), bool), None
        for turn, (bits, held, to) in enumerate(self.tables):
            own = key if left is None else key.take(left)
            slot = self._slot(own, bits, turn)
            ok = held.take(slot) == own
            if left is None:
                out, new = to.take(slot), ~ok
                left = np.flatnonzero(new)
            else:
                at = left[ok]
                out[at], new[at] = to.take(slot[ok]), False
                left = left[~ok]
            if not len(left):
                break
        if out is None:
            return self.root.take(letter), new
        out[left] = self.root.take(letter[left])
        return out, new


class Model:
    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        seen = sorted({c for t in samples.values() for c in t.lower() if c.isalpha()})
        self.width = len(seen) + 2
        self.classes = np.zeros(0x110000, np.int32)  # 0: no letter
        self.classes[[i for i in range(0x110000) if chr(i).isalpha()]] = self.width - 1
        for k, c in enumerate(seen):
            self.classes[ord(c)] = k + 1
        words = [self.normal(samples[lang]) for lang in self.langs]
        self.tables = [Transitions(suffix_automaton(w.tolist()), self.width) for w in words]
        self.bits = [math.log2(max(2, len(w))) for w in words]

    def normal(self, text: str | None) -> np.ndarray:
        """Classes of the lower-cased text; what isn't a letter is one separator between words."""
        got = self.classes[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        stay = got > 0
        stay[1:] |= got[:-1] > 0
        if len(stay):
            stay[0] = got[0] > 0
        return got[stay]

    def phrases(self, word_list: list[np.ndarray]) -> np.ndarray:
        """Phrase counts, [text, language]."""
        out = np.zeros((len(word_list), len(self.langs)), np.int64)
        sizes = np.array([len(w) for w in word_list], np.int64)
        if not sizes.sum():
            return out
        letters = np.concatenate(word_list)
        ends = np.cumsum(sizes)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(word_list)), blocks)
        first = np.cumsum(blocks) - blocks  # each text's first block
        begin = (ends - sizes)[owner] + BLOCK * (np.arange(len(owner)) - first[owner])
        end = np.minimum(begin + BLOCK, ends[owner])
        order = np.argsort(begin - end, kind="stable")  # long blocks first, so those still open are the first ones
        opened, size = begin[order], (end - begin)[order]
        active = np.searchsorted(-size, -np.arange(BLOCK), side="left")
        follows = np.flatnonzero(end < ends[owner])
        for k, table in enumerate(self.tables):
            flat = letters.astype(np.int64)
            starts, last = np.zeros(len(flat), bool), np.zeros(len(owner), np.int64)
            state = table.root.take(flat.take(opened))
            starts[opened] = True
            for t in range(1, BLOCK):
                n = active[t]
                if not n:
                    break
                at = opened[:n] + t
                state[:n], starts[at] = table.step(state[:n], flat.take(at))
            last[order] = state
            extra, met = self._carried(table, flat, starts, follows, last, end, ends[owner])
            before = np.concatenate([[0], np.cumsum(starts)])
            out[:, k] = np.where(sizes > 0, before[end[np.minimum(first, len(end) - 1)]] - before[begin[np.minimum(first, len(end) - 1)]], 0)
            for i in np.flatnonzero(blocks > 1):
                b = first[i]
                while end[b] < ends[i]:
                    out[i, k] += extra[b]
                    if met[b] == ends[i]:
                        break
                    place, b = met[b], first[i] + (met[b] - (ends[i] - sizes[i])) // BLOCK
                    out[i, k] += before[end[b]] - before[place + 1]
        return out

    @staticmethod
    def _carried(table: Transitions, flat: np.ndarray, starts: np.ndarray, lanes: np.ndarray, last: np.ndarray, at: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each block that another follows: phrases that begin after it up to where the walks meet, and that place."""
        extra, met = np.zeros(len(at), np.int64), until.copy()
        state, at, until = last[lanes], at[lanes], until[lanes]
        while len(lanes):
            state, new = table.step(state, flat.take(at))
            extra[lanes] += new
            done = new & starts.take(at)
            met[lanes[done]] = at[done]
            at = at + 1
            stay = ~done & (at < until)
            lanes, state, at, until = lanes[stay], state[stay], at[stay], until[stay]
        return extra, met

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [self.normal(t) for t in texts]
        letters = np.array([int((w > 0).sum()) for w in words])
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        rate = self.phrases(words) * np.array(self.bits) / np.maximum(1, letters)[:, None]
        best = rate.argmin(axis=1)
        top = np.sort(rate, axis=1)
        score = np.ones(len(texts)) if len(self.langs) == 1 else top[:, 1] / np.maximum(1e-12, top[:, 0] + top[:, 1])
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)], [float(s) if n else 0.0 for s, n in zip(score, letters, strict=True)]


_MODELS: dict[int, Model] = {}


def _model(samples: dict[str, str]) -> Model:
    key = hash(tuple(sorted(samples.items())))
    if key not in _MODELS:
        _MODELS.clear()
        release()  # what earlier stages left in this worker
        _MODELS[key] = Model(samples)
    return _MODELS[key]


def with_language(docs: DataFrame, samples: dict[str, str], text_col: str = "text", lang: str = "_lang", score: str = "_score", most_chars: int = 4_000_000) -> DataFrame:
    """docs with two more columns, whose names docs must not have: the language and the score."""
    return annotate(docs, text_col, lambda: _model(samples).predict, [(lang, "string"), (score, "double")], most_chars)


def identify(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred, score."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(bucket4(id_col) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("_t"))
    return with_language(rows, samples, "_t").select(F.col("_id").alias(id_col), "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
