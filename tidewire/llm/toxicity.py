"""Toxic passages by maximum-scoring segment search.

Training, on a bounded sample of labelled rows: words get log-odds of the toxic against the other rows under an
informative Dirichlet prior (pseudo-counts in proportion to the pooled counts), kept where the likelihood ratio is significant, less
a drift that makes the expected score of clean text negative.

Scoring: one linear pass (Ruzzo and Tompa) finds all maximal scoring segments of a document.  Segment scores of clean
text follow an extreme-value law, P(S >= x) = 1 - exp(-K n exp(-lambda x)); lambda solves E[exp(lambda s)] = 1 over
clean tokens and K is fitted on clean rows.  Passages below the chosen p-value are reported; the best segment's
evidence lambda S - ln(K n) is turned into a probability by a logistic curve fitted on rows the words weren't
learned from.

Labels are learned from; lang, source and id never enter a score.

Cases: a null or empty text scores as text without toxic words; texts of any length are read whole; positions are those
of the text as given, whatever its lower case is; null ids stay and are never held out; without toxic rows in the sample
every score is 0; repeated rows score alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import bucket4, chunks, labelled_sample, ship

TRAIN_ROWS = 8_000
PRIOR, G_LEAST, DRIFT, P_VALUE = 500.0, 12.0, 0.12, 0.01
EDGE = ".,;:!?\"'()[]{}*#$%&|<>~`-_=+/\\"
WORD = re.compile(r"\S+")


def tokens(text: str | None) -> list[str]:
    return [w.strip(EDGE) for w in (text or "").lower().split()]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), by Ruzzo and Tompa's linear-time algorithm.

    Only positive tokens start or extend candidates, so what is between them is taken from prefix sums.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # begin, end, sum before, sum at the end, the last candidate before with a smaller sum before
    for i in np.flatnonzero(scores > 0):
        new = [int(i), int(i) + 1, float(total[i]), float(total[i + 1]), -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
    return [(b, e, r - x) for b, e, x, r, _ in found]


@dataclass
class Model:
    weights: dict[str, float]
    unseen: float = -DRIFT
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    bias: float = -50.0

    def score_tokens(self, words: list[str]) -> np.ndarray:
        get, other = self.weights.get, self.unseen
        return np.array([get(w, other) for w in words], float)

    def evidence(self, score: float, n: int) -> float:
        return self.lam * score - self.log_k - math.log(max(1, n))

    def best(self, words: list[str]) -> tuple[float, list[tuple[int, int, float]]]:
        s = self.score_tokens(words)
        segs = segments(s)
        return max((x[2] for x in segs), default=0.0), segs

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * evidence + self.bias))))


def _log_odds(rows: list[tuple[list[str], int]]) -> dict[str, float]:
    count = [Counter(), Counter()]
    for words, y in rows:
        count[y].update(set(words))  # documents that hold the word: one long row doesn't decide
    pooled = count[0] + count[1]
    n, every = [sum(c.values()) for c in count], sum(pooled.values())
    out = {}
    for w, m in pooled.items():
        if not w:
            continue
        a = 0.5 + PRIOR * m / every
        x1, x0 = count[1][w] + a, count[0][w] + a
        odds = math.log(x1 / (n[1] + PRIOR - x1)) - math.log(x0 / (n[0] + PRIOR - x0))
        want = [m * n[0] / every, m * n[1] / every]
        g = 2 * sum(count[y][w] * math.log(count[y][w] / want[y]) for y in (0, 1) if count[y][w])
        if g >= G_LEAST:
            out[w] = max(-1.0, odds) - DRIFT
    return out


def fit(rows: list[tuple[str | None, int]]) -> Model:
    once = {(t or ""): int(y) for t, y in rows}  # copies of a text teach once
    data = [(tokens(t), y) for t, y in once.items()]
    if not any(y for _, y in data) or all(y for _, y in data):
        return Model({})
    halves = [data[::2], data[1::2]]
    # Words learned on one half are calibrated on the other, both ways; the words in use come from all rows.
    lam_of, ev = [], []
    for own, other in (halves, halves[::-1]):
        m = Model(_log_odds(own))
        m.lam, m.log_k = _gumbel(m, [w for w, y in other if not y])
        lam_of.append((m.lam, m.log_k))
        ev += [(m.evidence(m.best(w)[0], len(w)), y) for w, y in other]
    model = Model(_log_odds(data))
    model.lam, model.log_k = (sum(x[i] for x in lam_of) / 2 for i in (0, 1))
    model.slope, model.bias = _logistic(np.array([e for e, _ in ev]), np.array([y for _, y in ev]))
    return model


def _gumbel(m: Model, clean: list[list[str]]) -> tuple[float, float]:
    if not clean:
        return 1.0, 0.0
    s = np.concatenate([m.score_tokens(w) for w in clean] or [np.zeros(1)])
    lo, hi = 1e-3, 8.0
    if not (s > 0).any():
        lam = 1.0
    else:
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.exp(np.minimum(mid * s, 50)).mean() < 1 else (lo, mid)
        lam = lo
    tops = np.array([m.best(w)[0] for w in clean])
    n = np.array([max(1, len(w)) for w in clean], float)
    # Maximum likelihood of K with lambda given: rows / sum of n exp(-lambda S).
    return lam, math.log(len(clean) / np.sum(n * np.exp(-lam * tops)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    mean, sd = x.mean(), max(1e-9, x.std())
    z, w = (x - mean) / sd, np.zeros(2)
    design = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        grad = design.T @ (y - p) - 1e-2 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(0.0, w[0]) / sd), float(w[1] - max(0.0, w[0]) * mean / sd)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most `rows` labelled rows outside the held-out quarter."""
    lab = labels.select(F.col("doc_id").alias(id_col), "toxic")
    got = labelled_sample(docs.select(F.col(id_col), F.col(text_col).alias("_t")), lab, ["toxic"], rows, True, id_col)
    picked = sorted(((r[id_col], r["_t"] or "", r["toxic"]) for r in got.select(id_col, "_t", "toxic").toLocalIterator()), key=lambda r: (r[0], r[1]))
    return fit([(t, y) for _, t, y in picked])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id_col, held_out, score, predicted, passages: array<struct<start, end, score, p_value>> in code points."""
    ship(docs.sparkSession)

    def one(text: str | None) -> tuple[float, list]:
        words = tokens(text)
        top, segs = model.best(words)
        n, passages = len(words), []
        for b, e, s in segs:
            p = -math.expm1(-math.exp(min(50.0, -model.evidence(s, n))))
            if p <= P_VALUE:
                passages.append((b, e, s, p))
        if passages:
            at = [(m.start(), m.end()) for m in WORD.finditer(text)]  # lower case may be longer, but has the same words
            passages = [{"start": at[b][0], "end": at[e - 1][1], "score": s, "p_value": p} for b, e, s, p in passages]
        return model.probability(model.evidence(top, n)), passages

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(frames, "_t"):
            got = [one(t) for t in part["_t"]]
            s = [x[0] for x in got]
            yield pd.DataFrame({"_id": part["_id"], "held_out": part["held_out"], "score": s, "predicted": [int(x >= threshold) for x in s], "passages": [x[1] for x in got]})

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(bucket4(id_col) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("_t"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = f"_id {kind}, held_out boolean, score double, predicted int, passages array<struct<start:int,end:int,score:double,p_value:double>>"
    return rows.mapInPandas(run, out).withColumnRenamed("_id", id_col)
