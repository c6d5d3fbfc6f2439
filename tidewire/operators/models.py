"""Deterministic models for the ladder: token windows with mean pooling, and an analyst that goes by rules."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from hashlib import md5

import numpy as np

from tidewire.operators.ladder import Capability

DIM = 384
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}


def pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of each window's token states (windows, tokens, numbers) where the mask is on; zeros for a window without tokens."""
    held = np.where(mask[..., None], states, 0.0).sum(axis=1)
    return held / np.maximum(mask.sum(axis=1), 1)[:, None]


def windows(tokens: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Token ids in rows of `width`, padded with zeros, and the mask of the tokens."""
    ids = np.zeros((-(-len(tokens) // width), width), dtype=np.int64)
    ids.reshape(-1)[:len(tokens)] = tokens
    return ids, (np.arange(ids.size) < len(tokens)).reshape(ids.shape)


@lru_cache(1 << 16)
def token(word: str) -> int:
    return int(md5(word.encode("utf-8", "replace")).hexdigest()[:8], 16)


def hashed_pool(ids: np.ndarray, mask: np.ndarray, dim: int = DIM) -> np.ndarray:
    """`pooled` of states that are plus or minus one at the place that the token's id names, without building them."""
    out = np.zeros((len(ids), dim))
    at, on = np.nonzero(mask)[0], ids[mask]
    np.add.at(out, (at, on % dim), 1 - 2 * (on // dim % 2))
    return out / np.maximum(mask.sum(axis=1), 1)[:, None]


@dataclass(frozen=True)
class Embedder:
    """Provider of unit vectors: every window of a text is pooled, the windows are averaged by their tokens.

    pool(ids, mask) stands for the model; most_windows=1 reads a text's first window alone, None the whole text.
    A text without words has the zero vector.
    """

    pool: Callable[[np.ndarray, np.ndarray], np.ndarray] = hashed_pool
    dim: int = DIM
    width: int = 512
    batch: int = 32
    prefix: str = ""
    most_windows: int | None = None

    def vector(self, text: str) -> list[float]:
        ids, mask = windows([token(w) for w in WORDS.findall((self.prefix + text).translate(LOWER))], self.width)
        ids, mask = ids[:self.most_windows], mask[:self.most_windows]
        total = np.zeros(self.dim)
        for at in range(0, len(ids), self.batch):
            part = mask[at:at + self.batch]
            total += part.sum(axis=1) @ self.pool(ids[at:at + self.batch], part)
        size = np.linalg.norm(total)
        return (total / size if size > 1e-9 else np.zeros(self.dim)).tolist()

    def __call__(self, asked: list[dict], attempt: int) -> list[list[list[float]]]:
        return [[self.vector(t or "") for t in ([q["text"]] if isinstance(q["text"], str) else q["text"])] for q in asked]


def embedding(column: str = "text", dim: int = DIM) -> Capability:
    """Vectors of a string or of an array of strings; null and the empty string are refused, as are vectors of another size."""

    def parse(answer) -> dict | None:
        sound = all(len(v) == dim and np.isfinite(v).all() for v in answer)
        return {"embeddings": answer, "dimensions": dim if answer else 0} if sound else None

    return Capability((column,), lambda r: None if r[column] is None or r[column] == "" else {"text": r[column]}, parse, "embeddings array<array<double>>, dimensions int", f"{column} is required (string or array)")


def first_object(text: str) -> dict | None:
    """The first JSON object in an answer, whatever stands around it."""
    decoder = json.JSONDecoder()
    for at in (m.start() for m in re.finditer(r"\{", text)):
        try:
            return decoder.raw_decode(text, at)[0]
        except ValueError:
            continue
    return None


ANALYSIS = "completeness string, content_quality string, event_summary_points array<string>, thematic_keywords array<string>"


def analysis(title: str = "title", content: str = "content", most: int | None = None, marker: str = "...[truncated]") -> Capability:
    """An article's analysis; rows without title or content are refused.  `most` bounds the characters sent (None: all)."""

    def build(r: dict) -> dict | None:
        if not r[title] or not r[content]:
            return None
        cut = most is not None and len(r[content]) > most
        return {"title": r[title], "content": r[content][:most] + marker if cut else r[content]}

    def parse(answer: str) -> dict | None:
        found = first_object(answer or "")
        if found is None:
            return None
        one = lambda x: None if x is None else str(x)
        many = lambda x: [str(v) for v in x] if isinstance(x, list) else []
        return {k: (many if k in ("event_summary_points", "thematic_keywords") else one)(found.get(k)) for k in ("completeness", "content_quality", "event_summary_points", "thematic_keywords")}

    return Capability((title, content), build, parse, ANALYSIS, "title and content are required")


def analyst(asked: list[dict], attempt: int) -> list[str]:
    """Answers by rules: completeness by length, quality by the share of distinct long words, the title, the five most frequent words."""
    out = []
    for q in asked:
        n, text = len(q["content"]), q["content"].translate(LOWER)
        words = Counter(re.findall(r"[a-z]{6,}", text))
        best = sorted(words, key=lambda w: (-words[w], w))[:5]
        quality = "JUNK" if not words else "LOW_QUALITY" if len(words) * 5 < words.total() else "OK"
        size = "COMPLETE" if n >= 500 else "PARTIAL_USEFUL" if n >= 100 else "PARTIAL_USELESS"
        found = {"completeness": size, "content_quality": quality, "event_summary_points": [q["title"]], "thematic_keywords": best}
        out.append(f"```json\n{json.dumps(found)}\n```")
    return out


def failing(inner: Callable[[list[dict], int], list], rules: list[tuple[Callable[[dict], bool], int, object]]) -> Callable[[list[dict], int], list]:
    """A provider that answers as `inner`, but where a rule (test, calls, answer) holds for a request, its first `calls` calls get that answer."""

    def call(asked: list[dict], attempt: int) -> list:
        own = [next((a for test, calls, a in rules if attempt <= calls and test(q)), None) for q in asked]
        rest = iter(inner([q for q, a in zip(asked, own) if a is None], attempt))
        return [next(rest) if a is None else a for a in own]

    return call
