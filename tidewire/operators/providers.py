"""What stands for a model: deterministic embeddings, input formats, staged runs, retries and fetch rounds."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 384
RETRYABLE = {408, 429, 500, 502, 503, 504}  # fixed values


def embed(rows: DataFrame, text: str = "text", out: str = "embedding", dim: int = DIM, most_tokens: int | None = None) -> DataFrame:
    """Hashed word counts of unit length, in the JVM; a text without words has the zero vector."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    words = words if most_tokens is None else F.slice(words, 1, most_tokens)
    hashed = HashingTF(numFeatures=dim, inputCol="_words", outputCol="_tf").transform(rows.withColumn("_words", words))
    whole = Normalizer(inputCol="_tf", outputCol="_unit").transform(hashed)
    return whole.withColumn(out, vector_to_array("_unit")).drop("_words", "_tf", "_unit")


ARTICLE = ["id", "title", "content", "embedding", "publishDate"]  # fixed values


def item_format(columns: list[str]) -> str:
    """Which of the accepted inputs a table is, by its columns; up to seven with id and embedding are an extended item."""
    have = set(columns)
    if have == {"id", "embedding"}:
        return "embedding_item"
    if {"id", "embedding"} <= have and len(have) <= 7:
        return "extended_item"
    if set(ARTICLE) <= have:
        return "article_item"
    if "text" in have:
        return "vector_item" if "embedding" in have else "text_item"
    return "unknown"


def record_format(record: Column) -> Column:
    """`item_format` of one JSON object's keys; what isn't an object is unknown."""
    keys = F.json_object_keys(record)
    has = lambda *names: F.array_size(F.array_intersect(keys, F.array(*map(F.lit, names)))) == len(names)
    kinds = F.array_size(F.array_distinct(keys))
    return (F.when(has("id", "embedding") & (kinds == 2), "embedding_item").when(has("id", "embedding") & (kinds <= 7), "extended_item").when(has(*ARTICLE), "article_item")
            .when(has("text", "embedding"), "vector_item").when(has("text"), "text_item").otherwise("unknown"))


def normalized_items(rows: DataFrame) -> DataFrame:
    """id, text, embedding, metadata map of the other columns, for each of the formats."""
    kind = item_format(rows.columns)
    if kind == "unknown":
        raise ValueError(f"neither text nor embedding: {rows.columns}")
    own = [c for c in rows.columns if c not in ("id", "text", "content", "embedding")]
    ident = F.col("id").cast("string") if "id" in rows.columns else F.xxhash64("text").cast("string")
    parts = [F.col(c) for c in ("title", "content") if c in rows.columns]
    text: Column = F.col("text") if "text" in rows.columns else F.concat_ws("\n", *parts) if parts else F.lit(None).cast("string")
    vec = F.col("embedding").cast("array<double>") if "embedding" in rows.columns else F.lit(None).cast("array<double>")
    pairs = [x for name in own for x in (F.lit(name), F.col(name).cast("string"))]
    return rows.select(ident.alias("id"), text.alias("text"), vec.alias("embedding"), (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).alias("metadata"))


class Staged:
    """Named steps DataFrame -> DataFrame, applied in order; `took` holds the seconds that planning each one needed."""

    def __init__(self):
        self.steps: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []
        self.took: dict[str, float] = {}

    def add(self, name: str, step: Callable[[DataFrame], DataFrame]) -> Staged:
        self.steps.append((name, step))
        return self

    def run(self, rows: DataFrame) -> DataFrame:
        for name, step in self.steps:
            began = time.perf_counter()
            rows = rows.transform(step)
            self.took[name] = time.perf_counter() - began
        return rows


def delay(attempt: int, base: float = 0.5, factor: float = 2.0, most: float = 30.0, draw: Callable[[], float] = random.random) -> float:
    """Seconds before retry number `attempt` (1, 2, ...): half to all of the base first, then a tenth either way."""
    full = min(base * factor ** (attempt - 1), most)
    return min(most, full * (0.5 + 0.5 * draw() if attempt == 1 else 0.9 + 0.2 * draw()))


def retrying(call: Callable, attempts: int = 3, wait: Callable[[float], None] = time.sleep, **how):
    """call(), again after errors whose `status` may pass; other errors, and the last one, are raised."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            if attempt == attempts or getattr(e, "status", None) not in RETRYABLE:
                raise
            wait(delay(attempt, **how))


def rounds(hosts: list[str], most: int = 8, pause: int = 1000, host_pause: int = 5000) -> list[tuple[int, int]]:
    """(round, start in ms) of each host's item, in order: a round takes up to `most` items whose host rests no more.

    Items of one host may share a round, since the host's time is set when the round starts.
    """
    out: list = [None] * len(hosts)
    left, last, clock, n = list(range(len(hosts))), {}, 0, 0
    while left:
        ready = [i for i in left if hosts[i] not in last or clock - last[hosts[i]] >= host_pause][:most]
        if not ready:
            clock += max(500, min(last[hosts[i]] + host_pause for i in left) - clock)
            continue
        for i in ready:
            out[i], last[hosts[i]] = (n, clock), clock
        left = [i for i in left if out[i] is None]
        clock, n = clock + pause, n + 1
    return out


def fetch_rounds(rows: DataFrame, **how) -> DataFrame:
    """rows: queue bigint (one batch of messages), id bigint, host (null: no URL, dropped); adds round and start_ms."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        return f.assign(**dict(zip(("round", "start_ms"), map(list, zip(*rounds(f["host"].tolist(), **how))))))

    return rows.where(F.col("host").isNotNull()).select("queue", "id", "host").groupBy("queue").applyInPandas(run, "queue bigint, id bigint, host string, round int, start_ms bigint")
