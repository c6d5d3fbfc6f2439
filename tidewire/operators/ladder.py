"""Capabilities over providers: Arrow batches of requests, a ladder for rows that failed, retries counted by row.

A capability builds a row's request and reads an answer; a step calls one provider.  All steps of a batch run in the task
that holds it, so nothing is shuffled, and a lost task asks its own rows again.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.functions.text import QUOTA
from tidewire.operators.providers import RETRYABLE, delay

UNREADABLE = "answer without a readable value"


class Refused(Exception):
    """A provider's refusal of one row, or of a whole call where it is raised."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class Capability:
    """columns: what `build` sees of a row.  build gives the request, or null where the row lacks what is asked for (`missing`
    is then its error).  parse gives the value, of DDL type `value`, or null for an answer that can't be read."""

    columns: tuple[str, ...]
    build: Callable[[dict], dict | None]
    parse: Callable[[Any], dict | None]
    value: str
    missing: str = "required field is missing"


@dataclass(frozen=True)
class Retry:
    """tries: calls of a row at most; passes: whether an error may pass; delay: seconds before the next call, by the calls so far."""

    tries: int = 1
    passes: Callable[[Exception], bool] = lambda e: False
    delay: Callable[[int], float] = lambda n: 0.0


def spent(e: Exception) -> bool:
    """Whether an error tells of a spent quota."""
    return any(w in str(e).lower() for w in QUOTA)


def quota_delay(n: int, base: float = 1.0, draw: Callable[[], float] = random.random) -> float:
    return base * 2 ** (n - 1) + draw()


ONCE = Retry()
SERVICE = Retry(3, lambda e: getattr(e, "status", None) in RETRYABLE, delay)
SPENT_QUOTA = Retry(4, spent, quota_delay)


@dataclass(frozen=True)
class Step:
    """call(requests, attempt) gives an answer for each request, in order; an Exception in its place refuses that row alone."""

    name: str
    call: Callable[[list[dict], int], list]
    retry: Retry = ONCE
    size: int = 32

    def answers(self, asked: list[dict], attempt: int) -> list:
        out: list = []
        for at in range(0, len(asked), self.size):
            part = asked[at:at + self.size]
            try:
                got = self.call(part, attempt)
                if len(got) != len(part):
                    raise Refused(f"{len(got)} answers for {len(part)} requests")
            except Exception as e:
                got = [e] * len(part)
            out += got
        return out


def climb(asked: list[dict | None], steps: list[Step], capability: Capability, wait: Callable[[float], None] = time.sleep) -> list[dict]:
    """Each request's outcome: value, provider (null: none), rung reached (0: not asked), calls, error of the last call that failed.

    A row that a step refuses or answers unreadably goes to the next step; errors that may pass are tried again before that.
    """
    out = [{"value": None, "provider": None, "rung": 0, "calls": 0, "error": capability.missing if q is None else None} for q in asked]
    left = [i for i, q in enumerate(asked) if q is not None]
    for rung, step in enumerate(steps, 1):
        due, lost = left, []
        for attempt in range(1, step.retry.tries + 1):
            again = []
            for i, a in zip(due, step.answers([asked[i] for i in due], attempt)):
                o = out[i]
                o["rung"], o["calls"] = rung, o["calls"] + 1
                if isinstance(a, Exception):
                    o["error"] = str(a)
                    (again if attempt < step.retry.tries and step.retry.passes(a) else lost).append(i)
                elif (value := capability.parse(a)) is None:
                    o["error"] = UNREADABLE
                    lost.append(i)
                else:
                    o.update(value=value, provider=step.name, error=None)
            if not again:
                break
            wait(step.retry.delay(attempt))
            due = again
        left = sorted(lost)
        if not left:
            break
    return out


def _with(rows: DataFrame, out: str, kind: T.DataType, answers: Callable[[pa.RecordBatch], list], size: int) -> DataFrame:
    """rows as they are, and `out`, which `answers` gives for slices of `size` rows."""
    if out in rows.columns:
        raise ValueError(f"column {out} is there already")
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(answers(part), arrow)], names=[*part.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, kind)]))


def ladder(rows: DataFrame, capability: Capability, steps: list[Step], out: str = "answer", size: int = 256, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """rows with a struct `out` (value, provider, rung, calls, error; see `climb`).  Every row is kept, failed ones too, nulls are
    for `build` to judge, and other columns pass untouched.  `size` rows wait together; an empty table stays empty."""
    kind = T.StructType().add("value", T.StructType.fromDDL(capability.value)).add("provider", "string").add("rung", "integer").add("calls", "integer").add("error", "string")
    columns = list(capability.columns)
    return _with(rows, out, kind, lambda b: climb([capability.build(r) for r in b.select(columns).to_pylist()], steps, capability, wait), size)


def each(rows: DataFrame, work: Callable[[dict], dict], value: str, out: str = "result", columns: list[str] | None = None, parallel: int = 5) -> DataFrame:
    """rows with a struct `out` (value, error) from work(row): `parallel` rows at a time in a task, one row's error is its own."""
    kind = T.StructType().add("value", T.StructType.fromDDL(value)).add("error", "string")
    seen = rows.columns if columns is None else columns

    def one(row: dict) -> dict:
        try:
            return {"value": work(row), "error": None}
        except Exception as e:
            return {"value": None, "error": str(e) or type(e).__name__}

    def run(batch: pa.RecordBatch) -> list[dict]:
        with ThreadPoolExecutor(parallel) as pool:
            return list(pool.map(one, batch.select(seen).to_pylist()))

    return _with(rows, out, kind, run, parallel)
