"""The scraper's state of each source, and running step summaries, as structured streams.

State of a source: its feed's interval, when it was last checked, and failures in a row.  `last_checked` moves on full
success only; a failed check is due again after a wait that doubles; the fifth failure in a row is a dead letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Hours between checks by a source's frequency, tries before a dead letter, seconds of the first wait.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOURS = {1: 1, 2: 4, 3: 6, 4: 24}
TRIES, WAIT = 5, 30
FIRST = 5  # seconds before a new source's first check
CHECK = "source_id BIGINT, frequency INT, checked_at TIMESTAMP, ok BOOLEAN, error STRING"
RESULT = "source_id BIGINT, last_checked TIMESTAMP, failures INT, next_check TIMESTAMP, outcome STRING, error STRING"
STATE = "frequency INT, last_checked BIGINT, failures INT"


def tier(frequency: int | None) -> int:
    return frequency if frequency in HOURS else 2


def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A row for each check: what the source's state is afterwards.

    outcome: ok, retry or dead (the fifth failure in a row; counting starts anew).  A frequency that is none of the tiers
    counts as 2; one that is missing leaves the last one, or is 2 as well.  Checks are taken in order of their time; null
    times come first and count as time zero.
    """
    checks = pd.concat(list(frames)).sort_values(["checked_at", "ok"], na_position="first")
    frequency, last, failures = state.get if state.exists else (None, None, 0)
    out = []
    for r in checks.itertuples():
        at = 0 if pd.isna(r.checked_at) else int(r.checked_at.timestamp())
        given = None if pd.isna(r.frequency) else int(r.frequency)
        frequency = tier(given if given is not None else frequency)
        if r.ok is True or r.ok == True:  # noqa: E712  (numpy's or pandas' own)
            last, failures = at, 0
            out.append((key[0], last, 0, at + HOURS[frequency] * 3600, "ok", None))
            continue
        failures += 1
        error = r.error if isinstance(r.error, str) else None
        if failures >= TRIES:
            out.append((key[0], last, failures, at + HOURS[frequency] * 3600, "dead", error))
            failures = 0
        else:
            out.append((key[0], last, failures, at + WAIT * 2 ** (failures - 1), "retry", error))
    state.update((frequency, last, failures))
    rows = pd.DataFrame(out, columns=["source_id", "last_checked", "failures", "next_check", "outcome", "error"])
    for name in ("last_checked", "next_check"):
        rows[name] = pd.to_datetime(rows[name].astype("Int64"), unit="s")
    yield rows


def states(checks: DataFrame) -> DataFrame:
    """checks: a stream of CHECK rows; RESULT rows, one for each check."""
    return checks.groupBy("source_id").applyInPandasWithState(follow, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)


class Due(StatefulProcessor):
    """A timer for each source: due `FIRST` seconds after it is registered, then by its tier; the next one is set before the check is handed on."""

    def __init__(self, hour_ms: int = 3_600_000, first_ms: int = FIRST * 1000):
        self.hour_ms, self.first_ms = hour_ms, first_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tier = handle.getValueState("tier", "frequency int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, given = not self.tier.exists(), None
        for f in rows:
            given = f["frequency"].iloc[-1] if len(f) else given
        self.tier.update((tier(None if given is None or pd.isna(given) else int(given)),))
        if new:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.first_ms)
        yield pd.DataFrame({"source_id": [], "due_ms": [], "next_ms": []}, dtype="int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        frequency = int(self.tier.get()[0])
        due = expiredTimerInfo.getExpiryTimeInMs()
        after = max(due, timerValues.getCurrentProcessingTimeInMs()) + HOURS[frequency] * self.hour_ms
        self.handle.registerTimer(after)
        yield pd.DataFrame({"source_id": [key[0]], "due_ms": [due], "next_ms": [after]})

    def close(self) -> None:
        pass


def due_checks(sources: DataFrame, **how) -> DataFrame:
    """sources: a stream of (source_id bigint, frequency int), one row to register a source or change its tier; a row whenever a check is due.

    Timers outlive a restart; the clock runs on with the first batch that has a row (a registration, or a heartbeat).
    """
    sources.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return sources.groupBy("source_id").transformWithStateInPandas(Due(**how), "source_id bigint, due_ms bigint, next_ms bigint", "Append", "ProcessingTime")


def step_summary(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Workflow events (step_name, status, duration, ts) to summaries of each step and window; events later than `late` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "step_name").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.avg("duration").alias("avg_duration"), F.max("duration").alias("max_duration")).select(F.col("w.start").alias("began"), "step_name", "events", "completed", "failed", "avg_duration", "max_duration")


def uninitialised_batches(sources: DataFrame, size: int = 100) -> DataFrame:
    """Sources that are not initialised yet, dealt into chunks of at most `size` in order of their ids."""
    from tidewire.operators.tables import batches

    return batches(sources.where(F.col("do_initialized_at").isNull()).select("id"), "id", size)
