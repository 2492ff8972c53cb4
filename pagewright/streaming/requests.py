"""Streams of requests: host rates, circuit breakers, windows.

State lives per key in Spark's state store. Times are the events' own, never the clock. The batch forms of the same
rules are in ``operators.requests`` and below, so a stream's result can be held against them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SLOT = "host string, index long, t double, slot double"
BREAKER = "host string, index long, t double, ok boolean, admitted boolean, failures int, open_until double"


def tumbling(events: DataFrame, key: str, width: str = "1 day", delay: str = "1 day", at: str = "ts") -> DataFrame:
    windows = events.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), key)
    return windows.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 day", at: str = "ts") -> DataFrame:
    windows = events.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), key)
    return windows.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def host_slots(requests: DataFrame, interval: float) -> DataFrame:
    """When each request (host, index, t) of a stream may start, at least ``interval`` after the one before."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (free,) = state.get if state.exists else (float("-inf"),)
        for part in parts:
            part = part.sort_values(["t", "index"], kind="stable")
            slots = []
            for t in part["t"]:
                slots.append(max(t, free))
                free = slots[-1] + interval
            yield part.assign(slot=slots)[["host", "index", "t", "slot"]]
        state.update((free,))

    return requests.select("host", "index", "t").groupBy("host").applyInPandasWithState(run, SLOT, "free double", "append", GroupStateTimeout.NoTimeout)


class Breaker:
    """Failures of a host, halved with every ``half_life`` seconds; at ``most`` it opens for ``pause`` seconds.

    When it opens the count falls to the upper half; a success clears it.
    """

    def __init__(self, most: int, pause: float, half_life: float, failures: int = 0, last: float = 0.0, until: float = float("-inf")) -> None:
        self.most, self.pause, self.half_life = most, pause, half_life
        self.failures, self.last, self.until = failures, last, until

    def see(self, t: float, ok: bool) -> bool:
        """Whether a request at ``t`` is admitted; one that is counts with its outcome."""
        if t < self.until:
            return False
        if self.failures and self.half_life > 0:
            self.failures >>= min(31, int((t - self.last) / self.half_life))
        self.last = t
        self.failures = 0 if ok else self.failures + 1
        if self.failures >= self.most:
            self.until, self.failures = t + self.pause, (self.failures + 1) // 2
        return True


def _run_breaker(part: pd.DataFrame, breaker: Breaker) -> pd.DataFrame:
    part = part.sort_values(["t", "index"], kind="stable")
    rows = [(breaker.see(t, ok), breaker.failures, breaker.until) for t, ok in zip(part["t"], part["ok"], strict=True)]
    admitted, failures, until = zip(*rows, strict=True) if rows else ((), (), ())
    out = part.assign(admitted=list(admitted), failures=list(failures), open_until=list(until))
    return out[["host", "index", "t", "ok", "admitted", "failures", "open_until"]]


def breaker_stream(outcomes: DataFrame, most: int = 3, pause: float = 60.0, half_life: float = 600.0) -> DataFrame:
    """Outcomes (host, index, t, ok) of a stream with whether the host's breaker admitted them."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        breaker = Breaker(most, pause, half_life, *(state.get if state.exists else ()))
        for part in parts:
            yield _run_breaker(part, breaker)
        state.update((breaker.failures, breaker.last, breaker.until))

    rows = outcomes.select("host", "index", "t", "ok")
    return rows.groupBy("host").applyInPandasWithState(run, BREAKER, "failures int, last double, until double", "append", GroupStateTimeout.NoTimeout)


def breaker_batch(outcomes: DataFrame, most: int = 3, pause: float = 60.0, half_life: float = 600.0) -> DataFrame:
    """The same over a whole table. A host's requests follow each other in one task, which holds a batch of them.

    From batch to batch a task carries the few numbers of the host that it is at.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, breaker = None, Breaker(most, pause, half_life)
        for part in parts:
            for name, own in part.groupby("host", sort=False, dropna=False):
                name = None if pd.isna(name) else name
                if name != host:
                    host, breaker = name, Breaker(most, pause, half_life)
                yield _run_breaker(own, breaker)

    rows = outcomes.select("host", "index", "t", "ok").repartition("host").sortWithinPartitions("host", "t", "index")
    return rows.mapInPandas(run, BREAKER)
