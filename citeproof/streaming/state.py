"""Streams with state of their own: a window in which providers answer, and a cache that keeps the last write of a key.

Both need the state store that has timers: set spark.sql.streaming.stateStore.providerClass to STATE_STORE.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value: milliseconds in which candidates are collected.
WINDOW_MS = 1500
#: For so long answers that come after their window are told from first ones.
LATE_MS = 3_600_000

COLLECTED = "citation_key string, state string, providers string, answers string, missing string"


class _Collector(StatefulProcessor):
    """A citation's answers until all providers are in or the window ends."""

    def __init__(self, providers: list[str], window_ms: int):
        self.providers, self.window_ms = providers, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answers = handle.getMapState("answers", "provider string", "json string")
        self.closed = handle.getValueState("closed", "at bigint", ttlDurationMs=LATE_MS)

    def _gathered(self, key: tuple, state: str) -> pd.DataFrame:
        held = {k[0]: v[0] for k, v in self.answers.iterator()}
        order = [p for p in self.providers if p in held]
        lines = lambda xs: "\n".join(xs)
        row = (key[0], state, lines(order), lines(held[p] for p in order), lines(p for p in self.providers if p not in held))
        return pd.DataFrame([row], columns=["citation_key", "state", "providers", "answers", "missing"])

    def _close(self, key: tuple, state: str, now: int) -> pd.DataFrame:
        out = self._gathered(key, state)
        self.answers.clear()
        self.closed.update((now,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        late: list[tuple] = []
        for batch in rows:
            for provider, json in zip(batch["provider"], batch["json"], strict=True):
                if self.closed.exists():
                    late.append((key[0], "LATE", provider, json or "", ""))
                elif provider in self.providers and not self.answers.containsKey((provider,)):
                    if not self.answers.exists():
                        self.handle.registerTimer(now + self.window_ms)
                    self.answers.updateValue((provider,), (json or "",))
                    if sum(1 for _ in self.answers.keys()) == len(self.providers):
                        yield self._close(key, "COMPLETE", now)
        if late:
            yield pd.DataFrame(late, columns=["citation_key", "state", "providers", "answers", "missing"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.answers.exists():
            yield self._close(key, "WINDOW_CLOSED", timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def collect_answers(answers: DataFrame, providers: list[str], window_ms: int = WINDOW_MS) -> DataFrame:
    """A stream of answers (citation_key, provider, json: one line each) as one row per citation: COLLECTED.

    The first answer opens a citation's window. It closes when all providers are in (COMPLETE) or after window_ms of
    processing time (WINDOW_CLOSED), with the answers of `providers` in that order and the names of those missing; both
    are lists of lines. An answer that comes after that is a row of its own (LATE) for an hour, and opens a new window
    later. A provider's second answer in a window, and providers that aren't named, count nothing.
    """
    grouped = answers.select("citation_key", "provider", "json").where("citation_key is not null").groupBy("citation_key")
    return grouped.transformWithStateInPandas(_Collector(providers, window_ms), COLLECTED, "Append", "ProcessingTime")


CHANGES = "key string, op string, value string, expires_at bigint, seq bigint"


class _LastWrite(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, expires_at bigint, seq bigint")

    def _write(self, key: tuple, value: str | None, expires_at: int, seq: int) -> None:
        if self.entry.exists():
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.entry.update((value, expires_at, seq))
        # An entry that expires now is still read, so it goes a second later.
        self.handle.registerTimer((expires_at + 1) * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = max((r for batch in rows for r in batch[["seq", "expires_at", "value"]].itertuples(index=False)), key=lambda r: r.seq)
        value = None if pd.isna(last.value) else last.value
        if self.entry.exists() and self.entry.get()[2] > last.seq:
            return
        self._write(key, value, int(last.expires_at), int(last.seq))
        yield pd.DataFrame([(key[0], "SET", value, int(last.expires_at), int(last.seq))], columns=["key", "op", "value", "expires_at", "seq"])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            self._write(key, None if pd.isna(r.value) else r.value, int(r.expires_at), int(r.seq))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            value, expires_at, seq = self.entry.get()
            self.entry.clear()
            yield pd.DataFrame([(key[0], "PURGED", value, expires_at, seq)], columns=["key", "op", "value", "expires_at", "seq"])

    def close(self) -> None:
        pass


def last_writes(entries: DataFrame, time: str = "ts", delay: str = "0 seconds", initial: DataFrame | None = None) -> DataFrame:
    """A stream of cache writes (key, value, expires_at in epoch seconds, seq, time) as changes: CHANGES.

    The write with the highest seq holds (SET); when event time, less `delay`, has passed its expiry the entry's state is
    freed (PURGED). initial: the entries (key, value, expires_at, seq) of a cache table, one a key, that the stream starts
    from. What is set and not purged is cache.alive(cache.latest(...)) of all entries at that time.
    """
    given = entries.select("key", "value", "expires_at", "seq", time).where("key is not null").withWatermark(time, delay)
    start = initial.select("key", "value", "expires_at", "seq").groupBy("key") if initial is not None else None
    return given.groupBy("key").transformWithStateInPandas(_LastWrite(), CHANGES, "Update", "EventTime", start)
