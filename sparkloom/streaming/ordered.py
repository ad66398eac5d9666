"""Keyed streams whose next state hangs on the order of events, whatever order they arrive in.

A key's events wait in its state until the watermark has passed them; then they are
replayed by time, ties by number. So micro-batches may hold any mix of times, as far
as the watermark's delay reaches; what comes later than that is dropped, as in any
stream with a watermark. State holds the events of the delay and what the replay keeps.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .jobs import COOLDOWNS, ROUTE_COOLDOWNS, TRANSITIONS, Circuit, _transitions

HOUR = 3_600_000_000
Event = tuple[int, int, float]  # microseconds, number, value


class Ordered(StatefulProcessor):
    """Buffers (ts, seq, value) per key by the hour; ``replay`` gets them in order, and its state as text."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", StructType([StructField("hour", LongType())]), StructType([StructField("events", StringType())]))
        self.due = handle.getValueState("due", StructType([StructField("at", LongType())]))
        self.kept = handle.getValueState("kept", StructType([StructField("text", StringType())]))

    def replay(self, key: str, events: list[Event], state: str | None) -> tuple[pd.DataFrame, str]:
        raise TypeError("a subclass says what happens")

    def _call_at(self, us: int) -> None:
        """One timer a key, at its earliest waiting event."""
        at = us // 1000
        if self.due.exists():
            old = self.due.get()[0]
            if old <= at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[Event]] = {}
        for b in rows:
            us = b["ts"].astype("datetime64[us]").astype("int64")
            for e in zip(us.tolist(), b["seq"].tolist(), b["value"].tolist(), strict=True):
                new.setdefault(e[0] // HOUR, []).append(e)
        for hour, events in new.items():
            old = json.loads(self.waiting.getValue((hour,))[0]) if self.waiting.containsKey((hour,)) else []
            self.waiting.updateValue((hour,), (json.dumps(old + events),))
        if new:
            self._call_at(min(e[0] for events in new.values() for e in events))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000  # all before it has come
        self.due.clear()
        state, later = self.kept.get()[0] if self.kept.exists() else None, None
        for (hour,) in sorted(tuple(k) for k in self.waiting.keys()):  # an hour at a time is in memory
            events = [tuple(e) for e in json.loads(self.waiting.getValue((hour,))[0])]
            if hour * HOUR > mark:
                later = later or events
                break
            ready, rest = sorted(e for e in events if e[0] <= mark), [e for e in events if e[0] > mark]
            if rest:
                self.waiting.updateValue((hour,), (json.dumps(rest),))
                later = rest
            else:
                self.waiting.removeKey((hour,))
            if ready:
                out, state = self.replay(key[0], ready, state)
                if len(out):
                    yield out
        if later:
            self._call_at(min(e[0] for e in later))
        if state is not None:
            self.kept.update((state,))

    def close(self) -> None:
        pass


class CircuitProcessor(Ordered):
    """A route's circuit; the value is 1 for a success."""

    def __init__(self, cooldowns: Mapping[str, tuple[int, ...]] = ROUTE_COOLDOWNS, reopen: bool = False) -> None:
        self.cooldowns, self.reopen = dict(cooldowns), reopen

    def replay(self, key, events, state):
        circuit = Circuit(tuple(json.loads(state)) if state else None, self.reopen, self.cooldowns.get(key, COOLDOWNS))
        out = _transitions(key, [(seq, pd.Timestamp(us, unit="us"), value == 1) for us, seq, value in events], circuit)
        return out, json.dumps(circuit.dump())


class BackpressureProcessor(Ordered):
    """Paused from ``high`` on until ``low`` or less."""

    def __init__(self, high: float, low: float) -> None:
        self.high, self.low = high, low

    def replay(self, key, events, state):
        paused, marks = state == "1", []
        for _, _, value in events:
            paused = value >= self.high or (paused and value > self.low)
            marks.append(paused)
        us = pd.to_datetime([e[0] for e in events], unit="us").astype("datetime64[us]")
        return pd.DataFrame({"phase": key, "ts": us, "seq": [e[1] for e in events], "backlog": [e[2] for e in events], "paused": marks}), "1" if paused else "0"


def _run(events: DataFrame, late: str, processor: Ordered, schema: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def circuit_stream(log: DataFrame, late: str, cooldowns: Mapping[str, tuple[int, ...]] = ROUTE_COOLDOWNS, reopen: bool = False) -> DataFrame:
    """Transitions of a stream (route, event_id, ts, ok) as its watermark passes: those of ``jobs.circuit_batch`` up to there."""
    rows = log.select(F.col("route").cast("string").alias("key"), "ts", F.col("event_id").cast("long").alias("seq"), F.col("ok").cast("double").alias("value"))
    return _run(rows, late, CircuitProcessor(cooldowns, reopen), TRANSITIONS)


def backpressure_stream(levels: DataFrame, late: str, high: float, low: float) -> DataFrame:
    """(phase, ts, seq, backlog, paused) of a stream of levels as its watermark passes: that of ``jobs.backpressure`` up to there."""
    rows = levels.select(F.col("phase").cast("string").alias("key"), "ts", F.col("seq").cast("long").alias("seq"), F.col("backlog").cast("double").alias("value"))
    return _run(rows, late, BackpressureProcessor(high, low), "phase string, ts timestamp, seq long, backlog double, paused boolean")
