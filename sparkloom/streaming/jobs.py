"""Structured Streaming jobs, each with a batch twin that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sparkloom.operators.ranks import ranked
from sparkloom.sources import io
from sparkloom.sources.tables import KeyedTable

# Fixed values of the circuit: failures in a row, share of the last results, their number, cooldowns.
IN_A_ROW, SHARE, RECENT, COOLDOWNS = 10, 0.5, 20, (300, 900, 1800)
#: Routes with cooldowns of their own.
ROUTE_COOLDOWNS = {"youtube:ytdlp": (43_200, 86_400, 172_800)}
TRANSITIONS = "route string, event_id long, ts timestamp, event_type string, previous_state string, new_state string, cooldown_until timestamp"


def ingest_once(stream: DataFrame, keys: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """Later rows with a key seen within the watermark are no-ops; state stays bounded."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def ingest_forever(path: str, keys: list[str], order: list[str] | tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends only keys that the table at ``path`` never had, of a batch the first by ``order``."""
    return lambda batch, _epoch: io.append_new(batch, path, keys, order)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which timers need; the session's own choice comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there now into a foreachBatch sink, and stop."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def coverage(signals: DataFrame) -> DataFrame:
    """Best confidence per cell, the same in any order of arrival; batch or stream (update mode)."""
    return signals.groupBy("niche_id", "signal_type", "tier").agg(F.max("confidence").alias("best_confidence"), F.count("*").alias("n"))


class CoverageSink:
    """A foreachBatch sink of signals (niche_id, signal_type, tier, signal_id, confidence): the coverage grid, kept up.

    A cell's best confidence is an upsert that the greatest wins; ids go into a long
    table, once each, if they reach the best of their batch. So any order of arrival,
    and a batch that comes again, gives the same grid, and no row holds a cell's ids.
    """

    CELL = ("niche_id", "signal_type", "tier")

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 16) -> None:
        cell = ", ".join(f"{c} string" for c in self.CELL)
        self.best = KeyedTable(spark, f"{path}/best", f"{cell}, confidence double", self.CELL, 16)
        self.ids = KeyedTable(spark, f"{path}/ids", f"{cell}, signal_id string, confidence double", [*self.CELL, "signal_id", "confidence"], 64)
        self.compact_every = compact_every

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        rows = batch.persist()
        try:
            top = rows.groupBy(*self.CELL).agg(F.max("confidence").alias("confidence")).filter("confidence IS NOT NULL")
            self.ids.insert(rows.join(top, [*self.CELL, "confidence"], "left_semi"))
            self.best.upsert(top)
        finally:
            rows.unpersist()
        if epoch % self.compact_every == self.compact_every - 1:
            self.best.compact(["confidence"])

    def members(self) -> DataFrame:
        """The grid in long form: a row per cell and id that reaches the best confidence."""
        return self.ids.read().join(self.best.latest(["confidence"]), [*self.CELL, "confidence"], "left_semi").select(*self.CELL, "signal_id", "confidence")

    def grid(self) -> DataFrame:
        """Per cell the best confidence and the sorted ids that reach it, for cells of few ids."""
        return self.members().groupBy(*self.CELL).agg(F.max("confidence").alias("best_confidence"), F.array_sort(F.collect_set("signal_id")).alias("signal_ids"))


def route(valid_path: str, invalid_path: str, ok: Column) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: good rows to one table, others to another, of one computed batch."""

    def write(batch: DataFrame, _epoch: int) -> None:
        marked = batch.withColumn("_ok", F.coalesce(ok, F.lit(False))).persist()
        try:
            marked.filter("_ok").drop("_ok").write.mode("append").parquet(valid_path)
            marked.filter("NOT _ok").drop("_ok").write.mode("append").parquet(invalid_path)
        finally:
            marked.unpersist()

    return write


class Circuit:
    """A route's circuit: closed, open until a cooldown ends, then half open for one probe.

    As specified, the first open takes the second cooldown step, and a failed
    probe opens the circuit again only if the thresholds still hold, unless
    ``reopen``.
    """

    def __init__(self, state: tuple | None = None, reopen: bool = False, cooldowns: tuple[int, ...] = COOLDOWNS) -> None:
        self.state, self.row, self.opens, self.until, self.recent = state or ("closed", 0, 0, 0, "")
        self.reopen, self.cooldowns = reopen, cooldowns

    def dump(self) -> tuple:
        return self.state, self.row, self.opens, self.until, self.recent

    def record(self, at: int, ok: bool) -> list[tuple[str, str, str, int | None]]:
        """(event, previous, new, cooldown end) of one result at microsecond ``at``."""
        out: list[tuple[str, str, str, int | None]] = []
        if self.state == "open" and at >= self.until:
            self.state = "half_open"
            out.append(("probe_allowed", "open", "half_open", None))
        self.recent = (self.recent + ("1" if ok else "0"))[-RECENT:]
        if ok:
            if self.state == "half_open":
                self.state, self.row, self.opens, self.until = "closed", 0, 0, 0
                out.append(("circuit_close", "half_open", "closed", None))
            elif self.state == "closed":
                self.row = 0
            return out
        if self.state == "open":
            return out
        probe = self.state == "half_open"
        self.row += 1
        over = len(self.recent) >= RECENT and self.recent.count("0") / len(self.recent) > SHARE
        if self.row >= IN_A_ROW or over or (probe and self.reopen):
            before, self.state = self.state, "open"
            self.opens += 1
            self.until = at + 1_000_000 * self.cooldowns[min(self.opens, len(self.cooldowns) - 1)]
            out.append(("circuit_open", before, "open", self.until))
        return out


def _transitions(route: str, rows: list[tuple[int, pd.Timestamp, bool]], circuit: Circuit) -> pd.DataFrame:
    found = []
    for event_id, ts, ok in rows:
        for event, before, after, until in circuit.record(int(ts.value // 1000), ok):
            found.append((route, event_id, ts, event, before, after, None if until is None else pd.Timestamp(until, unit="us")))
    out = pd.DataFrame(found, columns=[x.split()[0] for x in TRANSITIONS.split(", ")])
    return out.astype({"ts": "datetime64[us]", "cooldown_until": "datetime64[us]"})


def circuit_batch(log: DataFrame, reopen: bool = False, cooldowns: Mapping[str, tuple[int, ...]] = ROUTE_COOLDOWNS) -> DataFrame:
    """Transitions of (route, event_id, ts, ok), per route in time order; ``cooldowns`` are those of routes with their own.

    Routes run in parallel; a route's log streams through its task in batches of
    sorted rows. A circuit's next state hangs on all results before it (when a
    cooldown ends depends on when it began), so a route can't be cut into parts
    that run at once: a hot route needs a task's time, though not its memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, circuit = None, Circuit()
        for b in batches:
            for name, one in b.groupby("route", sort=False):
                if name != now:
                    now, circuit = name, Circuit(reopen=reopen, cooldowns=cooldowns.get(name, COOLDOWNS))
                yield _transitions(name, list(zip(one["event_id"].tolist(), one["ts"], one["ok"].tolist(), strict=True)), circuit)

    dealt = log.select(F.col("route").cast("string").alias("route"), "event_id", "ts", "ok").repartition("route").sortWithinPartitions("route", "ts", "event_id")
    return dealt.mapInPandas(run, TRANSITIONS)


def degradations(transitions: DataFrame) -> DataFrame:
    """The openings and closings among transitions, as rows with ids of their own."""
    t = transitions.filter(F.col("event_type").isin("circuit_open", "circuit_close"))
    return t.select("route", "event_type", "ts", "cooldown_until", F.concat_ws(":", F.lit("deg"), "route", F.col("event_id").cast("string")).alias("degradation_id"))


class ExpiryProcessor(StatefulProcessor):
    """Emits signals once the watermark passes their expiry: a timer for the next expiry of a group of signals.

    A batch's signals are appended to the state as one text, and a timer that fires hands out all that is due,
    so calls to the state go by groups and batches, not by expiries.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("waiting", StructType([StructField("signals", StringType())]))
        self.next = handle.getValueState("next", StructType([StructField("at", LongType())]))

    def _wait(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.next.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        low = None
        for pdf in rows:
            if not len(pdf):
                continue
            ms = pdf["expires_at"].astype("datetime64[ms]").astype("int64")
            self.kept.appendValue((json.dumps([ms.tolist(), pdf["signal_id"].tolist()]),))
            low = int(ms.min()) if low is None else min(low, int(ms.min()))
        if low is not None:
            waiting = self.next.get() if self.next.exists() else None
            if waiting is None or low < waiting[0]:
                if waiting is not None:
                    self.handle.deleteTimer(waiting[0])
                self._wait(low)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        parts = [json.loads(text) for (text,) in self.kept.get()]
        held = pd.DataFrame({"at": pd.Series([x for at, _ in parts for x in at], dtype="int64"), "signal_id": pd.Series([x for _, ids in parts for x in ids], dtype=object)}).drop_duplicates()
        due = held["at"] <= now
        rest = held[~due]
        self.kept.clear()
        self.next.clear()
        if len(rest):
            self.kept.appendValue((json.dumps([rest["at"].tolist(), rest["signal_id"].tolist()]),))
            self._wait(int(rest["at"].min()))
        if due.any():
            yield pd.DataFrame({"signal_id": held.loc[due, "signal_id"], "expired_at": pd.to_datetime(held.loc[due, "at"], unit="ms")})

    def close(self) -> None:
        pass


def expiry_stream(signals: DataFrame, late: str = "1 minute") -> DataFrame:
    """(signal_id, expired_at) of signals (signal_id, observed_at, expires_at) as event time passes their expiry.

    State is kept per hour of expiry, in a few thousand groups however many signals
    there are; a signal that comes again with the same expiry is one. Times have milliseconds.
    Signals without an expiry never expire.
    """
    s = signals.withWatermark("observed_at", late).filter("expires_at IS NOT NULL").select("signal_id", "observed_at", "expires_at", F.date_trunc("hour", "expires_at").cast("string").alias("hour"))
    return s.groupBy("hour").transformWithStateInPandas(ExpiryProcessor(), outputStructType="signal_id string, expired_at timestamp", outputMode="Append", timeMode="EventTime")


def backpressure(levels: DataFrame, high: int, low: int) -> DataFrame:
    """Add ``paused`` to (phase, ts, seq, backlog): paused from ``high`` on until ``low`` or less.

    Time is cut into days: a day's last mark is a small total, and only the marks
    pass from day to day, so no task holds a phase's whole history.
    """
    mark = F.when(F.col("backlog") >= high, True).when(F.col("backlog") <= low, False)
    l = levels.withColumns({"_mark": mark, "_day": F.to_date("ts")})
    ends = l.groupBy("phase", "_day").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.struct("ts", "seq"))).alias("_last"))
    carried = ends.select("phase", "_day", F.last("_last", ignorenulls=True).over(Window.partitionBy("phase").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    within = F.last("_mark", ignorenulls=True).over(Window.partitionBy("phase", "_day").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return l.withColumn("_now", within).join(carried, ["phase", "_day"]).withColumn("paused", F.coalesce("_now", "_carry", F.lit(False))).drop("_mark", "_day", "_now", "_carry")


def rate_gaps(requests: DataFrame, least_seconds: float, daily: int) -> DataFrame:
    """Add gap_seconds to the request before on the route, too_soon, nth of the day and over_cap."""
    r = ranked(requests.withColumn("_day", F.to_date("ts")), ["route"], ["ts", "event_id"], "_at", {"_ts": "ts"})
    r = r.withColumn("gap_seconds", (F.unix_micros("ts") - F.unix_micros("_ts")) / 1e6).drop("_at", "_ts")
    r = ranked(r, ["route", "_day"], ["ts", "event_id"], "nth").drop("_day")
    return r.withColumns({"too_soon": F.coalesce(F.col("gap_seconds") < least_seconds, F.lit(False)), "over_cap": F.col("nth") > daily})
