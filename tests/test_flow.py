"""Sources, sinks and streams: a stream gives what its batch twin gives."""

from __future__ import annotations

import datetime as dt
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import coverage
from sparkloom.sources import io
from sparkloom.streaming import jobs, ordered

T0 = dt.datetime(2026, 1, 1)


def test_csv_keeps_text_and_unknowns(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "q", b', None), ("2", "x\ny", "0")], "a string, b string, c string")
    io.write_csv(df, f"{tmp_path}/t", ["b", "a", "missing", "c"])
    assert sorted(map(tuple, io.read_csv(spark, f"{tmp_path}/t", ["b", "a", "missing", "c"]).collect())) == [('a "q", b', "1", None, None), ("x\ny", "2", None, "0")]


def test_append_checked_refuses_unknown_columns(spark, tmp_path):
    spark.range(2).withColumn("x", F.lit("a")).write.parquet(f"{tmp_path}/t")
    io.append_checked(spark.range(1), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    with pytest.raises(ValueError, match="unknown columns: y"):
        io.append_checked(spark.range(1).withColumn("y", F.lit(1)), f"{tmp_path}/t")


def test_corrupt_json_keeps_its_text(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}')
    (tmp_path / "b.json").write_text("{broken")
    got = io.read_json(spark, str(tmp_path), "k int").collect()
    assert sorted((r.k or 0, r._corrupt is None) for r in got) == [(0, False), (1, True)]


def test_artifacts_and_edges_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("a1", "sha256:ab1", "v1", "page", "p", ["x"]), ("a2", "sha256:ab1", "v1", "page", "p", ["x"]), ("a3", "sha256:cd1", "v1", "page", None, ["x"]), ("a4", "sha256:ee1", "v1", "page", "p", [])], "artifact_id string, content_hash string, schema_version string, artifact_kind string, provenance string, derived_from array<string>")
    table = io.artifact_table(spark, f"{tmp_path}/a", "string")
    for _ in range(2):
        bad = io.append_artifacts(df, table)
        assert {(r.artifact_id, tuple(r.violations)) for r in bad.collect()} == {("a3", ("provenance",)), ("a4", ("derived_from",))}
    assert [r.artifact_id for r in table.read().collect()] == ["a1"]
    e = spark.createDataFrame([("a", "1", "b", "2")] * 2, "child_kind string, child_id string, parent_kind string, parent_id string")
    edges = io.edge_table(spark, f"{tmp_path}/e")
    assert [[r.inserted for r in io.append_edges(e, edges).collect()] for _ in range(2)] == [[True], [False]]
    assert edges.read().count() == 1


def test_manifest_of_files(spark, tmp_path):
    (tmp_path / "my_file-name.txt").write_bytes(b"hello")
    r = io.manifest(spark.read.format("binaryFile").load(str(tmp_path))).collect()[0]
    assert (r.type, r.title, r.checksum) == ("txt", "My File Name", "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824")


def log(n=120):
    """Route a fails, then recovers; route b is mixed."""
    rows = [("a", i, T0 + dt.timedelta(seconds=60 * i), not 5 <= i < 17) for i in range(60)]
    return rows + [("b", 1000 + i, T0 + dt.timedelta(seconds=90 * i), i % 3 == 0) for i in range(n)]


SCHEMA = "route string, event_id long, ts timestamp, ok boolean"


def run_stream(spark, tmp_path, rows, schema, job, mode="append", parts=3, key=lambda r: r):
    rows = sorted(rows, key=key)
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = job(stream).writeStream.outputMode(mode).format("memory").queryName("out_" + tmp_path.name.replace("-", "_")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("out_" + tmp_path.name.replace("-", "_"))


def test_circuit_opens_cools_down_and_closes(spark):
    got = [(r.event_id, r.event_type, r.new_state) for r in jobs.circuit_batch(spark.createDataFrame(log(), SCHEMA)).filter("route = 'a'").orderBy("ts").collect()]
    # Ten failures in a row open it at event 14; the first wait is the second step, 900 seconds.
    assert got == [(14, "circuit_open", "open"), (29, "probe_allowed", "half_open"), (29, "circuit_close", "closed")]


def test_failed_probe_reopens_only_on_request():
    kept = jobs.Circuit(("half_open", 0, 1, 0, "1"))
    assert kept.record(1, False) == [] and kept.state == "half_open"
    assert jobs.Circuit(("half_open", 0, 1, 0, "1"), reopen=True).record(1, False)[0][0] == "circuit_open"


def mixed(spark, tmp_path, rows, schema, job, files, late, at):
    """A stream whose files hold all times within ``late`` of each other in no order."""
    r = random.Random(4)
    rows = sorted(rows, key=lambda x: x[at] + dt.timedelta(seconds=r.randint(0, late)))
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        r.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = []
    job(stream).writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    return out


def test_circuit_stream_equals_batch_in_mixed_order(spark, tmp_path):
    rows = log()
    end = max(r[2] for r in rows) - dt.timedelta(seconds=1200)
    batch = jobs.circuit_batch(spark.createDataFrame(rows, SCHEMA)).collect()
    out = mixed(spark, tmp_path, rows, SCHEMA, lambda s: ordered.circuit_stream(s, "1200 seconds"), 5, 1200, 2)
    assert sorted(out, key=str) == sorted((tuple(r) for r in batch if r.ts <= end), key=str) and out


def test_backpressure_stream_equals_batch_in_mixed_order(spark, tmp_path):
    r = random.Random(8)
    rows = [(f"p{i % 3}", T0 + dt.timedelta(seconds=37 * (i // 2)), i, float(r.choice([1, 2, 5, 10, 15, 25, 30]))) for i in range(400)]
    schema = "phase string, ts timestamp, seq long, backlog double"
    end = max(x[1] for x in rows) - dt.timedelta(seconds=900)
    batch = {(x.phase, x.ts, x.seq, x.backlog, x.paused) for x in jobs.backpressure(spark.createDataFrame(rows, schema), 20, 3).collect() if x.ts <= end}
    out = mixed(spark, tmp_path, rows, schema, lambda s: ordered.backpressure_stream(s, "900 seconds", 20, 3), 6, 900, 1)
    assert set(out) == batch and len(out) == len(batch) > 300


def test_coverage_sink_gives_the_grid_in_any_order_and_when_batches_repeat(spark, tmp_path):
    rows = [(f"n{i % 3}", "demand", "open", f"s{i:02d}", (i * 37 % 20) / 20) for i in range(60)] + [("n9", "pain", "open", "x", None)]
    df = spark.createDataFrame(rows, "niche_id string, signal_type string, tier string, signal_id string, confidence double")
    want = sorted((r.niche_id, r.best_confidence, tuple(r.signal_ids)) for r in coverage.grid(df.filter("confidence IS NOT NULL")).collect())
    sink = jobs.CoverageSink(spark, f"{tmp_path}/g", compact_every=3)
    for epoch, k in enumerate((2, 0, 2, 1, 3)):
        sink(df.filter(F.pmod(F.xxhash64("signal_id"), F.lit(4)) == k), epoch)
    assert sorted((r.niche_id, r.best_confidence, tuple(r.signal_ids)) for r in sink.grid().collect()) == want


def test_coverage_stream_equals_batch_in_any_order(spark, tmp_path):
    rows = [(f"n{i % 3}", "demand", "open", (i * 37 % 100) / 100) for i in range(60)]
    schema = "niche_id string, signal_type string, tier string, confidence double"
    out = run_stream(spark, tmp_path, rows, schema, jobs.coverage, mode="complete", key=lambda r: r[3])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, jobs.coverage(spark.createDataFrame(rows, schema)).collect()))


def test_expiry_timer_fires_once_the_time_has_passed(spark, tmp_path):
    rows = [("s1", T0, T0 + dt.timedelta(hours=1)), ("s2", T0, T0 + dt.timedelta(days=9)), ("s3", T0 + dt.timedelta(hours=5), T0 + dt.timedelta(days=9)), ("s4", T0 + dt.timedelta(hours=6), T0 + dt.timedelta(days=9))]
    out = run_stream(spark, tmp_path, rows, "signal_id string, observed_at timestamp, expires_at timestamp", jobs.expiry_stream, parts=4, key=lambda r: r[1])
    assert [r.signal_id for r in out.collect()] == ["s1"]


class CountedState:
    """A state handle of one key in memory, which counts the calls made to it."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, set(), {}

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return None

        return call

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def _state(self, name, *_):
        handle, held = self, {}

        class State:
            def __getattr__(self, call):
                handle.calls += 1
                return {
                    "exists": lambda: bool(held), "clear": held.clear, "containsKey": lambda k: k in held, "getValue": lambda k: held[k], "removeKey": held.pop,
                    "updateValue": held.__setitem__, "update": lambda v: held.__setitem__(0, v), "appendValue": lambda v: held.__setitem__(len(held), v),
                    "get": lambda: held.get(0) if name == "next" else iter(list(held.values())),
                }[call]

        return State()

    getMapState = getListState = getValueState = _state


def test_expiry_calls_the_state_by_batches_not_by_expiries():
    handle, p, now = CountedState(), jobs.ExpiryProcessor(), dt.datetime(2026, 1, 1, 12)
    p.init(handle)
    ms = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    sent = [(f"s{i}\n{i}", now + dt.timedelta(seconds=i)) for i in range(500)]
    for part in (sent[250:], sent[:300]):  # fifty come twice, and the earlier ones later
        assert list(p.handleInputRows(None, iter([pd.DataFrame(part, columns=["signal_id", "expires_at"])]), None)) == []
    got = []
    for seconds in (99, 2000):
        mark = ms(now + dt.timedelta(seconds=seconds))
        while due := sorted(t for t in handle.timers if t <= mark):
            times = SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: m)
            got += [(r.signal_id, r.expired_at.to_pydatetime()) for out in p.handleExpiredTimer(None, times, SimpleNamespace(getExpiryTimeInMs=lambda d=due: d[0])) for r in out.itertuples()]
            handle.timers.discard(due[0])
        assert sorted(got) == sorted(sent[: min(seconds + 1, 500)])
    assert handle.calls < 40


def test_ingest_once_drops_later_copies(spark, tmp_path):
    rows = [(i % 5, T0 + dt.timedelta(seconds=i), i) for i in range(20)]
    out = run_stream(spark, tmp_path, rows, "k int, ts timestamp, v int", lambda s: jobs.ingest_once(s, ["k"], "ts"), key=lambda r: r[1])
    assert sorted(r.k for r in out.collect()) == [0, 1, 2, 3, 4]


def test_ingest_forever_and_route_sinks(spark, tmp_path):
    rows = [(i % 5, i) for i in range(20)]
    for k in range(2):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "k int, v int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, v int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, sink in (("a", jobs.ingest_forever(f"{tmp_path}/once", ["k"])), ("b", jobs.route(f"{tmp_path}/good", f"{tmp_path}/bad", F.col("v") < 4))):
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp{name}").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/once").count() == 5
    assert spark.read.parquet(f"{tmp_path}/good").count() == 4 and spark.read.parquet(f"{tmp_path}/bad").count() == 16


def test_backpressure_carries_over_days(spark):
    rows = [("p", T0, 1, 30.0), ("p", T0 + dt.timedelta(days=2), 2, 10.0), ("p", T0 + dt.timedelta(days=3), 3, 1.0), ("p", T0 + dt.timedelta(days=3, hours=1), 4, 10.0), ("q", T0, 5, 10.0)]
    got = {r.seq: r.paused for r in jobs.backpressure(spark.createDataFrame(rows, "phase string, ts timestamp, seq int, backlog double"), 20, 3).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_waiting_events_are_replayed_an_hour_at_a_time():
    import json
    from types import SimpleNamespace

    class Cell:
        def __init__(self):
            self.v = None

        exists, get, clear = (lambda self: self.v is not None), (lambda self: self.v), (lambda self: setattr(self, "v", None))

        def update(self, v):
            self.v = v

    class Cells(dict):
        getValue, containsKey, removeKey, updateValue = dict.__getitem__, dict.__contains__, dict.pop, dict.__setitem__

    class Seen(ordered.Ordered):
        def replay(self, key, events, state):
            return [(key, events)], (state or "") + str(len(events))

    p = Seen()
    p.waiting, p.due, p.kept, p.handle = Cells(), Cell(), Cell(), SimpleNamespace(registerTimer=lambda at: None, deleteTimer=lambda at: None)
    at = [(h * ordered.HOUR + k, k, 1.0) for h in (2, 0, 1) for k in (3, 1)]
    for h in (2, 0, 1):
        p.waiting[(h,)] = (json.dumps([e for e in at if e[0] // ordered.HOUR == h]),)
    mark = SimpleNamespace(getCurrentWatermarkInMs=lambda: 2 * ordered.HOUR // 1000)
    out = [e for chunk in p.handleExpiredTimer(("r",), mark, None) for _, e in chunk]
    assert out == [sorted(e for e in at if e[0] // ordered.HOUR == h) for h in (0, 1)] and p.kept.v == ("22",)
    assert list(p.waiting) == [(2,)] and p.due.v == ((2 * ordered.HOUR + 1) // 1000,)
