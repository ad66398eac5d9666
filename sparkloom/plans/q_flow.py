"""Queries on sources, sinks and streaming jobs. Readers, writers and streams work in new folders of the shared place."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.sources import io
from sparkloom.sources.shared import cut, new_folder
from sparkloom.sources.tables import KeyedTable
from sparkloom.streaming import jobs as J
from sparkloom.streaming import ordered as O

from . import bindings as B
from .catalog import register


@register("src_csv_table", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, CASE WHEN p_size > 5 THEN CAST(p_size AS VARCHAR) END AS p_size FROM part")
def src_csv_table(spark, d):
    path, columns = f"{new_folder(spark)}/part", ["p_partkey", "p_name", "p_brand", "p_size"]
    io.write_csv(B.table(spark, d, "part").withColumn("p_size", F.when(F.col("p_size") > 5, F.col("p_size"))), path, columns)
    return io.read_csv(spark, path, columns)


@register("sink_csv_table", "SELECT p_name || ',' || p_brand || ',' AS line, count(*) AS n FROM part GROUP BY ALL")
def sink_csv_table(spark, d):
    path = f"{new_folder(spark)}/part"
    io.write_csv(B.table(spark, d, "part"), path, ["p_name", "p_brand", "not_there"])  # columns in this order; others go, missing ones are empty
    lines = spark.read.text(path).filter("value <> 'p_name,p_brand,not_there'")
    return lines.groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@register("src_json_artifacts", "SELECT CASE WHEN event_id % 50 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 50 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 50 = 0 AS corrupt FROM events")
def src_json_artifacts(spark, d):
    path = f"{new_folder(spark)}/events"
    e = B.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    e.select(F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{cut off "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct("event_id", "k"))).alias("value")).write.text(path)
    got = io.read_json(spark, path, "event_id bigint, k bigint", lines=True)
    return got.select("event_id", "k", F.col("_corrupt").isNotNull().alias("corrupt"))


@register("sink_idempotent", "SELECT o_custkey AS key, min(o_orderkey) AS row_id, o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) AS inserted, false AS again FROM orders GROUP BY o_custkey")
def sink_idempotent(spark, d):
    rows = B.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("row_id"))
    t = KeyedTable(spark, f"{new_folder(spark)}/keys", "key long, row_id long", ["key"], 16)
    t.insert(B.table(spark, d, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("key"), F.lit(None).cast("long").alias("row_id")))
    first, second = t.insert(rows, ["row_id"]), t.insert(rows, ["row_id"])
    return first.join(second.select("key", F.col("inserted").alias("again")), "key").select("key", "row_id", "inserted", "again")


@register("sink_artifacts", "SELECT 'sha256:' || sha256(text) AS content_hash, substr(sha256(text), 1, 2) AS shard, min(doc_id) AS artifact_id, CAST(CASE WHEN min(doc_id) % 2 = 0 THEN 1 WHEN bool_or(doc_id % 2 = 0) THEN 1 ELSE 2 END AS BIGINT) AS version FROM (SELECT text, doc_id FROM documents WHERE doc_id % 9 <> 0 QUALIFY NOT bool_or(doc_id % 2 = 0) OVER (PARTITION BY text) OR doc_id % 2 = 0) GROUP BY text")
def sink_artifacts(spark, d):
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("artifact_id"), F.concat(F.lit("sha256:"), F.sha2(F.col("text").cast("binary"), 256)).alias("content_hash"), F.lit("page.v1").alias("schema_version"), F.lit("page").alias("artifact_kind"), F.when(F.col("doc_id") % 9 != 0, F.lit("p")).alias("provenance"), F.array("source").alias("derived_from"))
    t = io.artifact_table(spark, f"{new_folder(spark)}/artifacts")
    for part in (docs.filter("artifact_id % 2 = 0"), docs, docs):  # a half, all of it, and all of it once more
        io.append_artifacts(part, t)
    return t.read().select("content_hash", "shard", "artifact_id", F.col("_seq").alias("version"))


@register("sink_edges", "SELECT DISTINCT 'line' AS child_kind, l_orderkey AS child_id, 'part' AS parent_kind, l_partkey AS parent_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def sink_edges(spark, d):
    e = B.table(spark, d, "lineitem").select(F.lit("line").alias("child_kind"), F.col("l_orderkey").alias("child_id"), F.lit("part").alias("parent_kind"), F.col("l_partkey").alias("parent_id"))
    known = e.join(B.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("child_id")), "child_id", "left_semi").select(*e.columns)
    t = io.edge_table(spark, f"{new_folder(spark)}/edges", "long")
    io.append_edges(known, t)
    before = t.manifest()["version"]
    io.append_edges(e, t)
    io.append_edges(e, t)  # nothing
    return t.read(since=before).select(*e.columns)


@register("sink_append_checked", "SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS p_brand FROM part")
def sink_append_checked(spark, d):
    path, p = f"{new_folder(spark)}/part", B.table(spark, d, "part")
    p.filter("p_partkey % 2 = 0").select("p_partkey", "p_name", "p_brand").write.parquet(path)
    io.append_checked(p.filter("p_partkey % 2 <> 0").select("p_name", "p_partkey"), path)
    return spark.read.parquet(path)


@register("manifest_files", "SELECT 'artifact-' || substr(sha1('docs/' || source || '_' || lang || '/' || doc_id || '.txt'), 1, 12) AS artifact_id, 'txt' AS type, CAST(doc_id AS VARCHAR) AS title, sha256(text) AS checksum FROM documents")
def manifest_files(spark, d):
    f = B.table(spark, d, "documents").select(F.concat(F.lit("/data/docs/"), "source", F.lit("_"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    return io.manifest(f, F.lit("/data/")).select("artifact_id", "type", "title", "checksum")


# Batch twins of the streams: the event log of users as routes.


def _log(spark, d):
    e = B.table(spark, d, "events")
    return e.select(F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("route"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (~((F.col("event_type") == "error") | (F.dayofmonth("ts") % 5 == 0))).alias("ok"))


#: A route with cooldowns of its own.
OWN_COOLDOWNS = {"r3": (3600, 7200, 14400)}

# The circuit in SQL: a row a result, each state from the one before it.
_CIRCUIT = """WITH RECURSIVE lg AS (SELECT 'r' || (user_id % 10) AS route, event_id, ts, epoch_us(ts) AS us, NOT (event_type = 'error' OR day(ts) % 5 = 0) AS ok, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS i FROM events),
c AS (SELECT 'r' || r AS route, 0::BIGINT AS i, 'closed' AS state, 0 AS fails, 0 AS opens, 0::BIGINT AS until, '' AS recent, 'closed' AS before, false AS probed, false AS opened, false AS shut FROM (SELECT DISTINCT user_id % 10 AS r FROM events)
UNION ALL
SELECT route, i, CASE WHEN shut THEN 'closed' WHEN opened THEN 'open' ELSE now END, CASE WHEN ok AND now <> 'open' THEN 0 ELSE fails END, CASE WHEN shut THEN 0 WHEN opened THEN opens + 1 ELSE opens END,
  CASE WHEN shut THEN 0 WHEN opened THEN us + 1000000::BIGINT * (CASE WHEN route = 'r3' THEN [3600, 7200, 14400] ELSE [300, 900, 1800] END)[least(opens + 1, 2) + 1] ELSE until END, recent, now AS before, probed, opened, shut
FROM (SELECT *, ok AND now = 'half_open' AS shut, NOT ok AND now <> 'open' AND (fails >= 10 OR (length(recent) >= 20 AND length(replace(recent, '1', '')) / length(recent) > 0.5)) AS opened
  FROM (SELECT *, CASE WHEN NOT ok AND now <> 'open' THEN fails0 + 1 ELSE fails0 END AS fails
    FROM (SELECT lg.route, lg.i, lg.us, lg.ok, CASE WHEN c.state = 'open' AND lg.us >= c.until THEN 'half_open' ELSE c.state END AS now, c.state = 'open' AND lg.us >= c.until AS probed, c.fails AS fails0, c.opens, c.until, right(c.recent || CASE WHEN lg.ok THEN '1' ELSE '0' END, 20) AS recent
      FROM c JOIN lg ON lg.route = c.route AND lg.i = c.i + 1)))),
tr AS (SELECT route, i, 'probe_allowed' AS event_type, 'open' AS previous_state, 'half_open' AS new_state, NULL::TIMESTAMP AS cooldown_until FROM c WHERE probed
UNION ALL SELECT route, i, 'circuit_close', 'half_open', 'closed', NULL FROM c WHERE shut
UNION ALL SELECT route, i, 'circuit_open', before, 'open', make_timestamp(until) FROM c WHERE opened)"""


@register("stream_circuit", _CIRCUIT + " SELECT route, event_id, ts, event_type, previous_state, new_state, cooldown_until FROM tr JOIN lg USING (route, i)")
def stream_circuit(spark, d):
    arrived, late = _out_of_order(spark, _log(spark, d).withColumn("route", F.col("route").cast("string")), "route", "event_id")
    t = _collected(spark, lambda: O.circuit_stream(arrived, late, OWN_COOLDOWNS))
    return t.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "cooldown_until")})


@register("degradation_events", _CIRCUIT + " SELECT route, event_type, ts, cooldown_until, 'deg:' || route || ':' || event_id AS degradation_id FROM tr JOIN lg USING (route, i) WHERE event_type <> 'probe_allowed'")
def degradation_events(spark, d):
    t = J.degradations(J.circuit_batch(_log(spark, d), cooldowns=OWN_COOLDOWNS))
    return t.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "cooldown_until")})


@register("stream_backpressure", "WITH l AS (SELECT event_type AS phase, ts, event_id AS seq, value AS backlog, CASE WHEN value >= 20 THEN true WHEN value <= 3 THEN false END AS m FROM events) SELECT phase, seq, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY phase ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS paused FROM l")
def stream_backpressure(spark, d):
    l = B.table(spark, d, "events").select(F.col("event_type").alias("phase"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("backlog"))
    arrived, late = _out_of_order(spark, l, "phase", "seq")
    return _collected(spark, lambda: O.backpressure_stream(arrived, late, 20, 3)).select("phase", "seq", "paused")


@register("stream_rate_gap", "WITH r AS (SELECT user_id AS route, event_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0::DOUBLE AS gap_seconds, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS nth FROM events) SELECT route, event_id, round(gap_seconds, 6) AS gap_seconds, coalesce(gap_seconds < 600, false) AS too_soon, nth > 3 AS over_cap FROM r")
def stream_rate_gap(spark, d):
    r = B.table(spark, d, "events").select(F.col("user_id").alias("route"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return J.rate_gaps(r, 600.0, 3).select("route", "event_id", F.round("gap_seconds", 6).alias("gap_seconds"), "too_soon", "over_cap")


@register("stream_coverage", f"WITH {B.SIG}, m AS (SELECT niche_id, signal_type, tier, max(confidence) AS best FROM sig GROUP BY ALL) SELECT niche_id, signal_type, tier, round(best, 6) AS best_confidence, string_agg(signal_id, ';' ORDER BY signal_id) AS signal_ids FROM m JOIN sig USING (niche_id, signal_type, tier) WHERE confidence = best GROUP BY ALL")
def stream_coverage(spark, d):
    # Signals arrive in files that mix all times, some a batch; cells and their ids merge into stored tables.
    signals = B.signals(spark, d).select("niche_id", "signal_type", "tier", "signal_id", "confidence")
    sink = J.CoverageSink(spark, f"{new_folder(spark)}/grid")
    J.drain(_stream(spark, signals.repartition(9, F.xxhash64("signal_id")), 3), sink, f"{new_folder(spark)}/state")
    return sink.grid().select("niche_id", "signal_type", "tier", F.round("best_confidence", 6).alias("best_confidence"), F.array_join("signal_ids", ";").alias("signal_ids"))


def _stream(spark, df, files=1000):
    """A frame as a stream: written to a new folder, read as it would arrive there, some files a batch."""
    path = f"{new_folder(spark)}/in"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _out_of_order(spark, rows, key, number, files=4):
    """Rows with ``ts`` as a stream of files in which times are mixed, and how late its rows come.

    Each file has a slice of the time and a half of the slice before it. A tick under a
    key of its own ends the stream; with it all other rows fall due.
    """
    path = f"{new_folder(spark)}/in"
    us = F.unix_micros("ts")
    first, last = rows.agg(F.min(us), F.max(us)).first()
    first, last = first or 0, last or 0
    slice_us = (last - first) // files + 1
    at = F.floor((us - first) / slice_us) + F.pmod(F.xxhash64(number), F.lit(2))
    dealt = cut(rows.withColumn("_at", at))
    late = 2 * slice_us // 1_000_000 + 1
    for k in range(files + 1):  # in this order
        dealt.filter(F.col("_at") == k).drop("_at").orderBy(F.xxhash64(number)).coalesce(1).write.mode("append").parquet(path)
    tick = {key: F.lit("tick"), number: F.lit(-1).cast("long"), "ts": F.timestamp_micros(F.lit(last + 2_000_000 * late))}
    spark.range(1).select(*[(tick[f.name] if f.name in tick else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), f"{late} seconds"


def _collected(spark, stream):
    """All rows of an append-mode stream, run to its end; a batch that comes again writes its folder again."""
    out = f"{new_folder(spark)}/out"
    with J.rocksdb(spark):
        made = stream()
        spark.createDataFrame([], made.schema).write.parquet(f"{out}/batch=-1")
        J.drain(made, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}"), f"{new_folder(spark)}/state")
    return spark.read.schema(made.schema).parquet(out).select(*made.columns)


@register("stream_expiry", f"WITH {B.SIG} SELECT signal_id, CAST(date_trunc('millisecond', expires_at) AS TIMESTAMP) AS expired_at FROM sig WHERE expires_at <= (SELECT max(observed_at) FROM sig) - INTERVAL 1 MINUTE")
def stream_expiry(spark, d):
    # The stream's timers fire as event time passes; what is due at its end has been written by then.
    out = f"{new_folder(spark)}/expired"
    signals = _stream(spark, B.signals(spark, d).select("signal_id", "observed_at", "expires_at"))
    with J.rocksdb(spark):
        J.drain(J.expiry_stream(signals), lambda batch, _epoch: batch.write.mode("append").parquet(out), f"{new_folder(spark)}/state")
    return spark.read.parquet(out).select("signal_id", F.col("expired_at").cast("timestamp_ntz").alias("expired_at"))


@register("stream_idempotent_ingest", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def stream_idempotent_ingest(spark, d):
    out = f"{new_folder(spark)}/table"
    events = B.table(spark, d, "events").select("user_id", "event_type", "event_id")
    sink = J.ingest_forever(out, ["user_id", "event_type"], ["event_id"])
    J.drain(_stream(spark, events), sink, f"{new_folder(spark)}/state")
    J.drain(_stream(spark, events), sink, f"{new_folder(spark)}/state")  # all of it once more: no row is new
    return spark.read.parquet(out)


@register("stream_route", "SELECT value > 5 AS valid, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_route(spark, d):
    good, bad = (f"{new_folder(spark)}/{x}" for x in ("valid", "invalid"))
    J.drain(_stream(spark, B.table(spark, d, "events").select("event_type", "value")), J.route(good, bad, F.col("value") > 5), f"{new_folder(spark)}/state")
    every = spark.read.parquet(good).withColumn("valid", F.lit(True)).unionByName(spark.read.parquet(bad).withColumn("valid", F.lit(False)))
    return every.groupBy("valid", "event_type").agg(F.count("*").alias("n"))
