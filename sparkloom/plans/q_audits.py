"""Queries on lineage, audits, roll-ups and retries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import audits as A
from sparkloom.operators import lineage as L

from . import bindings as B
from .catalog import register


def _edge(df, ck, c, pk, p):
    return df.select(F.lit(ck).alias("child_kind"), F.col(c).cast("string").alias("child_id"), F.lit(pk).alias("parent_kind"), F.col(p).cast("string").alias("parent_id"), F.lit(f"{ck}-1").alias("version_tag"))


def edges(spark, d):
    """line -> order -> customer -> nation -> region, and line -> part; repeats and versioned kinds included."""
    t = lambda n: B.table(spark, d, n)
    li = t("lineitem").withColumn("line", F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey"))
    return _edge(li, "line.v1", "line", "order", "l_orderkey").unionByName(_edge(li, "line", "line", "part", "l_partkey")).unionByName(_edge(t("orders"), "order", "o_orderkey", "customer.v1", "o_custkey")).unionByName(_edge(t("customer"), "customer", "c_custkey", "nation", "c_nationkey")).unionByName(_edge(t("nation"), "nation", "n_nationkey", "query_spec", "n_regionkey"))


def roots(spark, d):
    return B.table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("id"))


_LINE = "l_orderkey || '.' || l_linenumber || '.' || l_partkey"
_ED = f"ed AS (SELECT DISTINCT * FROM (SELECT 'line' AS child_kind, {_LINE} AS child_id, 'order' AS parent_kind, CAST(l_orderkey AS VARCHAR) AS parent_id FROM lineitem UNION ALL SELECT 'line', {_LINE}, 'part', CAST(l_partkey AS VARCHAR) FROM lineitem UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), 'customer', CAST(o_custkey AS VARCHAR) FROM orders UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'nation', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'query_spec', CAST(n_regionkey AS VARCHAR) FROM nation))"
_TR = f"WITH RECURSIVE {_ED}, tr AS (SELECT CAST(o_orderkey AS VARCHAR) AS root_id, 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS id, 0 AS depth FROM orders UNION SELECT tr.root_id, ed.parent_kind, ed.parent_id, depth + 1 FROM tr JOIN ed ON ed.child_kind = tr.kind AND ed.child_id = tr.id)"


@register("lin_edges", f"WITH {_ED} SELECT parent_kind, count(*) AS n, min(parent_id) AS first FROM ed WHERE child_kind = 'line' GROUP BY ALL")
def lin_edges(spark, d):
    e = L.select_edges(L.unique_edges(edges(spark, d)), child_kind="line")
    return e.groupBy("parent_kind").agg(F.count("*").alias("n"), F.min("parent_id").alias("first"))


@register("lin_trace", f"{_TR} SELECT root_id, kind, id, depth FROM tr")
def lin_trace(spark, d):
    return L.trace(roots(spark, d), edges(spark, d)).select("root_id", "kind", "id", "depth")


@register("lin_leaves", f"{_TR} SELECT root_id, coalesce(string_agg(id, ';' ORDER BY id) FILTER (kind = 'query_spec'), '') AS leaves, bool_or(kind = 'query_spec') AS complete FROM tr GROUP BY root_id")
def lin_leaves(spark, d):
    return L.leaves(L.trace(roots(spark, d), edges(spark, d))).select("root_id", F.array_join("leaves", ";").alias("leaves"), "complete")


@register("lin_node_metadata", f"{_TR} SELECT root_id, tr.kind, id, n_name AS name FROM tr LEFT JOIN nation ON tr.kind = 'nation' AND tr.id = CAST(n_nationkey AS VARCHAR)")
def lin_node_metadata(spark, d):
    names = B.table(spark, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    return L.node_metadata(L.trace(roots(spark, d), edges(spark, d)), names).select("root_id", "kind", "id", "name")


@register("lin_diff", f"WITH {_ED}, l AS (SELECT DISTINCT child_id, parent_id FROM ed WHERE parent_kind = 'part'), r AS (SELECT DISTINCT child_id, CASE WHEN CAST(parent_id AS BIGINT) % 2 = 0 THEN parent_id ELSE parent_id || 'x' END AS parent_id FROM l) SELECT coalesce(l.child_id, r.child_id) AS child_id, coalesce(l.parent_id, r.parent_id) AS parent_id, CASE WHEN r.child_id IS NULL THEN 'left' WHEN l.child_id IS NULL THEN 'right' ELSE 'both' END AS side FROM l FULL JOIN r ON l.child_id = r.child_id AND l.parent_id = r.parent_id")
def lin_diff(spark, d):
    left = L.unique_edges(edges(spark, d)).filter("parent_kind = 'part'")
    right = left.withColumn("parent_id", F.when(F.col("parent_id").cast("long") % 2 == 0, F.col("parent_id")).otherwise(F.concat("parent_id", F.lit("x"))))
    return L.diff(left, right, ["child_id", "parent_id"])


@register("lin_resolve_root", "SELECT i AS id, CASE WHEN i % 3 = 0 AND i < 3000 THEN 'page' WHEN i % 5 = 0 THEN 'query_spec' WHEN i < 2000 THEN 'task' ELSE 'ERR_UNKNOWN' END AS kind FROM (SELECT o_orderkey AS i FROM orders)")
def lin_resolve_root(spark, d):
    o = B.table(spark, d, "orders")
    k = F.col("o_orderkey")
    arts = o.filter((k % 3 == 0) & (k < 3000)).select(k.alias("artifact_id"), F.explode(F.array(F.lit("old"), F.lit("page.v1"))).alias("artifact_kind")).withColumn("created_at", F.when(F.col("artifact_kind") == "old", 1).otherwise(2))
    return L.resolve(o.select(k.alias("id")), arts, o.filter(k % 5 == 0).select(k.alias("query_spec_id")), o.filter(k < 2000).select(k.alias("task_id"))).select("id", "kind")


@register("lin_replay_plan", "SELECT CAST(o_orderkey AS VARCHAR) AS root_id, CAST(n_regionkey AS VARCHAR) AS leaf_id, 3 AS depth, 'customer=order-1>nation=customer-1>query_spec=nation-1' AS pins FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def lin_replay_plan(spark, d):
    e = edges(spark, d)
    e = e.withColumns({c: L.strip_version(F.col(c)) for c in ("child_kind", "parent_kind")})
    return L.replay_plan(roots(spark, d), e, "query_spec")


# Jobs are customers, tasks their orders.
LANES = "['http', 'browser', 'search', 'extract', 'index']"
_TASKS = f"""tk AS (SELECT o_orderkey AS task_id, o_custkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'RUNNING' ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'DEAD_LETTER' WHEN o_orderkey % 4 = 1 THEN 'RETRY_WAIT' ELSE 'PENDING' END END AS state, {LANES}[CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS lane, CAST(o_orderkey % 3 AS INTEGER) AS priority, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey * 2 END AS result_artifact_id, o_orderdate AS t0, 'w' || o_orderkey % 10 AS lease_owner FROM orders)"""
_JOBS = "jb AS (SELECT c_custkey AS job_id, CASE WHEN c_custkey % 3 = 0 THEN 'completed' ELSE 'running' END AS status, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey // 7 END AS parent_job_id FROM customer)"
_ARTS = "ar AS (SELECT o_orderkey * 2 AS artifact_id, o_custkey AS p FROM orders WHERE o_orderkey % 10 <> 0), ae AS (SELECT o_orderkey * 2 AS child_id, o_custkey AS parent_id FROM orders WHERE o_orderkey % 4 <> 0)"
NOW = "1998-01-01 00:00:00"
_TERM = "('SUCCEEDED','FAILED','DEAD_LETTER','BLOCKED')"
_LIVE = "('PENDING','READY','RUNNING','RETRY_WAIT')"


def now():
    return F.lit(NOW).cast("timestamp")


def tasks(spark, d):
    o, k = B.table(spark, d, "orders"), F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderstatus") == "O", "RUNNING").when(k % 4 == 0, "DEAD_LETTER").when(k % 4 == 1, "RETRY_WAIT").otherwise("PENDING")
    lane = F.element_at(F.array(*[F.lit(x) for x in ("http", "browser", "search", "extract", "index")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(k.alias("task_id"), F.col("o_custkey").alias("job_id"), state.alias("state"), lane.alias("lane"), (k % 3).cast("int").alias("priority"), F.when(k % 6 != 0, k * 2).alias("result_artifact_id"), at.alias("not_before"), at.alias("retry_at"), at.alias("lease_expires_at"), at.alias("at"), F.concat(F.lit("w"), (k % 10).cast("string")).alias("lease_owner"))


def jobs(spark, d):
    k = F.col("c_custkey")
    return B.table(spark, d, "customer").select(k.alias("job_id"), F.when(k % 3 == 0, "completed").otherwise("running").alias("status"), F.when(k % 7 != 0, F.floor(k / 7)).alias("parent_job_id"))


def artifacts(spark, d):
    k = F.col("o_orderkey")
    return B.table(spark, d, "orders").filter(k % 10 != 0).select((k * 2).alias("artifact_id"), F.array("o_custkey").alias("derived_from"))


def artifact_edges(spark, d):
    k = F.col("o_orderkey")
    return B.table(spark, d, "orders").filter(k % 4 != 0).select((k * 2).alias("child_id"), F.col("o_custkey").alias("parent_id"))


_AUD = {
    "aud_inline_ref_gap": "SELECT 'inline_ref_gap' AS audit, CAST(artifact_id AS VARCHAR) AS subject, CAST(p AS VARCHAR) AS detail FROM ar WHERE (artifact_id, p) NOT IN (SELECT (child_id, parent_id) FROM ae)".replace("(artifact_id, p) NOT IN (SELECT (child_id, parent_id) FROM ae)", "NOT EXISTS (SELECT 1 FROM ae WHERE child_id = artifact_id AND parent_id = p)"),
    "aud_orphan_artifact": "SELECT 'orphan_artifact' AS audit, CAST(artifact_id AS VARCHAR) AS subject, '1' AS detail FROM ar WHERE artifact_id NOT IN (SELECT child_id FROM ae)",
    "aud_terminal_active": f"SELECT 'terminal_active' AS audit, CAST(job_id AS VARCHAR) AS subject, status AS detail FROM jb WHERE status = 'completed' AND job_id IN (SELECT job_id FROM tk WHERE state IN {_LIVE})",
    "aud_active_all_done": f"SELECT 'active_all_done' AS audit, CAST(jb.job_id AS VARCHAR) AS subject, CAST(n AS VARCHAR) AS detail FROM jb JOIN (SELECT job_id, count(*) AS n, bool_and(state IN {_TERM}) AS a FROM tk GROUP BY job_id) t ON t.job_id = jb.job_id WHERE a AND status <> 'completed'",
    "aud_missing_result": "SELECT 'missing_result' AS audit, CAST(task_id AS VARCHAR) AS subject, state AS detail FROM tk WHERE state = 'SUCCEEDED' AND result_artifact_id IS NULL",
    "aud_dangling_result": "SELECT 'dangling_result' AS audit, CAST(task_id AS VARCHAR) AS subject, CAST(result_artifact_id AS VARCHAR) AS detail FROM tk WHERE result_artifact_id IS NOT NULL AND result_artifact_id NOT IN (SELECT artifact_id FROM ar)",
    "aud_expired_leases": f"SELECT 'expired_lease' AS audit, CAST(task_id AS VARCHAR) AS subject, lease_owner AS detail FROM tk WHERE state = 'RUNNING' AND t0 < TIMESTAMP '{NOW}'",
}
_W = f"WITH {_TASKS}, {_JOBS}, {_ARTS} "


@register("aud_inline_ref_gap", _W + _AUD["aud_inline_ref_gap"])
def aud_inline_ref_gap(spark, d):
    return A.inline_reference_gaps(artifacts(spark, d), artifact_edges(spark, d))


@register("aud_orphan_artifact", _W + _AUD["aud_orphan_artifact"])
def aud_orphan_artifact(spark, d):
    return A.orphans(artifacts(spark, d), artifact_edges(spark, d))


@register("aud_terminal_active", _W + _AUD["aud_terminal_active"])
def aud_terminal_active(spark, d):
    return A.terminal_with_live(jobs(spark, d), tasks(spark, d))


@register("aud_active_all_done", _W + _AUD["aud_active_all_done"])
def aud_active_all_done(spark, d):
    return A.active_all_done(jobs(spark, d), tasks(spark, d))


@register("aud_missing_result", _W + _AUD["aud_missing_result"])
def aud_missing_result(spark, d):
    return A.missing_results(tasks(spark, d))


@register("aud_dangling_result", _W + _AUD["aud_dangling_result"])
def aud_dangling_result(spark, d):
    return A.dangling_results(tasks(spark, d), artifacts(spark, d))


@register("aud_expired_leases", _W + _AUD["aud_expired_leases"])
def aud_expired_leases(spark, d):
    return A.expired_leases(tasks(spark, d), now())


@register("aud_all", _W + " UNION ALL ".join(_AUD.values()))
def aud_all(spark, d):
    return A.every_audit(jobs(spark, d), tasks(spark, d), artifacts(spark, d), artifact_edges(spark, d), now())


_STATES = ("PENDING", "RUNNING", "RETRY_WAIT", "SUCCEEDED", "DEAD_LETTER")


@register("roll_task_counts", f"WITH {_TASKS} SELECT job_id, " + ", ".join(f"count(*) FILTER (state = '{s}') AS n_{s.lower()}" for s in _STATES) + ", count(*) AS total FROM tk GROUP BY job_id")
def roll_task_counts(spark, d):
    return A.task_counts(tasks(spark, d), _STATES)


@register("roll_job_children", f"WITH {_JOBS} SELECT parent_job_id, count(*) AS n, string_agg(CAST(job_id AS VARCHAR), ';' ORDER BY job_id) AS children FROM jb WHERE parent_job_id IS NOT NULL GROUP BY ALL")
def roll_job_children(spark, d):
    j = jobs(spark, d).filter("parent_job_id IS NOT NULL")
    return j.groupBy("parent_job_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("job_id")), lambda x: x.cast("string")), ";").alias("children"))


@register("roll_job_tasks", f"WITH {_TASKS} SELECT job_id, task_id, state, CAST(row_number() OVER (PARTITION BY job_id ORDER BY t0, task_id) AS INTEGER) AS position FROM tk")
def roll_job_tasks(spark, d):
    from pyspark.sql import Window

    return tasks(spark, d).withColumn("position", F.row_number().over(Window.partitionBy("job_id").orderBy("at", "task_id"))).select("job_id", "task_id", "state", "position")


@register("roll_workers", f"WITH {_TASKS} SELECT lease_owner, count(*) FILTER (state = 'RUNNING') AS active, max(t0) AS last_seen FROM tk GROUP BY lease_owner")
def roll_workers(spark, d):
    return A.workers(tasks(spark, d)).withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@register("roll_dead_letters", f"WITH {_TASKS} SELECT task_id, job_id, t0 AS done_at FROM tk WHERE state = 'DEAD_LETTER'")
def roll_dead_letters(spark, d):
    return tasks(spark, d).filter("state = 'DEAD_LETTER'").select("task_id", "job_id", F.col("at").cast("timestamp_ntz").alias("done_at")).orderBy(F.desc("done_at"), "task_id")


@register("roll_lane_backlog", f"WITH {_TASKS} SELECT lane, count(*) AS backlog FROM tk WHERE state IN {_LIVE} GROUP BY lane")
def roll_lane_backlog(spark, d):
    return A.lane_backlog(tasks(spark, d))


_BUD = "bd AS (SELECT c_custkey AS job_id, lane, CASE lane WHEN 'http' THEN 2 + c_custkey % 4 WHEN 'browser' THEN c_custkey % 3 ELSE 1 END AS budget FROM customer, (SELECT unnest(['http', 'browser', 'search']) AS lane) WHERE c_custkey % 5 <> 0)"


@register("roll_lane_spend", f"WITH {_TASKS}, {_BUD}, sp AS (SELECT job_id, lane, count(*) FILTER (state IN ('READY','LEASED','RUNNING','SUCCEEDED','RETRY_WAIT')) AS spent FROM tk GROUP BY ALL), j AS (SELECT coalesce(sp.job_id, bd.job_id) AS job_id, coalesce(sp.lane, bd.lane) AS lane, coalesce(spent, 0) AS spent, budget FROM sp FULL JOIN bd ON sp.job_id = bd.job_id AND sp.lane = bd.lane) SELECT job_id, lane, spent, budget, coalesce(spent < budget, true) AS allowed, CASE WHEN budget IS NULL THEN 'lane_not_budgeted' WHEN spent >= budget THEN 'budget_exhausted' ELSE 'within_budget' END AS reason FROM j")
def roll_lane_spend(spark, d):
    k = F.col("c_custkey")
    amounts = F.explode(F.create_map(F.lit("http"), 2 + k % 4, F.lit("browser"), k % 3, F.lit("search"), F.lit(1).cast("long")))
    budgets = B.table(spark, d, "customer").filter(k % 5 != 0).select(k.alias("job_id"), amounts.alias("lane", "budget"))
    return A.lane_spend(tasks(spark, d), budgets)


#: Limits of lanes; those of the index lane and of a lane without tasks are for the test of both ends.
_LIMITS = {"http": 24, "browser": 2, "extract": 1_000_000_000, "index": 0, "media": 2}


@register("roll_lane_in_flight", f"WITH {_TASKS}, lm AS (SELECT * FROM (VALUES {', '.join(repr(x) for x in _LIMITS.items())}) t(lane, most)), fl AS (SELECT lane, count(*) FILTER (state IN ('READY', 'LEASED', 'RUNNING')) AS in_flight FROM tk GROUP BY lane), j AS (SELECT coalesce(fl.lane, lm.lane) AS lane, coalesce(in_flight, 0) AS in_flight, most FROM fl FULL JOIN lm ON fl.lane = lm.lane) SELECT lane, in_flight, most, NOT (coalesce(most, 0) > 0 AND in_flight >= most) AS allowed, CASE WHEN coalesce(most, 0) <= 0 THEN 'lane_not_gated' WHEN in_flight >= most THEN 'limit_reached' ELSE 'within_limit' END AS reason FROM j")
def roll_lane_in_flight(spark, d):
    return A.lane_in_flight(tasks(spark, d), spark.createDataFrame(list(_LIMITS.items()), "lane string, most int"))


def dependencies(spark, d):
    from pyspark.sql import Window

    t = tasks(spark, d)
    return t.select("task_id", F.lag("task_id").over(Window.partitionBy("job_id").orderBy("at", "task_id")).alias("depends_on_task_id")).filter("depends_on_task_id IS NOT NULL")


@register("task_ready_set", f"WITH {_TASKS}, dp AS (SELECT task_id, lag(task_id) OVER (PARTITION BY job_id ORDER BY t0, task_id) AS p FROM tk) SELECT tk.task_id, tk.state FROM tk WHERE (state = 'PENDING' AND t0 <= TIMESTAMP '{NOW}' AND NOT EXISTS (SELECT 1 FROM dp JOIN tk t2 ON t2.task_id = dp.p WHERE dp.task_id = tk.task_id AND t2.state <> 'SUCCEEDED')) OR (state = 'RETRY_WAIT' AND t0 <= TIMESTAMP '{NOW}')")
def task_ready_set(spark, d):
    return A.ready_set(tasks(spark, d), dependencies(spark, d), now()).select("task_id", "state")


@register("fair_take", f"WITH {_TASKS}, g AS (SELECT *, row_number() OVER (PARTITION BY lane, job_id ORDER BY t0, task_id) AS k FROM tk), f AS (SELECT *, k / CASE priority WHEN 0 THEN 8.0::DOUBLE WHEN 1 THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS finish FROM g WHERE k <= 50) SELECT lane, task_id, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY finish, t0, task_id) AS turn FROM f) WHERE turn <= 50")
def fair_take(spark, d):
    return A.fair_take(tasks(spark, d), 50, {0: 8.0, 1: 4.0, 2: 1.0}, ["at", "task_id"]).select("lane", "task_id", "turn")


# Failures are error events.
_FA = "fa AS (SELECT event_id AS task_id, CASE WHEN event_id % 2 = 0 THEN [200, 403, 404, 408, 429, 500, 503][event_id % 7 + 1] END AS status_code, CASE WHEN event_id % 6 = 1 THEN NULL ELSE ['NETWORK_TIMEOUT', 'HTTP_403', 'HTTP_404', 'BROWSER_CRASH'][event_id % 4 + 1] END AS error_code, CAST(1 + event_id % 6 AS INTEGER) AS attempt, ['http', 'browser', 'enrich'][event_id % 3 + 1] AS lane, CASE WHEN event_id % 5 = 0 THEN (event_id % 50)::DOUBLE END AS retry_after, ts AS failed_at FROM events WHERE event_type = 'error')"
_CL = "cl AS (SELECT *, CASE WHEN status_code IS NOT NULL THEN 'HTTP_' || status_code WHEN error_code IS NULL THEN 'UNKNOWN_FAILURE' ELSE error_code END AS failure_class, CASE WHEN status_code IN (401, 403) OR (status_code IS NULL AND error_code = 'HTTP_403') THEN 'BLOCKED' WHEN status_code IN (408, 429, 500, 502, 503, 504) OR (status_code IS NULL AND error_code IN ('NETWORK_TIMEOUT', 'BROWSER_CRASH')) THEN 'RETRY_WAIT' ELSE 'FAILED' END AS action FROM fa), dl AS (SELECT *, CASE WHEN failure_class = 'HTTP_429' AND retry_after IS NOT NULL THEN greatest(0, retry_after) ELSE least(CASE lane WHEN 'http' THEN 32.0 WHEN 'browser' THEN 45.0 ELSE 30.0 END, CASE lane WHEN 'http' THEN 2.0 WHEN 'browser' THEN 5.0 ELSE 1.0 END * pow(2, attempt - 1))::DOUBLE END AS delay FROM cl)"


def failures(spark, d):
    e, k = B.table(spark, d, "events").filter("event_type = 'error'"), F.col("event_id")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    return e.select(k.alias("task_id"), F.when(k % 2 == 0, pick([200, 403, 404, 408, 429, 500, 503], 7)).alias("status_code"), F.when(k % 6 != 1, pick(["NETWORK_TIMEOUT", "HTTP_403", "HTTP_404", "BROWSER_CRASH"], 4)).alias("error_code"), (1 + k % 6).cast("int").alias("attempt"), pick(["http", "browser", "enrich"], 3).alias("lane"), F.when(k % 5 == 0, (k % 50).cast("double")).alias("retry_after"), F.col("ts").cast("timestamp").alias("failed_at"))


@register("fail_classify", f"WITH {_FA}, {_CL} SELECT task_id, failure_class, action, action = 'RETRY_WAIT' AS retryable FROM cl")
def fail_classify(spark, d):
    return failures(spark, d).select("task_id", A.classify(F.col("status_code"), F.col("error_code")).alias("c")).select("task_id", "c.failure_class", "c.action", "c.retryable")


@register("fail_backoff", f"WITH {_FA}, {_CL} SELECT task_id, delay FROM dl")
def fail_backoff(spark, d):
    c = A.classify(F.col("status_code"), F.col("error_code"))["failure_class"]
    return failures(spark, d).select("task_id", A.backoff(F.col("attempt"), F.col("lane"), c, F.col("retry_after")).alias("delay"))


_CI = "ci AS (SELECT 'r' || (user_id % 10) AS route, CASE WHEN user_id % 10 < 6 THEN 'open' ELSE 'closed' END AS cstate, CASE WHEN user_id % 10 < 6 THEN max(ts) - INTERVAL 3 DAYS END AS until FROM events WHERE user_id % 10 <> 9 GROUP BY user_id % 10)"


@register("fail_outcome", f"WITH {_FA.replace('AS failed_at FROM', 'AS failed_at, user_id FROM')}, {_CL}, {_CI}, oc AS (SELECT dl.*, ci.*, CASE WHEN action <> 'RETRY_WAIT' THEN action WHEN attempt >= 5 THEN 'DEAD_LETTER' ELSE 'RETRY_WAIT' END AS outcome FROM dl LEFT JOIN ci ON ci.route = 'r' || (dl.user_id % 10)) SELECT task_id, failure_class, outcome, CASE WHEN outcome = 'RETRY_WAIT' THEN CASE WHEN cstate = 'open' AND failed_at < until THEN until ELSE make_timestamp(epoch_us(failed_at) + CAST(delay * 1000000 AS BIGINT)) END END AS retry_at, CASE WHEN outcome = 'RETRY_WAIT' THEN CASE WHEN cstate = 'open' AND failed_at < until THEN 'open' WHEN cstate = 'open' THEN 'half_open' ELSE 'closed' END END AS circuit_state FROM oc")
def fail_outcome(spark, d):
    r = F.col("user_id") % 10
    route = F.concat(F.lit("r"), r.cast("string"))
    e = B.table(spark, d, "events")
    circuits = e.filter(r != 9).groupBy(route.alias("route"), r.alias("_r")).agg(F.max("ts").cast("timestamp").alias("t")).select("route", F.when(F.col("_r") < 6, "open").otherwise("closed").alias("state"), F.when(F.col("_r") < 6, F.col("t") - F.expr("INTERVAL 3 DAYS")).alias("cooldown_until"))
    f = failures(spark, d).join(e.select(F.col("event_id").alias("task_id"), route.alias("route")), "task_id")
    return A.outcomes(f, circuits=circuits).select("task_id", "failure_class", "outcome", F.col("retry_at").cast("timestamp_ntz").alias("retry_at"), "circuit_state")
