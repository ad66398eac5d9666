"""Audits and roll-ups over job, task and artifact tables; retries and failure classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the retry policy.
TERMINAL_JOB, TERMINAL_TASK, LIVE = ("completed", "failed", "cancelled"), ("SUCCEEDED", "FAILED", "DEAD_LETTER", "BLOCKED"), ("PENDING", "READY", "RUNNING", "RETRY_WAIT")
RETRYABLE_HTTP = (408, 429, 500, 502, 503, 504)
RETRYABLE = ("NETWORK_TIMEOUT", "DNS_TEMPORARY_FAILURE", "CONNECTION_RESET", "HTTP_408", "HTTP_429", "HTTP_500", "HTTP_502", "HTTP_503", "HTTP_504", "BROWSER_CRASH", "TEMPORARY_STORAGE_FAILURE", "DATABASE_CONNECTION_FAILURE")
BLOCKED = ("HTTP_403", "ROBOTS_DISALLOWED", "POLICY_DISALLOWED")
BASE_DELAY = {"http": 2.0, "browser": 5.0, "search": 2.0, "media": 2.0, "extract": 1.0, "enrich": 1.0, "index": 1.0}
MOST_DELAY = {"http": 32.0, "browser": 45.0, "search": 32.0, "media": 32.0, "extract": 30.0, "enrich": 30.0, "index": 30.0}


def finding(df: DataFrame, audit: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(audit).alias("audit"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def _lost(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose ``keys`` are not in ``right``, dealt over as many tasks as the session has shuffle partitions.

    A stated number is not coalesced, so a task sorts that part of the rows however large the tables are; rows that repeat need no distinct.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(n, *keys).join(right.select(*keys).repartition(n, *keys), keys, "left_anti")


def inline_reference_gaps(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """Inline parents without the matching edge."""
    inline = artifacts.select("artifact_id", F.explode("derived_from").alias("parent_id"))
    lost = _lost(inline, edges.select(F.col("child_id").alias("artifact_id"), "parent_id"), ["artifact_id", "parent_id"])
    return finding(lost, "inline_ref_gap", F.col("artifact_id"), F.col("parent_id"))


def orphans(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """Artifacts that name parents but have no edge at all."""
    named = artifacts.select("artifact_id", "derived_from").filter(F.size("derived_from") > 0)
    lost = _lost(named, edges.select(F.col("child_id").alias("artifact_id")), ["artifact_id"])
    return finding(lost, "orphan_artifact", F.col("artifact_id"), F.size("derived_from"))


def terminal_with_live(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    live = tasks.filter(F.col("state").isin(*LIVE)).select("job_id").distinct()
    return finding(jobs.filter(F.col("status").isin(*TERMINAL_JOB)).join(live, "job_id", "left_semi"), "terminal_active", F.col("job_id"), F.col("status"))


def active_all_done(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    done = tasks.groupBy("job_id").agg(F.min(F.col("state").isin(*TERMINAL_TASK)).alias("all_done"), F.count("*").alias("n")).filter("all_done")
    return finding(jobs.filter(~F.col("status").isin(*TERMINAL_JOB)).join(done, "job_id"), "active_all_done", F.col("job_id"), F.col("n"))


def missing_results(tasks: DataFrame) -> DataFrame:
    return finding(tasks.filter((F.col("state") == "SUCCEEDED") & F.col("result_artifact_id").isNull()), "missing_result", F.col("task_id"), F.col("state"))


def dangling_results(tasks: DataFrame, artifacts: DataFrame) -> DataFrame:
    with_result = tasks.select("task_id", "result_artifact_id").filter(F.col("result_artifact_id").isNotNull())
    lost = _lost(with_result, artifacts.select(F.col("artifact_id").alias("result_artifact_id")), ["result_artifact_id"])
    return finding(lost, "dangling_result", F.col("task_id"), F.col("result_artifact_id"))


def expired_leases(tasks: DataFrame, now: Column) -> DataFrame:
    return finding(tasks.filter((F.col("state") == "RUNNING") & (F.col("lease_expires_at") < now)), "expired_lease", F.col("task_id"), F.col("lease_owner"))


def every_audit(jobs: DataFrame, tasks: DataFrame, artifacts: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    parts = [inline_reference_gaps(artifacts, edges), orphans(artifacts, edges), terminal_with_live(jobs, tasks), active_all_done(jobs, tasks), missing_results(tasks), dangling_results(tasks, artifacts), expired_leases(tasks, now)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ready_set(tasks: DataFrame, dependencies: DataFrame, now: Column) -> DataFrame:
    """Pending tasks whose dependencies all succeeded and whose time has come, and retries that are due."""
    unfinished = dependencies.join(tasks.select(F.col("task_id").alias("depends_on_task_id"), F.col("state").alias("_s")), "depends_on_task_id", "left").filter(~F.coalesce(F.col("_s") == "SUCCEEDED", F.lit(False))).select("task_id").distinct()
    pending = tasks.filter((F.col("state") == "PENDING") & F.coalesce(F.col("not_before") <= now, F.lit(True))).join(unfinished, "task_id", "left_anti")
    return pending.unionByName(tasks.filter((F.col("state") == "RETRY_WAIT") & (F.col("retry_at") <= now)))


def fair_take(tasks: DataFrame, n: int, weights: dict[int, float], order: list[str]) -> DataFrame:
    """``n`` tasks per lane; a group's k-th task counts k / weight, so heavy groups go first and none starves."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, v)]), F.col("priority")), F.lit(1.0))
    k = F.row_number().over(Window.partitionBy("lane", "job_id").orderBy(*order))
    # No more than n of a group can be taken.
    t = tasks.withColumn("finish", k).filter(F.col("finish") <= n).withColumn("finish", F.col("finish") / weight)
    return t.withColumn("turn", F.row_number().over(Window.partitionBy("lane").orderBy("finish", *order))).filter(F.col("turn") <= n)


def classify(status: Column, code: Column) -> Column:
    """struct<failure_class, action, retryable, counts>; the HTTP status comes before the error code."""
    entry = lambda cls, action, retry: F.struct(cls.alias("failure_class"), F.lit(action).alias("action"), F.lit(retry).alias("retryable"), F.lit(retry).alias("counts"))
    http = F.concat(F.lit("HTTP_"), status.cast("string"))
    by_status = F.when(status.isin(401, 403), entry(http, "BLOCKED", False)).when(status.isin(*RETRYABLE_HTTP), entry(http, "RETRY_WAIT", True)).otherwise(entry(http, "FAILED", False))
    by_code = F.when(code.isNull(), entry(F.lit("UNKNOWN_FAILURE"), "FAILED", False)).when(code.isin(*BLOCKED), entry(code, "BLOCKED", False)).when(code.isin(*RETRYABLE), entry(code, "RETRY_WAIT", True)).otherwise(entry(code, "FAILED", False))
    return F.when(status.isNotNull(), by_status).otherwise(by_code)


def backoff(attempt: Column, lane: Column, failure_class: Column, retry_after: Column, jitter: Column | None = None) -> Column:
    """Seconds until the next try: doubling up to the lane's ceiling, times ``jitter``; a 429's own wait as it is."""
    pick = lambda table: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), lane), F.lit(table["http"]))
    raw = F.least(pick(MOST_DELAY), pick(BASE_DELAY) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))
    return F.when((failure_class == "HTTP_429") & retry_after.isNotNull(), F.greatest(F.lit(0.0), retry_after)).otherwise(raw * (F.lit(1.0) if jitter is None else jitter))


def jitter(task_id: Column, attempt: Column, share: float = 0.25) -> Column:
    """Within ±share, from a hash, so that a rerun agrees."""
    return 1 - share + 2 * share * F.pmod(F.xxhash64(task_id, attempt), F.lit(1_000_000)) / 1_000_000


def outcomes(failures: DataFrame, most_attempts: int = 5, circuits: DataFrame | None = None) -> DataFrame:
    """What becomes of each failed attempt: BLOCKED, FAILED, DEAD_LETTER, or RETRY_WAIT with its time.

    ``circuits`` (route, state, cooldown_until) are those of the routes: on a route
    whose circuit is open at the failure, a retry waits for the cooldown's end
    instead of the backoff. circuit_state is ``closed`` on unknown routes and null where no retry is to come.
    """
    f = failures.withColumn("c", classify(F.col("status_code"), F.col("error_code")))
    state = F.when(F.col("c.action") != "RETRY_WAIT", F.col("c.action")).when(F.col("attempt") >= most_attempts, "DEAD_LETTER").otherwise("RETRY_WAIT")
    f = f.withColumn("outcome", state)
    if circuits is None:
        f = f.withColumns({"_state": F.lit(None).cast("string"), "_until": F.lit(None).cast("timestamp")})
    else:
        f = f.join(circuits.select("route", F.col("state").alias("_state"), F.col("cooldown_until").alias("_until")), "route", "left")
    shut = F.coalesce((F.col("_state") == "open") & (F.col("failed_at") < F.col("_until")), F.lit(False))
    delay = backoff(F.col("attempt"), F.col("lane"), F.col("c.failure_class"), F.col("retry_after"))
    at = F.when(shut, F.col("_until")).otherwise(F.timestamp_micros((F.unix_micros("failed_at") + delay * 1e6).cast("long")))
    waits = lambda x: F.when(F.col("outcome") == "RETRY_WAIT", x)
    return f.withColumns({"retry_at": waits(at), "failure_class": F.col("c.failure_class"), "circuit_state": waits(F.when(shut, "open").when(F.col("_state") == "open", "half_open").otherwise(F.coalesce("_state", F.lit("closed"))))}).drop("c", "_state", "_until")


# States that have spent budget, and those in flight.
SPENT, IN_FLIGHT = ("READY", "LEASED", "RUNNING", "SUCCEEDED", "RETRY_WAIT"), ("READY", "LEASED", "RUNNING")


def task_counts(tasks: DataFrame, states: tuple[str, ...]) -> DataFrame:
    return tasks.groupBy("job_id").agg(*[F.count(F.when(F.col("state") == s, 1)).alias(f"n_{s.lower()}") for s in states], F.count("*").alias("total"))


def lane_backlog(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("state").isin(*LIVE)).groupBy("lane").agg(F.count("*").alias("backlog"))


def lane_spend(tasks: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per (job_id, lane): spent, budget, allowed and reason, against a table of budgets (job_id, lane, budget).

    Lanes without a budget are always allowed. A job's lane with a budget and no task has spent 0.
    """
    spent = tasks.groupBy("job_id", "lane").agg(F.count(F.when(F.col("state").isin(*SPENT), 1)).alias("spent"))
    j = spent.join(budgets.select("job_id", "lane", "budget"), ["job_id", "lane"], "full_outer").withColumn("spent", F.coalesce("spent", F.lit(0)))
    reason = F.when(F.col("budget").isNull(), "lane_not_budgeted").when(F.col("spent") >= F.col("budget"), "budget_exhausted").otherwise("within_budget")
    return j.withColumn("reason", reason).withColumn("allowed", F.col("reason") != "budget_exhausted")


def lane_in_flight(tasks: DataFrame, limits: DataFrame) -> DataFrame:
    """Per lane: in_flight, most, allowed and reason, against a table of limits (lane, most); no limit or 0 means no gate."""
    flying = tasks.groupBy("lane").agg(F.count(F.when(F.col("state").isin(*IN_FLIGHT), 1)).alias("in_flight"))
    j = flying.join(limits.select("lane", "most"), "lane", "full_outer").withColumn("in_flight", F.coalesce("in_flight", F.lit(0)))
    gated = F.coalesce(F.col("most") > 0, F.lit(False))
    reason = F.when(~gated, "lane_not_gated").when(F.col("in_flight") >= F.col("most"), "limit_reached").otherwise("within_limit")
    return j.withColumn("reason", reason).withColumn("allowed", F.col("reason") != "limit_reached")


def workers(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("lease_owner").agg(F.count(F.when(F.col("state") == "RUNNING", 1)).alias("active"), F.max("at").alias("last_seen"))
