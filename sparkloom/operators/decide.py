"""Freshness, re-ranking by constraints and decisions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import merged_set_hash
from .ranks import ranked

# Fixed values of the re-ranking.
FIT_WEIGHTS = {"margin_potential": 0.40, "shipping_fit": 0.35, "channel_fit": 0.25}
MIN_FIT, OPPORTUNITY_SHARE, FIT_SHARE, DEFAULT_LEVEL = 0.55, 0.65, 0.35, 3
TTL_DAYS = 14
EXPERIMENT, PRIORITY, CONTINUE, REJECT = "eligible_for_controlled_experiment_after_gates_pass", "priority_experiment_not_automatic_inventory_purchase", "continue_research_only_when_evidence_collection_is_inexpensive", "reject_or_archive"


def is_expired(as_of: Column, expires_at: Column | str = "expires_at") -> Column:
    """At the moment of expiry a signal is expired."""
    return as_of >= (F.col(expires_at) if isinstance(expires_at, str) else expires_at)


def partition(signals: DataFrame, as_of: Column) -> DataFrame:
    return signals.withColumn("expired", is_expired(as_of))


def evaluate(signals: DataFrame, as_of: Column) -> DataFrame:
    """Per niche: active and expired signals, a hash of the set of expired ids (a signal_id counts once) and whether to collect again.

    No row holds a niche's ids; ``expired_ids`` has them, a row each.
    """
    once = partition(signals, as_of).groupBy("niche_id", "signal_id").agg(F.max("expired").alias("expired"), F.count(F.when(~F.col("expired"), 1)).alias("_active"))
    n = F.count(F.when(F.col("expired"), 1))
    return once.groupBy("niche_id").agg(F.sum("_active").alias("n_active"), n.alias("n_expired"), merged_set_hash(F.col("signal_id"), F.col("expired")).alias("expired_set"), (n > 0).alias("needs_recollection"))


def expired_ids(signals: DataFrame, as_of: Column) -> DataFrame:
    """(niche_id, signal_id) of expired signals, each once."""
    return partition(signals, as_of).filter("expired").select("niche_id", "signal_id").distinct()


def evaluate_listed(signals: DataFrame, as_of: Column) -> DataFrame:
    """Per niche: active signals, sorted expired ids in one row and whether to collect again; for niches of few signals."""
    p = partition(signals, as_of)
    ids = F.array_sort(F.collect_list(F.when(F.col("expired"), F.col("signal_id"))))
    return p.groupBy("niche_id").agg(F.count(F.when(~F.col("expired"), 1)).alias("n_active"), ids.alias("expired_ids")).withColumn("needs_recollection", F.size("expired_ids") > 0)


def stale_opportunities(opportunities: DataFrame, signals: DataFrame, as_of: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """Add ``stale``: the time to live is over, or a signal used is expired; unknown signals don't count."""
    used = opportunities.select("opportunity_id", F.explode("scored_from").alias("signal_id"))
    old = used.join(signals.select("signal_id", "expires_at"), "signal_id").groupBy("opportunity_id").agg(F.max(is_expired(as_of)).alias("_old"))
    over = as_of >= F.col("as_of") + F.make_dt_interval(F.lit(ttl_days))
    return opportunities.join(old, "opportunity_id", "left").withColumn("stale", over | F.coalesce("_old", F.lit(False))).drop("_old")


def apply_expiry(stale: DataFrame) -> DataFrame:
    return stale.withColumn("status", F.when(F.col("stale"), "EXPIRED").otherwise(F.col("status")))


def _tasks(keyed: DataFrame) -> DataFrame:
    task = F.sha2(F.concat_ws("|", F.lit("recollect"), "job_id", "query_spec_id"), 256)
    return keyed.select("niche_id", "query_spec_id", F.concat(F.lit("tsk_rec_"), F.substring(task, 1, 12)).alias("task_id"), F.concat(F.lit("idem_rec_"), F.col("_key")).alias("idempotency_key"), F.lit("search").alias("lane"))


def recollection(evaluated: DataFrame, queries: DataFrame) -> DataFrame:
    """A task for each query (job_id, niche_id, query_spec_id) of each niche with expired signals; keys depend on the set of ids alone.

    ``evaluated`` comes from ``evaluate``; ``recollection_listed`` hashes the sorted ids themselves.
    """
    j = evaluated.filter("needs_recollection").join(queries, "niche_id")
    return _tasks(j.withColumn("_key", F.sha2(F.concat_ws("|", F.lit("recollect"), "expired_set", "query_spec_id"), 256)))


def recollection_listed(signals: DataFrame, as_of: Column, queries: DataFrame) -> DataFrame:
    """Like ``recollection``, with keys over the sorted expired ids of the niche, joined by ``|``, and the query.

    The ids of a niche stream, sorted, through one SHA-256; each query goes on from a copy of
    its state. So no row holds a niche's ids, and they are read once, however many queries there are.
    """
    ids = partition(signals, as_of).filter(F.col("expired") & F.col("signal_id").isNotNull())
    shape = lambda df, kind, job, id: df.filter(F.col("niche_id").isNotNull()).select("niche_id", F.lit(kind).alias("kind"), F.col(id).cast("string").alias("id"), job.cast("string").alias("job_id"))
    rows = shape(ids, 0, F.lit(None), "signal_id").unionByName(shape(queries, 1, F.col("job_id"), "query_spec_id"))
    rows = rows.repartition("niche_id").sortWithinPartitions("niche_id", "kind", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        niche, head, some = None, hashlib.sha256(), False
        for b in batches:
            for (here, kind), g in b.groupby(["niche_id", "kind"], sort=False):  # sorted: each comes in one run
                if here != niche:
                    niche, head, some = here, hashlib.sha256(b"recollect"), False
                if kind == 0:
                    head.update(("|" + "|".join(g["id"])).encode())
                    some = True
                elif some:
                    keys = []
                    for q in g["id"]:
                        h = head.copy()
                        h.update(b"" if q is None else f"|{q}".encode())
                        keys.append(h.hexdigest())
                    yield pd.DataFrame({"niche_id": here, "job_id": g["job_id"], "query_spec_id": g["id"], "_key": keys})

    return _tasks(rows.mapInPandas(run, "niche_id string, job_id string, query_spec_id string, _key string"))


def recollection_edges(tasks: DataFrame, expired: DataFrame) -> DataFrame:
    """Edges of recollection tasks to their query and to the expired signals (``expired_ids``) of their niche, a row each.

    Their number is that of tasks times signals of each niche; ``recollection_edge_counts`` needs none of them.
    """
    edge = lambda kind, parent: [F.lit("task").alias("child_kind"), F.col("task_id").alias("child_id"), F.lit(kind).alias("parent_kind"), F.col(parent).alias("parent_id"), F.lit("recollect_for").alias("relation")]
    return tasks.join(expired, "niche_id").select(*edge("signal", "signal_id")).unionByName(tasks.select(*edge("query_spec", "query_spec_id")))


def recollection_edge_counts(tasks: DataFrame, expired: DataFrame) -> DataFrame:
    """(task_id, parent_kind, n, first_id, last_id): the edges of ``recollection_edges`` per task and kind, all counted.

    A niche's signals shrink to their number, first and last before they meet its tasks.
    """
    of = lambda parent: [F.count("*").alias("n"), F.min(parent).alias("first_id"), F.max(parent).alias("last_id")]
    signals = tasks.join(expired.groupBy("niche_id").agg(*of("signal_id")), "niche_id").select("task_id", F.lit("signal").alias("parent_kind"), "n", "first_id", "last_id")
    specs = tasks.select("task_id", F.lit("query_spec").alias("parent_kind"), F.lit(1).cast("long").alias("n"), F.col("query_spec_id").alias("first_id"), F.col("query_spec_id").alias("last_id"))
    return signals.unionByName(specs).groupBy("task_id", "parent_kind").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))


def profile(candidates: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """margin_potential, shipping_fit and channel_fit: embedded values, overridden by external ones, filled by defaults."""
    j = candidates
    cols = ("margin_potential", "shipping_fit", "community_reachability")
    if external is not None:
        j = j.join(external.select("candidate_id", *[F.col(c).alias(f"x_{c}") for c in cols]), "candidate_id", "left")
    else:
        j = j.withColumns({f"x_{c}": F.lit(None).cast("int") for c in cols})
    chosen = {c: F.coalesce(F.col(f"x_{c}"), F.col(c), F.lit(DEFAULT_LEVEL)) for c in cols}
    return j.withColumns({"margin_potential": chosen["margin_potential"], "shipping_fit": chosen["shipping_fit"], "channel_fit": chosen["community_reachability"]}).drop(*[f"x_{c}" for c in cols])


def fit() -> Column:
    """Weighted geometric mean of the levels over 5, to 4 places; null if one is 0."""
    logs = sum((w * F.ln(F.col(c) / 5) for c, w in FIT_WEIGHTS.items()), F.lit(0.0))
    positive = F.lit(True)
    for c in FIT_WEIGHTS:
        positive = positive & (F.col(c) > 0)
    return F.when(positive, F.round(F.exp(logs / sum(FIT_WEIGHTS.values())), 4))


def blend(score: Column, fitted: Column) -> Column:
    return F.round(OPPORTUNITY_SHARE * score + FIT_SHARE * fitted, 6)


def rerank(opportunities: DataFrame, group: str = "niche_id") -> DataFrame:
    """Add fit_score, passes, blend and rank (1 first) within each decision group."""
    j = opportunities.withColumn("fit_score", fit())
    j = j.withColumns({"passes": F.coalesce(F.col("fit_score") >= MIN_FIT, F.lit(False)), "blend": blend(F.col("score"), F.col("fit_score"))})
    return ranked(j, [group], [F.desc("blend"), F.desc("score"), "opportunity_id"]).withColumn("rank", F.col("rank").cast("int"))


def band(score: Column) -> Column:
    """The action of the band that holds score * 100; null in the gaps between bands."""
    pct = score * 100.0
    return F.when(pct < 50, REJECT).when(pct.between(50, 64.99), CONTINUE).when(pct.between(65, 79.99), EXPERIMENT).when(pct >= 80, PRIORITY)


def actions(ranked: DataFrame, group: str = "niche_id") -> DataFrame:
    """One row per group: action, max_queries, top opportunity, parents in rank order. One shuffle, no window over all."""
    top = F.min_by(F.struct("opportunity_id", "score", "passes", (F.size("coverage_gaps") > 0).alias("has_gaps")), "rank").alias("top")
    parents = F.transform(F.array_sort(F.collect_list(F.struct("rank", "opportunity_id"))), lambda x: x["opportunity_id"])
    g = ranked.groupBy(group).agg(F.max("passes").alias("any_pass"), top, parents.alias("derived_from"))
    act = band(F.col("top.score"))
    wide = ~F.col("any_pass") | F.col("top.has_gaps")
    action = F.when(wide, "expand").when(~F.col("top.passes"), "stop").when(act.isin(EXPERIMENT, PRIORITY), "synthesize").when(act == CONTINUE, "expand").when(act == REJECT, "stop").otherwise("ERR_NO_BAND")
    queries = F.when(wide, 10).when((action == "expand"), 5)
    return g.select(group, action.alias("action"), queries.alias("max_queries"), F.col("top.opportunity_id").alias("top_id"), "derived_from")


def build(acted: DataFrame, config_hash: str, group: str = "niche_id") -> DataFrame:
    """Decision rows; the id is a hash of action, arguments and parents."""
    body = F.to_json(F.struct("action", F.struct("max_queries", group).alias("args"), F.lit(config_hash).alias("config_hash"), "derived_from"))
    return acted.select(F.concat(F.lit("dec_"), F.substring(F.sha2(body.cast("binary"), 256), 1, 12)).alias("decision_id"), group, "action", "max_queries", "top_id", "derived_from", F.lit(config_hash).alias("config_hash"))


def edges(decisions: DataFrame) -> DataFrame:
    return decisions.select(F.lit("decision").alias("child_kind"), F.col("decision_id").alias("child_id"), F.lit("opportunity").alias("parent_kind"), F.explode("derived_from").alias("parent_id"), F.lit("decided_from").alias("relation"))


def pain_shortlist(cited: DataFrame) -> DataFrame:
    """Cited ids that name pain evidence, or all of them if there is none, numbered pp_001 on."""
    pain = F.filter("cited", lambda x: x.startswith("ev_") & F.contains(x, F.lit("pain")))
    chosen = F.when(F.size(pain) > 0, pain).otherwise(F.col("cited"))
    return cited.select("opportunity_id", F.posexplode(chosen).alias("i", "record_id")).select("opportunity_id", F.format_string("pp_%03d", F.col("i") + 1).alias("pain_point_id"), "record_id")
