"""Evidence: finalising, indexing text, vector search, packing under a budget, sampling, roll-ups and set checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.sources.tables import KeyedTable

from . import dq
from .ranks import ranked


def finalize(evidence: DataFrame, page_id: str = "page_id") -> DataFrame:
    """The page first among the parents if it is missing; a content hash of the canonical fields."""
    has = F.array_contains("derived_from", F.col(page_id))
    parents = F.when(has, F.col("derived_from")).otherwise(F.concat(F.array(page_id), F.coalesce("derived_from", F.array().cast("array<string>"))))
    body = F.to_json(F.struct("evidence_type", "observation", "polarity", "source"))
    return evidence.withColumns({"derived_from": parents, "content_hash": F.concat(F.lit("sha256:"), F.sha2(body.cast("binary"), 256))})


def index_text(observation: Column, *lists: Column) -> Column:
    """The observation and all list fields, trimmed, a line each; empty ones left out."""
    parts = F.concat(F.array(observation), *[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), "\n")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row per key: a maximum, so partial results shrink before the shuffle."""
    others = [c for c in rows.columns if c != key]
    top = F.max_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(key).agg(top.alias("_t")).select(key, "_t.*")


def vector_table(spark: SparkSession, path: str) -> KeyedTable:
    """A stored collection of vectors; ``latest(["version"])`` reads each point once."""
    return KeyedTable(spark, path, "point string, record_id string, version int, embedding array<float>", ["point"])


def points(vectors: DataFrame) -> DataFrame:
    """Vectors (record_id, version, embedding) with their point ids, which come from the record's."""
    return vectors.select(F.substring(F.sha2("record_id", 256), 1, 32).alias("point"), "record_id", "version", F.col("embedding").cast("array<float>").alias("embedding"))


#: Pairs that a task scores at once.
CELLS = 1_000_000


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest by cosine; a zero vector has score 0; ties by id.

    Exact. Queries come in blocks of at most ``block``, so what is broadcast is
    bounded; a task scores ``CELLS`` pairs at once and keeps the k best per query before anything shuffles.
    """
    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // block))
    found = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        rows = part.collect()
        if not rows and found is not None:
            continue
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        q = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1 if rows else 0)
        shared = spark.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def near(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best_id, best = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
            tile = max(k, CELLS // max(1, len(ids)))
            for v in batches if len(ids) else ():
                for at in range(0, len(v), tile):  # so many scores at once, however large a batch is
                    some = v.iloc[at : at + tile]
                    x = np.stack(some["embedding"].to_numpy()).astype(np.float64)
                    size = np.linalg.norm(x, axis=1)
                    s = np.where(size > 0, q @ (x / np.maximum(size, 1e-300)[:, None]).T, 0.0)
                    vid = np.broadcast_to(some["vec_id"].to_numpy(np.int64), s.shape)
                    best_id, best = np.concatenate([best_id, vid], axis=1), np.concatenate([best, s], axis=1)
                    order = np.lexsort((best_id, -np.round(best, 9)), axis=1)[:, :k]
                    best_id, best = np.take_along_axis(best_id, order, 1), np.take_along_axis(best, order, 1)
            if best.size:
                yield pd.DataFrame({"query_id": np.repeat(ids, best.shape[1]), "vec_id": best_id.ravel(), "score": best.ravel()})

        one = vectors.select("vec_id", "embedding").mapInPandas(near, "query_id long, vec_id long, score double")
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def pack_bundle(records: DataFrame, budget: int) -> DataFrame:
    """Add ``included``: the records of a job in rank order up to the first that overflows the token budget.

    Tokens are at least 1, so the running sum is over the budget from then on.
    Only ``budget`` records a job can be included; later ranks need no sum.
    """
    running = F.sum("tokens").over(Window.partitionBy("job_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    able = records.filter(F.col("rank") <= budget).withColumn("included", running <= budget)
    rest = records.filter(F.col("rank") > budget).withColumn("included", F.lit(False))
    return able.unionByName(rest)


def manifest(packed: DataFrame, budget: int) -> DataFrame:
    return packed.groupBy("job_id").agg(F.count(F.when(F.col("included"), 1)).alias("included"), F.count(F.when(~F.col("included"), 1)).alias("excluded"), F.coalesce(F.sum(F.when(F.col("included"), F.col("tokens"))), F.lit(0)).cast("long").alias("token_total"), F.lit(budget).alias("max_tokens"))


def in_sample(record_id: Column, rate: int) -> Column:
    """A fixed share of ids: the first 8 hex digits of their SHA-256, mod 100, under ``rate``."""
    return (F.conv(F.substring(F.sha2(record_id.cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("long") % 100) < rate


def replay(requests: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded responses by exact key, with status ``MISSING`` where there is none."""
    return requests.join(responses, keys, "left").withColumn("status", F.when(F.col("response").isNull(), "MISSING").otherwise("OK"))


def rollup(evidence: DataFrame, keys: list[str], most: int = 25, exemplars: int = 3) -> DataFrame:
    """The ``most`` largest clusters of each key: count, mean sentiment, how many are negative, neutral and positive, and the first exemplars.

    Evidence is read once for all keys. A null sentiment counts in none of the three.
    """
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("cluster_kind"), F.col(k).cast("string").alias("cluster")) for k in keys]))
    long = evidence.select(every.alias("c"), "sentiment", "evidence_id").select("c.*", "sentiment", "evidence_id")
    sign = lambda ok: F.count(F.when(ok, 1))
    g = long.groupBy("cluster_kind", "cluster").agg(F.count("*").alias("n"), F.avg("sentiment").alias("sentiment"), sign(F.col("sentiment") < 0).alias("negative"), sign(F.col("sentiment") == 0).alias("neutral"), sign(F.col("sentiment") > 0).alias("positive"))
    rank = F.row_number().over(Window.partitionBy("cluster_kind").orderBy(F.desc("n"), "cluster"))
    top = g.withColumn("rank", rank).filter(F.col("rank") <= most)
    nth = F.row_number().over(Window.partitionBy("cluster_kind", "cluster").orderBy("evidence_id"))
    few = long.select("cluster_kind", "cluster", "evidence_id").withColumn("_k", nth).filter(F.col("_k") <= exemplars)  # tasks keep the first few before they shuffle
    shown = few.groupBy("cluster_kind", "cluster").agg(F.array_sort(F.collect_list("evidence_id")).alias("exemplars"))
    return top.join(shown, top["cluster_kind"].eqNullSafe(shown["cluster_kind"]) & top["cluster"].eqNullSafe(shown["cluster"])).select(*[top[c] for c in top.columns], "exemplars")


def quorum(records: DataFrame, least_records: int = 100, least_domains: int = 10) -> DataFrame:
    g = records.groupBy("job_id").agg(F.count("*").alias("records"), F.count_distinct("domain").alias("domains"))
    return g.withColumn("passed", (F.col("records") >= least_records) & (F.col("domains") >= least_domains))


def novelty(counts: DataFrame, floor: float = 0.05, dimensions: tuple[str, ...] = ("entities", "claims", "domains")) -> DataFrame:
    """Per (branch, round): new items over all items after the round, against the round before."""
    w = Window.partitionBy("branch").orderBy("round")
    new = sum((F.greatest(F.lit(0), F.col(d) - F.coalesce(F.lag(d).over(w), F.lit(0))) for d in dimensions), F.lit(0))
    after = sum((F.col(d) for d in dimensions), F.lit(0))
    c = counts.withColumn("novelty", F.when(after > 0, new / after).otherwise(0.0))
    return c.withColumn("passed", F.col("novelty") >= floor)


def claim_violations(claims: DataFrame, store: DataFrame) -> DataFrame:
    """(claim_id, violation): unknown citations, numbers that differ from the stored metric as text, and bare numbers in the text.

    ``claims``: claim_id, text, cited array<string>, numbers array<struct<record_id, value>>; ``store``: record_id, metric_value.
    """
    none = claims.filter(F.coalesce(F.size("cited"), F.lit(0)) <= 0).select("claim_id", F.lit("no_citation").alias("violation"))
    known = store.select(F.col("record_id").alias("_id"), F.col("metric_value").cast("string").alias("_m"))
    cited = claims.select("claim_id", F.explode("cited").alias("id"))
    unknown = cited.join(known, F.col("id") == F.col("_id"), "left_anti").select("claim_id", F.concat(F.lit("unknown:"), "id").alias("violation"))
    numbers = claims.select("claim_id", F.explode("numbers").alias("n")).select("claim_id", F.col("n.record_id").alias("id"), F.col("n.value").alias("v")).join(known, F.col("id") == F.col("_id"), "left")
    wrong = numbers.filter(~F.coalesce(F.col("v") == F.col("_m"), F.lit(False))).select("claim_id", F.concat_ws(":", F.when(F.col("_id").isNull(), "number_unknown").when(F.col("_m").isNull(), "no_metric").otherwise("number_differs"), "id").alias("violation"))
    quoted = claims.select("claim_id", F.transform(F.coalesce("numbers", F.array().cast("array<struct<record_id:string,value:string>>")), lambda n: n["value"]).alias("ok"), F.explode(F.regexp_extract_all("text", F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))).alias("q"))
    bare = quoted.filter(~F.array_contains("ok", F.col("q"))).select("claim_id", F.concat(F.lit("bare:"), "q").alias("violation"))
    return none.unionByName(unknown).unionByName(wrong).unionByName(bare)


def plan_violations(plans: DataFrame, allowed: list[str]) -> DataFrame:
    """(job_id, violation): too many queries, platforms that are not allowed, blank texts."""
    many = plans.filter(F.size("queries") > F.col("max_queries")).select("job_id", F.lit("budget").alias("violation"))
    q = plans.select("job_id", F.posexplode("queries").alias("i", "q"))
    bad = q.filter(~F.coalesce(F.col("q.platform").isin(*allowed), F.lit(False))).select("job_id", F.format_string("queries[%d].platform", "i").alias("violation"))
    blank = q.filter(F.trim(F.coalesce("q.text", F.lit(""))) == "").select("job_id", F.format_string("queries[%d].text", "i").alias("violation"))
    return many.unionByName(bad).unionByName(blank)


def check_decisions(required: dict[str, list[str]], manifest_hash: Column, cited_hash: Column) -> Column:
    """Violations of a decision (action, args), sorted: no or another manifest hash, an unknown action, missing arguments."""
    known = F.col("action").isin(*required)
    marks = [F.when(~F.coalesce(F.length(manifest_hash) > 0, F.lit(False)), F.lit("manifest_hash")).when(~F.coalesce(cited_hash == manifest_hash, F.lit(False)), F.lit("cited_manifest_hash"))]
    marks += [F.when(F.col("action").isNull() | F.col("args").isNull(), F.lit("action_and_args")).when(~known, F.lit("action"))]
    marks += [F.when((F.col("action") == a) & ~F.coalesce(F.array_contains(F.map_keys("args"), x), F.lit(False)), F.lit(f"{a}.{x}")) for a, xs in required.items() for x in xs]
    return F.array_sort(F.filter(F.array(*marks), lambda x: x.isNotNull()))


# Keys that prose must not carry.
EXPLANATION_FORBIDDEN = ("score", "subscores", "normalized_score", "opp_confidence", "opportunity_id", "final", "confidence")
RATIONALE_FORBIDDEN = ("action", "args", "constraint_rank", "score", "subscores", "fit_score", "rank", "ranked_opportunity_ids", "decision_id", "normalized_score", "confidence", "opportunity_id", "final")


def prose_violations(raw: Column, forbidden: tuple[str, ...]) -> Column:
    """Violations of prose given as a JSON text with ``text`` and perhaps ``cited_record_ids``, sorted.

    ``forbidden:<key>`` for keys of scoring or routing, ``text`` if it is missing or
    blank or no string, ``cited`` if it is no array, ``cited_empty`` for blank ids, ``json`` for what is no object.
    """
    keys = F.json_object_keys(raw)
    found = F.transform(F.array_intersect(keys, F.array(*map(F.lit, forbidden))), lambda k: F.concat(F.lit("forbidden:"), k))
    text, cited = F.get_json_object(raw, "$.text"), F.get_json_object(raw, "$.cited_record_ids")
    has_list = F.coalesce(F.trim(cited).startswith("["), F.lit(False))
    ids = F.from_json(F.when(has_list, cited), "array<string>")
    marks = F.array(
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "text"), F.when(cited.isNotNull() & ~has_list, "cited"),
        F.when(F.exists(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x), F.lit("")) == ""), "cited_empty"),
    )
    return F.when(keys.isNull(), F.array(F.lit("json"))).otherwise(F.array_sort(F.concat(found, F.filter(marks, lambda x: x.isNotNull()))))


def cited_ids(raw: Column) -> Column:
    """The ids that prose cites; none if there are none."""
    return F.coalesce(F.from_json(F.get_json_object(raw, "$.cited_record_ids"), "array<string>"), F.array().cast("array<string>"))


def explanation_violations(explanations: DataFrame, key: str, raw: str, store: DataFrame) -> DataFrame:
    """(key, violation) of explanations: those of the prose, and ``unknown:<id>`` for cited records that the store lacks."""
    own = explanations.select(key, F.explode(prose_violations(F.col(raw), EXPLANATION_FORBIDDEN)).alias("violation"))
    cited = explanations.select(key, F.explode(F.array_distinct(cited_ids(F.col(raw)))).alias("_id")).filter(F.trim("_id") != "")
    lost = cited.join(store.select(F.col("record_id").cast("string").alias("_id")).distinct(), "_id", "left_anti")
    return own.unionByName(lost.select(key, F.concat(F.lit("unknown:"), "_id").alias("violation")))


def route(evidence: DataFrame, rules: list[dq.Rule], key: str, lane: str = "enrich") -> tuple[DataFrame, DataFrame]:
    """Valid rows, and a repair task (task_id, record_id, lane, violations) for each other row.

    Both come from one pass over the rules; only valid rows should be indexed.
    Materialise ``evidence`` first if both are written.
    """
    return routed(dq.with_violations(evidence, rules), key, lane)


def routed(marked: DataFrame, key: str, lane: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``violations``: those without any, and a repair task for each other."""
    broken = marked.filter(F.size("violations") > 0)
    task = F.concat(F.lit("tsk_repair_"), F.substring(F.sha2(F.concat_ws("|", F.lit("repair"), F.col(key).cast("string"), F.array_join("violations", ",")), 256), 1, 12))
    return marked.filter(F.size("violations") == 0).drop("violations"), broken.select(task.alias("task_id"), F.col(key).cast("string").alias("record_id"), F.lit(lane).alias("lane"), "violations")


def mmr(records: DataFrame, alpha: float = 0.6, beta: float = 0.2, gamma: float = 0.2) -> DataFrame:
    """Rank by relevance and recency, less a growing penalty for each further record of one domain."""
    nth = ranked(records, ["job_id", "domain"], [F.desc("relevance"), "record_id"], "_nth")
    s = nth.withColumn("mmr", alpha * F.col("relevance") + beta * F.col("recency") + gamma / F.col("_nth")).drop("_nth")
    return ranked(s, ["job_id"], [F.desc(F.round("mmr", 9)), "record_id"]).withColumn("rank", F.col("rank").cast("int"))


# What each gate counts, and its least number.
GATES = {
    "independent_complaints": ("complaint", "observation_id", 10),
    "workaround_examples": ("workaround", "independence_group", 3),
    "source_diversity": (None, "source_class", 3),
    "competitor_review_analysis": ("competitor_review", "product", 2),
    "current_price_checks": ("price", "seller", 3),
    "risk_review": ("risk_review", "observation_id", 1),
    "falsification_test": ("falsification", "observation_id", 1),
}


def hard_gates(evidence: DataFrame, gates: dict[str, tuple[str | None, str, int]] | None = None) -> DataFrame:
    """Per candidate: for each gate the number of different values of its column among rows of its kind (all kinds if None),
    the gates that fail, and promote if none does."""
    gates = gates or GATES
    counted = lambda kind, column: F.col(column) if kind is None else F.when(F.col("kind") == kind, F.col(column))
    g = evidence.groupBy("candidate_id").agg(*[F.count_distinct(counted(kind, column)).alias(n) for n, (kind, column, _) in gates.items()])
    failed = F.filter(F.array(*[F.when(F.col(n) < least, F.lit(n)) for n, (_, _, least) in gates.items()]), lambda x: x.isNotNull())
    return g.withColumn("failed", failed).withColumn("promote", F.size("failed") == 0)
