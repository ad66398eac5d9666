"""Queries on evidence, set checks and second-wave operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import evidence as E
from sparkloom.operators import keys, near, season
from sparkloom.operators import profiles as R
from sparkloom.operators import signals as S
from sparkloom.operators import vectors as V
from sparkloom.operators.dq import Rule
from sparkloom.sources.shared import cut, new_folder

from . import bindings as B
from .catalog import register
from .q_decide import set_hash_sql
from .q_tables import _EV, evidence

R6 = lambda c: F.round(c, 6)
_POL = "CASE WHEN quality IS NULL THEN 'neutral' WHEN quality = 1 AND toxic = 0 THEN 'supporting' ELSE 'contradicting' END"


def _finalized(spark, d):
    e = evidence(spark, d).select("doc_id", F.lit("demand").alias("evidence_type"), F.col("lang").alias("observation"), "polarity", "source", F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("pg_"), F.col("doc_id").cast("string")))).otherwise(F.array(F.lit("pg_x"))).alias("derived_from"), F.concat(F.lit("pg_"), F.col("doc_id").cast("string")).alias("page_id"))
    return E.finalize(e)


@register("ev_finalize", f"WITH {_EV} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'pg_' || doc_id ELSE 'pg_' || doc_id || ';pg_x' END AS derived_from, 'sha256:' || sha256('{{\"evidence_type\":\"demand\",\"observation\":\"' || lang || '\",\"polarity\":\"' || polarity || '\",\"source\":\"' || source || '\"}}') AS content_hash FROM ev")
def ev_finalize(spark, d):
    return _finalized(spark, d).select("doc_id", F.array_join("derived_from", ";").alias("derived_from"), "content_hash")


@register("ev_route", f"WITH {_EV}, v AS (SELECT doc_id, concat_ws(',', CASE WHEN polarity = 'neutral' THEN 'polarity' END, CASE WHEN source = '' THEN 'source' END, CASE WHEN length(text) < 200 THEN 'text' END) AS v FROM ev) SELECT doc_id, CASE WHEN v = '' THEN 'evidence' ELSE 'repair' END AS route, v AS violations, CASE WHEN v <> '' THEN 'tsk_repair_' || substr(sha256('repair|' || doc_id || '|' || v), 1, 12) END AS task_id FROM v")
def ev_route(spark, d):
    rules = [Rule("polarity", "error", F.col("polarity") != "neutral"), Rule("text", "error", F.length("text") >= 200), Rule("source", "error", F.col("source") != "")]
    good, repair = E.route(evidence(spark, d), rules, "doc_id")
    none = F.lit(None).cast("string")
    return good.select("doc_id", F.lit("evidence").alias("route"), F.lit("").alias("violations"), none.alias("task_id")).unionByName(repair.select(F.col("record_id").cast("long").alias("doc_id"), F.lit("repair").alias("route"), F.array_join("violations", ",").alias("violations"), "task_id"))


@register("ev_replay_join", "WITH q AS (SELECT conv_id, turn, sha256(text) AS h FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, text AS response FROM conversations WHERE role = 'assistant') SELECT q.conv_id, q.turn, CASE WHEN response IS NULL THEN 'MISSING' ELSE 'OK' END AS status, coalesce(length(response), 0) AS n FROM q LEFT JOIN a ON q.conv_id = a.conv_id AND q.turn = a.turn")
def ev_replay_join(spark, d):
    c = B.table(spark, d, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", "turn")
    said = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return E.replay(asked, said, ["conv_id", "turn"]).select("conv_id", "turn", "status", F.coalesce(F.length("response"), F.lit(0)).cast("long").alias("n"))


@register("ev_index_text", f"WITH {_EV} SELECT doc_id, trim(lang) || chr(10) || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || polarity ELSE '' END AS index_text FROM ev")
def ev_index_text(spark, d):
    x = E.index_text(F.concat(F.lit(" "), F.col("lang")), F.array("source", F.lit("  ")), F.when(F.col("doc_id") % 2 == 0, F.array("polarity")))
    return evidence(spark, d).select("doc_id", x.alias("index_text"))


@register("ev_index_payload", f"WITH {_EV} SELECT 'ev_' || doc_id AS record_id, polarity, lang AS observation, source AS source_domain, 'evidence.v1' AS schema_version FROM ev")
def ev_index_payload(spark, d):
    p = F.struct(F.concat(F.lit("ev_"), F.col("doc_id").cast("string")).alias("record_id"), "polarity", F.col("lang").alias("observation"), F.col("source").alias("source_domain"), F.lit("evidence.v1").alias("schema_version"))
    return evidence(spark, d).select(p.alias("p")).select("p.*")


@register("ev_upsert_vectors", "WITH v AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 2 WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END AS version, embedding FROM embeddings) SELECT substr(sha256('ev_' || vec_id), 1, 32) AS point, 'ev_' || vec_id AS record_id, CAST(version AS INTEGER) AS version, len(embedding) AS dims, round(CAST(CAST(CAST(embedding[1] AS DOUBLE) * (version + 1) AS FLOAT) AS DOUBLE), 5) AS head FROM v")
def ev_upsert_vectors(spark, d):
    # Three batches of vectors, the newest first; the table is compacted between them.
    v = B.table(spark, d, "embeddings")
    t = E.vector_table(spark, f"{new_folder(spark)}/vectors")
    for version in (2, 0, 1):
        scaled = F.transform("embedding", lambda x: x * (version + 1))
        t.upsert(E.points(v.filter(F.col("vec_id") % (version + 1) == 0).select(F.concat(F.lit("ev_"), F.col("vec_id").cast("string")).alias("record_id"), F.lit(version).alias("version"), scaled.alias("embedding"))))
        if version == 0:
            t.compact(["version"])
    return t.latest(["version"]).select("point", "record_id", "version", F.size("embedding").cast("long").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 5).alias("head"))


@register("ev_semantic_search", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def ev_semantic_search(spark, d):
    v = B.table(spark, d, "embeddings")
    return E.cosine_top_k(v, v.filter(F.col("vec_id") % 20 == 0), 10).select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


@register("ev_semantic_search_approximate")
def ev_semantic_search_approximate(spark, d):
    # Of 32 files a query looks into 25: vectors without clusters ask for most of them (recall at 10 is 0.97 at sf0.1).
    v = B.table(spark, d, "embeddings")
    centroids = V.fit(v, 32)
    return V.search(cut(V.nearest_files(v, centroids, 1)), v.filter(F.col("vec_id") % 20 == 0), centroids, 10, 25).select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


@register("ev_store_lookup", "SELECT o_orderkey, o_custkey, CASE WHEN c_custkey IS NULL THEN 'MISSING' ELSE 'OK' END AS status FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def ev_store_lookup(spark, d):
    store = B.table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("x").alias("response"))
    return E.replay(B.table(spark, d, "orders").select("o_orderkey", "o_custkey"), store, ["o_custkey"]).select("o_orderkey", "o_custkey", "status")


def _bundle(spark, d):
    e = B.table(spark, d, "events")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("job_id").orderBy("event_id"))
    return e.select((F.col("user_id")).alias("job_id"), "event_id", (1 + F.col("event_id") % 97).alias("tokens")).withColumn("rank", rank)


_BU = "bu AS (SELECT user_id AS job_id, event_id, 1 + event_id % 97 AS tokens, sum(1 + event_id % 97) OVER (PARTITION BY user_id ORDER BY event_id) <= 1000 AS included FROM events)"


@register("ev_bundle_pack", f"WITH {_BU} SELECT job_id, count(*) FILTER (included) AS included, count(*) FILTER (NOT included) AS excluded, CAST(coalesce(sum(tokens) FILTER (included), 0) AS BIGINT) AS token_total, 1000 AS max_tokens FROM bu GROUP BY job_id")
def ev_bundle_pack(spark, d):
    return E.manifest(E.pack_bundle(_bundle(spark, d), 1000), 1000)


@register("ev_sample", "SELECT doc_id, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 30 AS sampled FROM documents")
def ev_sample(spark, d):
    return B.table(spark, d, "documents").select("doc_id", E.in_sample(F.col("doc_id"), 30).alias("sampled"))


@register("ver_quorum", f"WITH {_EV} SELECT lang AS job_id, count(*) AS records, count(DISTINCT source) AS domains, count(*) >= 100 AND count(DISTINCT source) >= 10 AS passed FROM ev GROUP BY lang")
def ver_quorum(spark, d):
    return E.quorum(evidence(spark, d).select(F.col("lang").alias("job_id"), F.col("source").alias("domain")))


@register("ver_novelty", "WITH c AS (SELECT user_id AS branch, CAST(date_trunc('day', ts) AS DATE) AS round, count(DISTINCT value) AS entities, count(*) AS claims, count(DISTINCT event_type) AS domains FROM events GROUP BY ALL), n AS (SELECT *, greatest(0, entities - coalesce(lag(entities) OVER w, 0)) + greatest(0, claims - coalesce(lag(claims) OVER w, 0)) + greatest(0, domains - coalesce(lag(domains) OVER w, 0)) AS fresh FROM c WINDOW w AS (PARTITION BY branch ORDER BY round)) SELECT branch, round, round(fresh::DOUBLE / (entities + claims + domains), 6) AS novelty, fresh::DOUBLE / (entities + claims + domains) >= 0.05 AS passed FROM n")
def ver_novelty(spark, d):
    e = B.table(spark, d, "events")
    c = e.groupBy(F.col("user_id").alias("branch"), F.to_date("ts").alias("round")).agg(F.count_distinct("value").alias("entities"), F.count("*").alias("claims"), F.count_distinct("event_type").alias("domains"))
    return E.novelty(c).select("branch", "round", R6("novelty").alias("novelty"), "passed")


@register("ver_claim_grounding", "SELECT o_orderkey AS claim_id, 'no_citation' AS violation FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'unknown:x' || o_custkey FROM orders WHERE o_orderkey % 7 = 3 UNION ALL SELECT o_orderkey, 'number_differs:c' || o_custkey FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey <> o_orderkey UNION ALL SELECT o_orderkey, 'bare:' || (o_custkey + 1) FROM orders WHERE o_orderkey % 11 = 0")
def ver_claim_grounding(spark, d):
    o = B.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    # Each claim cites its customer's record, whose metric is the customer's key.
    claims = o.select(
        k.alias("claim_id"), F.concat(F.lit("value "), F.when(k % 5 == 0, k.cast("string")).otherwise(c), F.when(k % 11 == 0, F.concat(F.lit(" and "), (F.col("o_custkey") + 1).cast("string"))).otherwise("")).alias("text"),
        F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 7 == 3, F.array(F.concat(F.lit("x"), c))).otherwise(F.array(F.concat(F.lit("c"), c))).alias("cited"),
        F.array(F.struct(F.concat(F.lit("c"), c).alias("record_id"), F.when(k % 5 == 0, k.cast("string")).otherwise(c).alias("value"))).alias("numbers"),
    )
    store = B.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("record_id"), F.col("c_custkey").alias("metric_value"))
    return E.claim_violations(claims, store)


@register("ver_plan", "SELECT o_custkey AS job_id, 'budget' AS violation FROM orders GROUP BY o_custkey HAVING count(*) > 10 UNION ALL SELECT job_id, 'queries[' || i || '].platform' FROM (SELECT o_custkey AS job_id, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE p = '5-LOW'")
def ver_plan(spark, d):
    o = B.table(spark, d, "orders")
    q = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("platform"), F.lit("find").alias("text")))), lambda x: F.struct(x["platform"].alias("platform"), x["text"].alias("text")))
    plans = o.groupBy(F.col("o_custkey").alias("job_id")).agg(q.alias("queries")).withColumn("max_queries", F.lit(10))
    return E.plan_violations(plans, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"])


_REQUIRED = {"expand": ["niche_id"], "stop": [], "synthesize": ["synthesis_id"], "escalate": ["reason"]}


@register("dec_valid", "SELECT o_orderkey, concat_ws(';', CASE WHEN o_orderkey % 10 = 9 THEN 'action' END, CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 11 = 0 THEN 'cited_manifest_hash' END, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 10 <> 9 AND o_orderkey % 2 = 0 THEN 'escalate.reason' END, CASE WHEN o_orderkey % 13 = 0 THEN 'manifest_hash' END, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 10 <> 9 AND o_orderkey % 3 = 0 THEN 'synthesize.synthesis_id' END) AS violations FROM orders")
def dec_valid(spark, d):
    k = F.col("o_orderkey")
    args = F.map_from_entries(F.filter(F.array(F.struct(F.lit("niche_id").alias("k"), F.lit("n").alias("v")), F.struct(F.lit("reason").alias("k"), F.when(k % 2 != 0, "r").alias("v")), F.struct(F.lit("synthesis_id").alias("k"), F.when(k % 3 != 0, "s").alias("v"))), lambda e: e["v"].isNotNull()))
    action = F.when(k % 10 == 9, "ponder").when(F.col("o_orderstatus") == "F", "expand").when(F.col("o_orderstatus") == "O", "synthesize").otherwise("escalate")
    o = B.table(spark, d, "orders").select("o_orderkey", action.alias("action"), args.alias("args"), F.when(k % 13 != 0, "h1").otherwise("").alias("asked"), F.when(k % 11 == 0, "h0").otherwise("h1").alias("cited"))
    return o.select("o_orderkey", F.array_join(E.check_decisions(_REQUIRED, F.col("asked"), F.col("cited")), ";").alias("violations"))


def _prose(spark, d, key):
    """Turns as prose of a model: some carry a key that is not theirs, some are blank, some cite oddly, some are no object."""
    t, conv = F.col("turn"), F.col("conv_id")
    text = F.when(conv % 6 == 5, "  ").otherwise(F.col("text"))
    cited = F.when(conv % 4 == 0, F.array((conv * 7).cast("string"), (conv * 11).cast("string"))).when(conv % 4 == 1, F.array(F.lit(" "))).otherwise(F.array().cast("array<string>"))
    body = F.to_json(F.struct(text.alias("text"), cited.alias("cited_record_ids"), F.when((conv + t) % 3 == 0, 1).alias(key)))
    raw = F.when((conv + t) % 7 == 6, F.concat(F.lit("no object "), conv.cast("string"))).when(conv % 4 == 2, F.regexp_replace(body, r"\[\]", '"one"')).otherwise(body)
    return B.table(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw"))


def _prose_sql(key: str) -> str:
    marks = [f"CASE WHEN (conv_id + turn) % 3 = 0 THEN 'forbidden:{key}' END", "CASE WHEN conv_id % 6 = 5 OR trim(text) = '' THEN 'text' END", "CASE WHEN conv_id % 4 = 2 THEN 'cited' END", "CASE WHEN conv_id % 4 = 1 THEN 'cited_empty' END"]
    return f"CASE WHEN (conv_id + turn) % 7 = 6 THEN ['json'] ELSE list_sort(list_filter([{', '.join(marks)}], lambda x: x IS NOT NULL)) END"


@register("dec_rationale_check", f"SELECT conv_id, turn, array_to_string({_prose_sql('rank')}, ';') AS violations FROM conversations")
def dec_rationale_check(spark, d):
    return _prose(spark, d, "rank").select("conv_id", "turn", F.array_join(E.prose_violations(F.col("raw"), E.RATIONALE_FORBIDDEN), ";").alias("violations"))


@register("explain_validate", f"SELECT conv_id * 1000 + turn AS explanation_id, unnest({_prose_sql('score')}) AS violation FROM conversations UNION ALL SELECT id, 'unknown:' || t FROM (SELECT conv_id * 1000 + turn AS id, unnest(list_distinct([conv_id * 7, conv_id * 11])) AS t FROM conversations WHERE conv_id % 4 = 0 AND (conv_id + turn) % 7 <> 6) WHERE t NOT IN (SELECT doc_id FROM documents)")
def explain_validate(spark, d):
    p = _prose(spark, d, "score").select((F.col("conv_id") * 1000 + F.col("turn")).alias("explanation_id"), "raw")
    return E.explanation_violations(p, "explanation_id", "raw", B.table(spark, d, "documents").select(F.col("doc_id").alias("record_id")))


@register("explain_attach", f"{B.ALL}, e AS (SELECT *, CAST(substr(niche_id, 7) AS INTEGER) AS k FROM opp WHERE status = 'OK') SELECT 'opp_' || replace(niche_id, '-', '_') AS opportunity_id, score, CASE WHEN k % 5 = 4 THEN 'NO_EXPLANATION' WHEN k % 3 = 0 OR k % 4 = 0 THEN 'ERR_CHANGED' ELSE 'OK' END AS status, CASE WHEN k % 5 = 4 THEN '' ELSE concat_ws(';', CASE WHEN k % 3 = 0 THEN 'score' END, CASE WHEN k % 4 = 0 THEN 'scored_from' END) END AS changed, CASE WHEN k % 5 <> 4 AND k % 3 <> 0 AND k % 4 <> 0 THEN 'Niche ' || niche_id || ' scores ' || printf('%.2f', score) END AS explanation FROM e")
def explain_attach(spark, d):
    from sparkloom.operators import score as P

    # The explainer's copies: some changed the score, some the signals, some gave nothing.
    o = cut(P.build(P.score(B.signals(spark, d), B.as_of()), B.as_of(), "sha256:test"))
    k = F.substring("niche_id", 7, 9).cast("int")
    theirs = o.filter(k % 5 != 4).withColumns({"explanation": F.format_string("Niche %s scores %.2f", "niche_id", "score"), "score": F.when(k % 3 == 0, F.col("score") + 1).otherwise(F.col("score")), "scored_from": F.when(k % 4 == 0, F.array(F.lit("x"))).otherwise(F.col("scored_from"))})
    return P.attach_explanations(o, theirs).select("opportunity_id", "score", F.col("explanation_status").alias("status"), F.array_join("changed", ";").alias("changed"), "explanation")


# Second wave


_KIND = "['complaint', 'workaround', 'competitor_review', 'price', 'risk_review', 'falsification', 'note']"
_GATE = {n: (None if k is None else k, {"observation_id": "doc_id", "independence_group": "source || lang", "source_class": "source", "product": "doc_id % 5", "seller": "doc_id % 4"}[c], m) for n, (k, c, m) in E.GATES.items()}


@register("gate_hard_evidence", f"WITH {_EV}, k AS (SELECT *, {_KIND}[(doc_id // 37 + doc_id % 37 % 4) % 7 + 1] AS kind FROM ev), g AS (SELECT candidate_id, " + ", ".join(f"count(DISTINCT {c})" + ("" if k is None else f" FILTER (kind = '{k}')") + f" AS {n}" for n, (k, c, _) in _GATE.items()) + " FROM k GROUP BY candidate_id) SELECT *, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {n} < {m} THEN '{n}' END" for n, (_, _, m) in _GATE.items()) + "], lambda x: x IS NOT NULL), ';') AS failed, " + " AND ".join(f"{n} >= {m}" for n, (_, _, m) in _GATE.items()) + " AS promote FROM g")
def gate_hard_evidence(spark, d):
    k = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("complaint", "workaround", "competitor_review", "price", "risk_review", "falsification", "note")]), ((F.floor(k / 37) + k % 37 % 4) % 7 + 1).cast("int"))
    e = evidence(spark, d).select("candidate_id", kind.alias("kind"), k.alias("observation_id"), F.concat("source", "lang").alias("independence_group"), F.col("source").alias("source_class"), (k % 5).alias("product"), (k % 4).alias("seller"))
    return E.hard_gates(e).withColumn("failed", F.array_join("failed", ";"))


@register("comp_composite", f"WITH {B.RAW}, m AS (SELECT niche_id, avg(value) FILTER (event_id % 2 = 0) AS listing_density, avg(value) FILTER (event_id % 2 <> 0) AS ad_intensity FROM raw WHERE signal_type = 'competition' AND (niche_id <> 'niche-4' OR event_id % 2 = 0) GROUP BY niche_id), c AS (SELECT *, 0.6::DOUBLE * listing_density + 0.4::DOUBLE * ad_intensity AS composite FROM m), n AS (SELECT count(composite) AS n FROM c), ed AS (SELECT *, row_number() OVER (ORDER BY composite) AS i FROM c WHERE composite IS NOT NULL), hi AS (SELECT composite AS v, i FROM ed, n WHERE i = CAST(floor(0.95::DOUBLE * (n - 1)) AS BIGINT) + 1), lo AS (SELECT composite AS v, i FROM ed, n WHERE i = CAST(floor(0.05::DOUBLE * (n - 1)) AS BIGINT) + 1) SELECT c.niche_id, round(c.composite, 6) AS composite, round((CASE WHEN ed.i > hi.i THEN hi.i WHEN ed.i < lo.i THEN lo.i ELSE ed.i END - 1)::DOUBLE / (n.n - 1), 6) AS percentile, CASE WHEN c.composite IS NULL THEN 'ERR_MISSING_COMPONENT' ELSE 'OK' END AS status FROM c LEFT JOIN ed USING (niche_id), n, hi, lo")
def comp_composite(spark, d):
    r = B.raw_signals(spark, d).filter("signal_type = 'competition' AND (niche_id <> 'niche-4' OR event_id % 2 = 0)")
    parts = r.select("niche_id", F.when(F.col("event_id") % 2 == 0, "listing_density").otherwise("ad_intensity").alias("metric_name"), "value")
    return S.competition_composite(parts).select("niche_id", R6("composite").alias("composite"), R6("percentile").alias("percentile"), "status")


@register("bundle_mmr", f"WITH {_EV}, m AS (SELECT lang AS job_id, doc_id AS record_id, 0.6 * ((doc_id * 37 % 101) / 100.0::DOUBLE) + 0.2 * ((doc_id % 13) / 13.0::DOUBLE) + 0.2 / row_number() OVER (PARTITION BY lang, source ORDER BY (doc_id * 37 % 101) / 100.0::DOUBLE DESC, doc_id) AS mmr FROM ev) SELECT job_id, record_id, round(mmr, 6) AS mmr, CAST(row_number() OVER (PARTITION BY job_id ORDER BY round(mmr, 9) DESC, record_id) AS INTEGER) AS rank FROM m")
def bundle_mmr(spark, d):
    r = evidence(spark, d).select(F.col("lang").alias("job_id"), F.col("doc_id").alias("record_id"), F.col("source").alias("domain"), ((F.col("doc_id") * 37 % 101) / 100.0).alias("relevance"), ((F.col("doc_id") % 13) / 13.0).alias("recency"))
    return E.mmr(r).select("job_id", "record_id", R6("mmr").alias("mmr"), "rank")


def _rollup_sql(kind: str, column: str) -> str:
    return f"SELECT '{kind}' AS cluster_kind, {column} AS cluster, count(*) AS n, round(avg(doc_id % 3 - 1), 6) AS sentiment, count(*) FILTER (doc_id % 3 = 0) AS negative, count(*) FILTER (doc_id % 3 = 1) AS neutral, count(*) FILTER (doc_id % 3 = 2) AS positive, array_to_string(list_sort(list(doc_id))[1:3], ';') AS exemplars FROM ev GROUP BY {column}"


@register("ev_rollup", f"WITH {_EV}, g AS ({' UNION ALL '.join(_rollup_sql(k, k) for k in ('source', 'lang', 'polarity'))}) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cluster_kind ORDER BY n DESC, cluster) AS INTEGER) AS rank FROM g) WHERE rank <= 25")
def ev_rollup(spark, d):
    e = evidence(spark, d).withColumn("sentiment", F.col("doc_id") % 3 - 1)
    r = E.rollup(e, ["source", "lang", "polarity"])
    return r.withColumns({"sentiment": F.round("sentiment", 6), "exemplars": F.array_join(F.transform("exemplars", lambda x: x.cast("string")), ";")})


_ITEMS = "it AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN 'h' || (vec_id // 14) ELSE 'v' || vec_id END AS content_hash, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings UNION ALL SELECT vec_id + 1000000, 'c' || vec_id, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * (1 + 0.1::DOUBLE * (i % 2))) FROM embeddings WHERE vec_id % 3 = 0)"


@register("bundle_dedup", f"WITH RECURSIVE {_ITEMS}, rp AS (SELECT content_hash, min(id) AS id, arg_min(e, id) AS e, count(*) AS copies FROM it GROUP BY content_hash), lk AS (SELECT a.id AS a, b.id AS b FROM rp a, rp b WHERE a.id <> b.id AND list_cosine_similarity(a.e, b.e) > 0.95), re AS (SELECT id, id AS other FROM rp UNION SELECT re.id, lk.b FROM re JOIN lk ON lk.a = re.other) SELECT content_hash, rp.id, copies, min(other) AS cluster FROM rp JOIN re USING (id) GROUP BY ALL")
def bundle_dedup(spark, d):
    # Vectors as evidence: some share a hash, and every third has a bent copy.
    v = B.table(spark, d, "embeddings")
    k = F.col("vec_id")
    own = F.when(k % 7 == 0, F.concat(F.lit("h"), F.floor(k / 14).cast("string"))).otherwise(F.concat(F.lit("v"), k.cast("string")))
    bent = F.transform("embedding", lambda x, i: (x.cast("double") * (1 + 0.1 * ((i + 1) % 2))).cast("float"))
    items = v.select(k.alias("id"), own.alias("content_hash"), "embedding").unionByName(v.filter(k % 3 == 0).select((k + 1_000_000).alias("id"), F.concat(F.lit("c"), k.cast("string")).alias("content_hash"), bent.alias("embedding")))
    return near.collapse(items)


_AS_OF = "TIMESTAMP '2024-02-10 00:00:00'"


@register("profile_ewma", f"WITH RECURSIVE e AS (SELECT user_id, ts, (event_type <> 'error')::INTEGER AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT user_id, i, ts, ok::DOUBLE AS v, 1 - ok AS streak FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.ts, 0.2::DOUBLE * e.ok + 0.8::DOUBLE * r.v, CASE WHEN e.ok = 1 THEN 0 ELSE r.streak + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, round(arg_max(v, i), 6) AS ewma, max(i) AS n, CAST(arg_max(streak, i) AS BIGINT) AS failure_streak, {_AS_OF} >= max(ts) + INTERVAL 14 DAYS OR arg_max(streak, i) >= 3 AS reprobe FROM r GROUP BY user_id")
def profile_ewma(spark, d):
    log = B.table(spark, d, "events").select(F.col("user_id").alias("domain"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").cast("int").alias("ok"))
    p = R.success_profiles(log, F.lit("2024-02-10 00:00:00").cast("timestamp"))
    return p.select(F.col("domain").alias("user_id"), R6("ewma").alias("ewma"), "n", "failure_streak", "reprobe")


@register("parser_demotion", f"WITH {_EV} SELECT source, lang, round(avg((length(text) >= 200)::INTEGER), 6) AS ratio, avg((length(text) >= 200)::INTEGER) < 0.9 AS demote FROM ev GROUP BY ALL")
def parser_demotion(spark, d):
    return R.parser_demotions(evidence(spark, d), ["source", "lang"], F.length("text") >= 200).withColumn("ratio", F.round("ratio", 6))


_SEASONS = "ca AS (SELECT n_nationkey AS season_id, 'region-' || n_regionkey AS region, CASE WHEN n_nationkey % 2 = 0 THEN 'northern' ELSE 'southern' END AS hemisphere, CASE WHEN n_nationkey = 7 THEN '02-31' ELSE lpad(CAST(1 + n_nationkey % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + n_nationkey AS VARCHAR), 2, '0') END AS window_start, 56 + 7 * (n_nationkey % 9) AS purchase_lead_days, 42 + 7 * (n_nationkey % 7) AS content_lead_days, CASE WHEN n_nationkey % 5 <> 0 THEN 30 + 11 * (n_nationkey % 8) END AS supplier_lead_days FROM nation), sg AS (SELECT s_nationkey AS season_id, 'region-' || n_regionkey AS region, CASE WHEN (s_nationkey + (s_suppkey % 5 = 0)::INTEGER) % 2 = 0 THEN 'northern' ELSE 'southern' END AS hemisphere, 'src-' || s_suppkey % 4 AS source FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@register("season_decision_date", f"WITH {_SEASONS}, sn AS (SELECT season_id, region, hemisphere, count(DISTINCT source) AS n FROM sg GROUP BY ALL), u AS (SELECT ca.*, TRY_CAST('2026-' || window_start AS DATE) AS use_start, coalesce(n, 0) AS n_signals FROM ca LEFT JOIN sn USING (season_id, region, hemisphere)) SELECT season_id, use_start, CAST(use_start - CAST(greatest(purchase_lead_days, content_lead_days, coalesce(supplier_lead_days, 0)) AS INTEGER) AS DATE) AS decide_by, n_signals, n_signals >= 2 AS confirmed, CASE WHEN use_start IS NULL THEN 'ERR_WINDOW' WHEN n_signals < 2 THEN 'UNCONFIRMED' ELSE 'OK' END AS status FROM u")
def season_decision_date(spark, d):
    # A calendar by nation (one window is no date), and suppliers as sources that saw a season, some in the other hemisphere.
    k, n = F.col("n_nationkey"), B.table(spark, d, "nation")
    region = F.concat(F.lit("region-"), F.col("n_regionkey").cast("string"))
    side = lambda x: F.when(x % 2 == 0, "northern").otherwise("southern")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    calendar = n.select(k.alias("season_id"), region.alias("region"), side(k).alias("hemisphere"), F.when(k == 7, "02-31").otherwise(F.concat(two(1 + k % 12), F.lit("-"), two(1 + k))).alias("window_start"), (56 + 7 * (k % 9)).alias("purchase_lead_days"), (42 + 7 * (k % 7)).alias("content_lead_days"), F.when(k % 5 != 0, 30 + 11 * (k % 8)).alias("supplier_lead_days"))
    s = B.table(spark, d, "supplier").join(n, F.col("s_nationkey") == k)
    signals = s.select(F.col("s_nationkey").alias("season_id"), region.alias("region"), side(F.col("s_nationkey") + (F.col("s_suppkey") % 5 == 0).cast("int")).alias("hemisphere"), F.concat(F.lit("src-"), (F.col("s_suppkey") % 4).cast("string")).alias("source"))
    return season.decision_dates(calendar, signals, 2026).select("season_id", "use_start", "decide_by", "n_signals", "confirmed", "status")


@register("signal_key", f"WITH {B.RAW}, r AS (SELECT DISTINCT niche_id, signal_type, record_id FROM raw) SELECT niche_id, signal_type, sha256(concat_ws('|', niche_id, signal_type, 'normalize-1', {set_hash_sql('record_id')})) AS key FROM r GROUP BY niche_id, signal_type")
def signal_key(spark, d):
    return keys.signal_keys(B.raw_signals(spark, d), S.CODE_VERSION)


@register("signal_key_listed", f"WITH {B.RAW} SELECT niche_id, signal_type, sha256(concat_ws('|', niche_id, signal_type, 'normalize-1', sha256(ids))) AS key FROM (SELECT niche_id, signal_type, string_agg(DISTINCT record_id, ',' ORDER BY record_id) AS ids FROM raw GROUP BY ALL)")
def signal_key_listed(spark, d):
    return keys.signal_keys(B.raw_signals(spark, d), S.CODE_VERSION, listed=True)


@register("opportunity_key", f"WITH {B.SIG}, {B.BEST}, {B.AXES} SELECT niche_id, sha256(concat_ws('|', niche_id, 'score-1', 'w-1', sha256(array_to_string(list_sort(string_split(scored_from, ';')), ',')))) AS key FROM ax")
def opportunity_key(spark, d):
    from sparkloom.operators import score as P

    return keys.opportunity_keys(P.pivot_axes(P.best_signals(B.signals(spark, d))), "score-1", "w-1")


_NOV = {"entities": "floor(value)", "claims": "event_type || floor(value / 4)", "domains": "event_id % 23"}


@register("novelty_100", "WITH f AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, " + ", ".join(f"(row_number() OVER (PARTITION BY user_id, {x} ORDER BY ts, event_id) = 1)::INTEGER AS new_{k}" for k, x in _NOV.items()) + " FROM events), s AS (SELECT user_id, event_id, place, " + ", ".join(f"avg(new_{k}) OVER w AS novel_{k}" for k in _NOV) + " FROM f WINDOW w AS (PARTITION BY user_id ORDER BY place ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) SELECT user_id, event_id, " + ", ".join(f"round(novel_{k}, 6) AS novel_{k}" for k in _NOV) + ", place >= 100 AND novel_entities < 0.05 AND novel_claims < 0.05 AND novel_domains < 0.10 AS stop FROM s")
def novelty_100(spark, d):
    one = lambda c: F.array(c.cast("string"))
    docs = B.table(spark, d, "events").select(F.col("user_id").alias("branch"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), one(F.floor("value")).alias("entities"), one(F.concat("event_type", F.floor(F.col("value") / 4).cast("string"))).alias("claims"), one(F.col("event_id") % 23).alias("domains"))
    return R.recent_novelty(docs).select(F.col("branch").alias("user_id"), F.col("seq").alias("event_id"), *[R6(f"novel_{k}").alias(f"novel_{k}") for k in _NOV], "stop")
