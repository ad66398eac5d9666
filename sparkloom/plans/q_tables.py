"""Queries on data quality, candidates, query packs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import candidates as K
from sparkloom.operators import dq as Q
from sparkloom.operators import score as P
from sparkloom.operators import signals as S

from . import bindings as B
from .catalog import register

DIMS = list(K.DIMENSIONS)


def candidates(spark, d):
    """Parts as candidates: level i is (key * i + size) mod 7, so that some are out of range."""
    p = B.table(spark, d, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    return p.select(
        F.concat(F.lit("nc-"), F.lpad(k.cast("string"), 3, "0")).alias("candidate_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("activity_id"), *[((k * i + s) % (7 if i == 5 else 6)).cast("int").alias(c) for i, c in enumerate(DIMS, 1)],
        F.when(F.substring("p_brand", -1, 1).isin("1", "3", "5"), "seed_prior").otherwise("evidence").alias("score_basis"), F.when(k % 3 == 0, F.concat(F.lit("ev_"), k.cast("string"))).otherwise("").alias("evidence_ids"),
        F.when(k % 2 == 0, "true").otherwise("false").alias("hard_gates_passed"), k.alias("key"),
    )


_C = "c AS (SELECT CASE WHEN p_partkey < 100 THEN 'nc-' || lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE 'nc-' || substr(CAST(p_partkey AS VARCHAR), 1, 3) END AS candidate_id, p_name AS title, p_brand AS activity_id, " + ", ".join(f"CAST((p_partkey * {i} + p_size) % {7 if i == 5 else 6} AS INTEGER) AS {c}" for i, c in enumerate(DIMS, 1)) + ", CASE WHEN right(p_brand, 1) IN ('1','3','5') THEN 'seed_prior' ELSE 'evidence' END AS score_basis, CASE WHEN p_partkey % 3 = 0 THEN 'ev_' || p_partkey ELSE '' END AS evidence_ids, p_partkey % 2 = 0 AS gate, p_partkey AS key FROM part)"
_TOT = sum(K.DIMENSIONS.values())
_WS = "CASE WHEN " + " AND ".join(f"{c} BETWEEN 0 AND 5" for c in DIMS) + " THEN 100 * (" + " + ".join(f"{c} * {w}::DOUBLE" for c, w in K.DIMENSIONS.items()) + f") / (5 * {_TOT}::DOUBLE) END"
_SC = f"w AS (SELECT *, {_WS} AS ws, score_basis <> 'seed_prior' AND evidence_ids = '' AS unv, risk_inverse IN (0, 1) AS risky FROM c), s AS (SELECT *, greatest(0, least(100, ws - CASE WHEN unv THEN 12 ELSE 0 END - CASE WHEN risky THEN 20 ELSE 0 END)) AS f, concat_ws(';', CASE WHEN unv THEN 'unverified_metric' END, CASE WHEN risky THEN 'high_safety_dependency' END) AS penalties FROM w)"
_BD = "CASE WHEN ws IS NULL THEN 'unknown' WHEN f BETWEEN 0 AND 49.99 THEN 'reject' WHEN f BETWEEN 50 AND 64.99 THEN 'research' WHEN f BETWEEN 65 AND 79.99 THEN 'experiment' WHEN f BETWEEN 80 AND 100 THEN 'priority' ELSE 'unknown' END"


@register("cand_weighted_score", f"WITH {_C}, {_SC} SELECT key, round(ws, 6) AS weighted_score FROM s")
def cand_weighted_score(spark, d):
    return candidates(spark, d).select("key", F.round(K.weighted_score(), 6).alias("weighted_score"))


@register("cand_penalties", f"WITH {_C}, {_SC} SELECT key, penalties, round(CASE WHEN ws IS NOT NULL THEN f END, 6) AS final FROM s")
def cand_penalties(spark, d):
    return candidates(spark, d).select("key", F.array_join(K.penalties(), ";").alias("penalties"), F.round(F.when(K.weighted_score().isNotNull(), K.penalised(K.weighted_score(), K.penalties())), 6).alias("final"))


@register("cand_band", f"WITH {_C}, {_SC} SELECT {_BD} AS band, count(*) AS n FROM s WHERE ws IS NOT NULL GROUP BY ALL")
def cand_band(spark, d):
    return K.score_table(candidates(spark, d)).filter("status = 'OK'").groupBy(F.col("score_band").alias("band")).agg(F.count("*").alias("n"))


@register("cand_eligibility", f"WITH {_C}, {_SC} SELECT key, coalesce(gate AND f >= 65, false) AS eligible, printf('%.2f', round(f, 2)) AS final_score FROM s WHERE ws IS NOT NULL")
def cand_eligibility(spark, d):
    return K.score_table(candidates(spark, d)).filter("status = 'OK'").select("key", F.col("experiment_eligible").alias("eligible"), "final_score")


@register("cand_score_table", f"WITH {_C}, {_SC} SELECT key, candidate_id, title, penalties, {_BD} AS score_band, CASE WHEN ws IS NULL THEN 'ERR_DIMENSION' ELSE 'OK' END AS status FROM s WHERE ws IS NOT NULL OR true")
def cand_score_table(spark, d):
    t = K.score_table(candidates(spark, d))
    return t.select("key", "candidate_id", "title", "penalties", F.when(F.col("status") == "OK", F.col("score_band")).otherwise("unknown").alias("score_band"), "status")


# Templates of the query packs: id, goal, text.
TEMPLATES = (
    ("t-hard", "complaint", "why is {task} so hard in {activity}"),
    ("t-broke", "complaint", "{product_territory} stopped working {activity}"),
    ("t-without", "complaint", "{activity} without {friction_family} trouble"),
    ("t-homemade", "workaround", "homemade {product_territory} for {task}"),
    ("t-instead", "workaround", "what people use instead of {product_territory}"),
    ("t-compare", "competition", "{product_territory} compared {current_year}"),
    ("t-cost", "price", "cost of {product_territory} in {region}"),
    ("t-when", "seasonality", "when does {activity} start in {region}"),
    ("t-nobody", "falsification", "nobody needs {product_territory}"),
    ("t-odd", "community", "{activity}  clubs  {task}"),
)


def _seeds(spark, d):
    p = B.table(spark, d, "part")
    word = lambda i: F.element_at(F.split("p_name", " "), i)
    return p.select(F.col("p_partkey").alias("r"), F.lower("p_type").alias("activity"), word(1).alias("task"), F.lower("p_brand").alias("friction_family"), word(-1).alias("product_territory"), F.col("p_brand").alias("activity_id"))


def _tsql(t: str) -> str:
    for k, v in {"activity": "lower(p_type)", "task": "string_split(p_name, ' ')[1]", "friction_family": "lower(p_brand)", "product_territory": "string_split(p_name, ' ')[-1]", "region": "'United States'", "current_year": "'2026'"}.items():
        t = t.replace("{" + k + "}", f"' || {v} || '")
    return f"'{t}'"


_QP = "qp AS (" + " UNION ALL ".join(f"SELECT p_partkey AS r, {i} AS t, '{tid}' AS template_id, '{g}' AS evidence_goal, trim({_tsql(x)}) AS query, p_brand AS activity_id FROM part" for i, (tid, g, x) in enumerate(TEMPLATES)) + ")"
_QD = "fq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) ORDER BY r, t) AS k FROM qp) WHERE k = 1), dq AS (SELECT 'query-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS query_id, activity_id, template_id, evidence_goal, query FROM (SELECT *, row_number() OVER (ORDER BY r, t) AS n FROM fq))"


def _pack(spark, d):
    return K.query_pack(_seeds(spark, d), K.templates(spark, TEMPLATES), "United States", 2026)


@register("query_pack", f"WITH {_QP} SELECT r, template_id, query, 'unsearched' AS status FROM qp")
def query_pack(spark, d):
    return _pack(spark, d).select("r", "template_id", "query", "status")


@register("query_pack_dedup", f"WITH {_QP}, {_QD} SELECT * FROM dq")
def query_pack_dedup(spark, d):
    return K.dedup_queries(_pack(spark, d)).drop("status")


@register("query_pack_by_activity", f"WITH {_QP.replace('FROM part', 'FROM part WHERE p_brand = ' + chr(39) + 'Brand#2' + chr(39))}, {_QD} SELECT * FROM dq")
def query_pack_by_activity(spark, d):
    return K.dedup_queries(K.query_pack(_seeds(spark, d).filter(F.col("activity_id") == "Brand#2"), K.templates(spark, TEMPLATES), "United States", 2026)).drop("status")


def evidence(spark, d):
    """Documents as evidence; the labels give the polarity."""
    docs, lab = B.table(spark, d, "documents"), B.table(spark, d, "labels")
    pol = F.when(F.col("quality").isNull(), "neutral").when((F.col("quality") == 1) & (F.col("toxic") == 0), "supporting").otherwise("contradicting")
    return docs.join(lab, "doc_id", "left").select(F.col("doc_id").alias("evidence_id"), (F.col("doc_id") % 37).alias("candidate_id"), pol.alias("polarity"), F.col("text").alias("observation"), "source", "lang", "text", "doc_id")


_EV = "ev AS (SELECT d.doc_id AS evidence_id, d.doc_id % 37 AS candidate_id, CASE WHEN quality IS NULL THEN 'neutral' WHEN quality = 1 AND toxic = 0 THEN 'supporting' ELSE 'contradicting' END AS polarity, text AS observation, source, lang, text, d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_SAFE = "regexp_replace(replace(observation, '|', '/'), '[\\r\\n]+', ' ', 'g')"


@register("report_evidence_split", f"WITH {_EV} SELECT candidate_id, polarity, CAST(row_number() OVER (PARTITION BY candidate_id, polarity ORDER BY evidence_id) AS INTEGER) AS position, evidence_id, {_SAFE} AS observation FROM ev")
def report_evidence_split(spark, d):
    return K.evidence_split(evidence(spark, d))


_SECTION = "CASE polarity WHEN 'supporting' THEN 1 WHEN 'contradicting' THEN 2 ELSE 3 END"


@register(
    "report_render",
    f"""WITH {_EV}, {_C}, {_SC}, k AS (SELECT key AS candidate_id, title, f, {_BD} AS band FROM s WHERE ws IS NOT NULL),
rw AS (SELECT candidate_id, {_SECTION} AS section, row_number() OVER (PARTITION BY candidate_id, polarity ORDER BY evidence_id) AS line, '| ' || evidence_id || ' | ' || {_SAFE} || ' |' AS text FROM ev WHERE candidate_id IN (SELECT candidate_id FROM k)),
hd AS (SELECT 1 AS n, 'Supporting evidence' AS name UNION ALL SELECT 2, 'Contradicting evidence' UNION ALL SELECT 3, 'Neutral evidence')
SELECT candidate_id, 0 AS section, 0 AS line, '# ' || title AS text FROM k UNION ALL SELECT candidate_id, 0, 1, 'Score: ' || printf('%.2f', round(f, 2)) || ' (' || band || ')' FROM k
UNION ALL SELECT candidate_id, n, 0, '## ' || name FROM k, hd UNION ALL SELECT * FROM rw
UNION ALL SELECT candidate_id, n, 1, '_none_' FROM k, hd WHERE NOT EXISTS (SELECT 1 FROM rw WHERE rw.candidate_id = k.candidate_id AND section = n)""",
)
def report_render(spark, d):
    c = candidates(spark, d).filter(K.weighted_score().isNotNull()).withColumn("candidate_id", F.col("key"))
    return K.render(K.score_table(c), K.evidence_split(evidence(spark, d)))


_STATES = ("seed", "researching", "evidence_ready", "red_team", "experiment_ready", "validated", "rejected", "stale")
_ALLOWED = " OR ".join(f"(previous = '{a}' AND state IN ({', '.join(repr(b) for b in bs)}))" for a, bs in K.TRANSITIONS.items())


@register("run_state_check", f"WITH st AS (SELECT o_custkey AS run_id, o_orderkey AS seq, ['seed','researching','evidence_ready','red_team','experiment_ready','validated','rejected','stale'][o_orderkey % 8 + 1] AS state FROM orders), lg AS (SELECT *, lag(state) OVER (PARTITION BY run_id ORDER BY seq) AS previous FROM st) SELECT run_id, seq, previous, state FROM lg WHERE previous IS NOT NULL AND previous <> state AND NOT ({_ALLOWED})")
def run_state_check(spark, d):
    o = B.table(spark, d, "orders")
    st = o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("seq"), F.element_at(F.array(*[F.lit(x) for x in _STATES]), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("state"))
    return K.illegal_transitions(st, K.TRANSITIONS).select("run_id", "seq", "previous", "state")


# Data quality


@register("dq_required_columns", "SELECT 'part' AS table_name, 'required_columns' AS rule, 'error' AS severity, c AS row_key, c AS detail FROM (VALUES ('niche_id'), ('p_color')) t(c)")
def dq_required_columns(spark, d):
    return Q.missing_columns(B.table(spark, d, "part"), "part", ["p_partkey", "p_name", "niche_id", "p_color"])


@register("dq_duplicate_keys", "SELECT 'lineitem' AS table_name, 'duplicate_keys' AS rule, 'error' AS severity, CAST(l_orderkey AS VARCHAR) AS row_key, CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def dq_duplicate_keys(spark, d):
    return Q.duplicate_keys(B.table(spark, d, "lineitem"), "lineitem", "l_orderkey")


@register("dq_key_pattern", "SELECT 'customer' AS table_name, 'pattern:c_name' AS rule, 'error' AS severity, CAST(c_custkey AS VARCHAR) AS row_key, c_name AS detail FROM customer WHERE NOT regexp_matches(c_name, '^Customer#0*[1-9]\\d{0,2}$')")
def dq_key_pattern(spark, d):
    return Q.run_rules(B.table(spark, d, "customer"), "customer", "c_custkey", [Q.pattern("c_name", r"^Customer#0*[1-9]\d{0,2}$")])


@register("dq_foreign_key", "SELECT 'orders' AS table_name, 'foreign_key:o_custkey' AS rule, 'error' AS severity, CAST(o_orderkey AS VARCHAR) AS row_key, CAST(o_custkey AS VARCHAR) AS detail FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def dq_foreign_key(spark, d):
    return Q.foreign_key(B.table(spark, d, "orders"), "o_custkey", B.table(spark, d, "customer").filter("c_nationkey < 20"), "c_custkey", "orders", "o_orderkey")


@register("dq_enum", "SELECT 'orders' AS table_name, 'enum:o_orderstatus' AS rule, 'error' AS severity, CAST(o_orderkey AS VARCHAR) AS row_key, o_orderstatus AS detail FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def dq_enum(spark, d):
    return Q.run_rules(B.table(spark, d, "orders"), "orders", "o_orderkey", [Q.enum("o_orderstatus", ["F", "O"])])


@register("dq_int_range", f"WITH {_C} SELECT 'candidates' AS table_name, 'int_range:' || n AS rule, 'error' AS severity, CAST(key AS VARCHAR) AS row_key, CAST(v AS VARCHAR) AS detail FROM (" + " UNION ALL ".join(f"SELECT key, '{c}' AS n, {c} AS v FROM c" for c in DIMS) + ") WHERE v NOT BETWEEN 0 AND 5")
def dq_int_range(spark, d):
    return Q.run_rules(candidates(spark, d), "candidates", "key", [Q.int_range(c, 0, 5) for c in DIMS])


@register("dq_conditional_required", f"WITH {_C} SELECT 'candidates' AS table_name, 'evidence_for_claims' AS rule, 'warning' AS severity, CAST(key AS VARCHAR) AS row_key, '' AS detail FROM c WHERE score_basis <> 'seed_prior' AND evidence_ids = ''")
def dq_conditional_required(spark, d):
    return Q.run_rules(candidates(spark, d), "candidates", "key", [Q.conditional("evidence_for_claims", F.col("score_basis") != "seed_prior", F.length("evidence_ids") > 0)])


@register("dq_conformance", f"WITH {B.SIG} SELECT signal_id, concat_ws(';', CASE WHEN confidence > 0.9 THEN 'confidence' END, CASE WHEN NOT regexp_matches(signal_id, '^sig_[0-9]{{1,3}}$') THEN 'signal_id' END, CASE WHEN tier NOT IN ('open', 'defended') THEN 'tier' END) AS violations FROM sig")
def dq_conformance(spark, d):
    rules = [Q.Rule("signal_id", "error", F.col("signal_id").rlike("^sig_[0-9]{1,3}$")), Q.Rule("tier", "error", F.col("tier").isin("open", "defended")), Q.Rule("confidence", "error", F.col("confidence").between(0, 0.9)), Q.Rule("score", "error", F.col("normalized_score").between(0, 1)), Q.Rule("window", "error", F.col("window_from") <= F.col("window_to")), Q.Rule("evidence", "error", F.size("evidence_ids") > 0)]
    return Q.with_violations(B.signals(spark, d), rules).select("signal_id", F.array_join("violations", ";").alias("violations"))


@register("dq_staleness", "SELECT 'orders' AS table_name, 'stale:day' AS rule, 'warning' AS severity, CAST(o_orderkey AS VARCHAR) AS row_key, strftime(o_orderdate, '%Y-%m-%d') AS detail FROM orders WHERE o_orderkey % 50 <> 0 AND date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') > 180 UNION ALL SELECT 'orders', 'date:day', 'error', CAST(o_orderkey AS VARCHAR), 'soon' FROM orders WHERE o_orderkey % 50 = 0")
def dq_staleness(spark, d):
    o = B.table(spark, d, "orders").withColumn("day", F.when(F.col("o_orderkey") % 50 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return Q.run_rules(o, "orders", "o_orderkey", Q.staleness("day", F.lit("1999-01-01").cast("date"), 180))


@register("dq_row_floor", "SELECT 'nation' AS table_name, 'row_floor' AS rule, 'error' AS severity, 'nation' AS row_key, CAST(count(*) AS VARCHAR) AS detail FROM nation HAVING count(*) < 500")
def dq_row_floor(spark, d):
    return Q.row_floor(B.table(spark, d, "nation"), "nation", 500)


#: Findings of the report by hand: counts over candidates, orders and customers.
_RANGES = " + ".join(f"count(*) FILTER ({c} NOT BETWEEN 0 AND 5)" for c in DIMS)


@register(
    "dq_report",
    f"""WITH {_C}, ce AS (SELECT {_RANGES} + count(*) FILTER (NOT regexp_matches(candidate_id, '^nc-\\d{{3,}}$')) + count(*) FILTER (NOT gate AND key % 7 = 0) AS n, count(*) FILTER (score_basis <> 'seed_prior' AND evidence_ids = '') AS w FROM c),
du AS (SELECT count(*) AS n FROM (SELECT candidate_id FROM c GROUP BY candidate_id HAVING count(*) > 1)),
oe AS (SELECT count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) + count(*) FILTER (o_orderkey % 50 = 0) + count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)) AS n, count(*) FILTER (o_orderkey % 50 <> 0 AND date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') > 180) AS w FROM orders),
fl AS (SELECT CASE WHEN count(*) < 1000000000 THEN 1 ELSE 0 END AS n FROM orders)
SELECT CAST(ce.n + du.n + oe.n + fl.n + 1 AS BIGINT) AS errors, CAST(ce.w + oe.w AS BIGINT) AS warnings, false AS ok FROM ce, du, oe, fl""",
)
def dq_report(spark, d):
    # One column is missing, some candidates share an id and some levels, ids, states, dates and references are wrong.
    c = candidates(spark, d).withColumn("gate", F.when((F.col("key") % 7 == 0) & (F.col("hard_gates_passed") == "false"), "no").otherwise(F.col("hard_gates_passed")))
    o = B.table(spark, d, "orders").withColumn("day", F.when(F.col("o_orderkey") % 50 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    tables = {"candidates": c, "orders": o, "customer": B.table(spark, d, "customer").filter("c_nationkey < 20")}
    specs = {
        "candidates": Q.TableRules("candidate_id", ["candidate_id", "title", "niche"], [*[Q.int_range(x, 0, 5) for x in DIMS], Q.pattern("candidate_id", r"^nc-\d{3,}$"), Q.enum("gate", ["true", "false"]), Q.conditional("evidence_for_claims", F.col("score_basis") != "seed_prior", F.length("evidence_ids") > 0)]),
        "orders": Q.TableRules("o_orderkey", ["o_orderkey"], [Q.enum("o_orderstatus", ["F", "O"]), *Q.staleness("day", F.lit("1999-01-01").cast("date"), 180)], [("o_custkey", "customer", "c_custkey")], 1_000_000_000),
    }
    return Q.totals([Q.validate(tables, specs)])


def _provenance(spark, d):
    o = B.table(spark, d, "orders")
    return o.select("o_orderkey", F.struct(F.when(F.col("o_orderkey") % 11 != 0, "v1").alias("schema_version"), F.when(F.col("o_orderkey") % 13 != 0, "cfg").otherwise("").alias("config_hash"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 17 == 0, "model-x").alias("model_id")).alias("provenance"))


@register("dq_provenance", "SELECT 'orders' AS table_name, 'provenance:schema_version' AS rule, 'error' AS severity, CAST(o_orderkey AS VARCHAR) AS row_key, '' AS detail FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT 'orders', 'provenance:config_hash', 'error', CAST(o_orderkey AS VARCHAR), '' FROM orders WHERE o_orderkey % 13 = 0")
def dq_provenance(spark, d):
    return Q.run_rules(_provenance(spark, d), "orders", "o_orderkey", Q.provenance_rules("provenance", ["schema_version", "config_hash", "created_at"]))


@register("dq_no_model_score", "SELECT 'orders' AS table_name, 'no_model_score' AS rule, 'error' AS severity, CAST(o_orderkey AS VARCHAR) AS row_key, 'model-x' AS detail FROM orders WHERE o_orderkey % 17 = 0")
def dq_no_model_score(spark, d):
    return Q.run_rules(_provenance(spark, d), "orders", "o_orderkey", [Q.Rule("no_model_score", "error", F.col("provenance.model_id").isNull(), F.col("provenance.model_id"))])


@register("dq_normalize_invariants", f"WITH {B.SIG} SELECT signal_id, concat_ws(';', CASE WHEN event_id % 13 = 0 AND (signal_type = 'competition' OR metric_name = 'content_saturation') AND abs(2 * normalized_score - 1) > 1e-12 THEN 'direction' END, CASE WHEN event_id % 17 = 0 THEN 'score' END, CASE WHEN event_id % 19 = 0 THEN 'window' END) AS violations FROM (SELECT * FROM sig WHERE event_id % 17 <> 0 OR event_id % 13 <> 0)".replace("CASE WHEN event_id % 13 = 0 AND", "CASE WHEN event_id % 17 = 0 OR event_id % 13 = 0 AND"))
def dq_normalize_invariants(spark, d):
    # Some scores are those before the direction, some out of range, some windows open.
    e = F.col("event_id")
    s = S.normalize(B.raw_signals(spark, d), B.as_of(), keep_rank=True).filter((e % 17 != 0) | (e % 13 != 0))
    s = s.withColumns({"normalized_score": F.when(e % 17 == 0, F.col("normalized_score") + 2).when(e % 13 == 0, F.col("percentile")).otherwise(F.col("normalized_score")), "window_to": F.when(e % 19 != 0, F.col("window_to"))})
    return s.select("signal_id", F.array_join(S.invariant_violations(), ";").alias("violations"))


@register("dq_lineage_required", f"WITH {B.RAW} SELECT signal_id FROM raw WHERE event_id % 9 = 0 OR event_id % 5 = 0")
def dq_lineage_required(spark, d):
    raw = B.raw_signals(spark, d)
    part = raw.withColumn("evidence_ids", F.when(F.col("event_id") % 9 != 0, F.col("evidence_ids")).otherwise(F.array().cast("array<string>")))
    edges = raw.filter(F.col("event_id") % 5 != 0).select(F.col("signal_id").alias("child_id"))
    return Q.with_lineage(part, "signal_id", "evidence_ids", edges).select("signal_id")


@register("dq_reproducible", f"{B.ALL} SELECT count(*) AS niches, 0::BIGINT AS differing FROM opp")
def dq_reproducible(spark, d):
    a = P.score(B.signals(spark, d), B.as_of())
    b = P.score(S.normalize(B.raw_signals(spark, d).repartition(7, "event_id"), B.as_of()), B.as_of())
    bad = Q.differences(a, b, ["niche_id"], {"raw_score": 1e-12, "raw_confidence": 1e-12}).withColumn("bad", F.lit(1))
    return a.join(bad, "niche_id", "left").agg(F.count("*").alias("niches"), F.count("bad").alias("differing"))


@register("dq_forbidden_fields", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'confidence;k' ELSE 'k' END AS found FROM events")
def dq_forbidden_fields(spark, d):
    e = B.table(spark, d, "events").withColumn("props", F.when(F.col("event_id") % 4 == 0, F.regexp_replace("props", "\\}", ', "confidence": 1}')).otherwise(F.col("props")))
    return e.select("event_id", F.array_join(Q.forbidden_fields("props", ["score", "confidence", "k"]), ";").alias("found"))
