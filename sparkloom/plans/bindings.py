"""The given tables as inputs of the operators, in Spark and in SQL.

Mappings are plain arithmetic on keys, so that both sides agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import signals as S

AS_OF = "2024-02-01 00:00:00"
#: Event type to (axis number, axis, metric).
KINDS = {"view": (0, "demand", "page_views"), "signup": (1, "growth", "signup_rate"), "error": (2, "pain", "complaint_rate"), "purchase": (3, "competition", "listing_count"), "click": (4, "content", "content_saturation")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def _kind(i: int, sql: bool = False):
    return " ".join(["CASE event_type", *[f"WHEN '{k}' THEN {v[i]!r}" for k, v in KINDS.items()], "END"])


def raw_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    utc = F.col("ts").cast("timestamp")
    return e.select(
        F.concat(F.lit("sig_"), F.col("event_id").cast("string")).alias("signal_id"), F.concat(F.lit("niche-"), (F.col("user_id") % 20).cast("string")).alias("niche_id"),
        F.expr(_kind(1)).alias("signal_type"), F.expr(_kind(2)).alias("metric_name"),
        F.when(F.col("event_id") % 10 <= 5, "open").when(F.col("event_id") % 10 <= 8, "defended").otherwise("hostile").alias("tier"),
        "value", (1 + F.get_json_object("props", "$.k").cast("int")).alias("sample_n"), (utc - F.expr("INTERVAL 7 DAYS")).alias("window_from"), utc.alias("window_to"), utc.alias("observed_at"),
        F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("record_id"), F.array(F.concat(F.lit("ev_"), F.col("event_id").cast("string"))).alias("evidence_ids"), "event_id",
    ).filter(F.expr(f"((cast(substr(niche_id, 7) AS int) * 7 + {_kind_of_axis()}) % 11) <> 0"))


def _kind_of_axis() -> str:
    return " ".join(["CASE signal_type", *[f"WHEN '{v[1]}' THEN {v[0]}" for v in KINDS.values()], "END"])


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.normalize(raw_signals(spark, sf_dir), as_of())


RAW = f"""raw AS (SELECT * FROM (SELECT 'sig_' || event_id AS signal_id, 'niche-' || (user_id % 20) AS niche_id, {_kind(1)} AS signal_type, {_kind(2)} AS metric_name,
  CASE WHEN event_id % 10 <= 5 THEN 'open' WHEN event_id % 10 <= 8 THEN 'defended' ELSE 'hostile' END AS tier,
  value, 1 + CAST(json_extract_string(props, '$.k') AS INTEGER) AS sample_n, ts - INTERVAL 7 DAYS AS window_from, ts AS window_to, ts AS observed_at, 'ev_' || event_id AS record_id, event_id, user_id
  FROM events) WHERE ((user_id % 20) * 7 + {_kind_of_axis()}) % 11 <> 0)"""

NREF = "CASE signal_type WHEN 'demand' THEN 50 WHEN 'growth' THEN 30 WHEN 'pain' THEN 40 WHEN 'competition' THEN 100 WHEN 'content' THEN 60 END"
HALF = "CASE signal_type WHEN 'demand' THEN 60 WHEN 'growth' THEN 30 WHEN 'pain' THEN 180 WHEN 'competition' THEN 45 WHEN 'content' THEN 21 ELSE 60 END"
TIERW = "CASE tier WHEN 'open' THEN 1.0::DOUBLE WHEN 'defended' THEN 0.85::DOUBLE WHEN 'hostile' THEN 0.5::DOUBLE END"
AGE = f"greatest(0::DOUBLE, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(window_to)) / 86400000000::DOUBLE)"
CONF = f"greatest(0::DOUBLE, least(1::DOUBLE, 0.45::DOUBLE * least(1::DOUBLE, ln(1 + sample_n::DOUBLE) / ln(1 + ({NREF})::DOUBLE)) + 0.30::DOUBLE * {TIERW} + 0.25::DOUBLE * exp(-{AGE} / ({HALF})::DOUBLE)))"

#: ``vc``: distinct values of a cohort with counts; ``rk``: clipped value and rank, by the plain definition.
RANKS = """vc AS (SELECT signal_type AS cohort, value, count(*) AS c FROM raw GROUP BY ALL),
cu AS (SELECT *, sum(c) OVER (PARTITION BY cohort ORDER BY value) AS upto, sum(c) OVER (PARTITION BY cohort) AS n FROM vc),
ends AS (SELECT cohort, max(CASE WHEN upto - c <= floor(0.05::DOUBLE * (n - 1)) AND floor(0.05::DOUBLE * (n - 1)) < upto THEN value END) AS lo,
  max(CASE WHEN upto - c <= floor(0.95::DOUBLE * (n - 1)) AND floor(0.95::DOUBLE * (n - 1)) < upto THEN value END) AS hi FROM cu GROUP BY cohort),
cl AS (SELECT cu.cohort, cu.value, n, lo, hi, CASE WHEN n < 2 THEN cu.value ELSE greatest(lo, least(hi, cu.value)) END AS clipped FROM cu JOIN ends USING (cohort)),
rk AS (SELECT cl.*, CASE WHEN cl.n = 1 THEN 0.5::DOUBLE ELSE ((x.upto - x.c) + (x.c - 1) / 2::DOUBLE)::DOUBLE / (cl.n - 1)::DOUBLE END AS pct FROM cl JOIN cu x ON x.cohort = cl.cohort AND x.value = cl.clipped)"""
SIG = f"""{RAW}, {RANKS}, sig AS (SELECT raw.*, CASE WHEN signal_type = 'competition' OR metric_name IN ('listing_count','listing_density','seller_count','ad_count','ad_intensity','content_saturation') THEN 1 - pct ELSE pct END AS normalized_score,
  {CONF} AS confidence, date_trunc('second', observed_at) + ({HALF}) * INTERVAL 1 DAY AS expires_at FROM raw JOIN rk ON rk.cohort = raw.signal_type AND rk.value = raw.value)"""
BEST = """bn AS (SELECT niche_id, coalesce(max(confidence) FILTER (signal_type = 'demand' AND tier IN ('open','defended')), 0) AS hard_demand, coalesce(max(confidence) FILTER (signal_type = 'pain' AND tier IN ('open','defended')), 0) AS hard_pain,
  coalesce(max(confidence) FILTER (signal_type = 'growth'), 0) AS any_growth, coalesce(max(confidence) FILTER (signal_type = 'competition'), 0) AS any_competition, coalesce(max(confidence) FILTER (signal_type = 'content'), 0) AS any_content FROM sig GROUP BY niche_id)"""


def _gap_sql(kind: str, word: str, col: str) -> str:
    return f"CASE WHEN {col} < 0.4 THEN '{kind}/open/{word} confidence ' || printf('%.3f', {col}) || ' < 0.40' END"


GAPS = "list_filter([" + ", ".join([*[_gap_sql(k, "needed: best of open and defended,", f"hard_{k}") for k in ("demand", "pain")], *[_gap_sql(k, "wanted: best of all tiers,", f"any_{k}") for k in ("growth", "competition", "content")]]) + "], lambda x: x IS NOT NULL)"
GATE = f"""gt AS (SELECT *, hard_demand >= 0.4 AND hard_pain >= 0.4 AS hard_required_met, CASE WHEN hard_demand >= 0.4 AND hard_pain >= 0.4 AND len({GAPS}) = 0 THEN 'admitted' WHEN hard_demand >= 0.4 AND hard_pain >= 0.4 THEN 'scores_with_gaps' ELSE 'blocked' END AS outcome, {GAPS} AS gaps FROM bn)"""


def shown_gaps(col: str = "coverage_gaps"):
    """Gaps as text, for results that are compared."""
    return F.array_join(F.transform(col, lambda g: F.concat_ws("/", g["signal_type"], g["source_tier"], g["reason"])), ";")


_W = {"demand": 0.25, "growth": 0.15, "pain": 0.25, "competition": 0.20, "content": 0.15}
AXES = """bs AS (SELECT niche_id, signal_type, arg_min({'id': signal_id, 'v': normalized_score, 'c': confidence}, (-confidence, signal_id)) AS b FROM sig GROUP BY niche_id, signal_type),
ax0 AS (SELECT niche_id, """ + ", ".join(f"coalesce(max(b.v) FILTER (signal_type = '{a}'), 0.5) AS value_{a}, coalesce(max(b.c) FILTER (signal_type = '{a}'), 0) AS conf_{a}, max(b.id) FILTER (signal_type = '{a}') AS id_{a}" for a in _W) + """ FROM bs GROUP BY niche_id),
ax AS (SELECT *, """ + ", ".join(("1 - (0.5 + (value_competition - 0.5) * conf_competition)" if a == "competition" else f"0.5 + (value_{a} - 0.5) * conf_{a}") + f" AS shrunk_{a}" for a in _W) + """, array_to_string(list_filter([""" + ", ".join(f"id_{a}" for a in _W) + """], lambda x: x IS NOT NULL), ';') AS scored_from FROM ax0)"""
_POS = " AND ".join(f"shrunk_{a} > 0" for a in _W)
_CPOS = " AND ".join(f"conf_{a} > 0" for a in _W)
SCORE = f"""sc0 AS (SELECT gt.niche_id, outcome, gaps, ax.* EXCLUDE (niche_id),
  CASE WHEN {_POS} THEN least(1::DOUBLE, exp({' + '.join(f'{w}::DOUBLE * ln(shrunk_{a})' for a, w in _W.items())}) * (1 + 0.15::DOUBLE * shrunk_demand * shrunk_competition + 0.15::DOUBLE * shrunk_pain * 0.5)) END AS raw_score0,
  CASE WHEN {_CPOS} THEN exp(({' + '.join(f'ln(conf_{a})' for a in _W)}) / 5) END AS raw_conf0 FROM gt JOIN ax USING (niche_id)),
sc AS (SELECT *, CASE WHEN outcome NOT IN ('admitted','scores_with_gaps') THEN 'BLOCKED_COVERAGE' WHEN raw_conf0 IS NULL OR raw_score0 IS NULL THEN 'ERR_NONPOSITIVE_CONFIDENCE' ELSE 'OK' END AS status FROM sc0),
opp AS (SELECT niche_id, status, CASE WHEN status = 'OK' THEN round(raw_score0, 2) END AS score, CASE WHEN status = 'OK' THEN round(raw_conf0, 2) END AS confidence, {', '.join(f"CASE WHEN status = 'OK' THEN round(shrunk_{a}, 3) END AS sub_{a}" for a in _W)},
  CASE WHEN outcome = 'scores_with_gaps' THEN array_to_string(gaps, ';') ELSE '' END AS coverage_gaps, scored_from, CASE WHEN status = 'OK' THEN raw_score0 END AS raw_score, CASE WHEN status = 'OK' THEN raw_conf0 END AS raw_confidence FROM sc)"""
#: Everything up to ``opp``.
ALL = f"WITH {SIG}, {BEST}, {GATE}, {AXES}, {SCORE}"
