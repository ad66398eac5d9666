"""Queries on signals, coverage, tiers and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import expressions as X
from sparkloom.functions import sql
from sparkloom.operators import coverage as C
from sparkloom.operators import score as P
from sparkloom.operators import evidence as E
from sparkloom.operators import signals as S
from sparkloom.sources.shared import cut

from . import bindings as B
from .catalog import register

R6 = lambda c: F.round(c, 6)


@register("sig_raw_validate", f"WITH {B.RAW} SELECT signal_id, CASE WHEN sample_n >= 1 THEN '' ELSE 'sample_n' END AS violations FROM raw")
def sig_raw_validate(spark, d):
    return B.raw_signals(spark, d).select("signal_id", F.array_join(S.raw_violations(), ";").alias("violations"))


@register("sig_raw_finalize", f"WITH {B.RAW} SELECT signal_id, record_id AS evidence_ids, tier FROM raw")
def sig_raw_finalize(spark, d):
    raw = B.raw_signals(spark, d)
    part = raw.withColumn("evidence_ids", F.when(F.col("event_id") % 2 == 0, F.col("evidence_ids")).otherwise(F.array().cast("array<string>"))).withColumn("tier", F.when((F.col("tier") == "open") & (F.col("event_id") % 3 == 0), F.lit(None)).otherwise(F.col("tier")))
    return S.finalize_raw(part).select("signal_id", F.array_join("evidence_ids", ";").alias("evidence_ids"), "tier")


@register("sig_route", f"WITH {B.RAW} SELECT signal_id, CASE WHEN sample_n > 5 THEN 'normalize' ELSE 'repair' END AS route, CASE WHEN sample_n <= 5 THEN 'tsk_repair_' || substr(sha256('repair|' || signal_id || '|sample_n'), 1, 12) END AS task_id, CASE WHEN sample_n <= 5 THEN 'classify' END AS lane FROM raw")
def sig_route(spark, d):
    raw = B.raw_signals(spark, d).withColumn("sample_n", F.col("sample_n") - 5)
    good, tasks = E.routed(raw.withColumn("violations", S.raw_violations()), "signal_id", "classify")
    none = F.lit(None).cast("string")
    return good.select("signal_id", F.lit("normalize").alias("route"), none.alias("task_id"), none.alias("lane")).unionByName(tasks.select(F.col("record_id").alias("signal_id"), F.lit("repair").alias("route"), "task_id", "lane"))


@register("sig_winsorize", f"WITH {B.RAW}, {B.RANKS} SELECT cohort, value, clipped FROM rk")
def sig_winsorize(spark, d):
    return S.cohort_ranks(B.raw_signals(spark, d).withColumn("cohort", F.col("signal_type"))).select("cohort", "value", "clipped")


@register("sig_percentile_rank", f"WITH {B.RAW}, {B.RANKS} SELECT cohort, value, round(pct, 6) AS pct FROM rk")
def sig_percentile_rank(spark, d):
    return S.cohort_ranks(B.raw_signals(spark, d).withColumn("cohort", F.col("signal_type"))).select("cohort", "value", R6("pct").alias("pct"))


@register("sig_direction", f"WITH {B.RAW} SELECT signal_id, round(CASE WHEN signal_type = 'competition' OR metric_name = 'content_saturation' THEN 1 - value / 100 ELSE value / 100 END, 6) AS directed FROM raw")
def sig_direction(spark, d):
    return B.raw_signals(spark, d).select("signal_id", R6(X.direction(F.col("value") / 100, F.col("signal_type"), F.col("metric_name"))).alias("directed"))


@register("sig_normalize", f"WITH {B.SIG} SELECT signal_id, niche_id, signal_type, tier, round(normalized_score, 6) AS normalized_score, round(confidence, 6) AS confidence, CAST(expires_at AS TIMESTAMP) AS expires_at, 'OK' AS status FROM sig")
def sig_normalize(spark, d):
    return B.signals(spark, d).select("signal_id", "niche_id", "signal_type", "tier", R6("normalized_score").alias("normalized_score"), R6("confidence").alias("confidence"), F.col("expires_at").cast("timestamp_ntz").alias("expires_at"), "status")


@register("sig_expires_at", f"WITH {B.RAW} SELECT signal_id, CAST(date_trunc('second', observed_at) + ({B.HALF}) * INTERVAL 1 DAY AS TIMESTAMP) AS expires_at FROM raw")
def sig_expires_at(spark, d):
    return B.raw_signals(spark, d).select("signal_id", X.expires_at(F.col("observed_at"), F.col("signal_type")).cast("timestamp_ntz").alias("expires_at"))


@register("sig_confidence", f"WITH {B.RAW} SELECT signal_id, round({B.CONF}, 6) AS confidence FROM raw")
def sig_confidence(spark, d):
    return B.raw_signals(spark, d).select("signal_id", R6(X.signal_confidence(F.col("sample_n"), F.col("signal_type"), F.col("tier"), F.col("window_to"), B.as_of())).alias("confidence"))


@register("sig_age_days", f"WITH {B.RAW} SELECT signal_id, round({B.AGE}, 6) AS age_days FROM raw")
def sig_age_days(spark, d):
    return B.raw_signals(spark, d).select("signal_id", R6(X.age_days(F.col("window_to"), B.as_of())).alias("age_days"))


@register("sig_apply_confidence", f"WITH {B.SIG} SELECT niche_id, signal_type, count(*) AS n, round(max(confidence), 6) AS best, round(avg(confidence), 5) AS mean FROM sig GROUP BY ALL")
def sig_apply_confidence(spark, d):
    sig = B.signals(spark, d).drop("confidence")
    again = sig.withColumn("confidence", X.signal_confidence(F.col("sample_n"), F.col("signal_type"), F.col("tier"), F.col("window_to"), B.as_of()))
    return again.groupBy("niche_id", "signal_type").agg(F.count("*").alias("n"), R6(F.max("confidence")).alias("best"), F.round(F.avg("confidence"), 5).alias("mean"))


@register("sig_tier_weight", f"WITH {B.RAW} SELECT tier, {B.TIERW} AS weight, count(*) AS n FROM raw GROUP BY ALL")
def sig_tier_weight(spark, d):
    return B.raw_signals(spark, d).groupBy("tier", X.tier_weight(F.col("tier")).alias("weight")).agg(F.count("*").alias("n"))


@register("sig_lineage", f"WITH {B.RAW} SELECT 'signal' AS child_kind, signal_id AS child_id, 'evidence' AS parent_kind, record_id AS parent_id, 'derived_from' AS relation FROM raw")
def sig_lineage(spark, d):
    return B.raw_signals(spark, d).select(F.lit("signal").alias("child_kind"), F.col("signal_id").alias("child_id"), F.lit("evidence").alias("parent_kind"), F.explode("evidence_ids").alias("parent_id"), F.lit("derived_from").alias("relation"))


@register("cov_grid", f"WITH {B.SIG}, m AS (SELECT niche_id, signal_type, tier, max(confidence) AS best FROM sig GROUP BY ALL) SELECT niche_id, signal_type, tier, round(best, 6) AS best_confidence, string_agg(signal_id, ';' ORDER BY signal_id) AS signal_ids FROM m JOIN sig USING (niche_id, signal_type, tier) WHERE confidence = best GROUP BY ALL")
def cov_grid(spark, d):
    return C.grid(B.signals(spark, d)).select("niche_id", "signal_type", "tier", R6("best_confidence").alias("best_confidence"), F.array_join("signal_ids", ";").alias("signal_ids"))


@register("cov_best_across", f"WITH {B.SIG}, {B.BEST} SELECT niche_id, round(hard_demand, 6) AS hard_demand, round(hard_pain, 6) AS hard_pain, round(any_growth, 6) AS any_growth, round(any_competition, 6) AS any_competition, round(any_content, 6) AS any_content FROM bn")
def cov_best_across(spark, d):
    b = C.best_by_niche(B.signals(spark, d))
    return b.select("niche_id", *[R6(c).alias(c) for c in b.columns[1:]])


@register("cov_hard_met", f"WITH {B.SIG}, {B.BEST} SELECT niche_id, hard_demand >= 0.4 AND hard_pain >= 0.4 AS hard_required_met FROM bn")
def cov_hard_met(spark, d):
    return C.best_by_niche(B.signals(spark, d)).select("niche_id", C.hard_met().alias("hard_required_met"))


@register("cov_gaps", f"WITH {B.SIG}, {B.BEST}, {B.GATE} SELECT niche_id, unnest(gaps) AS gap FROM gt")
def cov_gaps(spark, d):
    g = C.best_by_niche(B.signals(spark, d)).select("niche_id", F.explode(C.gaps()).alias("g"))
    return g.select("niche_id", F.concat_ws("/", "g.signal_type", "g.source_tier", "g.reason").alias("gap"))


@register("cov_gate", f"WITH {B.SIG}, {B.BEST}, {B.GATE} SELECT niche_id, outcome, hard_required_met, CASE WHEN outcome = 'scores_with_gaps' THEN array_to_string(gaps, ';') ELSE '' END AS coverage_gaps FROM gt")
def cov_gate(spark, d):
    return C.gate(C.best_by_niche(B.signals(spark, d)), B.as_of()).select("niche_id", "outcome", "hard_required_met", B.shown_gaps().alias("coverage_gaps"))


@register("tier_filter", f"WITH {B.RAW} SELECT tier, count(*) AS n FROM raw WHERE tier <> 'hostile' GROUP BY ALL")
def tier_filter(spark, d):
    return C.without_tiers(B.raw_signals(spark, d), ["hostile"]).groupBy("tier").agg(F.count("*").alias("n"))


_HOST = "hd AS (SELECT niche_id, coalesce(max(confidence) FILTER (signal_type = 'demand'), 0) >= 0.4 AND coalesce(max(confidence) FILTER (signal_type = 'pain'), 0) >= 0.4 AND NOT (coalesce(max(confidence) FILTER (signal_type = 'demand' AND tier <> 'hostile'), 0) >= 0.4 AND coalesce(max(confidence) FILTER (signal_type = 'pain' AND tier <> 'hostile'), 0) >= 0.4) AS hostile_dependent FROM s1 GROUP BY niche_id)"
_THIN = "s1 AS (SELECT * FROM sig WHERE NOT (signal_type = 'demand' AND tier <> 'hostile' AND CAST(substr(niche_id, 7) AS INTEGER) % 3 = 0))"


def _thin(spark, d):
    """Signals of which every third niche has demand from hostile sources only."""
    return B.signals(spark, d).filter(~((F.col("signal_type") == "demand") & (F.col("tier") != "hostile") & (F.substring("niche_id", 7, 9).cast("int") % 3 == 0)))


@register("tier_hostile_dependent", f"WITH {B.SIG}, {_THIN}, {_HOST} SELECT * FROM hd")
def tier_hostile_dependent(spark, d):
    return C.hostile_dependence(_thin(spark, d), hard_required_tiers=X.TIERS)


@register("tier_cap", f"WITH {B.SIG}, {_THIN}, {_HOST}, mx AS (SELECT niche_id, max(confidence) AS c FROM s1 GROUP BY niche_id) SELECT niche_id, round(CASE WHEN hostile_dependent THEN least(c, 0.5) ELSE c END, 6) AS capped FROM hd JOIN mx USING (niche_id)")
def tier_cap(spark, d):
    s = _thin(spark, d)
    top = s.groupBy("niche_id").agg(F.max("confidence").alias("c"))
    return C.hostile_dependence(s, hard_required_tiers=X.TIERS).join(top, "niche_id").select("niche_id", R6(C.cap(F.col("c"), F.col("hostile_dependent"))).alias("capped"))


_LOSS = f"WITH {B.SIG.replace('FROM raw JOIN rk', 'FROM raw JOIN rk')}, every AS (SELECT DISTINCT niche_id FROM sig), kept AS (SELECT * FROM sig WHERE tier NOT IN ('open', 'defended')), bn0 AS (SELECT niche_id, " + ", ".join(f"coalesce(max(confidence) FILTER (signal_type = '{k}' AND tier IN ('open','defended')), 0) AS hard_{k}" for k in ("demand", "pain")) + ", " + ", ".join(f"coalesce(max(confidence) FILTER (signal_type = '{k}'), 0) AS any_{k}" for k in ("growth", "competition", "content")) + " FROM kept GROUP BY niche_id), bn AS (SELECT niche_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("hard_demand", "hard_pain", "any_growth", "any_competition", "any_content")) + f" FROM every LEFT JOIN bn0 USING (niche_id)), {B.GATE}"


@register("tier_loss_gaps", _LOSS + " SELECT niche_id, array_to_string(gaps, ';') AS coverage_gaps FROM gt")
def tier_loss_gaps(spark, d):
    return C.loss_gaps(B.signals(spark, d), ["open", "defended"]).select("niche_id", B.shown_gaps().alias("coverage_gaps"))


@register("tier_effects", _LOSS + f", {_THIN}, {_HOST}, mc AS (SELECT niche_id, avg(confidence) + 0.05 AS c FROM s1 GROUP BY niche_id), gl AS (SELECT niche_id, 5 - least(5, len(gaps)) AS unused, array_to_string(gaps, ';') AS coverage_gaps FROM gt) SELECT niche_id, hostile_dependent, round(CASE WHEN hostile_dependent THEN least(c, 0.5) ELSE c END, 2) AS capped_confidence, coverage_gaps FROM gl JOIN hd USING (niche_id) LEFT JOIN mc USING (niche_id)".replace("5 - least(5, len(gaps)) AS unused, ", ""))
def tier_effects(spark, d):
    s = _thin(spark, d)
    confidence = s.groupBy("niche_id").agg((F.avg("confidence") + 0.05).alias("confidence"))
    return C.tier_effects(s, confidence, ["open", "defended"], hard_required_tiers=X.TIERS).withColumn("coverage_gaps", B.shown_gaps())


_NOHOST = f"WITH {B.RAW}, {B.RANKS}, sig AS (SELECT * FROM (SELECT raw.*, CASE WHEN signal_type = 'competition' OR metric_name = 'content_saturation' THEN 1 - pct ELSE pct END AS normalized_score, {B.CONF} AS confidence FROM raw JOIN rk ON rk.cohort = raw.signal_type AND rk.value = raw.value) WHERE tier <> 'open'), {B.BEST}, {B.GATE}, {B.AXES}, {B.SCORE}"


@register("tier_loss_score", _NOHOST + " SELECT niche_id, status, score, confidence, coverage_gaps FROM opp")
def tier_loss_score(spark, d):
    return P.score(C.without_tiers(B.signals(spark, d), ["open"]), B.as_of()).select("niche_id", "status", "score", "confidence", B.shown_gaps().alias("coverage_gaps"))


@register("score_best_signals", f"WITH {B.SIG}, {B.BEST}, {B.AXES} SELECT niche_id, signal_type, b.id AS signal_id, round(b.v, 6) AS normalized_score, round(b.c, 6) AS confidence FROM bs")
def score_best_signals(spark, d):
    return P.best_signals(B.signals(spark, d)).select("niche_id", "signal_type", "signal_id", R6("normalized_score").alias("normalized_score"), R6("confidence").alias("confidence"))


@register("score_shrink", f"WITH {B.SIG} SELECT signal_id, round(0.5 + (normalized_score - 0.5) * confidence, 6) AS shrunk FROM sig")
def score_shrink(spark, d):
    sql.register(spark)
    return B.signals(spark, d).selectExpr("signal_id", "round(shrink_toward_neutral(normalized_score, confidence), 6) AS shrunk")


@register("score_axis_pivot", f"WITH {B.SIG}, {B.BEST}, {B.AXES} SELECT niche_id, scored_from, " + ", ".join(f"round(shrunk_{a}, 6) AS shrunk_{a}" for a in X.AXES) + " FROM ax")
def score_axis_pivot(spark, d):
    return P.pivot_axes(P.best_signals(B.signals(spark, d))).select("niche_id", F.array_join("scored_from", ";").alias("scored_from"), *[R6(f"shrunk_{a}").alias(f"shrunk_{a}") for a in X.AXES])


@register("score_weighted_geomean", f"WITH {B.SIG}, {B.BEST}, {B.AXES} SELECT niche_id, round(CASE WHEN {B._POS} THEN exp({' + '.join(f'{w} * ln(shrunk_{a})' for a, w in X.AXIS_WEIGHTS.items())}) END, 6) AS base FROM ax")
def score_weighted_geomean(spark, d):
    return P.pivot_axes(P.best_signals(B.signals(spark, d))).select("niche_id", R6(P.base_score()).alias("base"))


@register("score_geomean", f"WITH {B.SIG}, {B.BEST}, {B.AXES} SELECT niche_id, round(CASE WHEN {B._CPOS} THEN pow({' * '.join(f'conf_{a}' for a in X.AXES)}, 0.2) END, 6) AS confidence FROM ax")
def score_geomean(spark, d):
    return P.pivot_axes(P.best_signals(B.signals(spark, d))).select("niche_id", R6(X.geometric_mean([F.col(f"conf_{a}") for a in X.AXES])).alias("confidence"))


_AD = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 100 END"
_ADC = "CASE WHEN event_id % 2 = 0 THEN NULL ELSE (event_id % 7) / 10.0::DOUBLE END"


@register("score_ad_intensity", f"WITH {B.RAW} SELECT signal_id, round(CASE WHEN {_AD} IS NULL THEN 0.5 WHEN {_ADC} IS NULL THEN {_AD} ELSE 0.5 + ({_AD} - 0.5) * {_ADC} END, 6) AS ad FROM raw")
def score_ad_intensity(spark, d):
    e = F.col("event_id")
    value, conf = F.when(e % 3 != 0, F.col("value") / 100), F.when(e % 2 != 0, (e % 7) / 10.0)
    return B.raw_signals(spark, d).select("signal_id", R6(P.ad_intensity(value, conf)).alias("ad"))


@register("score_interactions", f"WITH {B.SIG}, {B.BEST}, {B.AXES} SELECT niche_id, round(greatest(0, least(1, 0.6 * (1 + 0.15 * shrunk_demand * shrunk_competition + 0.15 * shrunk_pain * 0.65))), 6) AS final FROM ax")
def score_interactions(spark, d):
    return P.pivot_axes(P.best_signals(B.signals(spark, d))).select("niche_id", R6(P.with_interactions(F.lit(0.6), F.lit(0.35))).alias("final"))


_OPP_COLS = "niche_id, status, score, confidence, " + ", ".join(f"sub_{a}" for a in X.AXES) + ", coverage_gaps, scored_from"


@register("score_opportunity", f"{B.ALL} SELECT {_OPP_COLS} FROM opp")
def score_opportunity(spark: SparkSession, d: str) -> DataFrame:
    return P.score(B.signals(spark, d), B.as_of()).select("niche_id", "status", "score", "confidence", *[f"sub_{a}" for a in X.AXES], B.shown_gaps().alias("coverage_gaps"), F.array_join("scored_from", ";").alias("scored_from"))


@register("score_build", f"{B.ALL} SELECT 'opp_' || replace(niche_id, '-', '_') AS opportunity_id, niche_id, score, confidence, scored_from, 'ACTIVE' AS status, 'opportunity.v1' AS schema_version, true AS hashed FROM opp WHERE status = 'OK'")
def score_build(spark, d):
    o = P.build(P.score(B.signals(spark, d), B.as_of()), B.as_of(), "sha256:test")
    return o.select("opportunity_id", "niche_id", "score", "confidence", F.array_join("scored_from", ";").alias("scored_from"), "status", "schema_version", F.col("content_hash").rlike("^sha256:[0-9a-f]{64}$").alias("hashed"))


def _weights(spark, d):
    """Weight versions from the part sizes: three shifts of weight between two axes; one version does not add up."""
    p = B.table(spark, d, "part").select(F.col("p_size").alias("s")).distinct().filter("s <= 4")
    w = {a: F.lit(v) for a, v in X.AXIS_WEIGHTS.items()}
    w["demand"] = F.lit(0.25) + F.col("s") / 100.0
    w["growth"] = F.lit(0.15) - F.col("s") / 100.0 + F.when(F.col("s") == 4, 0.1).otherwise(0.0)
    return p.select(F.concat(F.lit("w-"), F.col("s").cast("string")).alias("version"), *[c.alias(f"w_{a}") for a, c in w.items()], F.lit(0.15).alias("lambda_gap"), F.lit(0.15).alias("lambda_pain"))


_WV = "wv AS (SELECT DISTINCT p_size AS s FROM part WHERE p_size <= 4)"


@register("score_weights_check", f"WITH {_WV} SELECT 'w-' || s AS version, s <> 4 AS valid FROM wv")
def score_weights_check(spark, d):
    return P.check_weights(_weights(spark, d)).select("version", "valid")


@register("score_rescore_versions", f"WITH {B.SIG}, {B.BEST}, {B.AXES}, {_WV} SELECT 'w-' || s AS version, niche_id, round(greatest(0, least(1, exp((0.25 + s / 100.0::DOUBLE) * ln(shrunk_demand) + (0.15 - s / 100.0::DOUBLE) * ln(shrunk_growth) + 0.25 * ln(shrunk_pain) + 0.2 * ln(shrunk_competition) + 0.15 * ln(shrunk_content)) * (1 + 0.15 * shrunk_demand * shrunk_competition + 0.15 * shrunk_pain * 0.5))), 6) AS raw_score FROM ax, wv WHERE s <> 4 AND {B._POS}")
def score_rescore_versions(spark, d):
    return P.rescore(P.pivot_axes(P.best_signals(B.signals(spark, d))), _weights(spark, d)).select("version", "niche_id", R6("raw_score").alias("raw_score")).filter("raw_score IS NOT NULL")


_COLS = ["score", "confidence", *[f"sub_{a}" for a in X.AXES]]
_DIFF = f"SELECT coalesce(l.niche_id, r.niche_id) AS niche_id, {', '.join(f'round(r.{c} - l.{c}, 6) AS d_{c}' for c in _COLS)}, {' AND '.join(f'l.{c} IS NOT DISTINCT FROM r.{c}' for c in _COLS)} AS identical FROM ({B.ALL} SELECT * FROM opp) l FULL JOIN ({_NOHOST} SELECT * FROM opp) r ON l.niche_id = r.niche_id"


@register("score_diff", _DIFF)
def score_diff(spark, d):
    sig = cut(B.signals(spark, d))  # normalised once, scored twice
    return P.diff(P.score(sig, B.as_of()), P.score(C.without_tiers(sig, ["open"]), B.as_of()))
