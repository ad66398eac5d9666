"""Opportunity scores: best signal per axis, shrinkage, geometric means, interactions, versions and diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import expressions as X

from . import coverage


def best_signals(signals: DataFrame) -> DataFrame:
    """The row per (niche_id, signal_type) with the highest confidence, then the smallest id."""
    known = signals.filter(F.col("signal_type").isin(*X.AXES))
    best = F.min_by(F.struct("signal_id", "normalized_score", "confidence"), F.struct((-F.col("confidence")).alias("c"), "signal_id"))
    return known.groupBy("niche_id", "signal_type").agg(best.alias("b")).select("niche_id", "signal_type", "b.*")


def pivot_axes(best: DataFrame) -> DataFrame:
    """One row per niche: value_, conf_, shrunk_<axis> and scored_from in axis order.

    A missing axis has value 0.5 and confidence 0; competition is turned into room.
    """
    of = lambda axis, col, default: F.coalesce(F.max(F.when(F.col("signal_type") == axis, F.col(col))), F.lit(default))
    p = best.groupBy("niche_id").agg(
        *[of(a, "normalized_score", 0.5).alias(f"value_{a}") for a in X.AXES], *[of(a, "confidence", 0.0).alias(f"conf_{a}") for a in X.AXES],
        *[F.max(F.when(F.col("signal_type") == a, F.col("signal_id"))).alias(f"_id_{a}") for a in X.AXES],
    )
    ids = F.filter(F.array(*[f"_id_{a}" for a in X.AXES]), lambda x: x.isNotNull())
    return p.withColumns({**shrunk_axes(), "scored_from": ids}).drop(*[f"_id_{a}" for a in X.AXES])


def shrunk_axes() -> dict[str, Column]:
    """shrunk_<axis> from value_ and conf_<axis>; competition is turned into room."""
    shrunk = {f"shrunk_{a}": X.shrink(F.col(f"value_{a}"), F.col(f"conf_{a}")) for a in X.AXES}
    return shrunk | {"shrunk_competition": 1 - shrunk["shrunk_competition"]}


def ad_intensity(value: Column, confidence: Column) -> Column:
    """0.5 if missing; as it is if its confidence is missing; else shrunk."""
    return F.when(value.isNull(), F.lit(0.5)).when(confidence.isNull(), value).otherwise(X.shrink(value, confidence))


def base_score(weights: dict[str, Column] | None = None) -> Column:
    """Weighted geometric mean of the shrunk axes. Weights may be columns."""
    w = weights or {a: F.lit(v) for a, v in X.AXIS_WEIGHTS.items()}
    total = sum((w[a] for a in X.AXES), F.lit(0.0))
    logs = sum((w[a] * F.ln(F.col(f"shrunk_{a}")) for a in X.AXES), F.lit(0.0))
    positive = F.lit(True)
    for a in X.AXES:
        positive = positive & (F.col(f"shrunk_{a}") > 0)
    return F.when(positive, F.exp(logs / total))


def with_interactions(base: Column, ad: Column, gap: Column | float = X.LAMBDA_GAP, pain: Column | float = X.LAMBDA_PAIN) -> Column:
    more = gap * F.col("shrunk_demand") * F.col("shrunk_competition") + pain * F.col("shrunk_pain") * (1 - ad)
    return X.clamp(base * (1 + more))


def score(signals: DataFrame, as_of: Column, ads: DataFrame | None = None, hard_required_tiers: Sequence[str] = coverage.HARD_TIERS) -> DataFrame:
    """One row per niche, also for those that can't be scored.

    status is OK, BLOCKED_COVERAGE or ERR_NONPOSITIVE_CONFIDENCE (a missing axis
    has confidence 0, so the geometric mean has no value); score and the rest
    are then null. ``ads`` may give niche_id, ad_value and ad_confidence.
    """
    # All that a niche needs comes from one aggregation: partial maxima per task, then one shuffle by niche.
    known = lambda a, c: F.when(F.col("signal_type") == a, c)
    best = {a: F.min_by(known(a, F.struct("signal_id", "normalized_score", "confidence")), known(a, F.struct((-F.col("confidence")).alias("c"), "signal_id"))).alias(f"_best_{a}") for a in X.AXES}
    met = lambda tiers: (coverage.best_across("demand", tiers) >= X.MIN_CELL_CONFIDENCE) & (coverage.best_across("pain", tiers) >= X.MIN_CELL_CONFIDENCE)
    hostile = met(hard_required_tiers) & ~met([t for t in hard_required_tiers if t != "hostile"])
    one = signals.groupBy("niche_id").agg(*coverage.best_columns(), *best.values(), hostile.alias("hostile_dependent"))
    j = coverage.gate(one, as_of)
    j = j.withColumns({f"value_{a}": F.coalesce(F.col(f"_best_{a}.normalized_score"), F.lit(0.5)) for a in X.AXES} | {f"conf_{a}": F.coalesce(F.col(f"_best_{a}.confidence"), F.lit(0.0)) for a in X.AXES})
    j = j.withColumns(shrunk_axes() | {"scored_from": F.filter(F.array(*[F.col(f"_best_{a}.signal_id") for a in X.AXES]), lambda x: x.isNotNull())})
    if ads is not None:
        j = j.join(ads.select("niche_id", "ad_value", "ad_confidence"), "niche_id", "left")
    else:
        j = j.withColumns({"ad_value": F.lit(None).cast("double"), "ad_confidence": F.lit(None).cast("double")})
    raw = with_interactions(base_score(), ad_intensity(F.col("ad_value"), F.col("ad_confidence")))
    confidence = coverage.cap(X.geometric_mean([F.col(f"conf_{a}") for a in X.AXES]), F.col("hostile_dependent"))
    j = j.withColumns({"raw_score": raw, "raw_confidence": confidence})
    status = F.when(~F.col("outcome").isin("admitted", "scores_with_gaps"), "BLOCKED_COVERAGE").when(F.col("raw_confidence").isNull() | F.col("raw_score").isNull(), "ERR_NONPOSITIVE_CONFIDENCE").otherwise("OK")
    j = j.withColumn("status", status)
    ok = lambda c: F.when(F.col("status") == "OK", c)
    return j.select(
        "niche_id", "status", ok(F.round("raw_score", 2)).alias("score"), ok(F.round("raw_confidence", 2)).alias("confidence"),
        *[ok(F.round(f"shrunk_{a}", 3)).alias(f"sub_{a}") for a in X.AXES], "coverage_gaps", "hostile_dependent", "scored_from",
        ok(F.col("raw_score")).alias("raw_score"), ok(F.col("raw_confidence")).alias("raw_confidence"),
    )


def build(scores: DataFrame, as_of: Column, config_hash: str, scoring_version: str = "score-1", weights_version: str = "w-1") -> DataFrame:
    """Opportunity artifacts of the scored niches, with content hash and provenance."""
    ok = scores.filter(F.col("status") == "OK")
    subs = F.struct(*[F.col(f"sub_{a}").alias(a) for a in sorted(X.AXES)])
    body = F.to_json(F.struct(F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("as_of"), "confidence", "coverage_gaps", "niche_id", "score", "scored_from", subs.alias("subscores")))
    provenance = F.struct(F.lit(scoring_version).alias("scoring_version"), F.lit(weights_version).alias("weights_version"), F.lit(config_hash).alias("config_hash"), as_of.alias("created_at"))
    return ok.select(F.concat(F.lit("opp_"), F.translate("niche_id", "-", "_")).alias("opportunity_id"), "niche_id", "score", "confidence", subs.alias("subscores"), "coverage_gaps", "hostile_dependent", "scored_from", as_of.alias("as_of"), F.lit("ACTIVE").alias("status"), provenance.alias("provenance"), F.concat(F.lit("sha256:"), F.sha2(body.cast("binary"), 256)).alias("content_hash"), F.lit("opportunity.v1").alias("schema_version"))


def check_weights(weights: DataFrame) -> DataFrame:
    """Add ``valid``: the five axis weights (w_<axis>) add up to 1 within 1e-9."""
    return weights.withColumn("valid", F.abs(sum((F.col(f"w_{a}") for a in X.AXES), F.lit(0.0)) - 1) <= 1e-9)


def rescore(axes: DataFrame, weights: DataFrame) -> DataFrame:
    """Every niche under every valid version: (version, niche_id, raw_score).

    The pivoted axes are read once; the versions are a hand-made list and their
    number is checked before they are broadcast.
    """
    few = check_weights(weights).filter("valid").limit(1001)
    if few.count() > 1000:
        raise ValueError("more than 1000 weight versions; rescore them in parts")
    j = axes.crossJoin(F.broadcast(few))
    raw = with_interactions(base_score({a: F.col(f"w_{a}") for a in X.AXES}), F.lit(0.5), F.col("lambda_gap"), F.col("lambda_pain"))
    return j.select("version", "niche_id", raw.alias("raw_score"))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per niche of two scorings: the changes of score, confidence and subscores, and whether all are equal."""
    cols = ["score", "confidence", *[f"sub_{a}" for a in X.AXES]]
    a, b = (d.select("niche_id", *[F.col(c).alias(f"{side}_{c}") for c in cols]) for d, side in ((left, "l"), (right, "r")))
    j = a.join(b, "niche_id", "full_outer")
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    return j.select("niche_id", *[F.round(F.col(f"r_{c}") - F.col(f"l_{c}"), 6).alias(f"d_{c}") for c in cols], same.alias("identical"))


#: What an explanation may not change.
KEPT = ("score", "confidence", "subscores", "scored_from", "provenance")


def attach_explanations(opportunities: DataFrame, explained: DataFrame, key: str = "opportunity_id", kept: Sequence[str] = KEPT) -> DataFrame:
    """Opportunities with the explanation of ``explained`` (key, explanation, and its copy of the kept fields), if it changed none of them.

    ``changed`` lists the kept fields that differ; such an explanation is left out
    (status ``ERR_CHANGED``). Status is ``NO_EXPLANATION`` where there is none. The kept
    fields of the result are always those of ``opportunities``.
    """
    theirs = explained.select(key, F.col("explanation").alias("_text"), *[F.col(c).alias(f"_{c}") for c in kept])
    j = opportunities.join(theirs, key, "left")
    changed = F.filter(F.array(*[F.when(~F.to_json(F.struct(F.col(c).alias("v"))).eqNullSafe(F.to_json(F.struct(F.col(f"_{c}").alias("v")))), F.lit(c)) for c in kept]), lambda x: x.isNotNull())
    status = F.when(F.col("_text").isNull(), "NO_EXPLANATION").when(F.size(changed) > 0, "ERR_CHANGED").otherwise("OK")
    j = j.withColumns({"changed": F.when(F.col("_text").isNotNull(), changed).otherwise(F.array().cast("array<string>")), "explanation_status": status})
    return j.withColumn("explanation", F.when(F.col("explanation_status") == "OK", F.col("_text"))).drop("_text", *[f"_{c}" for c in kept])
