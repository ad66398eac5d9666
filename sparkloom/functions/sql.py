"""The scoring model's functions for SQL: expressions that the optimizer puts in place, not Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .expressions import TIER_WEIGHT

_TIERS = " ".join(f"WHEN '{t}' THEN {w}D" for t, w in TIER_WEIGHT.items())


def register(spark: SparkSession) -> None:
    """Make ``shrink_toward_neutral``, ``tier_weight`` and ``signal_confidence`` known to this session's SQL."""
    from .expressions import CONFIDENCE_PARTS as W
    from .expressions import HALF_LIFE_DAYS, N_REF

    case = lambda table: "CASE kind " + " ".join(f"WHEN '{k}' THEN {float(v)}D" for k, v in table.items()) + " END"
    age = "greatest(0D, (unix_micros(as_of) - unix_micros(window_to)) / 86400e6D)"
    sample = f"least(1D, log1p(cast(sample_n AS DOUBLE)) / log1p({case(N_REF)}))"
    confidence = f"{W['sample']}D * {sample} + {W['tier']}D * (CASE tier {_TIERS} END) + {W['recency']}D * exp(-{age} / {case(HALF_LIFE_DAYS)})"
    for head, body in (
        ("shrink_toward_neutral(v DOUBLE, confidence DOUBLE)", "0.5D + (v - 0.5D) * (CASE WHEN confidence IS NULL THEN NULL ELSE greatest(0D, least(1D, confidence)) END)"),
        ("tier_weight(tier STRING)", f"CASE tier {_TIERS} END"),
        ("signal_confidence(sample_n BIGINT, kind STRING, tier STRING, window_to TIMESTAMP, as_of TIMESTAMP)", f"CASE WHEN ({confidence}) IS NOT NULL THEN greatest(0D, least(1D, {confidence})) END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")
