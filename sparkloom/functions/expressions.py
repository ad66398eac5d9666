"""Column expressions of the scoring model. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring model.
AXES = ("demand", "growth", "pain", "competition", "content")
TIERS = ("open", "defended", "hostile")
TIER_WEIGHT = {"open": 1.0, "defended": 0.85, "hostile": 0.5}
N_REF = {"demand": 50, "growth": 30, "pain": 40, "competition": 100, "content": 60}
HALF_LIFE_DAYS = {"demand": 60, "growth": 30, "pain": 180, "competition": 45, "content": 21}
CONFIDENCE_PARTS = {"sample": 0.45, "tier": 0.30, "recency": 0.25}
NEGATIVE_TYPES = ("competition",)
NEGATIVE_METRICS = ("listing_count", "listing_density", "seller_count", "ad_count", "ad_intensity", "content_saturation")
AXIS_WEIGHTS = {"demand": 0.25, "growth": 0.15, "pain": 0.25, "competition": 0.20, "content": 0.15}
LAMBDA_GAP, LAMBDA_PAIN = 0.15, 0.15
MIN_CELL_CONFIDENCE = 0.40
DEFAULT_HALF_LIFE = 60


def lookup(key: Column, table: Mapping[str, float], default: float | None = None) -> Column:
    """A small fixed table as a literal map; keys that it lacks give ``default`` or null."""
    entries = [F.lit(x) for k, v in table.items() for x in (k, v)]
    found = F.try_element_at(F.create_map(*entries), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Held between both; null stays null (``least`` and ``greatest`` would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def age_days(window_to: Column, as_of: Column) -> Column:
    """Days from the window's end to ``as_of``, never below 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(window_to)) / 86_400e6)


def tier_weight(tier: Column, override: Mapping[str, float] | None = None) -> Column:
    return lookup(tier, {**TIER_WEIGHT, **(override or {})})


def signal_confidence(sample_n: Column, kind: Column, tier: Column, window_to: Column, as_of: Column) -> Column:
    """Sample size, source tier and recency in one figure from 0 to 1; null for an unknown type or tier."""
    sample = F.least(F.lit(1.0), F.log1p(sample_n.cast("double")) / F.log1p(lookup(kind, N_REF).cast("double")))
    recency = F.exp(-age_days(window_to, as_of) / lookup(kind, HALF_LIFE_DAYS))
    w = CONFIDENCE_PARTS
    known = lookup(kind, N_REF).isNotNull() & sample_n.isNotNull() & window_to.isNotNull()
    return F.when(known, clamp(w["sample"] * sample + w["tier"] * tier_weight(tier) + w["recency"] * recency))


def expires_at(observed_at: Column, kind: Column) -> Column:
    days = lookup(kind, HALF_LIFE_DAYS, DEFAULT_HALF_LIFE).cast("int")
    return F.date_trunc("second", observed_at) + F.make_dt_interval(days)


def direction(score: Column, kind: Column, metric: Column) -> Column:
    """Scores of what is bad news are turned round."""
    return F.when(kind.isin(*NEGATIVE_TYPES) | metric.isin(*NEGATIVE_METRICS), 1 - score).otherwise(score)


def shrink(value: Column, confidence: Column) -> Column:
    """Towards 0.5 by what confidence is lacking."""
    return 0.5 + (value - 0.5) * clamp(confidence)


def geometric_mean(values: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """Null unless all values are positive."""
    weights = weights or [1.0] * len(values)
    total = sum(weights)
    logs = sum((w * F.ln(v) for v, w in zip(values, weights, strict=True)), F.lit(0.0))
    positive = F.lit(True)
    for v in values:
        positive = positive & (v > 0)
    return F.when(positive, F.exp(logs / total))
