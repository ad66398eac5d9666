"""Coverage of a niche by signals: the grid of types and tiers, gaps, the gate and what tiers are worth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import expressions as X

# Fixed values of the gate.
HARD, SOFT = ("demand", "pain"), ("growth", "competition", "content")
HARD_TIERS = ("open", "defended")
HOSTILE_CAP = 0.50


def grid(signals: DataFrame) -> DataFrame:
    """Per (niche_id, signal_type, tier): the best confidence and the sorted ids that reach it. Signals are read once."""
    cell = ["niche_id", "signal_type", "tier"]
    # Ids of equal confidence are gathered first; of a cell's confidences only the best goes on.
    same = signals.groupBy(*cell, "confidence").agg(F.collect_set("signal_id").alias("ids"))
    best = same.groupBy(*cell).agg(F.max(F.struct("confidence", F.array_sort("ids").alias("ids"))).alias("b"))
    return best.select(*cell, F.col("b.confidence").alias("best_confidence"), F.col("b.ids").alias("signal_ids"))


def best_across(kind: str, tiers: Sequence[str]) -> Column:
    """An aggregate: the best confidence of a type over some tiers, 0 if there is none."""
    return F.coalesce(F.max(F.when((F.col("signal_type") == kind) & F.col("tier").isin(*tiers), F.col("confidence"))), F.lit(0.0))


def best_columns(hard_tiers: Sequence[str] = HARD_TIERS) -> list[Column]:
    """Aggregates hard_<type> over the hard tiers and any_<type> over all tiers."""
    return [*[best_across(k, hard_tiers).alias(f"hard_{k}") for k in HARD], *[best_across(k, X.TIERS).alias(f"any_{k}") for k in SOFT]]


def best_by_niche(signals: DataFrame, hard_tiers: Sequence[str] = HARD_TIERS) -> DataFrame:
    """One row per niche: hard_<type> over the hard tiers and any_<type> over all tiers. One shuffle."""
    return signals.groupBy("niche_id").agg(*best_columns(hard_tiers))


def hard_met(floor: float = X.MIN_CELL_CONFIDENCE) -> Column:
    return (F.col("hard_demand") >= floor) & (F.col("hard_pain") >= floor)


def gaps(floor: float = X.MIN_CELL_CONFIDENCE) -> Column:
    """array<struct<signal_type, source_tier, reason>>: hard gaps, then soft ones."""
    entry = lambda kind, word, col: F.when(F.col(col) < floor, F.struct(F.lit(kind).alias("signal_type"), F.lit("open").alias("source_tier"), F.format_string(f"{word} confidence %.3f < {floor:.2f}", F.col(col)).alias("reason")))
    every = [entry(k, "needed: best of open and defended,", f"hard_{k}") for k in HARD] + [entry(k, "wanted: best of all tiers,", f"any_{k}") for k in SOFT]
    return F.filter(F.array(*every), lambda x: x.isNotNull())


def gate(best: DataFrame, as_of: Column, deadline: Column | None = None, floor: float = X.MIN_CELL_CONFIDENCE) -> DataFrame:
    """Add hard_required_met, deadline_reached, coverage_gaps and outcome.

    Outcomes: ``admitted``, ``scores_with_gaps``, ``deadline_with_gaps`` and ``blocked``.
    """
    reached = F.lit(False) if deadline is None else F.coalesce(as_of >= deadline, F.lit(False))
    j = best.withColumns({"hard_required_met": hard_met(floor), "deadline_reached": reached, "_gaps": gaps(floor)})
    outcome = F.when(F.col("hard_required_met") & (F.size("_gaps") == 0), "admitted").when(F.col("hard_required_met"), "scores_with_gaps").when(F.col("deadline_reached"), "deadline_with_gaps").otherwise("blocked")
    j = j.withColumn("outcome", outcome)
    shown = F.when(F.col("outcome").isin("scores_with_gaps", "deadline_with_gaps"), F.col("_gaps")).otherwise(F.filter("_gaps", lambda x: F.lit(False)))
    return j.withColumn("coverage_gaps", shown).drop("_gaps")


def without_tiers(signals: DataFrame, tiers: Sequence[str]) -> DataFrame:
    return signals.filter(~F.col("tier").isin(*tiers))


def hostile_dependence(signals: DataFrame, floor: float = X.MIN_CELL_CONFIDENCE, hard_required_tiers: Sequence[str] = HARD_TIERS) -> DataFrame:
    """niche_id, hostile_dependent: the hard cells are met only with hostile rows.

    With the default tiers, which hold no hostile one, it is never true; pass
    all three tiers to ask the question in earnest.
    """
    kept = [t for t in hard_required_tiers if t != "hostile"]
    met = lambda tiers: (best_across("demand", tiers) >= floor) & (best_across("pain", tiers) >= floor)
    return signals.groupBy("niche_id").agg((met(hard_required_tiers) & ~met(kept)).alias("hostile_dependent"))


def cap(confidence: Column, dependent: Column) -> Column:
    return F.when(dependent & confidence.isNotNull(), F.least(confidence, F.lit(HOSTILE_CAP))).otherwise(confidence)


def loss_gaps(signals: DataFrame, tiers: Sequence[str]) -> DataFrame:
    """The gaps of each niche of ``signals`` once some tiers are gone, also of niches with nothing else."""
    left = best_by_niche(without_tiers(signals, tiers))
    every = signals.select("niche_id").distinct().join(left, "niche_id", "left").na.fill(0.0)
    return every.withColumn("coverage_gaps", gaps())


def tier_effects(signals: DataFrame, confidence: DataFrame, lost: Sequence[str], hard_required_tiers: Sequence[str] = HARD_TIERS) -> DataFrame:
    """Per niche: hostile_dependent, its confidence (niche_id, confidence) capped for that, to 2 places, and the gaps once ``lost`` tiers are gone."""
    d = hostile_dependence(signals, hard_required_tiers=hard_required_tiers)
    j = d.join(loss_gaps(signals, lost), "niche_id").join(confidence.select("niche_id", F.col("confidence").alias("_c")), "niche_id", "left")
    return j.select("niche_id", "hostile_dependent", F.round(cap(F.col("_c"), F.col("hostile_dependent")), 2).alias("capped_confidence"), "coverage_gaps")
