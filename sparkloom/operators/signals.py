"""Raw metrics to comparable signals: cohort normalisation, direction, confidence and expiry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import expressions as X
from sparkloom.sources.shared import cut

from .ranks import ranked

CODE_VERSION = "normalize-1"


def violations(as_array: list[tuple[str, Column]]) -> Column:
    """Names of the rules that a row breaks, sorted; a rule that gives null is broken."""
    marks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in as_array]
    return F.array_sort(F.filter(F.array(*marks), lambda x: x.isNotNull()))


def raw_violations() -> Column:
    """What a raw signal must have before it is normalised."""
    return violations([
        ("niche_id", F.length("niche_id") > 0), ("signal_type", F.col("signal_type").isin(*X.AXES)), ("tier", F.col("tier").isin(*X.TIERS)),
        ("window", F.col("window_from").isNotNull() & (F.col("window_from") <= F.col("window_to"))), ("metric_name", F.length("metric_name") > 0),
        ("metric_value", F.col("value").isNotNull() & ~F.isnan("value")), ("sample_n", F.col("sample_n") >= 1), ("evidence_ids", F.size("evidence_ids") > 0),
    ])


def finalize_raw(raw: DataFrame, record_id: str = "record_id") -> DataFrame:
    """Put the record's id first among the evidence ids if it is missing; an unknown tier is open."""
    has = F.array_contains("evidence_ids", F.col(record_id))
    return raw.withColumns({
        "evidence_ids": F.when(has, F.col("evidence_ids")).otherwise(F.concat(F.array(record_id), F.coalesce("evidence_ids", F.array().cast("array<string>")))),
        "tier": F.coalesce("tier", F.lit("open")),
    })


def cohort_ranks(rows: DataFrame, cohort: str = "cohort", value: str = "value", lower: float = 0.05, upper: float = 0.95, slices: int = 128) -> DataFrame:
    """Rows (cohort, value, n, lo, hi, clipped, pct) per different value.

    ``clipped`` is the value held to those at ranks floor(lower*(n-1)) and
    floor(upper*(n-1)); ``pct`` its tie-aware rank from 0 to 1 among the
    unclipped values (0.5 if alone). Rows are read once, into counts per value.
    Cohorts are cut into slices at approximate quantiles of those, so that no task
    ranks a whole cohort; a slice's offset comes from the totals of those before it.
    Cohort columns of the counts meet small tables (a row a cohort, or a slice): the
    planner broadcasts those, or splits what is skewed.
    """
    counts = cut(rows.groupBy(cohort, value).agg(F.count("*").alias("c")))
    cuts = counts.groupBy(cohort).agg(F.percentile_approx(value, F.array(*[F.lit(i / slices) for i in range(1, slices)]), 1000).alias("cuts"))
    sliced = counts.join(_small(cuts), cohort).withColumn("slice", F.size(F.filter("cuts", lambda b: b < F.col(value)))).drop("cuts")
    # Within a slice by value; the slices' totals are the last of these sums.
    within = sliced.withColumn("_upto", F.sum("c").over(Window.partitionBy(cohort, "slice").orderBy(value)))
    within = cut(within)
    totals = within.groupBy(cohort, "slice").agg(F.sum("c").alias("t"))
    w = Window.partitionBy(cohort)
    offsets = totals.select(cohort, "slice", (F.sum("t").over(w.orderBy("slice")) - F.col("t")).alias("offset"), F.sum("t").over(w).alias("n"))
    upto = F.col("offset") + F.col("_upto")
    placed = within.join(_small(offsets), [cohort, "slice"]).select(cohort, value, "c", "n", (upto - F.col("c")).alias("below"), upto.alias("upto"))
    at = lambda share: F.floor(F.lit(float(share)) * (F.col("n") - 1))
    holds = lambda share: (F.col("below") <= at(share)) & (at(share) < F.col("upto"))
    entry = F.struct(F.col(value).alias("v"), F.col("below").alias("b"), F.col("c").alias("c"))
    ends = placed.groupBy(cohort).agg(F.max(F.when(holds(lower), entry)).alias("lo"), F.max(F.when(holds(upper), entry)).alias("hi"))
    j = placed.join(_small(ends), cohort)
    own = F.struct(F.col(value).alias("v"), F.col("below").alias("b"), F.col("c").alias("c"))
    chosen = F.when(F.col("n") < 2, own).when(F.col(value) < F.col("lo.v"), F.col("lo")).when(F.col(value) > F.col("hi.v"), F.col("hi")).otherwise(own)
    j = j.withColumn("_e", chosen)
    pct = F.when(F.col("n") == 1, F.lit(0.5)).otherwise((F.col("_e.b") + (F.col("_e.c") - 1) / 2) / (F.col("n") - 1))
    return j.select(cohort, value, "n", F.col("lo.v").alias("lo"), F.col("hi.v").alias("hi"), F.col("_e.v").alias("clipped"), pct.alias("pct"))


#: So many rows of totals a cohort or a slice are broadcast; more are met by a shuffle.
FEW = 100_000


def _small(totals: DataFrame) -> DataFrame:
    """Totals, materialised; marked for broadcast once their number is known to be small."""
    t = cut(totals)
    return F.broadcast(t) if t.count() <= FEW else t


def normalize(raw: DataFrame, as_of: Column, cohort: Column | None = None, keep_rank: bool = False) -> DataFrame:
    """Signals of all cohorts at once: normalized_score, confidence and expires_at added; ``percentile`` too with ``keep_rank``.

    An unknown type or tier gives a null confidence and the status ``ERR_UNKNOWN_KIND``.
    """
    keyed = raw.withColumn("cohort", F.col("signal_type") if cohort is None else cohort)
    ranks = cohort_ranks(keyed).select("cohort", "value", F.col("pct").alias("percentile"))
    joined = keyed.join(ranks, ["cohort", "value"])
    confidence = X.signal_confidence(F.col("sample_n"), F.col("signal_type"), F.col("tier"), F.col("window_to"), as_of)
    out = joined.withColumns({
        "normalized_score": X.direction(F.col("percentile"), F.col("signal_type"), F.col("metric_name")), "confidence": confidence,
        "expires_at": X.expires_at(F.col("observed_at"), F.col("signal_type")),
    })
    return out.withColumn("status", F.when(F.col("confidence").isNull(), "ERR_UNKNOWN_KIND").otherwise("OK")).drop("cohort", *([] if keep_rank else ["percentile"]))


def invariant_violations(strict: bool = False) -> Column:
    """What a normalised signal with its ``percentile`` breaks, sorted: ``score`` out of 0 to 1, ``window`` not set, ``direction``
    not applied. With ``strict`` a break is an error that stops the job."""
    expected = X.direction(F.col("percentile"), F.col("signal_type"), F.col("metric_name"))
    broken = violations([
        ("score", F.col("normalized_score").between(0, 1)), ("window", F.col("window_from").isNotNull() & F.col("window_to").isNotNull()),
        ("direction", F.abs(F.col("normalized_score") - expected) <= 1e-12),
    ])
    if not strict:
        return broken
    return F.when(F.size(broken) > 0, F.raise_error(F.concat_ws(": ", "signal_id", F.array_join(broken, ",")))).otherwise(broken)


# What the parts of competition weigh.
COMPONENTS = {"listing_density": 0.6, "ad_intensity": 0.4}


def competition_composite(components: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Per niche of (niche_id, metric_name, value): the parts' means, their weighted sum before ranking, its rank over all niches, and status.

    Niches are numbered by composite, equal ones by niche_id; places are held to those at shares 0.05 and 0.95. A niche that
    lacks a part has no composite and the status ``ERR_MISSING_COMPONENT``.
    """
    weights = weights or COMPONENTS
    g = components.groupBy("niche_id").agg(*[F.avg(F.when(F.col("metric_name") == m, F.col("value"))).alias(m) for m in weights])
    total = F.lit(0.0)
    for m, w in weights.items():
        total = total + w * F.col(m)
    g = cut(g.withColumn("composite", total).withColumn("status", F.when(F.col("composite").isNull(), "ERR_MISSING_COMPONENT").otherwise("OK")))
    whole = g.filter("status = 'OK'")
    last = whole.count() - 1
    place = ranked(whole.withColumn("_all", F.lit(1)), ["_all"], ["composite", "niche_id"], "_i").drop("_all")
    held = F.least(F.greatest("_i", F.lit(math.floor(0.05 * last) + 1)), F.lit(math.floor(0.95 * last) + 1))
    percentile = (held - 1) / last if last > 0 else F.lit(0.5)
    return place.withColumn("percentile", percentile).drop("_i").unionByName(g.filter("status <> 'OK'").withColumn("percentile", F.lit(None).cast("double")))
