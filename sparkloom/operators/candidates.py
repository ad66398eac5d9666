"""Rubric scores of candidates, query packs and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ranks import ranked, same
from sparkloom.sources.shared import cut

# Fixed values of the rubric.
DIMENSIONS = {
    "behavior_frequency": 1.2, "friction_severity": 1.3, "workaround_strength": 1.4, "complaint_repetition": 1.2, "product_simplicity": 0.8, "shipping_fit": 0.7, "margin_potential": 1.0,
    "return_risk_inverse": 0.8, "community_reachability": 1.0, "competition_gap": 1.3, "seasonal_timing": 0.7, "expansion_potential": 0.8, "risk_inverse": 1.0,
}
UNVERIFIED, SAFETY = 12, 20
BANDS = {"reject": (0, 49.99), "research": (50, 64.99), "experiment": (65, 79.99), "priority": (80, 100)}

def weighted_score() -> Column:
    """100 x the weighted sum over five times the weights; null if a level is no whole number from 0 to 5."""
    # One array of levels, looked at once: a sum of thirteen conditionals would be copied into every use by the planner.
    levels = F.transform(F.array(*[F.col(c).cast("string") for c in DIMENSIONS]), lambda x: x.try_cast("double"))
    held = F.transform(levels, lambda x: F.when(x.between(0, 5), x))
    weighted = F.zip_with(held, F.array(*[F.lit(float(w)) for w in DIMENSIONS.values()]), lambda x, w: x * w)
    return 100 * F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x) / (5 * sum(DIMENSIONS.values()))


def penalties() -> Column:
    """Names of the penalties that hold. The risk test is on the text, so ``1.0`` escapes it."""
    unverified = (F.col("score_basis") != "seed_prior") & (F.coalesce(F.trim("evidence_ids"), F.lit("")) == "")
    risky = F.col("risk_inverse").cast("string").isin("0", "1")
    return F.filter(F.array(F.when(unverified, "unverified_metric"), F.when(risky, "high_safety_dependency")), lambda x: x.isNotNull())


def penalised(score: Column, names: Column) -> Column:
    taken = F.when(F.array_contains(names, "unverified_metric"), UNVERIFIED).otherwise(0) + F.when(F.array_contains(names, "high_safety_dependency"), SAFETY).otherwise(0)
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score - taken)))


def band(score: Column) -> Column:
    """The first band that holds the score; ``unknown`` in the gaps and for null."""
    names = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for n, (a, b) in BANDS.items()])
    return F.coalesce(F.try_element_at(F.transform(F.filter(names, lambda x: score.between(x["a"], x["b"])), lambda x: x["n"]), F.lit(1)), F.lit("unknown"))


def eligible(score: Column) -> Column:
    return (F.lower(F.col("hard_gates_passed").cast("string")) == "true") & (score >= 65)


def score_table(candidates: DataFrame) -> DataFrame:
    """All columns, with weighted_score, penalties, final_score, score_band, experiment_eligible and status. No shuffle."""
    c = candidates.withColumns({"weighted_score": weighted_score(), "_p": penalties()})
    c = c.withColumn("_f", penalised(F.col("weighted_score"), F.col("_p")))
    return c.withColumns({
        "penalties": F.array_join("_p", ";"), "final_score": F.format_string("%.2f", F.round("_f", 2)), "score_band": band(F.col("_f")), "experiment_eligible": F.coalesce(eligible(F.col("_f")), F.lit(False)),
        "status": F.when(F.col("weighted_score").isNull(), "ERR_DIMENSION").otherwise("OK"),
    }).drop("_p", "_f")


def templates(spark, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A caller's templates (id, goal, text) as a numbered table."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(rows)], "t int, template_id string, evidence_goal string, template string")


def query_pack(rows: DataFrame, packs: DataFrame, region: str, year: int) -> DataFrame:
    """Every row (r, activity, task, friction_family, product_territory) under every template.

    The templates are a hand-made list; more than 10 000 are refused, since they
    are broadcast. A placeholder that no column fills gives the status ``ERR_PLACEHOLDER``.
    """
    few = packs.limit(10_001)
    if few.count() > 10_000:
        raise ValueError("more than 10000 templates")
    j = rows.crossJoin(F.broadcast(few))
    text = F.col("template")
    for name in ("activity", "task", "friction_family", "product_territory"):
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.col(name), F.lit("")))
    text = F.replace(F.replace(text, F.lit("{region}"), F.lit(region)), F.lit("{current_year}"), F.lit(str(year)))
    j = j.withColumn("query", F.trim(text))
    return j.withColumn("status", F.when(F.col("query").rlike(r"\{\w+\}"), "ERR_PLACEHOLDER").otherwise("unsearched"))


def dedup_queries(pack: DataFrame, buckets: int = 64, few: int = 100_000) -> DataFrame:
    """The first by (r, t) of each normalised text, with dense ids ``query-0001`` on.

    The least (r, t) of a text is one number, so partial sums by hash do most of the work and
    no task sorts its rows; only the rows of those numbers are looked at whole (up to ``few``
    numbers are broadcast, more shuffle). Ids come in two steps: totals of ranges of r, then
    numbers within a range.
    """
    norm = F.lower(F.trim(F.regexp_replace("query", r"\s+", " ")))
    r = F.coalesce(F.col("r").cast("decimal(20,0)"), F.lit("-99999999999999999999").cast("decimal(20,0)"))  # null comes first
    at = r * F.lit(10_000_000_000).cast("decimal(11,0)") + F.coalesce(F.col("t").cast("decimal(10,0)"), F.lit(-4_000_000_000).cast("decimal(10,0)"))
    placed = pack.withColumns({"norm": norm, "_at": at.cast("decimal(38,0)")})
    least = cut(placed.groupBy("norm").agg(F.min("_at").alias("_at")))
    met = F.col("p.norm").eqNullSafe(F.col("l.norm")) & (F.col("p._at") == F.col("l._at"))
    right = least.alias("l")
    held = placed.alias("p").join(F.broadcast(right) if least.count() <= few else right, met, "left_semi")
    first = held.groupBy("norm").agg(F.min(F.struct("r", "t", "query", "activity_id", "template_id", "evidence_goal", "status")).alias("q")).select("q.*")
    first = first.withColumn("part", F.floor(F.col("r") / buckets))
    held = first.groupBy("part").count()
    before = prefix_sums(held, "part", "count")
    number = F.row_number().over(Window.partitionBy("part").orderBy("r", "t"))
    out = first.withColumn("_n", number).join(before, "part")
    return out.select(F.format_string("query-%04d", (F.col("before") + F.col("_n")).cast("long")).alias("query_id"), "activity_id", "template_id", "evidence_goal", "query", "status")


def prefix_sums(totals: DataFrame, key: str, value: str, width: int = 1000) -> DataFrame:
    """(key, before): the sum of ``value`` over smaller keys (whole numbers), by blocks of keys.

    Only the block totals, a thousandth of the rows, are ordered in one task.
    """
    blocks = totals.withColumn("_b", F.floor(F.col(key) / width))
    sums = blocks.groupBy("_b").agg(F.sum(value).alias("_s"))
    starts = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_start"))
    inner = F.sum(value).over(Window.partitionBy("_b").orderBy(key)) - F.col(value)
    return blocks.withColumn("_i", inner).join(starts, "_b").select(key, (F.col("_start") + F.col("_i")).alias("before"))


def evidence_split(evidence: DataFrame) -> DataFrame:
    """The evidence of each candidate by polarity: (candidate_id, polarity, position, evidence_id, observation), table-safe.

    A row stays a row, whole: a candidate with very much evidence is never one value, and only ids
    are sorted; texts join them after. Rows that repeat an evidence_id share its position.
    """
    safe = F.regexp_replace(F.regexp_replace("observation", r"\|", "/"), r"[\r\n]+", " ")
    key = ["candidate_id", "polarity", "evidence_id"]
    ids = ranked(evidence.select(*key).distinct(), key[:2], key[2:], "position")
    return same(evidence.select(*key, safe.alias("observation")), ids, key).select("candidate_id", "polarity", F.col("position").cast("int").alias("position"), "evidence_id", "observation")


def render(candidates: DataFrame, split: DataFrame, headings: Mapping[str, str] | None = None) -> DataFrame:
    """One Markdown report per candidate, as lines (candidate_id, section, line, text) that a text sink writes in order.

    Section 0 is the title and the score; each further one is a heading (line 0) and a table row per evidence, or ``_none_``.
    """
    names = headings or {"supporting": "Supporting evidence", "contradicting": "Contradicting evidence", "neutral": "Neutral evidence"}
    c = candidates.select("candidate_id", "title", "final_score", "score_band")
    line = lambda section, n, text: F.struct(F.lit(section).alias("section"), F.lit(n).alias("line"), text.alias("text"))
    fixed = [line(0, 0, F.concat(F.lit("# "), F.col("title"))), line(0, 1, F.concat(F.lit("Score: "), F.col("final_score"), F.lit(" ("), F.col("score_band"), F.lit(")")))]
    fixed += [line(k, 0, F.lit(f"## {name}")) for k, name in enumerate(names.values(), 1)]
    heads = c.select("candidate_id", F.explode(F.array(*fixed)).alias("l")).select("candidate_id", "l.*")
    number = F.element_at(F.create_map(*[F.lit(x) for k, p in enumerate(names, 1) for x in (p, k)]), F.col("polarity"))
    known = split.filter(F.col("polarity").isin(*names)).join(c.select("candidate_id"), "candidate_id", "left_semi").withColumn("section", number)
    rows = known.select("candidate_id", "section", F.col("position").alias("line"), F.concat(F.lit("| "), F.col("evidence_id").cast("string"), F.lit(" | "), "observation", F.lit(" |")).alias("text"))
    every = c.select("candidate_id", F.explode(F.array(*[F.lit(k) for k in range(1, len(names) + 1)])).alias("section"))
    none = every.join(known.select("candidate_id", "section").distinct(), ["candidate_id", "section"], "left_anti").select("candidate_id", "section", F.lit(1).alias("line"), F.lit("_none_").alias("text"))
    return heads.unionByName(rows).unionByName(none)


# Allowed changes of the research state.
TRANSITIONS = {
    "seed": ("researching",), "researching": ("evidence_ready", "rejected", "stale"), "evidence_ready": ("red_team", "researching", "rejected"), "red_team": ("experiment_ready", "researching", "rejected"),
    "experiment_ready": ("validated", "researching", "rejected"), "validated": ("stale",), "rejected": ("researching",), "stale": ("researching",),
}


def illegal_transitions(states: DataFrame, allowed: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """Changes of (run_id, seq, state) that ``allowed`` does not list."""
    legal = F.lit(False)
    for a, bs in allowed.items():
        legal = legal | ((F.col("previous") == a) & F.col("state").isin(*bs))
    return ranked(states, ["run_id"], ["seq"], "_at", {"previous": "state"}).drop("_at").filter(F.col("previous").isNotNull() & (F.col("previous") != F.col("state")) & ~legal)
