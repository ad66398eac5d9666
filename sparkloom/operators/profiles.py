"""Profiles of domains from their request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import last_sums, placed

# Fixed values of the profiles.
ALPHA, TTL_DAYS, STREAK = 0.2, 14, 3


def success_profiles(log: DataFrame, as_of: Column, alpha: float = ALPHA, ttl_days: int = TTL_DAYS, streak: int = STREAK) -> DataFrame:
    """Per domain of (domain, ts, seq, ok): n, ewma, failure_streak, last_seen and reprobe.

    The average starts at the first result and moves by ``alpha`` towards each
    next one; every result counts, with the weight that the whole fold gives it. A
    domain is probed again once its last result is ``ttl_days`` old or its last ``streak`` results failed.
    """
    r = placed(log, "domain", "ts", ["seq"])
    later = F.col("total") - F.col("n")
    ok = F.col("ok").cast("double")
    weight = F.pow(F.lit(1 - alpha), later) * F.when(F.col("n") == 1, 1.0).otherwise(alpha)
    g = r.groupBy("domain").agg(F.count("*").alias("n"), F.sum(weight * ok).alias("ewma"), F.coalesce(F.min(F.when(F.col("ok").cast("boolean"), later)), F.count("*")).alias("failure_streak"), F.max("ts").alias("last_seen"))
    return g.withColumn("reprobe", (as_of >= F.col("last_seen") + F.make_dt_interval(F.lit(ttl_days))) | (F.col("failure_streak") >= streak))


def recent_novelty(docs: DataFrame, floors: dict[str, float] | None = None, last: int = 100) -> DataFrame:
    """Of (branch, ts, seq, entities, claims, domains; arrays of names): novelty of the last ``last`` documents, and stop.

    An item is new in the first document of its branch that has it. ``novel_<kind>`` is the new
    share among the items of the last documents; a branch should stop once a full
    run of them is under all floors.
    """
    floors = floors or {"entities": 0.05, "claims": 0.05, "domains": 0.10}
    r = placed(docs, "branch", "ts", ["seq"], "place", "_all").drop("_all")
    named = lambda kind: F.transform(F.array_distinct(kind), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("item")))
    every = F.explode(F.concat(*map(named, floors)))
    items = r.select("branch", "place", every.alias("e")).select("branch", "place", "e.kind", "e.item")
    # First seen is a minimum, so a hot item shrinks before it moves; then only firsts are counted.
    first = items.groupBy("branch", "kind", "item").agg(F.min("place").alias("place"))
    new = first.groupBy("branch", "place").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"_new_{k}") for k in floors])
    j = r.join(new, ["branch", "place"], "left").withColumns({f"_all_{k}": F.size(F.array_distinct(k)) for k in floors})
    sums = {f"{s}{k}": F.coalesce(F.col(f"{s}{k}"), F.lit(0)) for k in floors for s in ("_new_", "_all_")}
    j = last_sums(j, "branch", "place", sums, last)
    share = {f"novel_{k}": F.when(F.col(f"_all_{k}") > 0, F.col(f"_new_{k}") / F.col(f"_all_{k}")).otherwise(0.0) for k in floors}
    j = j.withColumns(share)
    stop = F.col("place") >= last
    for k, floor in floors.items():
        stop = stop & (F.col(f"novel_{k}") < floor)
    return j.withColumn("stop", stop).drop(*sums)


def parser_demotions(evidence: DataFrame, keys: list[str], ok: Column, least: float = 0.9) -> DataFrame:
    """Per parser (``keys``): the share of rows that pass, and whether it is under ``least``."""
    ratio = F.avg(F.coalesce(ok, F.lit(False)).cast("int"))
    return evidence.groupBy(*keys).agg(ratio.alias("ratio")).withColumn("demote", F.col("ratio") < least)
