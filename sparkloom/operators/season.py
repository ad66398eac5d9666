"""Seasonal timing: when to decide, and whether the season is confirmed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEADS = ("purchase_lead_days", "content_lead_days", "supplier_lead_days")


def decision_dates(calendar: DataFrame, signals: DataFrame, year: int, least_signals: int = 2) -> DataFrame:
    """Add use_start, decide_by, n_signals, confirmed and status to (season_id, region, hemisphere, window_start MM-DD, leads).

    A season is decided on its longest lead before its use window. ``signals``
    (season_id, region, hemisphere, source) confirm it if ``least_signals`` independent
    sources saw it in the same region and hemisphere; timing of one is never that of another.
    """
    start = F.concat(F.lit(f"{year:04d}-"), "window_start").try_cast("date")
    longest = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in LEADS])
    key = ["season_id", "region", "hemisphere"]
    seen = signals.groupBy(*key).agg(F.count_distinct("source").alias("n_signals"))
    c = calendar.withColumn("use_start", start).withColumn("decide_by", F.date_sub("use_start", longest.cast("int")))
    c = c.join(seen, key, "left").withColumn("n_signals", F.coalesce("n_signals", F.lit(0)))
    status = F.when(F.col("use_start").isNull(), "ERR_WINDOW").when(F.col("n_signals") < least_signals, "UNCONFIRMED").otherwise("OK")
    return c.withColumns({"confirmed": F.col("n_signals") >= least_signals, "status": status})
