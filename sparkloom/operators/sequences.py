"""Places in long per-key sequences, in two steps, so that no task orders a hot key's whole history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(rows: DataFrame, key: str, ts: str, order: list[str], name: str = "n", total: str = "total") -> DataFrame:
    """Add each row's place (from 1) among those of its key by ``ts`` and ``order``, and how many there are.

    Rows are ranked within their day; a day's offset is what the days before it hold.
    """
    r = rows.withColumn("_day", F.to_date(ts))
    days = r.groupBy(key, "_day").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(key)
    days = days.select(key, "_day", (F.sum("_c").over(w.orderBy("_day")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias(total))
    within = F.row_number().over(Window.partitionBy(key, "_day").orderBy(ts, *order))
    return r.withColumn("_w", within).join(days, [key, "_day"]).withColumn(name, F.col("_before") + F.col("_w")).drop("_day", "_w", "_before")


def last_sums(rows: DataFrame, key: str, place: str, sums: dict[str, Column], last: int = 100, block: int = 10_000) -> DataFrame:
    """Add sums over each row and the ``last`` - 1 before it. ``place`` counts a key's rows from 1.

    A key is cut into blocks of ``block`` rows; the end of a block is also context of the next.
    """
    at = F.col(place) - 1
    home = F.floor(at / block)
    also = F.when(at % block > block - last, F.array(home, home + 1)).otherwise(F.array(home))
    b = rows.withColumn("_home", home).withColumn("_block", F.explode(also))
    w = Window.partitionBy(key, "_block").orderBy(place).rowsBetween(1 - last, 0)
    return b.withColumns({n: F.sum(c).over(w) for n, c in sums.items()}).filter("_block = _home").drop("_home", "_block")
