"""Places and previous rows in groups of any size, in slices of the sorted rows, so that no task orders a whole group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.shared import cut


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "rank", previous: Mapping[str, str] | None = None, slices: int | None = None) -> DataFrame:
    """Add each row's place ``name`` (long, from 1) in its group by ``order``, and for each (new, column) of
    ``previous`` that column's value in the row before (null for a group's first).

    All rows are sorted by range over group and order at once, so a large group takes many
    of the ``slices`` (by default as many as shuffle partitions) and small ones share one. Rows
    are numbered inside a slice; from slice to slice only a count and one row a group pass on.
    ``order`` should tell all rows of a group apart: equal ones stay in one slice, in any order.
    Null groups are a group; an empty table gives no rows.
    """
    previous = dict(previous or {})
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    n = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *[F.col(c) for c in group], *by).withColumn("_slice", F.spark_partition_id())
    w = Window.partitionBy("_slice", *group).orderBy(*by)
    inner = dealt.select("*", F.row_number().over(w).cast("long").alias("_n"), *[F.lag(c).over(w).alias(f"_p_{new}") for new, c in previous.items()])
    inner = cut(inner)  # the slices are drawn from a sample: they must not be drawn again
    last = F.max_by(F.struct("_n", *[F.col(c).alias(f"_p_{new}") for new, c in previous.items()]), "_n")
    ends = inner.groupBy(*group, "_slice").agg(last.alias("_last"))
    over = Window.partitionBy(*group).orderBy("_slice")
    starts = ends.select(*group, "_slice", (F.sum("_last._n").over(over) - F.col("_last._n")).alias("_before"), F.lag("_last").over(over).alias("_carry"))
    out = same(inner, starts, [*group, "_slice"]).withColumn(name, F.col("_before") + F.col("_n"))
    out = out.withColumns({new: F.when(F.col("_n") == 1, F.col(f"_carry._p_{new}")).otherwise(F.col(f"_p_{new}")) for new in previous})
    return out.drop("_slice", "_n", "_before", "_carry", *[f"_p_{new}" for new in previous])


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both that have equal keys, of which null is one; the keys come once."""
    theirs = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    held = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(theirs, held).drop(*[f"_r_{k}" for k in keys])
