"""A join for keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", most: int = 1000, floor: int = 1000, rows_a_key: int = 1000) -> DataFrame:
    """``left`` joined to ``right``, whose keys have few rows each; ``left`` should be materialised.

    The largest keys of ``left``, at most ``most`` of those with over ``floor``
    rows, would each land in one task. Their rows of ``right`` are few and
    broadcast, and theirs of ``left`` stay where they are; all other keys, none of
    which holds over 1/``most`` of the rows, shuffle. More than ``rows_a_key`` rows
    of ``right`` for each hot key are not broadcast: then all is left to the planner.
    """
    hot = left.groupBy(*keys).count().filter(F.col("count") > floor).orderBy(F.desc("count")).limit(most).select(*keys)
    rows = hot.collect()
    if not rows:
        return left.join(right, keys, how)
    few = F.broadcast(left.sparkSession.createDataFrame(rows, hot.schema))
    theirs = right.join(few, keys, "left_semi")
    bound = rows_a_key * len(rows)
    if theirs.limit(bound + 1).count() > bound:
        return left.join(right, keys, how)
    there = left.join(few, keys, "left_semi").join(F.broadcast(theirs), keys, how)
    return there.unionByName(left.join(few, keys, "left_anti").join(right, keys, how))
