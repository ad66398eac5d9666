"""Version-aware keys: the same inputs under the same versions have the same key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_hash(ids: Column) -> Column:
    """A hash of an array of ids, in any order, each once."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(ids)), ","), 256)


def merged_set_hash(ids: Column, where: Column | None = None) -> Column:
    """An aggregate: a hash of a group's ids that needs no list of them; each id must come once.

    The ids' SHA-256 are added up in eight parts of 32 bits, so partial sums merge
    in any order and a group of any size is nine numbers; their number counts too.
    """
    if where is not None:
        ids = F.when(where, ids)
    h = F.sha2(ids.cast("string").cast("binary"), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for i in range(8)]
    return F.sha2(F.concat_ws(",", F.count(ids).cast("string"), *parts).cast("binary"), 256)


def versioned(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def signal_keys(raw: DataFrame, version: str, listed: bool = False) -> DataFrame:
    """(niche_id, signal_type, key): the key hangs on the version and the set of records.

    ``listed`` hashes the sorted list of a group's records, which one row must hold;
    else their hashes are added up, for groups of any size.
    """
    group = ["niche_id", "signal_type"]
    if listed:
        sets = raw.groupBy(*group).agg(set_hash(F.collect_set("record_id")).alias("_set"))
    else:
        sets = raw.select(*group, "record_id").distinct().groupBy(*group).agg(merged_set_hash(F.col("record_id")).alias("_set"))
    return sets.select(*group, versioned(*group, F.lit(version), "_set").alias("key"))


def opportunity_keys(axes: DataFrame, scoring_version: str, weights_version: str) -> DataFrame:
    """(niche_id, key) of pivoted axes: the key hangs on both versions and the signals used."""
    return axes.select("niche_id", versioned("niche_id", F.lit(scoring_version), F.lit(weights_version), set_hash(F.col("scored_from"))).alias("key"))
