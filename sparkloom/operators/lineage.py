"""Lineage: closure over an edge table, leaves, differences and replay plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.shared import cut

from .joins import hot_join


def strip_version(kind):
    """Kinds that differ only by a trailing ``.v1`` are one kind."""
    return F.regexp_replace(kind, r"\.v1$", "")


def unique_edges(edges: DataFrame) -> DataFrame:
    kinds = {c: strip_version(F.col(c)) for c in ("child_kind", "parent_kind")}
    return edges.withColumns(kinds).dropDuplicates(["child_kind", "child_id", "parent_kind", "parent_id"])


def select_edges(edges: DataFrame, limit: int | None = None, **where: str) -> DataFrame:
    for column, value in where.items():
        edges = edges.filter(F.col(column) == value)
    ordered = edges.orderBy("child_kind", "child_id", "parent_kind", "parent_id")
    return ordered if limit is None else ordered.limit(limit)


def _walk(start: DataFrame, edges: DataFrame, step, merge: int = 8) -> DataFrame:
    """All (root, kind, id, depth) found, by rounds until one finds nothing new, however deep that is.

    ``step`` turns a frontier joined to its edges into the next one. The edges are
    hashed by child once. A round writes only its new rows; every ``merge`` rounds what
    was found becomes one table, so that plans stay small. A node that many roots
    reach does not land in one task.
    """
    key = ["root", "kind", "id"]
    frontier = cut(start.withColumn("depth", F.lit(0)))
    e = cut(_within(edges, frontier).withColumnsRenamed({"child_kind": "kind", "child_id": "id"}).repartition("kind", "id"))
    n = frontier.count()
    found, depth = [frontier], 0
    while n:
        depth += 1
        now = frontier.drop("depth")
        near = hot_join(now, e, ["kind", "id"]) if n > FEW else now.join(e, ["kind", "id"])
        frontier = cut(step(near).join(_union(found).select(*key), key, "left_anti").withColumn("depth", F.lit(depth)))
        n = frontier.count()
        found = [*found, frontier] if len(found) < merge else [cut(_union([*found, frontier]))]
    return _union(found)


def _within(edges: DataFrame, start: DataFrame, most: int = 1000) -> DataFrame:
    """The edges that a walk from ``start`` can meet: those of the kinds that its kinds lead to, by all edges' pairs of kinds.

    With over ``most`` pairs or kinds all edges stay.
    """
    pairs = edges.select("child_kind", "parent_kind").distinct().limit(most + 1).collect()
    kinds = {r[0] for r in start.select("kind").distinct().limit(most + 1).collect()}
    if len(pairs) > most or len(kinds) > most:
        return edges
    while new := {p for c, p in pairs if c in kinds} - kinds:
        kinds |= new
    return edges.filter(F.col("child_kind").isin(*sorted(k for k in kinds if k is not None)))


#: A frontier of so few rows has no hot node.
FEW = 1000


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def trace(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root_kind, root_id, kind, id, depth) of every node that each root reaches, itself at depth 0.

    All roots walk together, a round per depth; a node met before is not walked
    again, so cycles end. Duplicates from shared parents collapse in each round.
    """
    start = roots.select(F.struct("kind", "id").alias("root"), "kind", "id").distinct()
    up = lambda j: j.select("root", F.col("parent_kind").alias("kind"), F.col("parent_id").alias("id")).distinct()
    # Edges that are there twice give what the round's distinct drops.
    kinds = {c: strip_version(F.col(c)) for c in ("child_kind", "parent_kind")}
    found = _walk(start, edges.withColumns(kinds).select("child_kind", "child_id", "parent_kind", "parent_id"), up)
    return found.select(F.col("root.kind").alias("root_kind"), F.col("root.id").alias("root_id"), "kind", "id", "depth")


def leaves(traced: DataFrame, leaf_kind: str = "query_spec") -> DataFrame:
    """Per root: its sorted leaves and whether there is one."""
    ids = F.array_sort(F.collect_set(F.when(F.col("kind") == leaf_kind, F.col("id"))))
    return traced.groupBy("root_kind", "root_id").agg(ids.alias("leaves")).withColumn("complete", F.size("leaves") > 0)


def resolve(ids: DataFrame, artifacts: DataFrame, specs: DataFrame, tasks: DataFrame) -> DataFrame:
    """The kind of each id: the latest artifact's, else query_spec, else task, else ``ERR_UNKNOWN``."""
    a = artifacts.select(F.col("artifact_id").alias("id"), strip_version(F.col("artifact_kind")).alias("kind"), F.lit(0).alias("p"), F.col("created_at").cast("long").alias("at"))
    s = specs.select(F.col("query_spec_id").alias("id"), F.lit("query_spec").alias("kind"), F.lit(1).alias("p"), F.lit(0).cast("long").alias("at"))
    t = tasks.select(F.col("task_id").alias("id"), F.lit("task").alias("kind"), F.lit(2).alias("p"), F.lit(0).cast("long").alias("at"))
    known = a.unionByName(s).unionByName(t).groupBy("id").agg(F.min_by("kind", F.struct("p", -F.col("at"), "kind")).alias("kind"))
    return ids.join(known, "id", "left").withColumn("kind", F.coalesce("kind", F.lit("ERR_UNKNOWN")))


def diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with ``side``: left, right or both."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(True)), right.select(*keys).distinct().withColumn("_r", F.lit(True))
    j = a.join(b, keys, "full_outer")
    return j.select(*keys, F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both").alias("side"))


def replay_plan(roots: DataFrame, edges: DataFrame, leaf_kind: str) -> DataFrame:
    """(root_id, leaf_id, depth, pins): version tags on the first-found, shortest path to each leaf; ties by the path's text."""

    def up(j: DataFrame) -> DataFrame:
        pins = F.concat_ws(">", F.nullif("pins", F.lit("")), F.concat_ws("=", "parent_kind", "version_tag"))
        return j.select("root", F.col("parent_kind").alias("kind"), F.col("parent_id").alias("id"), pins.alias("pins")).groupBy("root", "kind", "id").agg(F.min("pins").alias("pins"))

    start = roots.select(F.struct("kind", "id").alias("root"), "kind", "id").distinct().withColumn("pins", F.lit(""))
    found = _walk(start, edges.select("child_kind", "child_id", "parent_kind", "parent_id", "version_tag"), up)
    return found.filter(F.col("kind") == leaf_kind).select(F.col("root.id").alias("root_id"), F.col("id").alias("leaf_id"), "depth", "pins")


def node_metadata(traced: DataFrame, attributes: DataFrame) -> DataFrame:
    return traced.join(attributes, ["kind", "id"], "left")
