"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.shared import new_folder, remove

from .joins import hot_join


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of the nodes of ``edges`` (a, b): the smallest node that each reaches.

    First each node's neighbours are linked to the smallest of them instead, so that the many
    edges of a large group become about one a node. Then label passing with pointer jumping, to the
    fixed point; a round's tables go once the next has its own. A node with a large part of all edges does not land in one task.
    """
    spark, folder = edges.sparkSession, new_folder(edges.sparkSession)

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    given = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "given")
    low = given.groupBy("a").agg(F.min("b").alias("low"))
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    fewer = given.join(low, "a").select(F.explode(F.array(pair("a", "low"), pair("b", "low"))).alias("e")).select("e.*").distinct()
    both = stored(fewer.union(fewer.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "label-0")
    step = 0
    while True:
        step += 1
        # Labels of the neighbours: a hot neighbour b is the key of many edges.
        near = hot_join(both, label.withColumnRenamed("node", "b"), ["b"])
        seen = near.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        lower = stored(label.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("mid")), f"lower-{step}")
        up = label.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        new = stored(hot_join(lower, up, ["mid"]).select("node", F.least("mid", "top").alias("root"), "old"), f"label-{step}")
        for name in (f"lower-{step}", f"label-{step - 1}"):
            remove(spark, f"{folder}/{name}")
        label = new.select("node", "root")
        if new.filter(F.col("root") != F.col("old")).isEmpty():
            remove(spark, f"{folder}/given")
            remove(spark, f"{folder}/both")
            return label
