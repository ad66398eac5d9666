"""An inverted file for approximate vector search by cosine.

Unit vectors are filed under the nearest of a bounded number of centroids; a query
looks into the few files whose centroids are nearest to it. Centroids come from
spherical k-means over all vectors: each task adds up its vectors per centroid, and
the sums of all tasks meet per centroid. Large files are cut into slices, as are the
queries of a file, so a task holds a slice of each and gives its k best per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.shared import cut

#: Pairs of vectors that a task scores at once.
CELLS = 1_000_000
FOUND = "query_id long, vec_id long, score double"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pd.Series) -> np.ndarray:
    return unit(np.stack(column.to_numpy()).astype(np.float64))


def fit(vectors: DataFrame, files: int, rounds: int = 6) -> np.ndarray:
    """At most ``files`` centroids (files x dimensions numbers on the driver); the first are the vectors with the least hash of their id."""
    first = vectors.filter("embedding IS NOT NULL").orderBy(F.xxhash64("vec_id", F.lit("centroid")), "vec_id").limit(files).select("embedding").collect()
    centroids = unit(np.array([r[0] for r in first], np.float64)) if first else np.zeros((0, 1))
    spark = vectors.sparkSession
    for _ in range(rounds if len(first) == files else 0):
        shared = spark.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(shared.value)
            for b in batches:
                if len(b):
                    x = _matrix(b["embedding"])
                    np.add.at(total, (x @ shared.value.T).argmax(axis=1), x)
            some = np.flatnonzero(np.abs(total).sum(axis=1) > 0)
            yield pd.DataFrame({"file": np.repeat(some, total.shape[1]), "d": np.tile(np.arange(total.shape[1]), len(some)), "x": total[some].ravel()})

        new = centroids.copy()
        met = vectors.filter("embedding IS NOT NULL").select("embedding").mapInPandas(sums, "file int, d int, x double").groupBy("file", "d").agg(F.sum("x").alias("x")).toPandas()
        new[met["file"], met["d"]] = met["x"]
        new = unit(new)
        if np.abs(new - centroids).max() < 1e-4:
            break
        centroids = new
    return centroids


def nearest_files(vectors: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Rows (vec_id, embedding, file), one for each of the ``probes`` nearest centroids; vectors are brought to length one."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b) or not len(shared.value):
                continue
            n = min(probes, len(shared.value))
            rows = max(1, 50_000 // n)  # a row comes out n times
            for at in range(0, len(b), rows):
                x = _matrix(b["embedding"].iloc[at : at + rows])
                near = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :n]
                yield pd.DataFrame({"vec_id": np.repeat(b["vec_id"].to_numpy()[at : at + rows], n), "embedding": list(np.repeat(x, n, axis=0)), "file": near.ravel()})

    return vectors.filter("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(run, "vec_id long, embedding array<double>, file int")


def _slices(filed: DataFrame, most: int, name: str) -> DataFrame:
    """Add the row's slice of its file and their number; slices have about ``most`` rows."""
    counts = filed.groupBy("file").agg(F.ceil(F.count("*") / most).cast("int").alias(f"{name}s"))
    return filed.join(F.broadcast(counts), "file").withColumn(name, F.pmod(F.xxhash64("vec_id", F.lit(name)), F.col(f"{name}s")).cast("int"))


def search(index: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, probes: int, slice_rows: int = 20_000) -> DataFrame:
    """(query_id, vec_id, score, rank): of the vectors in a query's ``probes`` nearest files the k nearest, ties by id.

    ``index`` is ``nearest_files(vectors, centroids, 1)``, materialised. One plan,
    however many queries. Null vectors are neither found nor searched for.
    """
    held = _slices(index, slice_rows, "part")
    asked = cut(nearest_files(queries, centroids, probes))
    asked = _slices(asked, slice_rows // 8, "ask")
    parts, asks = held.select("file", "parts").distinct(), asked.select("file", "asks").distinct()  # a row a file: bounded
    left = held.join(F.broadcast(asks), "file").withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    right = asked.join(F.broadcast(parts), "file").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def near(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        v = v.sort_values("vec_id")
        ids, x, asked = v["vec_id"].to_numpy(), np.stack(v["embedding"].to_numpy()).T, q["vec_id"].to_numpy()
        found, tile = [], max(1, CELLS // len(ids))
        for at in range(0, len(q), tile):  # so many scores at once, however large the slices are
            score = np.round(np.stack(q["embedding"].iloc[at : at + tile].to_numpy()) @ x, 9)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            found.append(pd.DataFrame({"query_id": np.repeat(asked[at : at + tile], top.shape[1]), "vec_id": ids[top].ravel(), "score": np.take_along_axis(score, top, axis=1).ravel()}))
        return pd.concat(found, ignore_index=True)

    key = ["file", "part", "ask"]
    some = left.select(*key, "vec_id", "embedding").groupBy(*key).cogroup(right.select(*key, "vec_id", "embedding").groupBy(*key)).applyInPandas(near, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))  # at most k rows from each slice met
    return some.withColumn("rank", rank).filter(F.col("rank") <= k)
