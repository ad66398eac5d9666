"""Near-equal vectors collapse: exact hashes first, then cosine by random-hyperplane buckets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.shared import cut

from .graph import components


def _tables(n: int, cosine: float, block: int, recall: float) -> tuple[int, int]:
    """Bits a bucket and number of tables: buckets of ``n`` spread vectors stay under ``block``, links are met with ``recall``."""
    bits = max(4, min(40, math.ceil(math.log2(max(1, n) / block)))) if n > block else 4
    same = 1 - math.acos(cosine) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same**bits))


def _buckets(bits: int, tables: int, dims: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = np.random.default_rng(seed).normal(size=(tables, bits, dims))
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["embedding"].to_numpy()).astype(np.float64)
            for t in range(tables):
                key = (x @ planes[t].T > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield b.assign(t=t, bucket=key)

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n positions the smallest one that the links i-j reach, found for all at once."""
    root = np.arange(n)
    while (root[i] != root[j]).any():
        low = np.minimum(root[i], root[j])
        for ends in (root[i], root[j]):
            np.minimum.at(root, ends, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def _forest(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        ids, own = pdf["id"].to_numpy(), pdf["own"].to_numpy()
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        # Two blocks that meet compare across only; each has met itself elsewhere.
        left, right = (np.arange(len(ids)),) * 2 if (own == own[0]).all() else (np.flatnonzero(own == own[0]), np.flatnonzero(own != own[0]))
        root = np.arange(len(ids))
        for at in range(0, len(left), 512):  # a slice of rows against all of the other side
            i, j = np.nonzero(x[left[at : at + 512]] @ x[right].T > cosine)
            known = np.arange(len(ids))
            root = _roots(len(ids), np.r_[known, left[at + i]], np.r_[root, right[j]])
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})

    return run


def collapse(items: DataFrame, cosine: float = 0.95, block: int = 1024, recall: float = 0.999, seed: int = 5) -> DataFrame:
    """Of (id, content_hash, embedding): a row per content hash, with id (the smallest), copies and cluster.

    Rows with equal hashes are copies. Different ones whose vectors have a cosine
    over ``cosine`` link; a cluster is the smallest id reachable. Candidates share
    a bucket of at least one of several tables, as many as meet a link at ``cosine``
    with ``recall``; every candidate is checked exactly. A bucket over ``block`` rows is
    cut in blocks that meet in pairs, and blocks give forests of links, not pairs.
    Zero vectors link to nothing.
    """
    reps = cut(items.groupBy("content_hash").agg(F.min("id").alias("id"), F.min_by("embedding", "id").alias("embedding"), F.count("*").alias("copies")))
    n = reps.count()
    dims = reps.select(F.size("embedding").alias("d")).first()
    if not dims:
        return reps.select("content_hash", "id", "copies", F.col("id").alias("cluster"))
    bits, tables = _tables(n, cosine, block, recall)
    filed = reps.select("id", "embedding").mapInPandas(_buckets(bits, tables, dims["d"], seed), "id long, embedding array<float>, t int, bucket long")
    hot = filed.groupBy("t", "bucket").count().filter(F.col("count") > block).select("t", "bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = filed.join(hot, ["t", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    met = dealt.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("t", "bucket", F.least("own", "o").alias("lo"), F.greatest("own", "o").alias("hi"), "own", "id", "embedding")
    links = met.groupBy("t", "bucket", "lo", "hi").applyInPandas(_forest(cosine), "a long, b long").distinct()
    roots = components(links)
    return reps.join(roots, reps["id"] == roots["node"], "left").select("content_hash", "id", "copies", F.coalesce("root", "id").alias("cluster"))
