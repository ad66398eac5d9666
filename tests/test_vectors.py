"""The inverted file against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import evidence, vectors


def table(spark, n=1500, dims=16, seed=1):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(12, dims))
    x = centers[r.integers(0, 12, n)] + 0.6 * r.normal(size=(n, dims))
    return spark.createDataFrame([(i, [float(y) for y in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")


def rows(df):
    return {(r.query_id, r.vec_id): (round(r.score, 6), r["rank"]) for r in df.collect()}


def test_all_files_give_the_exact_answer_however_sliced(spark):
    v = table(spark, 400)
    q = v.filter("vec_id % 20 = 0")
    c = vectors.fit(v, 8)
    index = vectors.nearest_files(v, c, 1)
    assert index.count() == 400
    exact = rows(evidence.cosine_top_k(v, q, 10))
    for most in (20_000, 16):
        assert rows(vectors.search(index, q, c, 10, 8, most)) == exact


@pytest.mark.parametrize("where", ["made", "/root/testdata/sf0.01/embeddings.parquet"])
def test_recall_of_some_files(spark, where):
    import os

    if where != "made" and not os.path.exists(where):
        pytest.skip("no tables here")
    v = table(spark) if where == "made" else spark.read.parquet(where)
    q = v.filter("vec_id % 20 = 0")
    c = vectors.fit(v, 32)
    found, exact = rows(vectors.search(vectors.nearest_files(v, c, 1), q, c, 10, 12 if where == "made" else 25)), rows(evidence.cosine_top_k(v, q, 10))
    recall = len(found.keys() & exact.keys()) / len(exact)
    print("recall", where, recall)
    assert recall >= 0.95


def test_nulls_zeros_ties_and_empty_tables(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    c = vectors.fit(v, 2)
    got = vectors.search(vectors.nearest_files(v, c, 1), v.filter("vec_id = 1"), c, 3, 2).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got)[:2] == [(1, 1, 1.0), (2, 2, 1.0)] and len(got) == 3
    none = v.filter(F.lit(False))
    assert vectors.search(vectors.nearest_files(none, vectors.fit(none, 4), 1), none, vectors.fit(none, 4), 3, 2).count() == 0


def test_both_searches_take_their_vectors_in_tiles(spark):
    # 2100 queries against 2100 vectors: several tiles in a batch and in a slice; all files are looked into, so both are exact.
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2100, 4)).round(1)
    x[7] = 0
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = np.round(u @ u.T, 9)
    want = {(i, int(j), n + 1) for i in range(len(x)) for n, j in enumerate(np.lexsort((np.arange(len(x)), -s[i]))[:3])}
    exact = {(r.query_id, r.vec_id, r["rank"]) for r in evidence.cosine_top_k(v, v, 3).collect()}
    centroids = vectors.fit(v, 4)
    filed = {(r.query_id, r.vec_id, r["rank"]) for r in vectors.search(vectors.nearest_files(v, centroids, 1), v, centroids, 3, 4).collect()}
    assert len(exact ^ want) < 20 and len(filed ^ want) < 20  # the ninth digit of a score may round either way
    assert evidence.CELLS // 2048 < len(x) and vectors.CELLS // len(x) < len(x)
