import pytest
from pyspark.sql import functions as F

from sparkloom.sources.tables import KeyedTable


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_inserts_are_idempotent_and_report(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k long, v string", ["k"], 8)
    a = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x"), (None, "n")], "k long, v string")
    assert rows(t.insert(a), "k", "v", "inserted") == sorted([(1, "a", True), (2, "x", True), (None, "n", True)], key=str)
    assert not any(r.inserted for r in t.insert(a).collect())
    assert t.manifest()["version"] == 1
    assert rows(t.insert(spark.createDataFrame([(2, "y"), (3, "z")], "k long, v string")), "k", "inserted") == [(2, False), (3, True)]
    assert rows(t.read(), "k", "v") == sorted([(1, "a"), (2, "x"), (3, "z"), (None, "n")], key=str)
    assert rows(t.read(since=1), "k") == [(3,)]


def test_a_batch_meets_only_its_buckets(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k long", ["k"], 16)
    t.insert(spark.range(200).select(F.col("id").alias("k")))
    b = spark.createDataFrame([(7,)], "k long").select(t._bucket()).first()[0]
    files = t.read([b]).inputFiles()
    assert files and all(f"_bucket={b}/" in f for f in files)


def test_a_write_that_stops_leaves_the_table_whole(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path / "t"), "k long, v string", ["k"], 4)
    a = spark.createDataFrame([(i, "a") for i in range(20)], "k long, v string")
    t.insert(a)
    with monkeypatch.context() as m:  # the files are there, the commit is not
        m.setattr(t, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            t.insert(spark.createDataFrame([(i, "b") for i in range(10, 40)], "k long, v string"))
    assert rows(t.read(), "k", "v") == sorted([(i, "a") for i in range(20)], key=str)
    bad = F.udf(lambda k: 1 // (k - 25) * 0 + k, "long")
    with pytest.raises(Exception):  # a task fails while others have written
        t.insert(spark.createDataFrame([(i, "b") for i in range(10, 40)], "k long, v string").withColumn("k", bad("k")))
    assert t.read().count() == 20 and t.clean() == 1
    assert t.insert(spark.createDataFrame([(i, "b") for i in range(10, 40)], "k long, v string")).filter("inserted").count() == 20
    assert t.read().count() == 40


def test_another_writer_is_noticed(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k long", ["k"], 4)
    t.insert(spark.range(5).select(F.col("id").alias("k")))
    with pytest.raises(RuntimeError):
        t._commit(1, [])


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_older_versions_never_win(spark, tmp_path, order):
    t = KeyedTable(spark, str(tmp_path / "t"), "k long, version int, v array<float>", ["k"], 4)
    batches = [spark.createDataFrame([(k, n, [float(n), float(k)]) for k in range(0, 30, n + 1)], "k long, version int, v array<float>") for n in range(3)]
    want = sorted((k, n := 2 if k % 3 == 0 else 1 if k % 2 == 0 else 0, [float(n), float(k)]) for k in range(30))
    for i, n in enumerate(order):
        t.upsert(batches[n])
        if i == 1:
            t.compact(["version"])
    assert rows(t.latest(["version"]), "k", "version", "v") == sorted(want, key=str)
    t.compact(["version"])
    assert rows(t.read(), "k", "version", "v") == sorted(want, key=str) and t.clean() == 0


def test_of_equal_versions_the_last_added_wins_before_and_after_compaction(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k long, version int, v string", ["k"], 2)
    for v in ("z", "a"):
        t.upsert(spark.createDataFrame([(1, 5, v)], "k long, version int, v string"))
    assert t.latest(["version"]).first().v == "a"
    t.compact(["version"])
    t.upsert(spark.createDataFrame([(1, 4, "old")], "k long, version int, v string"))
    assert t.latest(["version"]).first().v == "a"
