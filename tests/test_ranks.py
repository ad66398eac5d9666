"""Places in sliced groups against the plain window, and validation in one scan a table."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import candidates, dq, evidence
from sparkloom.operators.ranks import ranked
from sparkloom.streaming import jobs


def _plain(rows, group, order):
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.select("*", F.row_number().over(w).cast("long").alias("rank"), F.lag("v").over(w).alias("before"))


@pytest.mark.parametrize("order", [lambda: ["v", "id"], lambda: [F.desc("v"), "id"], lambda: [F.desc_nulls_last("v"), F.desc("id")]])
@pytest.mark.parametrize("slices", [1, 7, 64])
def test_as_the_plain_window_would(spark, order, slices):
    order = order()
    # One group has half of all rows; there are null groups, null and equal values.
    g = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 97 == 1, None).otherwise((F.col("id") % 41).cast("string"))
    rows = spark.range(3000).select("id", g.alias("g"), F.when(F.col("id") % 13 != 0, F.pmod(F.xxhash64("id"), F.lit(50))).alias("v"))
    got = ranked(rows, ["g"], order, previous={"before": "v"}, slices=slices)
    assert got.columns == ["id", "g", "v", "rank", "before"]
    assert sorted(got.collect(), key=lambda r: r["id"]) == sorted(_plain(rows, ["g"], order).collect(), key=lambda r: r["id"])


def test_a_hot_group_is_spread(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    out = ranked(rows, ["g"], ["id"], slices=16)
    assert out.filter("g = 'hot'").agg(F.max("rank")).first()[0] == 10_000
    # The same deal as inside: the hot group meets many tasks, none with more than a small part.
    spread = rows.repartitionByRange(16, "g", "id").filter("g = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) >= 8 and max(r["count"] for r in spread) <= 3_000


def test_no_rows_and_no_groups(spark):
    none = spark.createDataFrame([], "g string, v int")
    assert ranked(none, ["g"], ["v"], previous={"b": "v"}).collect() == []
    one = ranked(spark.range(50), [], [F.desc("id")], slices=5)
    assert {r["id"]: r["rank"] for r in one.collect()} == {i: 50 - i for i in range(50)}


def test_evidence_keeps_every_row(spark):
    rows = [(None, "neutral", 3, "x|y"), (None, "neutral", 1, "a\nb"), (1, "neutral", 5, None), (1, "supporting", 7, "t"), (1, "neutral", 6, "u"), (1, "neutral", 6, "u")]
    got = candidates.evidence_split(spark.createDataFrame(rows, "candidate_id int, polarity string, evidence_id int, observation string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, "neutral", 1, 1, "a b"), (None, "neutral", 2, 3, "x/y"), (1, "neutral", 1, 5, None), (1, "neutral", 2, 6, "u"), (1, "neutral", 2, 6, "u"), (1, "supporting", 1, 7, "t")], key=str)


def test_gaps_pass_over_days(spark):
    rows = [("r", 1, "2024-01-01 23:59:00"), ("r", 2, "2024-01-02 00:01:00"), ("r", 3, "2024-01-02 00:01:00"), ("s", 4, "2024-01-02 05:00:00")]
    t = spark.createDataFrame(rows, "route string, event_id int, t string").select("route", "event_id", F.to_timestamp("t").alias("ts"))
    got = {r["event_id"]: (r["gap_seconds"], r["nth"], r["too_soon"], r["over_cap"]) for r in jobs.rate_gaps(t, 60.0, 1).collect()}
    assert got == {1: (None, 1, False, False), 2: (120.0, 1, False, False), 3: (0.0, 2, True, True), 4: (None, 1, False, False)}


def test_mmr_penalises_by_place_in_the_domain(spark):
    rows = [("j", f"d{i % 2}", i, (i * 7 % 5) / 5, (i % 3) / 3) for i in range(20)]
    t = spark.createDataFrame(rows, "job_id string, domain string, record_id int, relevance double, recency double")
    nth = F.row_number().over(Window.partitionBy("job_id", "domain").orderBy(F.desc("relevance"), "record_id"))
    want = t.withColumn("mmr", 0.6 * F.col("relevance") + 0.2 * F.col("recency") + 0.2 / nth)
    want = want.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc(F.round("mmr", 9)), "record_id")))
    assert sorted(map(tuple, evidence.mmr(t).collect())) == sorted(map(tuple, want.collect()))


def test_validation_scans_each_table_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def count(it):
        for b in it:
            reads.add(len(b))
            yield b

    def counted(rows, schema):
        return spark.createDataFrame(rows, schema).mapInPandas(count, schema)

    a = counted([(1, 10, 3), (1, 11, 9), (2, None, 3), (3, 12, None)], "k int, p long, s int")
    b = counted([(10,), (10,), (11,)], "id int")
    specs = {
        "a": dq.TableRules("k", ["k", "gone"], [dq.int_range("s", 0, 5)], [("p", "b", "id")], 5),
        "b": dq.TableRules("id", ["id"], (), (), 3),
    }
    got = sorted((tuple(r) for r in dq.validate({"a": a, "b": b}, specs).collect()), key=str)
    assert reads.value == 7
    assert got == sorted([
        ("a", "required_columns", "error", "gone", "gone"), ("a", "duplicate_keys", "error", "1", "2"), ("a", "int_range:s", "error", "1", "9"), ("a", "int_range:s", "error", "3", "null"),
        ("a", "foreign_key:p", "error", "2", None), ("a", "foreign_key:p", "error", "3", "12"), ("a", "row_floor", "error", "a", "4"), ("b", "duplicate_keys", "error", "10", "2"),
    ], key=str)
    none = dq.validate({"b": spark.createDataFrame([], "id int")}, {"b": dq.TableRules("id", ["id"], (), (), 1)}).collect()
    assert [tuple(r) for r in none] == [("b", "row_floor", "error", "b", "0")]
