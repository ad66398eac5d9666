"""How document filters act on each other in every order, kept up by a stream with retractions.

All files of the table go through available-now micro-batches. A row's texts are
judged where they are; then only its mask of failed filters and a text key travel.
The state of a text, kept in buckets of some 2,000 texts whatever the size of the
table, is the smallest id seen and the masks counted under that id:
when a smaller id arrives, the earlier masks are taken back from the counters of
their parts and counted again as copies. Copies inside a task shrink to a few rows
before they shuffle, so a text of a third of all rows does not land on one task.
Each batch adds one small table of changes under its number; a repeated batch
writes the same table again. Their sums are the counts per part and mask, from
which all orders follow.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, new_folder, text_key

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
JUDGED = "part string, k_hash long, k_crc long, k_len int, doc_id long, known boolean, mask int"
SHRUNK = "k_hash long, k_crc long, k_len int, low long, part string, mask int, good int, toxic int, n long"
CHANGES = "part string, mask int, docs long, good long, toxic long"
KEY = ["k_hash", "k_crc", "k_len"]


def mask_of(text: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text fails; words are runs of anything but ASCII white space."""
    words = text.split()
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * (len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) > 3 * n_chars, len(text) != len(text.translate(None, b"#$%&*|")))
    return sum(1 << i for i, x in enumerate(fails) if x)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        masks = [mask_of(t, n) for t, n in zip(b["text"].tolist(), b["n"].tolist(), strict=True)]
        yield b.drop(columns=["text", "n"]).assign(mask=masks)


def _shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a text within a batch: those of its smallest id as counts, all others as copies; null ids are no copies."""
    for b in batches:
        if not len(b):
            continue
        low = b.groupby(KEY)["doc_id"].transform("min")  # nulls don't count
        copy = b["doc_id"].notna() & (b["doc_id"] > low)
        b = b.assign(low=low.where(b["doc_id"].notna() & ~copy), mask=b["mask"].where(~copy, b["mask"] | COPY))
        out = b.groupby([*KEY, "low", "part", "mask", "good", "toxic"], dropna=False).size().rename("n").reset_index()
        yield out[["k_hash", "k_crc", "k_len", "low", "part", "mask", "good", "toxic", "n"]].astype({"low": "Int64"})


def _retract(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Changes of the counters by new rows of a bucket's texts; the state has each text's smallest id and what is counted under it."""
    texts: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
    change: Counter = Counter()
    for b in batches:
        for text, at, *row, n in zip(*(b[c].tolist() for c in ("text", "low", "part", "mask", "good", "toxic", "n")), strict=True):
            if pd.isna(at):  # a copy already, or a row without an id
                change[tuple(row)] += n
                continue
            at = int(at)
            low, held = texts.get(text, (None, []))
            if low is None or at < low:
                for (p, m, g, t), k in held:
                    change[p, m, g, t] -= k
                    change[p, m | COPY, g, t] += k
                low, held = at, []
                texts[text] = [low, held]
            if at > low:
                row[1] |= COPY
            else:
                held.append([row, n])
            change[tuple(row)] += n
    state.update((json.dumps(texts),))
    rows = [(p, m, n, n * g, n * t) for (p, m, g, t), n in change.items() if n]
    if rows:
        yield pd.DataFrame(rows, columns=["part", "mask", "docs", "good", "toxic"])


def _marks(labels: DataFrame) -> DataFrame:
    """One row per labelled id; of repeated labels the largest counts."""
    of = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    return labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("known")).agg(of("quality").alias("good"), of("toxic"))


def mask_counts(spark: SparkSession, path: str, labels: DataFrame, files_a_batch: int | None = None, texts_a_bucket: int = 2000) -> DataFrame:
    """Documents, good and toxic ones per (part, mask) of the Parquet table at ``path``.

    ``files_a_batch`` is how many files a micro-batch takes; by default 16 for each core of the cluster.
    States of about ``texts_a_bucket`` texts are kept and updated together, as a call for each text costs milliseconds.
    """
    folder = new_folder(spark)
    path = path.rstrip("/")
    shown = spark.read.parquet(path)
    files = files_a_batch or 16 * spark.sparkContext.defaultParallelism
    stream = spark.readStream.schema(shown.schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, the path may also be one file
    t = F.coalesce(F.col("text"), F.lit(""))
    # A row without an id meets no label; its place in its file stands in, so that such rows spread.
    rows = stream.select(
        F.coalesce(F.col("lang"), F.lit("")).alias("part"), *text_key(F.col("text")), F.col("doc_id").cast("long").alias("id"), F.col("_metadata.row_index").alias("at"), t.cast("binary").alias("text"), F.length(t).alias("n")
    ).select("part", *KEY, F.coalesce("id", "at").alias("doc_id"), F.col("id").isNotNull().alias("known"), "text", "n")
    judged = rows.mapInPandas(_judge, JUDGED).join(cut(_marks(labels)), ["doc_id", "known"], "left")
    some = judged.select(*KEY, F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    buckets = max(64, -(-shown.count() // texts_a_bucket))
    dealt = some.mapInPandas(_shrink, SHRUNK).select(F.pmod("k_hash", F.lit(buckets)).alias("bucket"), F.concat_ws(":", *KEY).alias("text"), "low", "part", "mask", "good", "toxic", "n")
    changes = dealt.groupBy("bucket").applyInPandasWithState(_retract, CHANGES, "texts string", "append", "NoTimeout")

    def add(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("docs", "good", "toxic")])
        sums.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    spark.createDataFrame([], CHANGES).write.parquet(f"{folder}/changes/batch=-1")
    query = changes.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(add).start()
    query.awaitTermination()
    every = spark.read.schema(f"{CHANGES}, batch long").parquet(f"{folder}/changes")
    return every.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("docs", "good", "toxic")]).filter("docs != 0")


def orders(counts: DataFrame) -> DataFrame:
    """All orders and steps from the counts per (part, mask): 600 rows a part."""
    met = counts.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = [F.instr("filter_order", f) for f in FILTERS]
    bits = lambda which: sum((F.when(which(at), 1 << i).otherwise(0) for i, at in enumerate(place)), F.lit(0))
    met = met.withColumn("own", bits(lambda at: at == F.col("step"))).withColumn("before", bits(lambda at: at < F.col("step")))
    hit = lambda c: F.col("mask").bitwiseAND(F.col(c)) != 0
    total = lambda when, c="docs": F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    gone = hit("own") & ~hit("before")
    out = met.groupBy("part", "filter_order", "step", "own").agg(
        total(~hit("own") & ~hit("before")).alias("kept"), total(gone).alias("removed"), total(hit("own") & hit("before")).alias("redundant"), total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(gone, "good").alias("good_lost"), total(gone, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def audit(spark: SparkSession, path: str, labels: DataFrame, files_a_batch: int | None = None) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    A part is a lang value, null and empty ones together. A null text is empty. A
    row with a null doc_id has no label, is no copy and makes none; of repeated rows
    with the smallest id all pass as first. An empty table gives no rows; other
    columns are not read. The state of a text holds one id and at most a count for
    each (part, mask, label) under it.
    """
    return orders(mask_counts(spark, path, labels, files_a_batch))
