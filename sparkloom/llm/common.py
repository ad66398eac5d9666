"""Helpers that every training-data operator shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.shared import cut as cut
from sparkloom.sources.shared import new_folder as new_folder
from sparkloom.sources.shared import remove as remove
from sparkloom.sources.shared import written as written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Add a row number to a checkpointed frame (its files fix the order, so a rerun repeats it)."""
    return df.withColumn(name, F.monotonically_increasing_id())


def text_key(text: Column) -> list[Column]:
    """Columns that stand for a text where only equality counts: 64 + 32 bits of hash and the length."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k_hash"), F.crc32(t).alias("k_crc"), F.octet_length(t).alias("k_len")]


def held_out(doc_id: Column) -> Column:
    """True for the rows whose crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled training rows (text, label, fold), never held-out ones.

    The rows with the smallest hash of the id are taken, the same at every run;
    of rows that repeat an id, the one with the smallest hash of the text.
    ``fold`` (0 to 9) also comes from the id. Null labels and ids don't count.
    Documents are scanned in parallel; only the chosen rows travel.
    """
    lab = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("label").alias("label"))
        .withColumn("_h", F.xxhash64("_id", F.lit("sample")))
        .orderBy("_h", "_id").limit(limit)
    )
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(lab), "_id").groupBy("_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return one.select("_id", "text", "label", F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(10)).cast("int").alias("fold"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
