"""Training-corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of
documents; every stage's output is written and read again before the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontam, packing, pii, simhash, toxicity
from sparkloom.llm.common import new_folder, table
from sparkloom.llm.queries import vocabulary
from sparkloom.sources.shared import remove


@contextmanager
def short_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """What runs inside sends Python workers ``rows`` rows at once, so that all stages' workers fit an executor together,
    and leaves no shuffle files behind.

    The session's own settings come back after; a stage's work is therefore done inside, into compressed files.
    """
    inside = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {name: spark.conf.get(name) for name in inside}
    try:
        for name, value in inside.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: The table that the last stage of an application handed on.
_handed: dict[str, str] = {}


def drop_handed(spark: SparkSession, docs: DataFrame) -> None:
    """Delete what the stage before handed on: its output has been written again by now. Not if ``docs`` still reads it."""
    path = _handed.get(spark.sparkContext.applicationId)
    if path is not None and not any(f"{path}/" in f for f in docs.inputFiles()):
        remove(spark, path)
        del _handed[spark.sparkContext.applicationId]


def handed_on(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, until the next stage begins."""
    path = new_folder(spark)
    df.write.parquet(f"{path}/table")
    _handed[spark.sparkContext.applicationId] = path
    return spark.read.schema(df.schema).parquet(f"{path}/table")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; the model is fitted on the labelled rows of all documents."""
    drop_handed(spark, docs)
    with short_batches(spark):
        model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
        return handed_on(spark, toxicity.keep_clean(docs, model))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays: five-word shingles, fingerprints
    at most 7 bits apart or a Jaccard similarity of 0.8, both exactly. Null texts are one group; repeated rows count once; an empty table stays empty."""
    drop_handed(spark, docs)
    with short_batches(spark):
        return handed_on(spark, simhash.first_of_each(docs, shingle=5, radius=7, similar=0.8))


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows are cut out; what is nothing else goes."""
    drop_handed(spark, docs)
    with short_batches(spark):
        return handed_on(spark, decontam.remove(docs, table(spark, sf_dir, "benchmark")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the names of their kinds."""
    drop_handed(spark, docs)
    return pii.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as packed sequences of at most 4096 tokens, a row a piece."""
    drop_handed(spark, docs)
    with short_batches(spark):
        return packing.pack(packing.pieces(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", keep_first_copies),
    ("benchmark_decontamination", cut_benchmark_passages),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Fingerprints, the learned grammar and the evolved groupings have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stage outputs are Parquet in the shared folder.

    An output goes once the next stage's is written; the last one stays, as the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = new_folder(spark), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
