"""The folder that the driver and all executors share, and plans cut through it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only on a local master where none is set."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if given is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-ckpt-"))
        _remove_at_end(spark, sc.getCheckpointDir())
    return given or sc.getCheckpointDir()


def _remove_at_end(spark: SparkSession, path: str) -> None:
    """The folder is made, and deleted when the session's JVM ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession) -> str:
    """The path of a new, empty folder that the driver and all executors share; it goes with the session at the latest."""
    path = f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"
    _remove_at_end(spark, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: like ``cut``, but in columns, compressed and pruned when read."""
    path = f"{new_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
