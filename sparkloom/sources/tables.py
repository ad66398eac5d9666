"""Stored tables with keys: appends that skip known keys, upserts merged on read, compaction.

Rows lie in buckets by the hash of their key, so a batch meets only the buckets of
its own keys, and of those only the key columns. A write has two steps: its files
go into a folder that nobody reads, then a manifest that names all folders of the
new version is written aside and renamed into the log. Readers follow the last
manifest, so a write that stops half-way leaves the table as it was. One writer at a
time: the rename refuses a version that is there, where the store can tell.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.sources.shared import written

BUCKET, SEQ = "_bucket", "_seq"


class KeyedTable:
    """A table of rows with ``keys`` at ``path``; it begins empty, with the columns of ``schema``."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.jvm = spark._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def manifest(self) -> dict:
        """The last version: its number and its folders, each with its buckets and when it was added."""
        log = self._at("log")
        names = [f.getPath().getName() for f in self.fs.listStatus(log)] if self.fs.exists(log) else []
        done = sorted(n for n in names if n.startswith("v"))
        if not done:
            return {"version": 0, "folders": []}
        return json.loads(self.spark.read.text(f"{self.path}/log/{done[-1]}", wholetext=True).first()[0])

    def _commit(self, version: int, folders: list[dict]) -> None:
        aside, final = self._at("log", f".{uuid.uuid4().hex}"), self._at("log", f"v{version:012d}")
        out = self.fs.create(aside, True)
        out.write(bytearray(json.dumps({"version": version, "folders": folders}).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(aside, final):
            self.fs.delete(aside, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another writer")

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """The new folder and its buckets; rows carry ``_seq``. A bucket has few files, a large one as many as its size asks for."""
        folder = uuid.uuid4().hex
        rows.withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
        names = [f.getPath().getName() for f in self.fs.listStatus(self._at("data", folder))]
        return folder, sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}="))

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, buckets: Sequence[int] | None = None, since: int = 0) -> DataFrame:
        """Rows as written with ``_seq``, the version that added them; of some buckets only, or of versions after ``since``."""
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.path}/data/{f['folder']}/{BUCKET}={b}" for f in self.manifest()["folders"] if f["seq"] > since for b in f["buckets"] if wanted is None or b in wanted]
        shape = StructType([*self.schema.fields]).add(SEQ, "long")
        found = self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)  # one scan, however many versions
        return found.filter(F.col(SEQ) > since) if since else found

    def insert(self, df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
        """Append the first row (by ``order``) of each key that the table lacks, in one commit; returns those
        first rows with ``inserted``. The same batch again inserts nothing."""
        names = self.schema.names
        rest = [c for c in names if c not in self.keys]
        # A minimum, so that a hot key shrinks before it moves.
        first = df.select(*names).groupBy(*self.keys).agg(F.min_by(F.struct(*rest), F.struct(*(order or rest))).alias("_r")).select(*self.keys, "_r.*") if rest else df.select(*names).distinct()
        batch = written(first.select(*names).withColumn(BUCKET, self._bucket()))
        met = [r[0] for r in batch.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
        now = self.manifest()
        # Grouping moves each side once and takes nulls for equal; a join would move the known keys twice and sort both.
        sides = batch.select(*self.keys, F.struct(*rest).alias("_r") if rest else F.lit(None).alias("_r"), F.lit(True).alias("_new"))
        known = self.read(met).select(*self.keys, F.lit(None).cast(sides.schema["_r"].dataType).alias("_r"), F.lit(False).alias("_new"))
        carried = [F.first("_r", ignorenulls=True).alias("_r")] if rest else []
        grouped = sides.unionByName(known).groupBy(*self.keys).agg(F.max("_new").alias("_new"), F.min("_new").alias("inserted"), *carried).filter("_new")
        flagged = written(grouped.select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in names], "inserted"))
        new = flagged.filter("inserted")
        if not new.isEmpty():
            self._add(new.select(*names), now)
        return flagged

    def _add(self, rows: DataFrame, now: dict) -> None:
        version = now["version"] + 1
        folder, buckets = self._write(rows.withColumn(SEQ, F.lit(version).cast("long")))
        self._commit(version, [*now["folders"], {"folder": folder, "buckets": buckets, "seq": version}])

    def upsert(self, df: DataFrame) -> None:
        """Add rows as a delta; which of a key's rows counts is decided by ``latest``."""
        self._add(df.select(*self.schema.names), self.manifest())

    def latest(self, order: Sequence[str], buckets: Sequence[int] | None = None) -> DataFrame:
        """One row per key: the greatest by ``order``, of equals the one added last, then the greatest row; so older rows
        never win, in whatever order they came."""
        return self._latest(order, buckets).drop(SEQ)

    def _latest(self, order: Sequence[str], buckets: Sequence[int] | None = None) -> DataFrame:
        rest = [c for c in self.schema.names if c not in self.keys]
        top = F.max_by(F.struct(*rest, SEQ), F.struct(*order, SEQ, *rest))
        return self.read(buckets).groupBy(*self.keys).agg(top.alias("_r")).select(*self.keys, "_r.*").select(*self.schema.names, SEQ)

    def compact(self, order: Sequence[str]) -> None:
        """Rewrite the table to one row per key in one folder; the folders before it go once the commit stands."""
        now = self.manifest()
        if len(now["folders"]) < 2:
            return
        folder, buckets = self._write(self._latest(order))
        self._commit(now["version"] + 1, [{"folder": folder, "buckets": buckets, "seq": now["version"]}])
        for f in now["folders"]:
            self.fs.delete(self._at("data", f["folder"]), True)

    def clean(self) -> int:
        """Delete folders of no version, which stopped writes have left; returns how many."""
        named = {f["folder"] for f in self.manifest()["folders"]}
        data = self._at("data")
        lost = [f.getPath() for f in self.fs.listStatus(data) if f.getPath().getName() not in named] if self.fs.exists(data) else []
        for p in lost:
            self.fs.delete(p, True)
        return len(lost)
