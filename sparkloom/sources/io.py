"""Sources and sinks. Appends are safe for one writer at a time; several writers need an ACID table format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.sources.tables import KeyedTable


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Rows of text; an empty cell is unknown (null), zero is a value."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "overwrite") -> None:
    """These columns in this order; others are left out, missing ones are null."""
    have = set(df.columns)
    df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def append_checked(df: DataFrame, path: str) -> None:
    """Append to a Parquet table; a column that the table lacks is an error."""
    target = df.sparkSession.read.parquet(path).schema
    extra = sorted(set(df.columns) - set(target.names))
    if extra:
        raise ValueError(f"unknown columns: {', '.join(extra)}")
    have = set(df.columns)
    df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target]).write.mode("append").parquet(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False) -> DataFrame:
    """Documents of a fixed shape, a file each or a line each; those that can't be read keep their text in ``_corrupt``."""
    shaped = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType([*shaped.fields]).add("_corrupt", "string")).option("multiLine", not lines).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def html_pages(files: DataFrame) -> DataFrame:
    """Raw pages (url, content as bytes, as ``binaryFile`` gives them) as rows: url, html, n_bytes, content_hash, status.

    Bytes are UTF-8 unless a meta tag in front names Latin-1. Status is ``EMPTY``
    for blank pages and ``NO_URL`` without an address.
    """
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    latin = F.lower(head).rlike("<meta[^>]+charset=[\"']?(iso-8859-1|latin-?1|windows-1252)")
    html = F.when(latin, F.decode("content", "ISO-8859-1")).otherwise(F.col("content").cast("string"))
    status = F.when(F.coalesce(F.trim("url"), F.lit("")) == "", "NO_URL").when(F.coalesce(F.trim(html), F.lit("")) == "", "EMPTY").otherwise("OK")
    return files.select("url", html.alias("html"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2("content", 256).alias("content_hash"), status.alias("status"))


def new_rows(df: DataFrame, target: DataFrame | None, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The first row per key (by ``order``) of those whose key the target lacks.

    The choice is a minimum, so a hot key shrinks before it moves.
    """
    others = [c for c in df.columns if c not in keys]
    if others:
        pick = F.min_by(F.struct(*others), F.struct(*(order or others)))
        first = df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*").select(*df.columns)
    else:
        first = df.distinct()
    return first if target is None else first.join(target.select(*keys).distinct(), list(keys), "left_anti").select(*df.columns)


def with_inserted(df: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``inserted``: this row's key is new. Nothing is written."""
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    return df.join(known, list(keys), "left").withColumn("inserted", F.col("_known").isNull()).drop("_known")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = (), partition_by: Sequence[str] = ()) -> None:
    """Append rows with new keys to a Parquet table, which is made if there is none."""
    spark = df.sparkSession
    target = spark.read.parquet(path) if _exists(spark, path) else None
    rows = new_rows(df, target, keys, order)
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


ARTIFACT_KEY = ("content_hash", "schema_version", "artifact_kind")
EDGE_KEY = ("child_kind", "child_id", "parent_kind", "parent_id")


def checked_artifacts(df: DataFrame) -> DataFrame:
    """Add ``violations`` and ``shard``: provenance and parents are required."""
    marks = F.array(F.when(F.col("provenance").isNull(), "provenance"), F.when(F.coalesce(F.size("derived_from"), F.lit(0)) <= 0, "derived_from"))
    return df.withColumns({"violations": F.filter(marks, lambda x: x.isNotNull()), "shard": F.substring(F.regexp_replace("content_hash", "^sha256:", ""), 1, 2)})


def artifact_table(spark: SparkSession, path: str, id_type: str = "long") -> KeyedTable:
    """The stored table that ``append_artifacts`` fills."""
    return KeyedTable(spark, path, f"artifact_id {id_type}, content_hash string, schema_version string, artifact_kind string, provenance string, derived_from array<string>, shard string", ARTIFACT_KEY)


def append_artifacts(df: DataFrame, table: KeyedTable) -> DataFrame:
    """Write the valid artifacts that are new, the smallest id of each content; returns the invalid ones with their violations."""
    c = checked_artifacts(df)
    table.insert(c.filter(F.size("violations") == 0), ["artifact_id"])
    return c.filter(F.size("violations") > 0)


def edge_table(spark: SparkSession, path: str, id_type: str = "string") -> KeyedTable:
    """The stored table that ``append_edges`` fills."""
    return KeyedTable(spark, path, f"child_kind string, child_id {id_type}, parent_kind string, parent_id {id_type}", EDGE_KEY)


def append_edges(df: DataFrame, table: KeyedTable) -> DataFrame:
    """Write the edges that are new; returns the batch's edges, once each, with ``inserted``."""
    return table.insert(df)


def manifest(files: DataFrame, root: Column | None = None) -> DataFrame:
    """Inventory of (path, content): id, type, title and checksum. ``root`` is cut off the paths."""
    path = F.col("path") if root is None else F.replace(F.col("path"), root, F.lit(""))
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return files.select(F.concat(F.lit("artifact-"), F.substring(F.sha1(path.cast("binary")), 1, 12)).alias("artifact_id"), path.alias("path"), F.nullif(F.regexp_extract(name, r"\.([^.]+)$", 1), F.lit("")).alias("type"), F.initcap(F.regexp_replace(stem, r"[_-]+", " ")).alias("title"), F.sha2("content", 256).alias("checksum"))
