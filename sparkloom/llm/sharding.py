"""Shards by vector bin packing: bytes, tokens and rows are balanced together.

Rows with equal texts form a group and stay together; a group that would fill a
good part of a shard is split evenly. A group goes to the shard where the dot
product of its size vector and the shard's residual capacity is highest. The
groups large enough to matter to a shard's total are few whatever the input
(each is at least a fixed fraction of the total), so one task places them; all
others are dealt into lanes, and each lane fills its part of what the heavy
groups have left of each shard. Swaps between shards of a lane then even out
what the placing has left over in all three sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.joins import hot_join

from .common import cut, numbered, text_key
from .packing import word_ids

SIZES = ("bytes", "tokens", "rows")
#: What counts in the dot product.
WEIGHTS = np.array([1.0, 1.0, 1.0])
#: What counts in swaps: the law is on bytes.
SWAP_WEIGHTS = np.array([4.0, 1.0, 1.0])
#: Groups of each of two shards that one swap is chosen from, spread over all their sizes.
SWAP_FROM = 1000


def place(vectors: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The bin of each vector, in the order given; ``residual`` (bins x dimensions) is used up.

    The highest dot product counts among bins with room in every dimension; with
    none, among all.
    """
    out = np.zeros(len(vectors), np.int64)
    weighted = vectors * WEIGHTS
    for i, v in enumerate(vectors):
        fits = (residual >= v).all(axis=1)
        dot = residual @ weighted[i]
        b = int(np.argmax(np.where(fits, dot, -np.inf) if fits.any() else dot))
        out[i] = b
        residual[b] -= v
    return out


def even_out(vectors: np.ndarray, bins: np.ndarray, residual: np.ndarray, close: float = 1e-4, rounds: int = 100) -> None:
    """Move or swap items between two bins as long as that brings ``residual`` nearer to zero; changes ``bins`` and ``residual``.

    The two bins whose residuals differ most are tried first. It ends when all are within
    ``close`` of a bin's share, when no two bins have a better swap, or after ``rounds`` swaps a bin.
    """
    count = len(residual)
    w, left = vectors * SWAP_WEIGHTS, residual * SWAP_WEIGHTS
    lo, hi = np.triu_indices(count, 1)
    for _ in range(rounds * count):
        gaps = ((left[lo] - left[hi]) ** 2).sum(axis=1)
        for p in np.argsort(-gaps, kind="stable"):
            if gaps[p] < (2 * close / count) ** 2:
                return
            pair = lo[p], hi[p]
            goal = (left[pair[1]] - left[pair[0]]) / 2  # what should go from the first to the second
            sides = [np.flatnonzero(bins == b) for b in pair]
            sides = [m[:: -(-len(m) // SWAP_FROM) or 1] for m in sides]
            a, b = (np.vstack([np.zeros(3), w[m]]) for m in sides)  # nothing may go, too
            off = ((a - goal) ** 2).sum(axis=1)[:, None] - 2 * (a - goal) @ b.T + (b**2).sum(axis=1)
            i, j = divmod(int(np.argmin(off)), len(b))
            if off[i, j] < 0.999 * gaps[p] / 4:
                break
        else:
            return
        for at, members, source, target in ((i, sides[0], *pair), (j, sides[1], *pair[::-1])):
            if at:
                item = members[at - 1]
                bins[item] = target
                left[source] += w[item]
                left[target] -= w[item]
        residual[:] = left / SWAP_WEIGHTS


def _fill(capacity: np.ndarray):
    """Place one lane's groups, the largest first, in proportion to what the shards have left."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "k_hash", "part"], ascending=[False, True, True], ignore_index=True)
        v = pdf[list(SIZES)].to_numpy(float)
        share, residual = v / np.maximum(v.sum(axis=0), 1), capacity.copy()
        shard = place(share, residual)
        even_out(share, shard, residual)
        return pdf[["k_hash", "k_crc", "k_len", "part", *SIZES]].assign(shard=shard)

    return run


def _gather(fill):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if frames:
            yield fill(pd.concat(frames, ignore_index=True))

    return run


def _counted(tokenizer: str):
    """Replace each text by the number of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer).ids
        for b in batches:
            tokens = pa.array([len(ids(t)) // 4 for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in b.schema.names[:-1]], tokens], [*b.schema.names[:-1], "tokens"])

    return run


ROWS = "doc_id long, k_hash long, k_crc long, k_len int, bytes long, tokens long"
PLACED = "k_hash long, k_crc long, k_len int, part int, bytes long, tokens long, rows long, shard int"


def shards(docs: DataFrame, tokenizer: str, count: int = 16, heavy_share: float = 1 / 128, split_share: float = 1 / 8, lane_rows: int = 20_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot and grown_shard.

    size is the UTF-8 bytes of the text (null: none) plus 1. The law is
    ``bytes``: sizes of shards are near equal, as far as single rows allow, and so
    are their tokens (of ``tokenizer``, whole texts, none added) and rows; grown_shard is null. slot numbers a shard's rows from 0 without gaps.
    Rows with a null doc_id and repeated rows are rows like others. An empty
    table gives no rows; columns other than doc_id and text are not read.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    base = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text")), (F.octet_length(t) + 1).cast("long").alias("bytes"), t.alias("text"),
    ).mapInArrow(_counted(tokenizer), ROWS))
    base = numbered(base, "row").withColumn("salt", F.xxhash64("row"))
    key = ["k_hash", "k_crc", "k_len"]
    groups = cut(base.groupBy(*key).agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    sums = groups.agg(*[F.sum(c).alias(c) for c in SIZES]).first()
    total = {c: float(sums[c] or 1) for c in SIZES}
    share = F.greatest(*[F.col(c) * count / total[c] for c in SIZES])  # of a shard
    split = groups.filter((share > split_share) & (F.col("rows") > 1)).select(*key, F.least(F.ceil(share / split_share), F.col("rows")).cast("int").alias("parts"))
    few = split.filter("parts > 1")  # each has 1/(8 x count) of some dimension: a bounded number
    rows = base.join(F.broadcast(few), key, "left").withColumn("part", F.coalesce(F.pmod("salt", "parts"), F.lit(0)).cast("int"))
    items = cut(rows.groupBy(*key, "part").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    # At most 3 x count / heavy_share groups are heavy, since each has that share of a shard in some dimension.
    heavy = cut(items.filter(share > heavy_share).repartition(1).mapInPandas(_gather(_fill(np.full((count, 3), 1.0 / count))), PLACED))
    used = {r["shard"]: r for r in heavy.groupBy("shard").agg(*[F.sum(c).alias(c) for c in SIZES]).collect()}
    left = np.array([[max(0.0, total[c] / count - (used[s][c] if s in used else 0)) for c in SIZES] for s in range(count)])
    capacity = left / np.maximum(left.sum(axis=0), 1e-9)
    lanes = max(1, -(-int(total["rows"]) // lane_rows))
    light = items.filter(share <= heavy_share).withColumn("lane", F.pmod(F.xxhash64(*key, "part"), F.lit(lanes)))
    placed = cut(light.groupBy("lane").applyInPandas(_fill(capacity), PLACED).unionByName(heavy))
    # A slot is the place within (shard, block) plus what earlier blocks of the shard hold.
    dealt = cut(hot_join(rows, placed.select(*key, "part", "shard"), [*key, "part"]).select("doc_id", "bytes", "k_crc", "shard", "row", F.pmod(F.xxhash64("row", F.lit("block")), F.lit(lanes)).alias("block")))
    held = dealt.groupBy("shard", "block").count()
    before = held.select("shard", "block", (F.sum("count").over(Window.partitionBy("shard").orderBy("block")) - F.col("count")).alias("before"))
    at = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row")) - 1
    return dealt.withColumn("at", at).join(before, ["shard", "block"]).select("doc_id", F.col("bytes").alias("size"), F.col("k_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
