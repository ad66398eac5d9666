"""SimHash near-duplicate detection by bit-sliced comparison.

Fingerprints are made where the texts are; only 8 bytes a document travel.
Equal fingerprints collapse first. Two different ones within ``radius`` bits
agree on g of ``radius + g`` bit ranges, so each is filed under each choice of g of
its ranges; g grows with the number of fingerprints. Within a file the bits lie vertically, 64 fingerprints to a machine
word, and carry-save counters add up 64 distances at once; a word is abandoned
once all of its distances exceed the radius. A file of more than ``block`` rows
is split, and its blocks meet in pairs, so no task gets a whole hot file. Each
task returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.graph import components as components
from sparkloom.operators.joins import hot_join

from .common import cut, free_names, new_folder, remove, written

SEED = 42


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a text's lower-cased words, repeats included; none without words."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, ">u8")
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    starts, ends = (end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], dtype=">u8")


def majority(h: np.ndarray) -> int:
    """The 64-bit SimHash of shingle hashes; 0 if there are none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprint(text: str, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text; 0 for one without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """Rows (doc_id, fp): fp is the fingerprint as a signed long. Null texts have no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"].tolist()], dtype=np.uint64).astype(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInPandas(run, "doc_id long, fp long")


#: So many (fingerprint, word) cells are compared at once, and so many of those that have a close pair are spread out at once.
CELLS, SPREAD_CELLS = 1 << 17, 1 << 12


def close_pairs(fp: np.ndarray, group: np.ndarray, side: np.ndarray, cross: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the fingerprints of one group that differ in at most ``radius`` (under 8) bits.

    ``group`` is sorted. In groups marked ``cross`` only pairs of different
    ``side`` count. Each pair comes once.
    """
    parts = [(np.zeros(0, np.int64),) * 2, *close_pair_parts(fp, group, side, cross, radius)]
    return np.concatenate([i for i, _ in parts]), np.concatenate([j for _, j in parts])


def close_pair_parts(fp: np.ndarray, group: np.ndarray, side: np.ndarray, cross: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of ``close_pairs``, some hundred thousand at a time, so that memory is bounded however many there are."""
    n = len(fp)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    count = np.diff(np.r_[first, n])
    words = -(-count // 64)
    word0 = np.cumsum(words) - words
    gid = np.repeat(np.arange(len(first)), count)
    within = np.arange(n) - first[gid]
    word, lane = word0[gid] + within // 64, (within % 64).astype(np.uint64)
    total = int(words.sum())
    planes = np.zeros((64, total), np.uint64)
    for b in range(64):
        np.bitwise_or.at(planes[b], word, ((fp >> np.uint64(b)) & np.uint64(1)) << lane)
    used = np.zeros(total, np.uint64)
    np.bitwise_or.at(used, word, np.uint64(1) << lane)
    start_of = np.full(total, 0, np.int64)
    start_of[word0] = first
    start_of = np.repeat(first, words) + 64 * (np.arange(total) - np.repeat(word0, words))
    cells_of = words[gid]
    at = 0
    cum = np.cumsum(cells_of)
    while at < n:  # a bounded number of (fingerprint, word) cells at once
        upto = max(at + 1, int(np.searchsorted(cum, (cum[at - 1] if at else 0) + CELLS, "right")))
        q = np.repeat(np.arange(at, upto), cells_of[at:upto])
        base = np.cumsum(cells_of[at:upto]) - cells_of[at:upto]
        w = word0[gid[q]] + (np.arange(len(q)) - np.repeat(base, cells_of[at:upto]))
        keep = start_of[w] + 63 > q  # only words with later fingerprints
        q, w = q[keep], w[keep]
        one = np.zeros(len(q), np.uint64)
        two, four, over = one.copy(), one.copy(), one.copy()
        for b in range(64):
            mask = np.uint64(0) - ((fp[q] >> np.uint64(b)) & np.uint64(1))
            add = planes[b][w] ^ mask
            carry = one & add
            one ^= add
            add = two & carry
            two ^= carry
            carry = four & add
            four ^= add
            over |= carry
            if b % 8 == 7 and b > 8:
                near = used[w] & ~_exceeds(one, two, four, over, radius)
                live = near != 0
                if not live.all():
                    q, w, one, two, four, over = q[live], w[live], one[live], two[live], four[live], over[live]
                if not len(q):
                    break
        if len(q):
            near = used[w] & ~_exceeds(one, two, four, over, radius)
            some = np.flatnonzero(near)
            for part in (some[x : x + SPREAD_CELLS] for x in range(0, len(some), SPREAD_CELLS)):
                bits = np.unpackbits(near[part].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                c, k = np.nonzero(bits)
                i, j = q[part[c]], start_of[w[part[c]]] + k
                good = (j > i) & (~cross[i] | (side[i] != side[j]))
                if good.any():
                    yield i[good], j[good]
        at = upto


def _exceeds(one: np.ndarray, two: np.ndarray, four: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the lanes whose count is over the radius, compared bit by bit."""
    above, equal = over.copy(), ~over
    for plane, bit in ((four, radius & 4), (two, radius & 2), (one, radius & 1)):
        if bit:
            equal &= plane
        else:
            above |= equal & plane
            equal &= ~plane
    return above


def forest(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position that each of n positions is linked to by ``pairs``, which come some at a time."""
    root = np.arange(n)
    for i, j in pairs:
        _joined(root, i, j)
    return root


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of each i and j; each position points at its root before and after."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _links(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            key = pdf[["r", "k", "lo", "hi"]].to_numpy()
            group = np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(axis=1)])
            fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            root = forest(len(fp), close_pair_parts(fp, group, pdf["own"].to_numpy(), (pdf["lo"] != pdf["hi"]).to_numpy(), radius))
            moved = np.flatnonzero(root != np.arange(len(fp)))
            s = fp.view(np.int64)
            return pd.DataFrame({"a": s[moved], "b": s[root[moved]]})

        held: list[pd.DataFrame] = []
        rows = 0
        for b in batches:  # sorted by file: only the last file of what is held may go on
            held.append(b)
            rows += len(b)
            if rows < 200_000:
                continue
            pdf = pd.concat(held, ignore_index=True)
            last = (pdf[["r", "k", "lo", "hi"]] == pdf[["r", "k", "lo", "hi"]].iloc[-1]).all(axis=1).to_numpy()
            cut_at = len(pdf) - int(last[::-1].argmin() if not last.all() else len(last))
            if cut_at:
                yield solve(pdf.iloc[:cut_at].reset_index(drop=True))
            held = [pdf.iloc[cut_at:]]
            rows = len(held[0])
        if rows:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def _ranges(n: int, radius: int, block: int) -> tuple[int, int]:
    """How many bit ranges to cut, and how many of them two fingerprints must share.

    Of radius + g ranges, g stay equal whatever the radius differing bits are. The
    least g is taken for which files of ``n`` spread fingerprints stay under ``block``.
    """
    g = next((g for g in (1, 2, 3) if n / 2 ** (64 * g / (radius + g)) <= block), 3)
    return radius + g, g


def links(distinct: DataFrame, radius: int = 4, block: int = 2048, shared: int | None = None) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints (column fp) at ``radius`` bits or fewer.

    ``shared`` ranges must agree (1 to 3); by default as many as the number of fingerprints asks for.
    """
    if not 0 < radius < 8:
        raise ValueError("radius must be from 1 to 7")
    m, g = _ranges(distinct.count(), radius, block) if shared is None else (radius + shared, shared)
    at = [64 * i // m for i in range(m + 1)]
    masks = [sum(((1 << at[i + 1]) - (1 << at[i])) for i in some) for some in combinations(range(m), g)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    file = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.col("fp").bitwiseAND(F.lit(signed(x)).cast("long")).alias("k")) for r, x in enumerate(masks)]))
    files = distinct.select("fp", file.alias("f")).select("fp", "f.r", "f.k")
    # At most a 1/block part of all files is hot; a hot file's rows are not gathered but cut in blocks that meet in pairs.
    hot = files.groupBy("r", "k").count().filter(F.col("count") > block).select("r", "k", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = files.join(hot, ["r", "k"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = dealt.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("r", "k", F.least("own", "o").alias("lo"), F.greatest("own", "o").alias("hi"), "own", "fp")
    dealt = met.repartition("r", "k", "lo", "hi").sortWithinPartitions("r", "k", "lo", "hi", "fp")
    return dealt.mapInPandas(_links(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, block: int = 2048) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of ``docs``.

    component_id is the smallest doc_id reachable over links, its own included.
    Null and word-free texts have fingerprint zero. Rows with a null doc_id take
    part; a component of such rows only has a null component_id. Repeated rows
    give repeated rows. Columns of ``docs`` other than doc_id and text are not read.
    """
    fps = cut(fingerprints(docs, shingle))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    return _named(fps, distinct, components(links(distinct.select("fp"), radius, block)))


def _named(fps: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """Documents with the smallest id of their component; ``distinct`` has each fingerprint and its smallest id."""
    named = cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = hot_join(named, lows, ["root"]).select("fp", "component_id", "root")
    written = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return hot_join(fps, of_fp, ["fp"]).select("doc_id", written("fp").alias("fingerprint"), "component_id", written("root").alias("root_fingerprint"))


#: MinHash bands for texts whose fingerprints lie too far apart: similar texts (0.8) meet in one of them with probability 0.99.
BANDS, ROWS = 12, 5
_SPREAD = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: A pair that agrees in fewer of its 60 minima is not compared further. At a similarity of 0.8 they agree in 48.8 with a
#: deviation of 3.1 (a sixteenth of the others agree by chance), so that 1 link in some millions is lost here.
AGREE = 32


def minima(h: np.ndarray) -> np.ndarray | None:
    """The least value of each MinHash function over a text's shingle hashes; None for a text without words."""
    if not len(h):
        return None
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    h = np.unique(h).astype(np.uint64)
    for i in range(0, len(h), 16_384):
        least = np.minimum(least, (h[i : i + 16_384, None] * _SPREAD[0] + _SPREAD[1]).min(axis=0))
    return least


def band_keys(least: np.ndarray | None) -> list[int]:
    """A number for each band of a text's minima; none for a text without words."""
    import xxhash

    if least is None:
        return []
    low = [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(low, np.uint64).view(np.int64).tolist()


def sketch(least: np.ndarray | None) -> list[int]:
    """Four bits of each minimum, sixteen to a number; the last one is filled up with zeros."""
    if least is None:
        return []
    bits = np.zeros(64, np.uint64)
    bits[: BANDS * ROWS] = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)
    return np.bitwise_or.reduce(bits.reshape(4, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1).view(np.int64).tolist()


def agreeing(x: Column, y: Column) -> Column:
    """In how many of the minima two sketches agree."""
    ones = F.lit(0x1111111111111111)

    def differ(k: int) -> Column:
        d = x[k].bitwiseXOR(y[k])
        some = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))
        return F.bit_count(some.bitwiseAND(ones))

    return F.lit(BANDS * ROWS) - sum((differ(k) for k in range(1, 4)), differ(0))


def _whole(x: float) -> int:
    """The least whole number of at least ``x``, rounding noise aside: a bound that is never too high."""
    return math.ceil(x - 1e-9)


def prefix(h: np.ndarray, similar: float, heavy: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first of a text's different shingle hashes (sorted) in the order that all texts share: by number, then those in ``heavy`` (sorted) by ``place``.

    As many as it takes for two texts of a Jaccard similarity of ``similar`` to share one.
    """
    if not len(h):
        return h
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
        hot = heavy[at] == h
        h = np.concatenate([h[~hot], h[hot][np.argsort(place[at[hot]], kind="stable")]])
    return h[: len(h) - _whole(similar * len(h)) + 1]


def _marks(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows (doc_id, t, fp, some): t stands for the text by 64 bits of hash; ``some`` are a fifth of its shingles, others in each text, once a task for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            hashes = [shingle_hashes(t, shingle) for t in b["text"].tolist()]
            fp = np.array([majority(h) for h in hashes], dtype=np.uint64).view(np.int64)
            some = []
            for t, h in zip(b["t"].tolist(), hashes, strict=True):
                u = np.unique(h).astype(np.uint64) if t not in seen else np.zeros(0, np.uint64)
                some.append(u[(u * np.uint64(t % 2**64 | 1)) >> np.uint64(32) < np.uint64(2**32 // 5)].view(np.int64))
                seen.add(t)
            yield b.drop(columns=["text"]).assign(doc_id=b["doc_id"].astype("Int64"), fp=fp, some=some)

    return _texts(docs).mapInPandas(run, "doc_id long, t long, fp long, some array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


#: Shingles that so many texts have among a fifth of their own are heavy. They come last in the order of the shingles, the most frequent at
#: the end, so that rare ones make up the prefixes. All shingles of a slot (their last bits) count as its most frequent one, so that the
#: table stays the same size whatever the input; that only changes the order, and no order loses a pair.
HEAVY, SLOTS = 4, 1 << 22


def heavy_levels(marks: DataFrame) -> np.ndarray:
    """For each slot eight times the logarithm to base 2 of how often its most frequent shingle stands in ``some``; 0 where none is heavy."""
    often = marks.select(F.explode("some").alias("key")).groupBy("key").count().filter(F.col("count") >= HEAVY)
    slot = F.col("key").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")
    top = often.groupBy(slot).agg(F.max(F.floor(8 * F.log2("count"))).cast("short").alias("level")).toArrow()
    levels = np.zeros(SLOTS, np.uint8)
    levels[top["slot"].to_numpy()] = top["level"].to_numpy()
    return levels


def prefix_rows(docs: DataFrame, levels: np.ndarray, shingle: int, similar: float) -> DataFrame:
    """Rows (key, t, n, at): the shingles of each text's prefix that another text has in its own, their places there, and how many different shingles the text has."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            keys, ts, ns, places = [np.zeros(0, np.uint64)], [], [], []
            for t, text in zip(b["t"].tolist(), b["text"].tolist(), strict=True):
                if t in seen:
                    continue
                seen.add(t)
                h = np.unique(shingle_hashes(text, shingle)).astype(np.uint64)
                level = shared.value[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
                k = prefix(h, similar, h[level > 0], level[level > 0])
                keys.append(k)
                ts.append(np.full(len(k), t, np.int64))
                ns.append(np.full(len(k), len(h), np.int32))
                places.append(np.arange(len(k), dtype=np.int32))
            whole = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
            yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "t": whole(ts, np.int64), "n": whole(ns, np.int32), "at": whole(places, np.int32)})

    rows = _texts(docs).drop("doc_id").mapInPandas(run, "key long, t long, n int, at int").repartition("key").dropDuplicates(["key", "t"])
    w = Window.partitionBy("key").orderBy("t")
    return rows.select("*", F.lag("t").over(w).alias("_p"), F.lead("t").over(w).alias("_q")).filter("_p IS NOT NULL OR _q IS NOT NULL").drop("_p", "_q")


def met_rows(rows: DataFrame, roots: DataFrame, similar: float, block: int = 2048) -> DataFrame:
    """The ``rows`` of ``prefix_rows`` whose key has texts of different ``roots`` (t, root), as (key, t, n, rest, root, blocks, own).

    ``rest`` places of the prefix are left from this one on. A key of more than ``block`` texts is cut in ``blocks``, of which the text is in its ``own``.
    """
    placed = rows.join(roots, "t")
    many = placed.groupBy("key").agg(F.count("*").alias("c"), (F.min("root") < F.max("root")).alias("mixed")).filter("mixed")
    dealt = placed.join(many.select("key", F.ceil(F.col("c") / block).cast("int").alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
    rest = (F.col("n") - F.ceil(similar * F.col("n") - 1e-9) + 1 - F.col("at")).cast("int").alias("rest")
    return dealt.select("key", "t", "n", rest, "root", "blocks", "own")


#: Two texts must share so many shingles of their prefixes, or as many as the similarity asks for if those are fewer. Most pairs of unlike
#: texts that share a shingle by chance share one or two.
SHARED = 4


def candidates(met: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of texts of different roots whose prefixes share as many shingles (``SHARED`` at most) as a similarity of ``similar`` asks for.

    Two similar texts share o = s / (1 + s) * (p + q) of their p and q shingles. All that the prefix which
    ends first shares with the other text lies in both prefixes; that is all of it but those that only its own
    text has: at least m = o - s * max(p, q) + 1 shingles. The i-th of these has m - i more behind it in either
    prefix, so the first k of them are met where m - k + 1 places are left, and a pair that has fewer than k there is not similar.
    ``met`` is a stored ``met_rows``; its blocks meet in pairs.
    """
    side = lambda o, lo, hi: met.withColumn("o", F.explode(o)).select("key", F.col(lo).alias("lo"), F.col(hi).alias("hi"), "t", "n", "rest", "root")
    left = side(F.sequence("own", F.col("blocks") - 1), "own", "o")
    right = side(F.sequence(F.lit(0), F.col("own")), "o", "own").withColumnsRenamed({c: f"{c}2" for c in ("t", "n", "rest", "root")})
    once = (F.col("root") != F.col("root2")) & ((F.col("lo") < F.col("hi")) | (F.col("t") < F.col("t2")))
    most = F.ceil(similar * F.greatest("n", "n2") - 1e-9)
    asked = F.ceil(similar / (1 + similar) * (F.col("n") + F.col("n2")) - 1e-9) - most + 1
    k = F.least(asked, F.lit(SHARED))
    both = left.join(right, ["key", "lo", "hi"]).filter(once & (F.least("n", "n2") >= most) & (F.least("rest", "rest2") >= asked - k + 1))
    pairs = both.groupBy(F.least("t", "t2").alias("a"), F.greatest("t", "t2").alias("b")).agg(F.count("*").alias("c"), F.max(k).alias("k"))
    return pairs.filter("c >= k").select("a", "b")


#: Pairs are compared in rounds of a quarter of the documents' bytes, or so many if that is more.
ROUND = 1 << 26


def similar_links(docs: DataFrame, met: DataFrame, shingle: int, similar: float) -> DataFrame:
    """Links (a, b) between all texts of different components that have a Jaccard similarity of ``similar``.

    ``met`` is a stored ``met_rows``. No such pair is left out; the shingles of the candidates are compared
    whole, and only their texts travel, compressed and for as long as this takes. However many pairs a text is in,
    those of a round hold a quarter of the documents' bytes.
    """
    spark, folder, found = docs.sparkSession, new_folder(docs.sparkSession), new_folder(docs.sparkSession)
    pairs = _stored(candidates(met, similar), f"{folder}/pairs")
    needed = pairs.select(F.col("a").alias("t")).unionByName(pairs.select(F.col("b").alias("t"))).distinct()
    texts = _texts(docs).select("t", "text").join(needed, "t", "left_semi")
    texts = _stored(texts.groupBy("t").agg(F.any_value("text").alias("text")).withColumn("size", F.octet_length("text")), f"{folder}/texts")
    whole = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sent = pairs.groupBy("a").count().join(texts.select(F.col("t").alias("a"), "size"), "a").agg(F.sum(F.col("count") * F.col("size"))).first()[0] or 0
    rounds = max(1, math.ceil(sent / max(ROUND, whole / 4)))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = []
            for x, y in zip(b["x"].tolist(), b["y"].tolist(), strict=True):
                p, q = (np.unique(shingle_hashes(z, shingle)) for z in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                held.append(both >= similar * (len(p) + len(q) - both))
            yield b.loc[held, ["a", "b"]]

    for k in range(rounds):
        part = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k)
        half = _stored(hot_join(part, texts.select(F.col("t").alias("a"), F.col("text").alias("x")), ["a"]), f"{folder}/half")
        both = hot_join(half, texts.select(F.col("t").alias("b"), F.col("text").alias("y")), ["b"])
        both.select("a", "b", "x", "y").mapInPandas(compare, "a long, b long").write.parquet(f"{found}/{k}")
        remove(spark, f"{folder}/half")
    remove(spark, folder)
    return spark.read.schema("a long, b long").parquet(*[f"{found}/{k}" for k in range(rounds)])


def _stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a Parquet table at ``path``."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def near_texts(docs: DataFrame, shingle: int = 5, radius: int = 7, similar: float = 0.8, block: int = 2048) -> DataFrame:
    """Like ``near_duplicates``, with links between texts of a Jaccard similarity of ``similar`` too, exactly.

    Components of the fingerprints come first; only texts of different components are
    looked at further. Texts and shingles are taken for equal if their 64-bit hashes are.
    """
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession)
    made = _stored(_marks(docs, shingle), f"{folder}/made")
    marks, levels = _stored(made.drop("some"), f"{folder}/marks"), heavy_levels(made)
    remove(spark, f"{folder}/made")
    distinct = _stored(marks.groupBy("fp").agg(F.min("doc_id").alias("low")), f"{folder}/distinct")
    edges = _stored(links(distinct.select("fp"), radius, block), f"{folder}/edges")
    roots = components(edges)
    of_text = marks.select("t", "fp").distinct()
    placed = _stored(hot_join(of_text, roots.withColumnRenamed("node", "fp"), ["fp"], "left").select("t", "fp", F.coalesce("root", "fp").alias("root")), f"{folder}/placed")
    rows = _stored(prefix_rows(docs, levels, shingle, similar), f"{folder}/rows")
    met = _stored(met_rows(rows, placed.select("t", "root"), similar, block), f"{folder}/met")
    remove(spark, f"{folder}/rows")
    more = similar_links(docs, met, shingle, similar)
    if not more.isEmpty():
        fp_of = lambda t: placed.select(F.col("t").alias(t), F.col("fp").alias(f"fp_{t}"))
        named = more.join(fp_of("a"), "a").join(fp_of("b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
        roots = components(edges.unionByName(named))
    out = written(_named(marks.select("doc_id", "fp"), distinct, roots))
    remove(spark, folder)
    return out


def first_of_each(docs: DataFrame, shingle: int = 4, radius: int = 4, block: int = 2048, similar: float | None = None) -> DataFrame:
    """The rows of ``docs`` that are first in their component, with the columns of ``docs``.

    ``similar`` links texts of that Jaccard similarity too. Rows that repeat the
    kept doc_id are kept once; rows with a null doc_id are kept once a component
    that has no other id. A null text has no words; columns of any name stay as they
    are. An empty table gives no rows.
    """
    plain = docs.select("doc_id", "text")
    found = cut(near_duplicates(plain, shingle, radius, block)) if similar is None else near_texts(plain, shingle, radius, similar, block)
    ids = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    wanted = found.filter(F.col("component_id").isNull() & (F.col("fingerprint") == F.col("root_fingerprint"))).select("fingerprint").distinct()
    return kept.unionByName(_anonymous(docs, wanted, shingle))


def _anonymous(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """One row with a null doc_id for each wanted fingerprint."""
    (key,) = free_names(docs, "fingerprint")

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t or "", shingle) for t in text], dtype=np.uint64).astype(np.int64))

    once = fp.asNondeterministic()  # else the join's filter computes it a second time, in a worker of its own
    made = docs.filter(F.col("doc_id").isNull()).withColumn(key, F.lower(F.lpad(F.hex(once("text")), 16, "0"))).dropDuplicates([key])
    return made.join(wanted.withColumnRenamed("fingerprint", key), key, "left_semi").select(*docs.columns)
