"""Benchmark decontamination with an FM-index per shard of the training texts.

A task turns its documents into word numbers. No occurrence of a test phrase can
hold a word that no phrase has, so a run of phrase words too short for any
phrase is left out, exactly; what stays is the shard's text. Over it the task
builds a suffix array, the Burrows-Wheeler transform in a wavelet matrix with
rank counts, and a sample of suffix positions. All phrases search backwards
together; occurrences are located by walking to a sampled position, and the
spans of a document are merged. Benchmark texts reach the tasks in blocks of bounded
size, and tasks number the words of a block's windows in arrays; a shard is searched
for one block after the other.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of so many bytes or more travel as SHA-256 in hex, which is as long: no other word looks like one.
LONG = 64
LOWER = {c: c + 32 for c in range(65, 91)}
#: The same words on UTF-8 bytes: separators become spaces, A-Z lower case.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
class Wavelet:
    """A wavelet matrix over small non-negative integers: access and rank of many positions at once."""

    def __init__(self, values: np.ndarray, sigma: int) -> None:
        self.n = len(values)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (values >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % 8 + 8)).view("<u8")
            self.words.append(packed)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.zeros.append(self.n - int(bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        part = self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.counts[k][word] + np.bitwise_count(part)

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``value`` occurs before position ``at``."""
        begin = np.zeros_like(at)
        for k in range(self.levels):
            one = ((value >> (self.levels - 1 - k)) & 1).astype(bool)
            b, e = self._ones(k, begin), self._ones(k, at)
            begin = np.where(one, self.zeros[k] + b, begin - b)
            at = np.where(one, self.zeros[k] + e, at - e)
        return at - begin

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at positions ``at``, and the rank of each there."""
        begin, value = np.zeros_like(at), np.zeros_like(at)
        for k in range(self.levels):
            b, e = self._ones(k, begin), self._ones(k, at)
            one = self._ones(k, at + 1) > e
            value = value * 2 + one
            begin = np.where(one, self.zeros[k] + b, begin - b)
            at = np.where(one, self.zeros[k] + e, at - e)
        return value, at - begin


class FMIndex:
    """Full-text index over numbers from 1; 0 ends the text, so phrases can't hold it."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int, every: int = 8) -> None:
        text = np.r_[text, 0].astype(np.int64)
        self.n = len(text)
        order = self._suffixes(text, depth)
        self.wavelet = Wavelet(text[order - 1], sigma)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]
        self.marked = (order % every == 0) | (order == 0)
        self.sampled = order[self.marked]
        self.rank_marked = np.cumsum(self.marked) - 1

    @staticmethod
    def _suffixes(text: np.ndarray, depth: int) -> np.ndarray:
        """Suffix array by prefix doubling, on until all suffixes differ (backward search needs their full order)."""
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        n, step = len(text), 1
        while True:
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            s = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.r_[0, s[1:] != s[:-1]])
            rank, step = new, step * 2
            if rank.max() == n - 1 or step >= n:
                return order

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges [lo, hi) of phrases (rows of equal length), searched backwards at once."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            c = phrases[alive, k]
            lo[alive] = self.before[c] + self.wavelet.rank(c, lo[alive])
            hi[alive] = self.before[c] + self.wavelet.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        dead = lo >= hi
        lo[dead] = hi[dead] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back until a row is sampled."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.marked[at])
        while len(todo):
            value, rank = self.wavelet.access(at[todo])
            at[todo] = self.before[value] + rank
            steps[todo] += 1
            todo = todo[~self.marked[at[todo]]]
        return self.sampled[self.rank_marked[at]] + steps


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(BYTES).split() if text else []


def windows(rows: list[tuple[object, str | None]], window: int) -> dict[tuple[bytes, ...], set[str]]:
    """Window to the items that have it. A null item_id counts as "null"."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in rows:
        w = words(text)
        name = "null" if item is None else str(item)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[i : i + window]), set()).add(name)
    return found


class Phrases:
    """The windows of a block of items as arrays of word numbers, and which items have each.

    Words of ``LONG`` bytes or more stand as their digests (see ``_blocks``), in the texts that are searched too.
    """

    def __init__(self, rows: list[tuple[str | None, str]], window: int) -> None:
        names = sorted({"null" if item is None else item for item, _ in rows})
        name_at = {n: i for i, n in enumerate(names)}
        self.names = np.array(names, object)
        self.number: dict[bytes, int] = {}  # from 2; 1 stands between runs
        cut_up: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in rows:
            w = words(text)
            if w:
                codes = np.array([self.number.setdefault(x, len(self.number) + 2) for x in w], np.int32)
                n = min(window, len(w))
                cut_up.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(codes, n), name_at["null" if item is None else item]))
        self.long = any(len(x) >= LONG for x in self.number)
        self.sigma = len(self.number) + 2
        self.shortest, self.deepest = min(cut_up, default=0), max(cut_up, default=1)
        #: Length to (different windows, where the items of each begin and end, items).
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, parts in cut_up.items():
            codes, of = np.unique(np.concatenate([c for c, _ in parts]), axis=0, return_inverse=True)
            pairs = np.unique(np.c_[of.ravel(), np.repeat([k for _, k in parts], [len(c) for c, _ in parts])], axis=0)
            self.by_length[n] = codes.astype(np.int64), np.searchsorted(pairs[:, 0], np.arange(len(codes) + 1)), pairs[:, 1]


#: The last block's phrases of a Python worker, over its tasks.
_LAST: dict[object, Phrases] = {}


def _phrases(key: object, rows, window: int) -> Phrases:
    if (key, window) not in _LAST:
        _LAST.clear()
        _LAST[key, window] = Phrases(rows, window)
    return _LAST[key, window]


def _hits(texts: list[list[bytes]], phrases: Phrases) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    """Spans and items of each text (by position) that holds a phrase: one shard's FM-index, built and searched."""
    get = phrases.number.get
    owner, parts, places = [], [], []
    for d, w in enumerate(texts):
        if not phrases.shortest or len(w) < phrases.shortest:
            continue
        if phrases.long:
            w = [x if len(x) < LONG else hashlib.sha256(x).hexdigest().encode() for x in w]
        code = np.fromiter(map(get, w, repeat(0)), np.int64, len(w))
        edge = np.diff(np.r_[0, (code > 0).astype(np.int8), 0])
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for a, z in zip(begin.tolist(), end.tolist(), strict=True):
            if z - a >= phrases.shortest:
                owner.append(np.full(z - a + 1, d))
                parts.append(np.r_[code[a:z], 1])
                places.append(np.r_[np.arange(a, z), -1])
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    if not parts:
        return spans, items
    of, place = np.concatenate(owner), np.concatenate(places)
    index = FMIndex(np.concatenate(parts), phrases.sigma, phrases.deepest)
    for n, (codes, begin, item) in phrases.by_length.items():
        lo, hi = index.search(codes)
        some = np.flatnonzero(hi > lo)
        size = (hi - lo)[some]
        which = np.repeat(some, size)
        rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[some], size)
        for i in range(0, len(rows), 1_000_000):
            at = index.locate(rows[i : i + 1_000_000])
            for d, a in zip(of[at].tolist(), place[at].tolist(), strict=True):
                spans.setdefault(d, []).append((a, a + n))
            for d, k in np.unique(np.c_[of[at], which[i : i + 1_000_000]], axis=0).tolist():  # each window once a text, however often it occurs
                items.setdefault(d, set()).update(phrases.names[item[begin[k] : begin[k + 1]]].tolist())
    return spans, items


def _search(blocks, window: int, shard_words: int, added: list[str], trim: bool):
    job = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(held: list[pa.RecordBatch], texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            for k, block in enumerate(blocks):
                some, named = _hits(texts, _phrases((job, k), block.value, window))
                for d in some:
                    spans[d] = merged([*spans.get(d, []), *some[d]])
                    items.setdefault(d, set()).update(named[d])
            n = range(len(texts))
            made = [list(map(len, texts)), [[{"a": a, "b": b} for a, b in spans.get(d, [])] for d in n], [sorted(items.get(d, ())) for d in n]]
            t = pa.Table.from_batches(held)
            for name, values in zip(added, made, strict=True):
                at = t.schema.get_field_index(name)
                t = t.set_column(at, t.schema.field(at), pa.array(values, t.schema.field(at).type))
            if trim and spans:
                at = t.schema.get_field_index("text")
                left = [cut_words(x, spans[d]) if d in spans else x for d, x in enumerate(t.column(at).to_pylist())]
                t = t.set_column(at, t.schema.field(at), pa.array(left, t.schema.field(at).type))
            yield from t.to_batches(max_chunksize=2048)

        frames: list[pa.RecordBatch] = []
        texts: list[list[bytes]] = []
        held = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                more = [words(t) for t in b.column("text").to_pylist()]
                frames.append(b)
                texts += more
                held += sum(map(len, more))
                if held >= shard_words:
                    yield from shard(frames, texts)
                    frames, texts, held = [], [], 0
        if frames:
            yield from shard(frames, texts)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, window: int, block_chars: int, piece_words: int) -> list[list[tuple[str | None, str]]]:
    """The different items, long ones in pieces that overlap by a window, dealt into blocks of about ``block_chars``.

    Spark cuts and deals. Long words stand as digests, so a piece has a bounded size however long its words are;
    a block that comes out over eight times too large is dealt again.
    """
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), "".join(map(chr, LOWER)), "".join(map(chr, LOWER.values())))
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), F.regexp_extract_all(lower, F.lit(word), F.lit(0)).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("w", F.transform("w", lambda x: F.when(F.octet_length(x) < LONG, x).otherwise(F.sha2(x.cast("binary"), 256))))
    step = piece_words - window + 1
    starts = F.expr(f"sequence(0, greatest(size(w) - {window}, 0), {step})")
    pieces = w.select("item", "w", F.explode(starts).alias("at")).select("item", F.array_join(F.slice("w", F.col("at") + 1, piece_words), " ").alias("text")).distinct()
    return _dealt(cut(pieces), block_chars, 0)


def _dealt(pieces: DataFrame, block_chars: int, turn: int) -> list[list[tuple[str | None, str]]]:
    """Pieces in blocks of about ``block_chars``; a piece larger than that has a block of its own."""
    rows, chars = pieces.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n = max(1, -(-chars // block_chars))
    if rows <= 1 or n == 1 or (turn and chars <= 8 * block_chars):
        return [[(r["item"], r["text"]) for r in pieces.collect()]]
    blocks = []
    for k in range(n):
        blocks += _dealt(pieces.filter(F.pmod(F.xxhash64("item", "text", F.lit(turn)), F.lit(n)) == k), block_chars, turn + 1)
    return blocks


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 4_000_000, shard_words: int = 500_000, piece_words: int = 20_000, trim: bool = False) -> tuple[DataFrame, list[str]]:
    """``docs`` with three columns added, and their names: words, spans (of words, end exclusive) and items (sorted names).

    The names are unlike all of ``docs``. Null and word-free texts have no words
    and no hits; an empty benchmark hits nothing; a null item_id is the item
    "null". Repeated items count once. What is broadcast is one block of benchmark
    texts at a time, whatever the benchmark's size. With ``trim`` the texts come without the words of their spans.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(benchmark, window, block_chars, piece_words)]
    added = free_names(docs, "n_words", "spans", "items")
    kinds = ("bigint", "array<struct<a:bigint,b:bigint>>", "array<string>")
    out = docs.withColumns({k: c.cast(t) for k, c, t in zip(added, (F.lit(0), F.array(), F.array()), kinds, strict=True)})
    return out.mapInArrow(_search(blocks, window, shard_words, added, trim), out.schema), added


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, **limits: int) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated.

    Null ids and repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    found, (n_words, spans, items) = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window, **limits)
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    names = F.array_join(F.array_sort(items), ",")
    return found.select("doc_id", F.col(n_words).alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10, **limits: int) -> DataFrame:
    """``docs`` with the hit words cut out of the texts; documents of which no word is left go.

    Documents without a hit stay as they are, null and word-free ones too, and so
    do repeated rows and all columns, whatever their names. An empty table gives no rows.
    """
    found, (_, spans, _) = find(docs, benchmark, window, trim=True, **limits)  # one Python worker a task, as the search itself cuts
    return found.filter((F.size(spans) == 0) | (F.length("text") > 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; nothing but separators left gives an empty text."""
    at = [(m.start(), m.end()) for m in WORD.finditer(text.translate(LOWER))]
    keep, end = [], 0
    for a, b in spans:
        keep.append(text[end : at[a][0]])
        end = at[b - 1][1]
    keep.append(text[end:])
    out = " ".join(x.strip() for x in keep if x.strip())
    return out if WORD.search(out.translate(LOWER)) else ""
