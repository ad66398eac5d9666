"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents are tokenised once, in parallel; from then on only piece lengths
travel. Pieces are dealt evenly into cells; for each cell several islands evolve
groupings (sets of bins), exchange their elites, and the best island's bins
count. Fewer bins win, then bins whose room is gathered in as few of them as
can be. Bins that a cell could not fill well are opened again and their pieces
meet those of other cells in the next level, so what is lost is not one bin a
cell but one bin a cell of the last, far smaller level.
"""

from __future__ import annotations

import codecs
import os
import random
import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
EVOLVED = "cell long, island int, piece_key long, length long, bin long, bins long, fitness double, births long, migrants long"
#: Words of a generation whose ids a Python worker remembers, over its tasks. A full generation is kept until the
#: next is full; words met meanwhile move on, so frequent ones stay.
REMEMBERED = 300_000
#: Signs that may end a word.
SIGNS = ".,!%&$#*|?:;"
#: What needs the library for its word: letters beyond Latin, a capital that becomes two, separators that only
#: Python takes for white space, and what may be a special token.
ODD = re.compile("[^\x00-\u024f]|[\u0130\x1c-\x1f]|<\\|")


def _signs(kind: str) -> str:
    """The characters of a Unicode category among the plain ones, for a pattern's class."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


#: The vocabulary's own units of a lower-cased plain word: endings, letters, single digits, other signs.
UNITS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_signs('L')}]+|[{_signs('N')}]|[^\s{_signs('L')}{_signs('N')}]+")


#: A stop or comma beside another sign, which may share an id with it.
RUN = re.compile(rf"[.,](?:(?=[^\s{_signs('L')}{_signs('N')}])|(?<=[^\s{_signs('L')}{_signs('N')}][.,]))")


def _latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class WordIds(dict):
    """Ids of lower-cased words as little-endian bytes; a word that is not held is looked up and held.

    Signs after a word are looked up by themselves, so a word is held once
    whatever follows it.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize  # one unit's tokens
        as_signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        of_byte = {b: m for c in range(0x250) for b, m in zip(chr(c).encode(), as_signs.pre_tokenize_str(chr(c))[0][0], strict=True)}
        self.alphabet = "".join(of_byte.get(b, "\ufffe") for b in range(256))

    def ids(self, text: str) -> bytes:
        """White space never reaches the vocabulary, so a text's ids are those of its words in turn."""
        if (_latin(text) and "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f")) or not ODD.search(text):
            low = text.lower()
            if not RUN.search(low):  # most signs are single stops and commas
                low = low.replace(".", " . ").replace(",", " , ")
            return b"".join(map(self.__getitem__, low.split()))
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join([self[w if ODD.search(w) else w.lower()] for w in words])

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word.isascii() and word.isalpha():
                ids = self._merged(word)
            else:
                core = word.rstrip(SIGNS)
                if core.isalpha() and len(core) < len(word) and not ODD.search(core):
                    return self[core] + self[word[len(core) :]]
                ids = self._encoded(word)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _encoded(self, word: str) -> bytes:
        if ODD.search(word):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if not word.isalpha() and (units := UNITS.findall(word)) != [word]:
            return b"".join(map(self.__getitem__, units))
        return self._merged(codecs.charmap_decode(word.encode(), "strict", self.alphabet)[0])

    def _merged(self, unit: str) -> bytes:
        found = [t.id for t in self.merge(unit)]
        return struct.pack(f"<{len(found)}I", *found)


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The vocabulary of this Python worker, which its tasks share."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def _tokenise(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = word_ids(path).ids
        end = end_id.to_bytes(4, "little")
        full = 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                ids = of(text) + end
                doc = None if pd.isna(doc_id) else int(doc_id)
                for k, at in enumerate(range(0, len(ids), full)):
                    part = ids[at : at + full]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame({name: pd.array([r[i] for r in rows], dtype=kind) for i, (name, kind) in enumerate((("doc_id", "Int64"), ("piece", "int32"), ("start", "int64"), ("length", "int64"), ("ids_crc32", "int64")))})

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut at ``capacity``.

    A null text is empty (one id); null ids stay. Repeated rows give repeated
    pieces, an empty table none. Other columns of ``docs`` are not read.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInPandas(_tokenise(tokenizer, capacity, end_id), PIECES)


# A grouping is a list of bins, each a list of item numbers; `free` holds what is left in each.


def _best_fit(items: list[int], size: list[int], bins: list[list[int]], free: list[int], capacity: int) -> None:
    """Put each item where it leaves the least room, into a new bin if none has room."""
    order = sorted((f, b) for b, f in enumerate(free) if f)
    for i in items:
        need = size[i]
        at = bisect_left(order, (need, -1))
        if at < len(order):
            f, b = order.pop(at)
            bins[b].append(i)
        else:
            b, f = len(bins), capacity
            bins.append([i])
            free.append(capacity)
        free[b] = f - need
        if free[b]:
            insort(order, (free[b], b))


def _fitness(free: list[int], capacity: int) -> float:
    """Falkenauer's measure: the mean squared fill, highest where the room is in few bins."""
    return sum(((capacity - f) / capacity) ** 2 for f in free) / max(1, len(free))


class Grouping:
    """Bins with what is free in each; ``rate`` is lower for fewer bins, then for a higher fitness."""

    def __init__(self, bins: list[list[int]], free: list[int], capacity: int) -> None:
        self.bins, self.free = bins, free
        self.rate = (len(bins), -_fitness(free, capacity))

    def perfect(self, least: int) -> bool:
        """No grouping is better: as few bins as can be, and room in one of them at most."""
        return len(self.bins) <= least and sum(f > 0 for f in self.free) <= 1


def _filled(order: list[int], size: list[int], capacity: int) -> Grouping:
    bins: list[list[int]] = []
    free: list[int] = []
    _best_fit(order, size, bins, free, capacity)
    return Grouping(bins, free, capacity)


def _cross(mother: Grouping, father: Grouping, size: list[int], capacity: int, rng: random.Random, most: int = 8) -> Grouping:
    """Inject well-filled bins of the father, drop the mother's bins that hold their items, best-fit the displaced."""
    good = [b for b, f in enumerate(father.free) if f <= 0.01 * capacity] or [min(range(len(father.free)), key=father.free.__getitem__)]
    given = [father.bins[b] for b in rng.sample(good, rng.randint(1, min(most, len(good))))]
    taken = {i for b in given for i in b}
    # Mutation: some of the bins with room are dissolved too, so that what is left in them can meet.
    roomy = sorted((b for b, f in enumerate(mother.free) if f), key=lambda b: -mother.free[b])[: 2 * most]
    dissolved = set(rng.sample(roomy, rng.randint(1, min(most, len(roomy))))) if roomy else set()
    bins, free, displaced = [list(b) for b in given], [capacity - sum(size[i] for i in b) for b in given], []
    for k, b in enumerate(mother.bins):
        if k not in dissolved and taken.isdisjoint(b):
            bins.append(list(b))
            free.append(mother.free[k])
        else:
            displaced += [i for i in b if i not in taken]
    displaced.sort(key=lambda i: -size[i] * (1 + 0.05 * rng.random()))
    _best_fit(displaced, size, bins, free, capacity)
    return Grouping(bins, free, capacity)


def evolve(size: list[int], elites: list[list[list[int]]], capacity: int, seed: int, population: int, generations: int) -> tuple[Grouping, int]:
    """The best grouping of one island and its number of crossovers; ``elites`` are groupings to start from.

    An island ends early only with a grouping that none can beat.
    """
    rng = random.Random(seed)
    least = -(-sum(size) // capacity)
    people = [Grouping([list(b) for b in e], [capacity - sum(size[i] for i in b) for b in e], capacity) for e in elites]
    while len(people) < population and not any(p.perfect(least) for p in people):
        noise = 0.0 if not people else 0.05 * len(people)
        people.append(_filled(sorted(range(len(size)), key=lambda i: -size[i] * (1 + noise * rng.random())), size, capacity))
    people.sort(key=lambda p: p.rate)
    births = 0
    while births < generations and not people[0].perfect(least):
        a, b = sorted(rng.sample(range(len(people)), 2)) if len(people) > 1 else (0, 0)
        people.append(_cross(people[a], people[b], size, capacity, rng))
        people = sorted(people, key=lambda p: p.rate)[:population]
        births += 1
    return people[0], births


def _island(capacity: int, population: int, generations: int, epoch: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, island = int(pdf["cell"].iloc[0]), int(pdf["island"].iloc[0])
        pdf = pdf.sort_values(["length", "piece_key"], ascending=[False, True])
        own = pdf.drop_duplicates("piece_key")
        keys, size = own["piece_key"].tolist(), own["length"].tolist()
        elites, before, migrants = [], 0, 0
        if epoch:
            place = {k: i for i, k in enumerate(keys)}
            for origin, one in pdf.groupby("origin", sort=True):
                bins: dict[int, list[int]] = {}
                for k, b in zip(one["piece_key"].tolist(), one["bin"].tolist(), strict=True):
                    bins.setdefault(b, []).append(place[k])
                elites.append(list(bins.values()))
                migrants += int(origin) != island
                if int(origin) == island:
                    before = int(one["births"].iloc[0])
        best, births = evolve(size, elites, capacity, cell * 1009 + island * 31 + epoch, population, generations)
        bin_of = [(i, n) for n, b in enumerate(best.bins) for i in b]
        out = {"cell": cell, "island": island, "piece_key": [keys[i] for i, _ in bin_of], "length": [size[i] for i, _ in bin_of], "bin": [n for _, n in bin_of]}
        return pd.DataFrame(out | {"bins": len(best.bins), "fitness": -best.rate[1], "births": before + births, "migrants": migrants})

    return run


def islands_of(items: DataFrame, cells: int, capacity: int, islands: int, population: int, generations: int) -> DataFrame:
    """Groupings of (piece_key, length) by all islands of all cells, after both epochs (columns of ``EVOLVED``)."""
    dealt = items.select(F.pmod(F.xxhash64("piece_key"), F.lit(cells)).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "piece_key", "length")
    first = cut(dealt.groupBy("cell", "island").applyInPandas(_island(capacity, population, generations, 0), EVOLVED))
    # Each island's elite stays and also migrates to the next island of the ring.
    move = F.explode(F.array_distinct(F.array(F.col("island"), ((F.col("island") + 1) % islands).cast("int")))).alias("to")
    guests = first.select("cell", move, F.col("island").alias("origin"), "piece_key", "length", "bin", "births").withColumnRenamed("to", "island")
    return cut(guests.groupBy("cell", "island").applyInPandas(_island(capacity, population, generations, 1), EVOLVED))


def _level(items: DataFrame, cells: int, capacity: int, islands: int, population: int, generations: int) -> DataFrame:
    """The best island's bins of each cell: (cell, piece_key, length, bin)."""
    second = islands_of(items, cells, capacity, islands, population, generations)
    best = second.groupBy("cell").agg(F.min(F.struct("bins", -F.col("fitness"), "island"))["island"].alias("island"))
    return second.join(best, ["cell", "island"]).select("cell", "piece_key", "length", "bin")


def pack(parts: DataFrame, capacity: int = 4096, cell_size: int = 2048, levels: int = 3, islands: int = 2, population: int = 4, generations: int = 12, open_below: float = 0.995) -> DataFrame:
    """Give each row of ``parts`` (with a ``length`` from 1 to ``capacity``) a sequence_id and an offset.

    Every row is placed once, repeated rows each by themselves; offsets of a
    sequence run from 0 without gaps. An empty input gives an empty result. All
    other columns stay; columns named sequence_id or offset are replaced.
    """
    base = numbered(cut(parts.drop("sequence_id", "offset").select(F.struct("*").alias("row"), F.col("length").cast("long").alias("length"))), "piece_key")
    whole = base.filter(F.col("length") >= capacity).select("piece_key", F.col("piece_key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = base.filter(F.col("length") < capacity).select("piece_key", "length")
    placed = whole
    for level in range(1, levels + 1):
        n = rest.count()
        if not n:
            break
        cells = -(-n // cell_size)
        done = cut(_level(rest, cells, capacity, islands, population, generations))
        fill = done.groupBy("cell", "bin").agg(F.sum("length").alias("fill"))
        last = level == levels or cells == 1
        closed = fill.filter((F.col("fill") >= open_below * capacity) | F.lit(last)).select("cell", "bin")
        shut = done.join(closed, ["cell", "bin"])
        # Bins hold at most `capacity` rows, so this window is bounded.
        before = F.sum("length").over(Window.partitionBy("cell", "bin").orderBy("piece_key").rowsBetween(Window.unboundedPreceding, -1))
        number = F.lit(level).cast("long") * (1 << 59) + F.col("cell") * (1 << 13) + F.col("bin")
        placed = placed.unionByName(shut.select("piece_key", number.alias("sequence_id"), F.coalesce(before, F.lit(0)).cast("long").alias("offset")))
        if last:
            break
        rest = cut(done.join(closed, ["cell", "bin"], "left_anti").select("piece_key", "length"))
    return base.join(placed, "piece_key").select("row.*", "sequence_id", "offset")
