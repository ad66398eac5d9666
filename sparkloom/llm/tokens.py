"""Token counts of whole texts, without their ids.

A text falls into pre-tokens at places that no piece of the vocabulary crosses,
so the pieces of a text are those of its pre-tokens. Each document becomes its
pre-tokens and how often each occurs; each distinct pre-token of the corpus is
given to the library once; counts are joined to frequencies and summed up.

Few pre-tokens make up most of the (document, pre-token) pairs. The most frequent,
a million at most, travel to the documents and are joined where those are; only
pairs of rarer ones shuffle, none of which is in many documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BLANK = "▁"
BORDER = re.compile(f"(?<![ {BLANK}])[ {BLANK}]|\n")
#: Pre-tokens of more characters are cut further, wherever two characters stand together in no piece.
LONG = 32
#: Characters of a text that are cut into pre-tokens at once.
STRETCH = 1_000_000
#: Bytes of a pre-token that may be broadcast.
WIDEST = 64


class Vocabulary:
    """A sentencepiece model and where texts may be cut without changing their pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        if any("\n" in p or re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces):
            raise ValueError("pieces of this vocabulary go on over blanks or newlines")
        self.together = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        # Signs that follow a letter in no piece begin a pre-token there; else a run of blanks or a newline does. A text
        # with a blank before it is a row of pre-tokens.
        signs = "".join(re.escape(c) for c in ".,;:!?\"')" if not any(a.isascii() and a.isalpha() and b == c for a, b in self.together)) or BLANK
        self.pre_token = re.compile(f"(?:[ {BLANK}]+|\n|(?<=[A-Za-z])[{signs}])(?:[A-Za-z]+(?![^{signs} {BLANK}\n])|[^ {BLANK}\n]*)")

    def pre_tokens(self, text: str) -> Counter[str]:
        """How often each pre-token occurs in a text; none in an empty one."""
        found: Counter[str] = Counter()
        if not text:
            return found
        text = f" {text}"
        at = 0
        while at < len(text):
            border = BORDER.search(text, at + STRETCH)
            end = border.start() if border else len(text)
            found.update(self.pre_token.findall(text, at, end))
            at = end
        for word in [w for w in found if len(w) > LONG]:
            times = found.pop(word)
            for part in self.parts(word):
                found[part] += times
        return found

    def parts(self, word: str) -> Iterator[str]:
        """A long pre-token, cut wherever no piece goes on."""
        w = word.replace(" ", BLANK)
        at = 0
        for i in range(1, len(w)):
            if w[i - 1 : i + 1] not in self.together:
                yield word[at:i]
                at = i
        yield word[at:]

    def sizes(self, words: list[str]) -> list[int]:
        """Pieces of each pre-token. The library puts a blank in front, which stands for a pre-token's first blank;
        one without gets a newline, which is a piece by itself, as is the blank then."""
        blank = [w[0] in (" ", BLANK) for w in words]
        ids = self.model.encode([w[1:] if b else f"\n{w}" for w, b in zip(words, blank, strict=True)], num_threads=1)
        return [max(1, len(x)) if b else len(x) - 2 for x, b in zip(ids, blank, strict=True)]


_KNOWN: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    """Read once a Python worker."""
    if path not in _KNOWN:
        _KNOWN[path] = Vocabulary(path)
    return _KNOWN[path]


FREQUENCIES = "row long, doc_id long, n_bytes long, n_tokens long, words array<string>, times array<int>"


def frequencies(docs: DataFrame, model: str, often: tuple[pa.Array, np.ndarray] | None = None, most: int = 200_000) -> DataFrame:
    """A row per document: its number, doc_id, n_bytes, and its pre-tokens with their frequencies.

    The tokens of pre-tokens in ``often`` (words, pieces) are summed into
    ``n_tokens``; they are left out of ``words``. A worker hands rows on once they
    hold ``most`` pre-tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def row_group(batch: pa.RecordBatch, words: list[str], times: list[int], ends: list[int]) -> pa.RecordBatch:
        word, n, end, known = pa.array(words, pa.string()), np.array(times, np.int32), np.array(ends), np.zeros(len(ends), np.int64)
        if shared.value is not None:
            held, pieces = shared.value
            at = pc.index_in(word, value_set=held).to_numpy(zero_copy_only=False)
            found = ~np.isnan(at) if at.dtype.kind == "f" else np.ones(len(at), bool)
            sums = np.zeros(len(word), np.int64)
            sums[found] = n[found].astype(np.int64) * pieces[at[found].astype(np.int64)]
            known = np.r_[0, np.cumsum(sums)][end]
            word, n, end = word.filter(pa.array(~found)), n[~found], np.r_[0, np.cumsum(~found)][end]
        ends32 = pa.array(end, pa.int32())
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("row", "doc_id", "n_bytes")), pa.array(np.diff(known), pa.int64()), pa.ListArray.from_arrays(ends32, word), pa.ListArray.from_arrays(ends32, pa.array(n, pa.int32()))],
            ["row", "doc_id", "n_bytes", "n_tokens", "words", "times"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = vocabulary_of(model).pre_tokens
        for batch in batches:
            words: list[str] = []
            times: list[int] = []
            ends, first = [0], 0
            for i, text in enumerate(batch.column("text")):
                found = of(text.as_py())
                words += found.keys()
                times += found.values()
                ends.append(len(words))
                if len(words) >= most or i == batch.num_rows - 1:
                    yield row_group(batch.slice(first, i + 1 - first), words, times, ends)
                    words, times, ends, first = [], [], [0], i + 1

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, FREQUENCIES)


def piece_counts(words: DataFrame, model: str) -> DataFrame:
    """Add ``pieces`` to distinct pre-tokens (column word)."""

    @F.pandas_udf("int")
    def pieces(word: pd.Series) -> pd.Series:
        return pd.Series(vocabulary_of(model).sizes(word.tolist()), dtype="int32")

    return words.withColumn("pieces", pieces("word"))


def least_often(counts: DataFrame, most: int) -> int:
    """The number of documents from which on pre-tokens are the most frequent, at most ``most`` of them.

    It is the least power of a tenth root of two, so that the histogram behind it has under 700 rows.
    """
    step = F.floor(F.log2(F.col("docs").cast("double")) * 10).cast("int")
    held = 0
    bound = 2**62
    for row in counts.filter(f"octet_length(word) <= {WIDEST}").groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += row["count"]
        if held > most:
            break
        bound = math.ceil(2 ** (row["step"] / 10) - 1e-9)
    return bound


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, often: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Counts are those of the library for the whole text, without begin or end. A
    null or empty text has none. Null ids and repeated rows stay, each a row of its
    own; an empty table gives no rows. Columns other than doc_id and text are not
    read. At most ``often`` pre-tokens of 64 bytes at most are broadcast.
    """
    pairs = lambda of: of.select("row", F.explode(F.arrays_zip("words", "times")).alias("p")).select("row", F.col("p.words").alias("word"), F.col("p.times").cast("long").alias("times"))
    counts = written(piece_counts(frequencies(docs, model).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("docs")), model))
    frequent = (F.col("docs") >= least_often(counts, often)) & (F.octet_length("word") <= WIDEST)
    head = counts.filter(frequent).select("word", "pieces").toArrow()
    known = (pa.array(head["word"].combine_chunks(), pa.string()), head["pieces"].to_numpy())
    freq = written(frequencies(docs, model, known))
    rest = pairs(freq).join(counts.filter(~frequent).select("word", "pieces"), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("rest"))
    n = F.col("n_tokens") + F.coalesce("rest", F.lit(0))
    return freq.select("row", "doc_id", "n_bytes", "n_tokens").join(rest, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
