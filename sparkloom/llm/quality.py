"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has two units, one for itself and one for its shape (runs of upper,
lower, digits; other signs as they are), each hashed into a fixed number of
places, so that the vocabulary never outgrows its bound. A place has a sparse
random index vector. Its context vector is the sum of the index vectors met
around it anywhere in the corpus: tasks add them up where the texts are, and only
sums travel. A document is the mean of its words' vectors, with its length, word
length and share of different words. A numpy network with one hidden layer
scores it; a temperature found on a fold that the network did not see calibrates
the probabilities. Only network and temperature come from a bounded sample.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample

#: Places of words and of shapes, and the length of a vector: these bound the model whatever the corpus.
WORDS, SHAPES, DIM = 8192, 2048, 32
FEATURES = 2 * DIM + 3
#: Words on each side that are context.
WINDOW = 2
#: Words whose units a Python worker remembers.
CACHE = 300_000
#: Words whose vectors a task holds at once.
CHUNK = 100_000
_RUNS = re.compile(r"(.)\1+", re.DOTALL)


class _Classes(dict):
    """Code point to its class: A, a, 0 or the sign itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return self[code]


_CLASSES = _Classes()


def shape(word: str) -> str:
    """The whole word's shape: runs of upper, lower, digits and of any other sign, each as one."""
    return _RUNS.sub(r"\1", word.translate(_CLASSES))


class _Units(dict):
    """Word to both of its places, as one number."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        form = _PLAIN if word.islower() and word.isalpha() else zlib.crc32(shape(word).encode("utf-8", "replace")) % SHAPES
        code = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % WORDS * SHAPES + form
        return code


_PLAIN = zlib.crc32(b"a") % SHAPES


def index_vectors() -> np.ndarray:
    """A sparse ternary vector for each place: the same on every machine."""
    rng = np.random.default_rng(11)
    at = rng.random((WORDS + SHAPES, DIM)).argsort(axis=1)
    return np.where(at < 2, 1, np.where(at < 4, -1, 0)).astype(np.int16)


Piece = tuple[np.ndarray, int, int]  # units, and which of them count; the others are context only


def context_sums(pieces: list[Piece], index: np.ndarray, sums: np.ndarray) -> None:
    """Add the index vectors around each place of ``pieces`` to ``sums``; the last column counts."""
    gap = np.full(WINDOW, -1)
    code = np.concatenate([x for units, _, _ in pieces for x in (units, gap)])
    counted = np.zeros(len(code), bool)
    at = 0
    for units, a, z in pieces:
        counted[at + a : at + z] = True
        at += len(units) + WINDOW
    if not counted.any():
        return
    v = index[code // SHAPES] + index[WORDS + code % SHAPES]
    v[code < 0] = 0
    around = np.zeros_like(v)
    for k in range(1, WINDOW + 1):
        around[k:] += v[:-k]
        around[:-k] += v[k:]
    real = np.flatnonzero(counted)
    for place in (code[real] // SHAPES, WORDS + code[real] % SHAPES):
        order = np.argsort(place, kind="stable")
        found, start, count = np.unique(place[order], return_index=True, return_counts=True)
        sums[found, :DIM] += np.add.reduceat(around[real[order]], start, axis=0, dtype=np.int32)
        sums[found, DIM] += count


def _pieces(texts: list[str], units: _Units) -> Iterator[list[Piece]]:
    """The texts as units, about ``CHUNK`` at once; a longer text comes in pieces that see their neighbours' ends."""
    held: list[Piece] = []
    n = 0
    for t in texts:
        words = t.split()
        for at in range(0, len(words), CHUNK):
            before = max(0, at - WINDOW)
            part = np.fromiter(map(units.__getitem__, words[before : at + CHUNK + WINDOW]), np.int64)
            held.append((part, at - before, min(at + CHUNK, len(words)) - before))
            n += len(part)
            if n >= CHUNK:
                yield held
                held, n = [], 0
    if held:
        yield held


BLOCK = 512  # places a row of partial sums


def _partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    index, units = index_vectors(), _Units()
    sums = np.zeros((WORDS + SHAPES, DIM + 1), np.int64)
    for b in batches:
        for pieces in _pieces(b["text"].tolist(), units):
            context_sums(pieces, index, sums)
    if sums[:, DIM].any():
        parts = [zlib.compress(sums[i : i + BLOCK].astype("<i8").tobytes(), 1) for i in range(0, len(sums), BLOCK)]
        yield pd.DataFrame({"block": range(len(parts)), "sums": parts})


def _whole_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, data in zip(b["block"].tolist(), b["sums"], strict=True):
            one = np.frombuffer(zlib.decompress(data), "<i8")
            total[block] = total[block] + one if block in total else one
    yield pd.DataFrame({"block": list(total), "sums": [a.tobytes() for a in total.values()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vectors of all places, from every text of ``docs``.

    A task sends one row of sums per block of places; blocks add up in parallel,
    and what reaches the driver has the fixed size of the table.
    """
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    partial = texts.mapInPandas(_partial_sums, "block int, sums binary")
    sums = np.zeros((WORDS + SHAPES, DIM + 1), np.int64)
    for r in partial.repartition("block").mapInPandas(_whole_sums, "block int, sums binary").collect():
        sums[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["sums"], "<i8").reshape(-1, DIM + 1)
    return vectors_of(sums)


def vectors_of(sums: np.ndarray) -> np.ndarray:
    """Index vector plus unit context vector; what all contexts share, that of the frequent words, is taken off."""
    count = sums[:, DIM:].astype(float)
    mean = sums[:, :DIM] / np.maximum(count, 1)
    for part in (slice(0, WORDS), slice(WORDS, None)):
        mean[part] -= sums[part, :DIM].sum(axis=0) / max(1.0, count[part].sum())
    norm = np.linalg.norm(mean, axis=1, keepdims=True)
    context = np.where(count > 0, mean / np.maximum(norm, 1e-9), 0)
    return (index_vectors() + context).astype(np.float32)


def pooled(texts: list[str], table: np.ndarray, units: _Units) -> np.ndarray:
    """The features of each text; a text without words has zeros."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    of = units.__getitem__
    for i, t in enumerate(texts):
        words = t.split()
        if not words:
            continue
        total = np.zeros(2 * DIM)
        for at in range(0, len(words), CHUNK):
            code = np.fromiter(map(of, words[at : at + CHUNK]), np.int64)
            one, count = np.unique(code, return_counts=True)
            n = count.astype(np.float32)
            total[:DIM] += n @ table[one // SHAPES]
            total[DIM:] += n @ table[WORDS + one % SHAPES]
        out[i, : 2 * DIM] = total / len(words)
        out[i, 2 * DIM :] = np.log1p(len(words)), len(set(words)) / len(words), np.log1p(len(t) / len(words))
    return out


class Network:
    """Two layers, trained by Adam on balanced log loss; ``temperature`` divides the logit."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.__dict__.update(arrays)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, fold: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - mean) / scale
        train, check = fold < 8, fold >= 8
        if not check.any() or not train.any():
            train = check = np.ones(len(x), bool)
        w = {"w1": rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, hidden**-0.5, hidden), "b2": np.zeros(1)}
        m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
        step, zt, yt = 0, z[train], y[train].astype(float)
        for _ in range(epochs):
            order = rng.permutation(len(zt))
            for i in range(0, len(order), 64):
                part = order[i : i + 64]
                h = np.tanh(zt[part] @ w["w1"] + w["b1"])
                g = (1 / (1 + np.exp(-(h @ w["w2"] + w["b2"]))) - yt[part]) / len(part)
                back = np.outer(g, w["w2"]) * (1 - h * h)
                grad = {"w1": zt[part].T @ back + 1e-4 * w["w1"], "b1": back.sum(axis=0), "w2": h.T @ g + 1e-4 * w["w2"], "b2": np.array([g.sum()])}
                step += 1
                for k in w:
                    m[k] = 0.9 * m[k] + 0.1 * grad[k]
                    v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                    w[k] -= 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        net = cls(w | {"mean": mean, "scale": scale, "temperature": np.array([1.0])})
        logit, truth = net.logit(x[check]), y[check]
        loss = lambda t: np.mean(np.logaddexp(0, np.where(truth == 1, -1, 1) * logit / t))
        net.temperature = np.array([min(np.geomspace(0.25, 8, 41), key=loss)])
        return net

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature[0], -40, 40)))


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [b for b in batches if len(b)]
    if frames:
        pdf = pd.concat(frames, ignore_index=True).sort_values("_id", ignore_index=True)
        net = Network.fit(np.stack(pdf["x"].to_list()).astype(float), pdf["label"].to_numpy(), pdf["fold"].to_numpy())
    else:
        net = Network.fit(np.zeros((1, FEATURES)), np.array([1]), np.array([0]))
    out = io.BytesIO()
    np.savez_compressed(out, **net.__dict__)
    yield pd.DataFrame({"model": [out.getvalue()]})


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> tuple[np.ndarray, Network]:
    """Word vectors of all of ``docs``, and a network from at most ``sample`` labelled rows outside the held-out quarter.

    Without labels the network scores all alike. The sample's texts are pooled
    in parallel; one task gets their features.
    """
    table = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = _Units()
        for b in batches:
            yield b[["_id", "label", "fold"]].assign(x=list(pooled(b["text"].tolist(), shared.value, units)))

    rows = labelled_sample(docs, labels, "quality", sample).mapInPandas(pool, "_id long, label int, fold int, x array<float>")
    with np.load(io.BytesIO(bytes(rows.repartition(1).mapInPandas(_fit, "model binary").first()["model"]))) as f:
        return table, Network(dict(f))


def score(docs: DataFrame, model: tuple[np.ndarray, Network], least: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted.

    A null text is empty; it gets a score too. Null ids and repeated rows stay,
    equal texts score alike, an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model[0], model[1].__dict__))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, net, units = shared.value[0], Network(shared.value[1]), _Units()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "score": net.score(pooled(b["text"].tolist(), table, units))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= least).cast("int"))
