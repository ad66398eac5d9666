"""Documents with all the odd cases: nulls, empties, very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, spans string, items string, k_hash long, row string, length string, label int, bin string, t string"


def prose(n: int, seed: int = 0) -> str:
    r = random.Random(seed)
    parts = ["the", "an", "er", "on", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    return " ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(n))


def rows() -> list[tuple]:
    base = prose(120, 1)
    texts = [
        (1, base), (2, base), (3, base.replace("the", "thy", 1)), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, prose(9000, 2)), (9, "Repeat me now please ok " * 12), (10, "a\nb\na\n\nB\n"),
        (11, "é 漢字 😀 naïve façade\x0bx\x0cy"), (12, "x" * 60_000), (13, base), (13, base), (None, prose(30, 5)), (None, None), (None, prose(30, 5)), (14, "a@b.c +1 (980) 555-6268 4111 1111 1111 1111 10.0.0.1"),
        *[(20 + i, prose(40 + i, 20 + i)) for i in range(30)],
    ]
    return [(i, t, "en", "s", None, 7, "x", "y", 1, "r", "l", 3, "b", "t") for i, t in texts]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
