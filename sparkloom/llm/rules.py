"""Quality rules: text statistics in Spark, and a decision list learned from labelled rows.

All statistics are built-in functions over one row's text, so nothing shuffles
before they are written once. The learner sees a bounded sample of labelled
statistics: sequential covering grows a conjunction of thresholds, prunes it on
a part it did not grow on, keeps it if it is precise, and takes what it covers
away. The list becomes an ordered ``CASE WHEN``.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5


def _without(text: Column, signs: str) -> Column:
    return F.length(F.translate(text, signs, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_upper, n_signs of each whole text.

    A null text has no words. Repeated words are those in windows of five that
    occur twice or more in the text, the first included; shorter texts have none.
    """
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    # All blanks become spaces; the pieces between single spaces are words, and empty where blanks meet.
    t = t.withColumn("pieces", F.split(F.translate("t", BLANKS[1:], " " * (len(BLANKS) - 1)), " "))
    t = t.select(
        "doc_id",
        (F.length("t") - F.size("pieces") + 1).cast("long").alias("word_chars"),
        (F.length("t") - _without(F.col("t"), "#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.length("t") - _without(F.col("t"), UPPER)).cast("long").alias("n_upper"),
        (F.length("t") - _without(F.col("t"), "!?.,;:")).cast("long").alias("n_signs"),
        F.when(F.instr("t", "\n") > 0, lines).otherwise(F.array().cast("array<string>")).alias("lines"),
        F.transform(F.filter("pieces", lambda x: x != ""), lambda x: F.xxhash64(x)).alias("w"),
    )
    t = t.select(
        *[c for c in t.columns if c not in ("lines", "w")],
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("w").cast("long").alias("n_words"),
        F.when(F.size("w") >= WINDOW, F.expr(f"transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))")).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # Only texts that repeat a window sort theirs.
    t = t.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.expr("array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))")))
    t = t.withColumn("p", F.expr("array_sort(transform(filter(transform(s, (e, j) -> struct(e.i AS i, (j > 0 AND s[j - 1].x = e.x) OR (j + 1 < size(s) AND s[j + 1].x = e.x) AS again)), e -> e.again), e -> e.i))"))
    covered = F.expr(f"aggregate(p, struct(0L AS n, cast(-{WINDOW} AS int) AS at), (a, i) -> struct(a.n + least({WINDOW}, i - a.at) AS n, i AS at), a -> a.n)")
    return t.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_upper", "n_signs")


#: Interpretable ratios of the statistics; a text without words has zeros.
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "sign_share": "n_signs / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
    "words": "cast(n_words AS double)",
}
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    border: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.border if self.above else row[self.feature] <= self.border

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.border if self.above else value <= self.border


def _borders(values: list[float], most: int) -> list[float]:
    """Borders halfway between neighbours, at most ``most``, at even ranks."""
    distinct = sorted(set(values))
    middles = [(a + b) / 2 for a, b in zip(distinct, distinct[1:], strict=False)]
    return middles if len(middles) <= most else [middles[i * len(middles) // most] for i in range(most)]


def _counts(rows: list[dict], feature: str, borders: list[float]) -> list[tuple[int, int]]:
    """For each border, the (bad, good) rows at or below it."""
    bad, good = [0] * (len(borders) + 1), [0] * (len(borders) + 1)
    for r in rows:
        at = bisect_left(borders, r[feature])
        (bad if r["bad"] else good)[at] += 1
    out, b, g = [], 0, 0
    for i in range(len(borders)):
        b, g = b + bad[i], g + good[i]
        out.append((b, g))
    return out


def _gain(bad: int, good: int, before: float) -> float:
    """FOIL's gain against the share of bad rows before the test."""
    from math import log2

    return bad * (log2((bad + 1e-9) / (bad + good)) - before) if bad else 0.0


def _grow(rows: list[dict], features: list[str], most_tests: int, most_borders: int) -> list[Test]:
    from math import log2

    tests: list[Test] = []
    while len(tests) < most_tests:
        bad = sum(r["bad"] for r in rows)
        if not bad or bad == len(rows):
            break
        before = log2(bad / len(rows))
        best: tuple[float, Test] | None = None
        for f in features:
            borders = _borders([r[f] for r in rows], most_borders)
            for border, (b, g) in zip(borders, _counts(rows, f, borders), strict=True):
                for above, (x, y) in ((False, (b, g)), (True, (bad - b, len(rows) - bad - g))):
                    gain = _gain(x, y, before)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = gain, Test(f, above, border)
        if best is None:
            break
        tests.append(best[1])
        rows = [r for r in rows if best[1].holds(r)]
    return tests


def _worth(tests: list[Test], rows: list[dict]) -> float:
    hit = [r["bad"] for r in rows if all(t.holds(r) for t in tests)]
    return (sum(hit) + 0.5) / (len(hit) + 1) if hit else 0.0


def learn(rows: list[dict], precision: float = 0.85, support: int = 5, most_rules: int = 12, most_tests: int = 4, most_borders: int = 48) -> list[list[Test]]:
    """The decision list: each rule a conjunction that marks bad rows. ``rows`` hold FEATURES and ``bad``."""
    features = list(FEATURES)
    rules: list[list[Test]] = []
    left = rows
    while len(rules) < most_rules and sum(r["bad"] for r in left) >= support:
        grow = [r for r in left if r["fold"] < 7]
        prune = [r for r in left if r["fold"] >= 7] or grow
        tests = _grow(grow, features, most_tests, most_borders)
        while len(tests) > 1:  # drop what the unseen part does not need
            worth = _worth(tests, prune)
            shorter = max(([t for t in tests if t is not x] for x in tests), key=lambda ts: _worth(ts, prune))
            if _worth(shorter, prune) < worth:
                break
            tests = shorter
        hit = [r for r in left if all(t.holds(r) for t in tests)] if tests else []
        if len(hit) < support or sum(r["bad"] for r in hit) < precision * len(hit):
            break
        rules.append(tests)
        left = [r for r in left if not all(t.holds(r) for t in tests)]
    return rules


def verdict(rules: list[list[Test]]) -> Column:
    """The list as one ordered conditional: the number of the first rule that holds, else 0."""
    out = None
    for k, tests in enumerate(rules, 1):
        both = tests[0].column()
        for t in tests[1:]:
            both = both & t.column()
        out = F.when(both, F.lit(k)) if out is None else out.when(both, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def train(stats: DataFrame, labels: DataFrame, sample: int = 20_000) -> list[list[Test]]:
    """Rules from at most ``sample`` labelled rows outside the held-out quarter; only their numbers reach the driver.

    Of rows that repeat an id one counts, that with the smallest numbers.
    """
    lab = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = lab.withColumn("h", F.xxhash64("doc_id", F.lit("rules"))).orderBy("h", "doc_id").limit(sample)
    numbers = [c for c in stats.columns if c != "doc_id"]
    one = stats.filter(f"NOT ({BASE_FAILED})").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*numbers)).alias("s")).select("doc_id", "quality", "s.*")
    rows = one.orderBy("doc_id").select(*[F.expr(e).alias(k) for k, e in FEATURES.items()], (F.col("quality") == 0).alias("bad"), F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(10)).alias("fold"))
    return learn([r.asDict() for r in rows.collect()])


def assess(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """One row per document: doc_id, n_words, the four statistics, base_failed, kept and rule (0: none).

    ``kept`` is false if base_failed, else unless a learned rule marks the row.
    Without labels no rule is learned. A null text has no words. Null ids and
    repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    stats = cut(statistics(docs))
    rule = verdict(train(stats, labels, sample))
    failed = F.expr(BASE_FAILED)
    out = stats.withColumns({"base_failed": failed, "rule": rule})
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
