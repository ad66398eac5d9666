"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns a clause's words into classes. Five transducers, composed into
one deterministic machine of a few hundred states, read the classes in turn:
reported speech, negation, target, insult and threat. Each rewrites what it hears
for the next and adds the weight of the transition it takes; the last two emit
the matched patterns. A clause's score is the weight of its path through the
composed machine. A document is scored by its matched clauses alone.
"""

from __future__ import annotations

import io
import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample

#: Fixed word lists that seed the lexicon.
INSULTS = "idiot idiots moron morons scum trash loser losers clown clowns stupid worthless pathetic disgusting imbecile dumb scumbag bastard idiota imbécil basura idiote ordure crétin abschaum dummkopf widerlich".split()
THREATS = "kill hurt destroy beat shoot stab burn strangle murder matar tuer töten".split()
TARGETS = "you your you're u ur he she they them him her those people tu usted vous ihr du sie".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't without hardly nicht kein keine ne pas jamais nunca".split()
REPORTS = "said says say saying called calls wrote writes claimed claims quoted quote asked reported dijo dit sagte".split()
FIRST = "i i'll we we'll gonna will".split()

CLAUSE = re.compile(r"[.!?;]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
QUOTES = "\"“”«»"
READ = re.compile(rf"[{QUOTES}]|{TOKEN.pattern}")
PATTERNS = ("insult", "insult_target", "insult_negated", "insult_reported", "threat", "threat_target", "threat_negated", "threat_reported")
#: Transitions that have a weight: log odds before any label; learned weights are pulled towards these.
WEIGHTS = {
    "insult": 2.0, "insult_target": 1.0, "insult_negated": -1.7, "insult_reported": -1.4,
    "threat": 0.8, "threat_target": 2.2, "threat_negated": -0.8, "threat_reported": -0.5, "threat_first": 0.5,
}
KIND = {"I": "insult", "H": "threat"}


class Transducer:
    """A deterministic transducer: (state, symbol) to (state, symbols out).

    A symbol that begins with ``+`` names a weighted transition that was taken.
    It passes through all later transducers, so that a path's weights add up.
    """

    def __init__(self, start, step, end=lambda state: ()) -> None:
        self.start, self.step, self.end = start, step, end

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads."""

        def feed(state, symbols):
            out = []
            for s in symbols:
                if s[0] == "+":
                    out.append(s)
                else:
                    state, wrote = other.step(state, s)
                    out += wrote
            return state, tuple(out)

        def step(state, symbol):
            a, wrote = self.step(state[0], symbol)
            b, out = feed(state[1], wrote)
            return (a, b), out

        def end(state):
            b, out = feed(state[1], self.end(state[0]))
            return (*out, *other.end(b))

        return Transducer((self.start, other.start), step, end)

    def compiled(self) -> Transducer:
        """The same machine with its transitions remembered, state by state, as they are met."""
        known: dict = {}
        step = self.step

        def remembered(state, symbol):
            key = (state, symbol)
            if key not in known:
                known[key] = step(state, symbol)
            return known[key]

        found = Transducer(self.start, remembered, self.end)
        found.known = known
        return found


# Symbols: C begins a clause (Ct one with a target), W a word, F first person, T target, N negation, R reporting verb,
# Q a quotation mark, I insult, H threat; the latter two gather the marks r, n and t.


def _reported(state, symbol):
    """After a reporting verb of the clause (1), or inside quotes (2) that may hold many clauses, I and H are marked r."""
    if symbol == "Q":
        return state ^ 2, ()
    if symbol[0] == "C":
        return state & 2, (symbol,)
    if symbol == "R":
        return state | 1, ("R",)
    return state, (f"{symbol}r", f"+{KIND[symbol]}_reported") if state and symbol in KIND else (symbol,)


def _negated(state, symbol):
    """Within three words after a negation, I and H are marked n."""
    if symbol == "N":
        return 3, ("N",)
    if symbol[0] == "C":
        return 0, (symbol,)
    return max(0, state - 1), (f"{symbol}n", f"+{KIND[symbol[0]]}_negated") if state and symbol[0] in KIND else (symbol,)


def _targeted(state, symbol):
    """In a clause with a target, I and H are marked t."""
    if symbol[0] == "C":
        return symbol == "Ct", ("C",)
    return state, (f"{symbol}t", f"+{KIND[symbol[0]]}_target") if state and symbol[0] in KIND else (symbol,)


def _insult(state, symbol):
    return state, ("insult" + _manner(symbol), "+insult") if symbol[0] == "I" else (symbol,)


def _threat(state, symbol):
    """A threat at a target within six words after the first person weighs more."""
    if symbol == "F":
        return 6, ()
    left = 0 if symbol[0] == "C" else max(0, state - 1)
    if symbol[0] != "H":
        return left, (symbol,) if symbol in PATTERNS else ()
    return left, ("threat" + _manner(symbol), "+threat", *(("+threat_first",) if state and "t" in symbol else ()))


def _manner(symbol: str) -> str:
    return "_reported" if "r" in symbol else "_negated" if "n" in symbol else "_target" if "t" in symbol else ""


def parts() -> list[Transducer]:
    return [Transducer(0, f) for f in (_reported, _negated, _targeted, _insult, _threat)]


def grammar() -> Transducer:
    machine, *others = parts()
    for other in others:
        machine = machine.then(other)
    return machine.compiled()


class Grammar:
    """The machine under a lexicon: exact words, and stems that begin words; ``weights`` are those of transitions."""

    def __init__(self, words: dict[str, str], stems: dict[str, str], weights: dict[str, float] | None = None) -> None:
        self.words, self.stems = words, stems
        self.weights = WEIGHTS if weights is None else weights
        self.sizes = sorted({len(s) for s in stems})
        self.machine = grammar()
        self.core = frozenset(w for w, c in words.items() if c in KIND)
        self.marks = ahocorasick.Automaton()
        for w in {*self.core, *stems} or {"\0"}:
            self.marks.add_word(w, True)
        self.marks.make_automaton()

    def suspect(self, text: str) -> bool:
        return next(self.marks.iter(text), None) is not None

    def classify(self, word: str) -> str:
        c = self.words.get(word)
        if c:
            return c
        for n in self.sizes:
            if len(word) > n and word[:n] in self.stems:
                return self.stems[word[:n]]
        return "W"

    def clauses(self, text: str) -> Iterator[list[str]]:
        """The symbols of each clause with an insult or threat, quotation marks of those between included.

        Quotes hold over clauses to the end of the line; a line's last mark counts only if another opened it.
        """
        low = text.lower()
        if not self.suspect(low):
            return
        for line in low.split("\n"):
            if not self.suspect(line):
                continue
            marks = sum(map(line.count, QUOTES))
            left = marks - marks % 2
            yield ["line"]
            ahead: list[str] = []  # quotation marks of clauses without suspects
            for clause in CLAUSE.split(line):
                here = min(left, sum(map(clause.count, QUOTES)))
                left -= here
                if not self.suspect(clause):
                    ahead += ["Q"] * here
                    continue
                read = [c for m in READ.finditer(clause) if (c := "Q" if m[0] in QUOTES else self.classify(m[0])) != "Q" or (here := here - 1) >= 0]
                yield [*ahead, "Ct" if "T" in read else "C", *read]
                ahead = []

    def paths(self, text: str) -> list[list[str]]:
        """What the machine writes for each matched clause: patterns, and the weighted transitions it took."""
        out = []
        step, state = self.machine.step, self.machine.start
        for symbols in self.clauses(text):
            if symbols == ["line"]:
                state = self.machine.start
                continue
            wrote: list[str] = []
            for s in symbols:
                state, new = step(state, s)
                wrote += new
            if wrote:
                out.append(wrote)
        return out

    def count(self, text: str) -> np.ndarray:
        """How often each pattern matches, over the clauses that hold an insult or a threat."""
        found = Counter(s for path in self.paths(text) for s in path)
        return np.array([float(found[p]) for p in PATTERNS])

    def transitions(self, text: str) -> np.ndarray:
        """How often each weighted transition is taken."""
        found = Counter(s for path in self.paths(text) for s in path)
        return np.array([float(found[f"+{p}"]) for p in WEIGHTS])

    def scores(self, text: str) -> list[float]:
        """The weight of each matched clause."""
        return [sum(self.weights[s[1:]] for s in path if s[0] == "+") for path in self.paths(text)]


def base_lexicon() -> dict[str, str]:
    out = {w: "F" for w in FIRST}
    for c, ws in (("R", REPORTS), ("N", NEGATIONS), ("T", TARGETS), ("H", THREATS), ("I", INSULTS)):
        out |= dict.fromkeys(ws, c)
    return out


def learn_lexicon(texts: list[str], y: np.ndarray, least: int = 8, odds: float = 8.0, kinds: int = 4) -> tuple[dict[str, str], dict[str, str]]:
    """Seeds, and words and stems (first 4 to 8 letters) that stand in toxic texts at least ``odds`` times as often.

    Support counts different neighbours, so that copies of one text don't teach
    a word; a stem needs ``kinds`` different words.
    """
    pos: Counter[str] = Counter()
    neg: Counter[str] = Counter()
    for t, label in zip(texts, y, strict=True):
        ws = set(TOKEN.findall(t.lower()))
        (pos if label else neg).update(ws | {w[:n] + "-" for w in ws for n in (4, 5, 6, 7, 8) if len(w) > n})
    p, n = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    able = {u for u, c in pos.items() if c >= least and (c + 0.1) / p >= odds * (neg[u] + 1) / n}
    around: dict[str, set[str]] = {u: set() for u in able}
    forms: dict[str, set[str]] = {u: set() for u in able}
    for t in (t for t, label in zip(texts, y, strict=True) if label):
        ws = TOKEN.findall(t.lower())
        for before, w in zip(["", *ws], ws, strict=False):
            for u in (w, *(w[:k] + "-" for k in (4, 5, 6, 7, 8) if len(w) > k)):
                if u in around:
                    around[u].add(before)
                    forms[u].add(w)
    words, stems = base_lexicon(), {}
    for u in sorted(able):
        if len(around[u]) < least:
            continue
        if u[-1] == "-":
            if len(forms[u]) >= kinds:
                stems[u[:-1]] = "I"
        elif u not in words:
            words[u] = "I"
    stems = {s: c for s, c in stems.items() if not any(s[:k] in stems for k in range(4, len(s)))}
    return words, stems


def _features(scores: list[float], text: str) -> list[float]:
    """What a document's matched clauses weigh: the heaviest, all together, their number, and all against the length."""
    if not scores:
        return [0.0] * 5
    heavy = math.log1p(sum(max(0.0, s) for s in scores))
    return [1.0, max(scores), heavy, math.log1p(sum(s > 1 for s in scores)), math.log1p(text.count(" ") + text.count("\n")) - heavy]


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, pull: float) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; weights are pulled towards ``prior``, the bias (last) is free."""
    z = np.c_[x, np.ones(len(x))]
    b = start = np.r_[prior, math.log((y.sum() + 1) / (len(y) - y.sum() + 9))]
    pulls = np.r_[np.full(x.shape[1], pull), 1e-3]
    loss = lambda b: np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ b)).sum() + (pulls * (b - start) ** 2).sum() / 2
    for _ in range(50 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pulls), z.T @ (p - y) + pulls * (b - start))
        size = next((h for h in (1.0, 0.5, 0.25, 0.1, 0.03, 0.01) if loss(b - h * step) < loss(b)), 0.0)
        b = b - size * step
        if size * np.abs(step).max() < 1e-6:
            break
    return b


#: What the features of a document add before any label.
PRIOR = np.array([-1.0, 1.0, 1.0, 0.5, -0.5])


def fit_model(texts: list[str], y: np.ndarray) -> dict:
    """Lexicon, weights of the transitions, and weights of the document's features, from labelled texts."""
    words, stems = learn_lexicon(texts, y) if len(texts) else (base_lexicon(), {})
    g = Grammar(words, stems)
    taken = np.array([np.log1p(g.transitions(t)) for t in texts]).reshape(-1, len(WEIGHTS))
    learned = _logistic(taken, y, np.array(list(WEIGHTS.values())), 1.0)[:-1]
    g.weights = dict(zip(WEIGHTS, learned.tolist(), strict=True))
    x = np.array([_features(g.scores(t), t) for t in texts]).reshape(-1, len(PRIOR))
    return {"words": words, "stems": stems, "transitions": g.weights, "weights": _logistic(x, y, PRIOR, 1.0)}


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> dict:
    """A model from at most ``sample`` labelled rows outside the held-out quarter; without any, seeds and prior weights."""
    import pickle

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        pdf = pd.concat(frames, ignore_index=True).sort_values("_id") if frames else pd.DataFrame({"text": [], "label": []})
        out = io.BytesIO()
        pickle.dump(fit_model(pdf["text"].tolist(), pdf["label"].to_numpy(float)), out)
        yield pd.DataFrame({"model": [out.getvalue()]})

    rows = labelled_sample(docs, labels, "toxic", sample).repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(bytes(rows[0]["model"])) if rows else fit_model([], np.zeros(0))


def scorer(model: dict):
    g, b = Grammar(model["words"], model["stems"], model["transitions"]), model["weights"]

    def run(texts: list[str]) -> np.ndarray:
        x = np.array([_features(g.scores(t), t) for t in texts]).reshape(-1, len(PRIOR))
        return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ b, -30, 30)))

    return run


def score(docs: DataFrame, model: dict, least: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted.

    A null text is empty; it gets a score too. Null ids and repeated rows stay,
    equal texts score alike, an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = scorer(shared.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "score": of(b["text"].tolist())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= least).cast("int"))


def keep_clean(docs: DataFrame, model: dict, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is under ``least``, unchanged.

    A null text is empty and clean unless empty texts score high. Null ids,
    repeated rows and all columns stay whatever their names; an empty table gives
    no rows. Only ``text`` is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = scorer(shared.value)
        for t in texts:
            yield pd.Series(of([x or "" for x in t.tolist()]))

    return docs.filter(toxic("text") < least)
