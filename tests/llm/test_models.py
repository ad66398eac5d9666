"""Quality classifier, toxicity grammar, quality rules."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import quality, rules, toxicity

from .fixtures import docs, empty, prose

LABELS = "doc_id long, quality int, toxic int, text string, lang string"


def made(n=240):
    """Documents and labels: every fourth is low (symbols), every third toxic (insults)."""
    out, lab = [], []
    for i in range(n):
        r = random.Random(i)
        words = prose(60, 1000 + i).split()
        low, toxic = i % 4 == 0, i % 3 == 0
        if low:
            words = [w + r.choice(["###", "%%%", "$$$"]) for w in words]
        if toxic:
            for k in r.sample(range(60), 3):
                words[k] = r.choice(["blorgface", "idiot", "gruntle" + r.choice("abcdefgh")])
        out.append((i, " ".join(words), "en", "s", 0, 7, "x", "y", 1, "r", "l", 3, "b", "t"))
        lab.append((i, int(not low), int(toxic), "clash", "clash"))
    return out, lab


@pytest.fixture(scope="module")
def corpus(spark):
    rows, lab = made()
    d = docs(spark)
    more = spark.createDataFrame([r for r in rows if r[0] > 60], d.schema)
    return d.unionByName(more).cache(), spark.createDataFrame([x for x in lab if x[0] > 60] + [(None, 1, 1, "", ""), (61, None, None, "", "")], LABELS).cache()


def out_of(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_held_out_accuracy_and_odd_rows(spark, corpus, which):
    d, lab = corpus
    module = {"quality": quality, "toxicity": toxicity}[which]
    got = module.score(d, module.train(d, lab)).collect()
    assert len(got) == d.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.7 if which == "quality" else 0.3)) for r in got)
    assert all(r.held_out == (r.doc_id is not None and out_of(r.doc_id)) for r in got)
    truth = {x.doc_id: (x.quality if which == "quality" else x.toxic) for x in lab.collect() if x.doc_id is not None and x.quality is not None}
    test = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in test if y], [s for s, y in test if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.95


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_labels_or_rows(spark, module):
    lab = spark.createDataFrame([], LABELS)
    assert module.score(empty(spark), module.train(empty(spark), lab)).count() == 0
    assert module.score(docs(spark), module.train(docs(spark), lab)).count() == docs(spark).count()


def test_labels_of_held_out_rows_are_not_learned(spark):
    from sparkloom.llm.common import labelled_sample

    ids = list(range(200))
    d = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, 1) for i in ids], "doc_id long, quality int, toxic int")
    used = {r._id for r in labelled_sample(d, lab, "toxic", 1000).collect()}
    assert used == {i for i in ids if not out_of(i)}
    assert len(labelled_sample(d, lab, "toxic", 17).collect()) == 17


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    from sparkloom.llm.common import labelled_sample

    d = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(3, None), (3, "b"), (4, "c")], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, 1) for i in (1, 3, 4) for _ in range(3)], "doc_id long, quality int, toxic int")
    assert len(labelled_sample(d, lab, "toxic", 10).collect()) == len({1, 3, 4} - {i for i in (1, 3, 4) if out_of(i)})


def test_shapes_see_the_whole_word():
    assert quality.shape("a" * 64 + "###1") == "a#0" and quality.shape("a" * 64 + "zzz") == "a" and quality.shape("Ab1b2c#d$e%f") == "Aa0a0a#a$a%a"
    units = quality._Units()
    assert units["a" * 64 + "###1"] % quality.SHAPES != units["a" * 64 + "zzz"] % quality.SHAPES


def plain_contexts(texts):
    """Brute force: for each word and shape, the index vectors of the words around it, one by one."""
    index, units = quality.index_vectors(), quality._Units()
    sums = np.zeros((quality.WORDS + quality.SHAPES, quality.DIM + 1), np.int64)
    for t in texts:
        w = [(units[x] // quality.SHAPES, quality.WORDS + units[x] % quality.SHAPES) for x in (t or "").split()]
        for i, places in enumerate(w):
            for p in places:
                sums[p, quality.DIM] += 1
                for j in range(max(0, i - quality.WINDOW), min(len(w), i + quality.WINDOW + 1)):
                    if j != i:
                        sums[p, : quality.DIM] += index[w[j][0]] + index[w[j][1]]
    return sums


def test_context_sums_against_brute_force(spark, monkeypatch):
    texts = [r.text for r in docs(spark).collect()]
    want = plain_contexts(texts)
    assert np.allclose(quality.word_vectors(docs(spark)), quality.vectors_of(want), atol=1e-6)
    for chunk in (1, 3, 50):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        sums = np.zeros_like(want)
        for p in quality._pieces([t or "" for t in texts[:7]], quality._Units()):
            quality.context_sums(p, quality.index_vectors(), sums)
        assert (sums == plain_contexts(texts[:7])).all()


def test_pooling_against_brute_force(monkeypatch):
    table = np.random.default_rng(1).random((quality.WORDS + quality.SHAPES, quality.DIM)).astype(np.float32)
    units = quality._Units()
    texts = ["", "one", "A b1 A #x 12 " * 9, prose(300, 4)]
    monkeypatch.setattr(quality, "CHUNK", 7)
    got = quality.pooled(texts, table, units)
    for x, t in zip(got, texts, strict=True):
        w = t.split()
        if not w:
            assert not x.any()
            continue
        own = np.mean([table[units[a] // quality.SHAPES] for a in w], axis=0)
        form = np.mean([table[quality.WORDS + units[a] % quality.SHAPES] for a in w], axis=0)
        assert np.allclose(x, [*own, *form, np.log1p(len(w)), len(set(w)) / len(w), np.log1p(len(t) / len(w))], rtol=1e-4)


def test_scores_are_calibrated_by_a_temperature():
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 4))
    y = (r.random(600) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    fold = np.arange(600) % 10
    net = quality.Network.fit(x, y, fold)
    check = fold >= 8
    loss = lambda t: np.mean(np.logaddexp(0, np.where(y[check] == 1, -1, 1) * net.logit(x[check]) / t))
    assert loss(net.temperature[0]) == min(loss(t) for t in np.geomspace(0.25, 8, 41))
    assert np.allclose(net.score(x), 1 / (1 + np.exp(-net.logit(x) / net.temperature[0])))


def test_clean_documents_pass_the_filter_unchanged(spark, corpus):
    d, lab = corpus
    kept = toxicity.keep_clean(d, toxicity.train(d, lab))
    assert kept.columns == d.columns
    texts = {(r.doc_id, r.text) for r in kept.collect()}
    assert (1, docs(spark).filter("doc_id = 1").first().text) in texts and (None, None) in texts
    assert not any(t and "idiot" in t for _, t in texts)


G = toxicity.Grammar(toxicity.base_lexicon(), {})


@pytest.mark.parametrize(
    ("text", "pattern"),
    [
        ("you are an idiot", "insult_target"), ("what an idiot", "insult"), ("you are not an idiot", "insult_negated"), ('she said "idiot" loudly', "insult_reported"), ("he called it trash", "insult_reported"),
        ("i will kill you", "threat_target"), ("they kill time", "threat_target"), ("never kill", "threat_negated"), ("kill", "threat"),
    ],
)
def test_grammar(text, pattern):
    counts = dict(zip(toxicity.PATTERNS, G.count(text), strict=False))
    assert counts == {p: float(p == pattern) for p in toxicity.PATTERNS}


def test_clauses_bound_the_patterns():
    counts = dict(zip(toxicity.PATTERNS, G.count("You came. What an idiot! Not me; trash"), strict=False))
    assert counts["insult"] == 2 and counts["insult_target"] == 0 and counts["insult_negated"] == 0


def test_a_clause_of_any_length_is_counted_whole():
    text = '"' + "idiot " * 70 + '" kill ' + "x " * 9 + "not a moron, kill " + "trash " * 100 + "you scum"
    counts = dict(zip(toxicity.PATTERNS, G.count(text), strict=False))
    assert counts == dict.fromkeys(toxicity.PATTERNS, 0.0) | {"insult_reported": 70.0, "insult_negated": 1.0, "threat_negated": 1.0, "threat_target": 1.0, "insult_target": 101.0}


def test_a_clause_of_200_insults_counts_200():
    assert dict(zip(toxicity.PATTERNS, G.count("a " + "moron " * 200), strict=True))["insult"] == 200


def test_quotes_hold_over_clauses_to_the_end_of_the_line():
    count = lambda t: {p: n for p, n in zip(toxicity.PATTERNS, G.count(t), strict=True) if n}
    assert count('She said: "First thing. You are an idiot." You are trash.') == {"insult_reported": 1, "insult_target": 1}
    assert count('One "mark only. You are an idiot.') == {"insult_target": 1}
    assert count('"A. B."! "You are an idiot.\nYou are trash."') == {"insult_target": 2}
    assert count('«He came. You are trash. Bye» you scum') == {"insult_reported": 1, "insult_target": 1}


def test_first_person_threats_at_a_target_weigh_more():
    weigh = lambda t: sum(G.scores(t))
    first = toxicity.WEIGHTS["threat_first"]
    assert np.isclose(weigh("i will kill you"), weigh("they kill you") + first) and np.isclose(weigh("kill you"), weigh("they kill you"))
    assert np.isclose(weigh("i see one two three four five six that they kill you"), weigh("they kill you")) and np.isclose(weigh("i kill time"), toxicity.WEIGHTS["threat"])
    assert np.isclose(weigh("you are not an idiot"), sum(toxicity.WEIGHTS[f"insult{x}"] for x in ("", "_negated", "_target")))


def one_after_another(symbols):
    """Brute force: each transducer reads all that the one before it wrote; weights are taken out on the way."""
    weight = 0.0
    for t in toxicity.parts():
        state, out = t.start, []
        for s in symbols:
            state, wrote = t.step(state, s)
            out += [w for w in wrote if w[0] != "+"]
            weight += sum(toxicity.WEIGHTS[w[1:]] for w in wrote if w[0] == "+")
        symbols = out
    return symbols, weight


def test_the_composed_machine_does_what_the_five_do_in_turn():
    r = random.Random(4)
    machine = toxicity.grammar()
    for _ in range(400):
        symbols = r.choices(["C", "Ct", "W", "F", "T", "N", "R", "Q", "I", "H"], weights=[2, 2, 6, 2, 3, 2, 2, 2, 4, 4], k=r.randint(1, 60))
        state, out = machine.start, []
        for s in symbols:
            state, wrote = machine.step(state, s)
            out += wrote
        want, weight = one_after_another(["C", *symbols][1:])
        assert [x for x in out if x[0] != "+"] == want and np.isclose(sum(toxicity.WEIGHTS[x[1:]] for x in out if x[0] == "+"), weight)
    assert len(machine.known) <= 4 * 4 * 2 * 7 * 10  # states x symbols: memory is bounded whatever is read


def test_an_over_long_clause_is_read_in_bounded_memory():
    g = toxicity.Grammar(toxicity.base_lexicon(), {})
    r = random.Random(6)
    words = ["you", "idiot", "not", "kill", "said", '"', "i", "word", "trash"]
    counts = sum(g.count(" ".join(r.choices(words, k=5000))).sum() for _ in range(20))
    assert counts > 20_000 and len(g.machine.known) < 2300


def test_composition_feeds_one_machine_to_the_next():
    up = toxicity.Transducer(0, lambda s, x: (s, (x.upper(),)))
    twice = toxicity.Transducer(0, lambda s, x: (s + 1, (x, x)), lambda s: (str(s),))
    both = up.then(twice)
    state, out = both.start, []
    for x in "ab":
        state, wrote = both.step(state, x)
        out += wrote
    assert [*out, *both.end(state)] == ["A", "A", "B", "B", "2"]


def test_rule_statistics_against_brute_force(spark):
    rows = docs(spark).select("doc_id", "text").collect()
    got = rules.statistics(docs(spark)).collect()
    want = Counter()
    for r in rows:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        want[(r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_decision_list_learns_and_keeps_clean_rows(spark, corpus):
    d, lab = corpus
    got = {r.doc_id: r for r in rules.assess(d, lab).collect() if r.doc_id is not None}
    truth = {x.doc_id: x.quality for x in lab.collect() if x.doc_id is not None and x.quality is not None}
    assert all(got[i].kept == bool(q) for i, q in truth.items())
    assert got[9].base_failed and not got[9].kept and got[4].base_failed and got[1].kept
    assert rules.assess(empty(spark), spark.createDataFrame([], LABELS)).count() == 0


def test_rules_are_pruned_conjunctions():
    r = random.Random(2)
    rows = []
    for k in range(600):
        x = {f: r.random() for f in rules.FEATURES}
        bad = x["symbol_share"] > 0.6 and x["upper_share"] > 0.5
        rows.append(x | {"bad": bad, "fold": k % 10})
    found = rules.learn(rows)
    assert found and {t.feature for t in found[0]} == {"symbol_share", "upper_share"}
    assert rules.learn([x | {"bad": False} for x in rows]) == []


def test_a_repeated_id_is_one_row_for_the_rules(spark):
    one = " ".join(f"w{i}" for i in range(40))
    d = spark.createDataFrame([(1, one + f" {i}###") for i in range(300)] + [(3, one), (4, one + " x")], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 0, 0) for i in (1, 3, 4)], "doc_id long, quality int, toxic int")
    assert rules.train(rules.statistics(d), lab, sample=10) == []  # three rows at most: too few for a rule
    assert rules.assess(d, lab).filter("kept").count() == 302
