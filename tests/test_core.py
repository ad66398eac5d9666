"""Operators on small frames with results worked out by hand or by the plain definition."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import expressions as X
from sparkloom.operators import audits, candidates, coverage, decide, dq, evidence, lineage, pages, score, signals
from sparkloom.plans.registry import QUERIES

AS_OF = dt.datetime(2026, 7, 21, 12)
SIGNAL = "niche_id string, signal_id string, signal_type string, tier string, normalized_score double, confidence double, observed_at timestamp, expires_at timestamp"
GOLD = [("demand", 0.72, 0.80, "open"), ("growth", 0.65, 0.55, "open"), ("pain", 0.80, 0.75, "open"), ("competition", 0.40, 0.70, "defended"), ("content", 0.68, 0.50, "hostile")]


def golden(spark, drop=(), niche="n1", change=None):
    rows = [(niche, f"sig_{k}", k, t, v, (change or {}).get(k, c), AS_OF, AS_OF + dt.timedelta(days=30)) for k, v, c, t in GOLD if k not in drop]
    return spark.createDataFrame(rows, SIGNAL)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_golden_opportunity(spark):
    ads = spark.createDataFrame([("n1", 0.35, None)], "niche_id string, ad_value double, ad_confidence double")
    r = one(score.score(golden(spark), F.lit(AS_OF), ads))
    assert (r.status, r.score, r.confidence, r.hostile_dependent, r.coverage_gaps) == ("OK", 0.72, 0.65, False, [])
    assert (r.sub_demand, r.sub_growth, r.sub_pain, r.sub_competition, r.sub_content) == (0.676, 0.583, 0.725, 0.57, 0.59)
    assert r.scored_from == [f"sig_{k}" for k in X.AXES]
    assert math.isclose(r.raw_score, 0.71889, abs_tol=1e-5) and math.isclose(r.raw_confidence, 0.64941, abs_tol=1e-5)


def test_missing_axis_is_a_status_not_a_failure(spark):
    r = one(score.score(golden(spark, drop=("content",)), F.lit(AS_OF)))
    assert (r.status, r.score) == ("ERR_NONPOSITIVE_CONFIDENCE", None) and [g.signal_type for g in r.coverage_gaps] == ["content"]
    assert one(score.score(golden(spark, drop=("pain",)), F.lit(AS_OF))).status == "BLOCKED_COVERAGE"
    low = one(score.score(golden(spark, change={"content": 0.2}), F.lit(AS_OF)))
    assert low.status == "OK" and low.coverage_gaps[0].reason == "wanted: best of all tiers, confidence 0.200 < 0.40"


def test_gate_deadline(spark):
    b = coverage.best_by_niche(golden(spark, drop=("pain",)))
    assert one(coverage.gate(b, F.lit(AS_OF), F.lit(AS_OF))).outcome == "deadline_with_gaps"
    assert one(coverage.gate(b, F.lit(AS_OF), F.lit(AS_OF + dt.timedelta(1)))).outcome == "blocked"


def test_hostile_dependence_needs_hostile_tiers(spark):
    rows = golden(spark).withColumn("tier", F.when(F.col("signal_type") == "demand", "hostile").otherwise(F.col("tier")))
    assert not one(coverage.hostile_dependence(rows)).hostile_dependent
    assert one(coverage.hostile_dependence(rows, hard_required_tiers=X.TIERS)).hostile_dependent


@pytest.mark.parametrize("seed", range(3))
def test_cohort_ranks_against_the_definition(spark, seed):
    r = random.Random(seed)
    cohorts = {f"c{n}": [float(r.randint(0, max(1, n // 3))) for _ in range(n)] for n in (1, 2, 3, 7, 40, 400)} | {"same": [2.0] * 9}
    df = spark.createDataFrame([(c, v) for c, vs in cohorts.items() for v in vs], "cohort string, value double")
    got = {(x.cohort, x.value): (x.clipped, x.pct) for x in signals.cohort_ranks(df, slices=8).collect()}
    for c, vs in cohorts.items():
        s, n = sorted(vs), len(vs)
        for v in vs:
            clip = v if n < 2 else max(s[int(0.05 * (n - 1))], min(s[int(0.95 * (n - 1))], v))
            pct = 0.5 if n == 1 else (sum(x < clip for x in vs) + (sum(x == clip for x in vs) - 1) / 2) / (n - 1)
            assert got[(c, v)][0] == clip and math.isclose(got[(c, v)][1], pct, abs_tol=1e-12)


def test_confidence_grows_with_sample_and_falls_with_age(spark):
    df = spark.createDataFrame([(n, k, t, AS_OF - dt.timedelta(days=d)) for n, k, t, d in [(5, "demand", "open", 0), (50, "demand", "open", 0), (500, "demand", "open", 0), (50, "demand", "hostile", 0), (50, "demand", "open", 90), (50, "demand", "open", -5), (5, "nope", "open", 0)]], "n int, k string, t string, w timestamp")
    c = [r[0] for r in df.select(X.signal_confidence(F.col("n"), F.col("k"), F.col("t"), F.col("w"), F.lit(AS_OF))).collect()]
    assert c[0] < c[1] == c[2] == c[5] == 1.0 and c[3] == 0.85 and c[4] < c[1] and c[6] is None


def test_best_signal_ties_go_to_the_smallest_id(spark):
    df = spark.createDataFrame([("n", "b", "demand", 0.1, 0.5), ("n", "a", "demand", 0.2, 0.5), ("n", "c", "demand", 0.3, 0.4), ("n", "z", "other", 0.3, 0.9)], "niche_id string, signal_id string, signal_type string, normalized_score double, confidence double")
    assert [(r.signal_id, r.normalized_score) for r in score.best_signals(df).collect()] == [("a", 0.2)]


def test_expiry_is_inclusive(spark):
    s = golden(spark).withColumn("expires_at", F.lit(AS_OF))
    assert {r.expired for r in decide.partition(s, F.lit(AS_OF)).collect()} == {True}
    assert {r.expired for r in decide.partition(s, F.lit(AS_OF - dt.timedelta(seconds=1))).collect()} == {False}


def test_rerank_goldens(spark):
    opp = spark.createDataFrame([("o1", "n", 0.72, [], 4, 5, 4), ("o2", "n", 0.90, [], 0, 5, 4), ("o3", "n", 0.72, [], None, None, None)], "opportunity_id string, niche_id string, score double, coverage_gaps array<string>, margin_potential int, shipping_fit int, community_reachability int").withColumn("candidate_id", F.col("opportunity_id"))
    r = {x.opportunity_id: x for x in decide.rerank(decide.profile(opp)).collect()}
    assert (r["o1"].fit_score, r["o1"].blend, r["o1"].rank) == (0.865, 0.77075, 1)
    assert (r["o3"].fit_score, r["o3"].passes, r["o2"].fit_score, r["o2"].rank) == (0.6, True, None, 3)
    a = one(decide.actions(decide.rerank(decide.profile(opp))))
    assert (a.action, a.top_id, a.derived_from) == ("synthesize", "o1", ["o1", "o3", "o2"])


def test_rubric_goldens_and_penalties(spark):
    row = lambda level, basis, ev, gate: (*[level] * 13, basis, ev, gate)
    names = list(candidates.DIMENSIONS)
    df = spark.createDataFrame([row("5", "seed_prior", "", "true"), row("3", "evidence", "", "TRUE"), row("1", "seed_prior", "e", "true"), row("6", "seed_prior", "", "true"), row("1.0", "seed_prior", "", "x")], ", ".join(f"{c} string" for c in [*names, "score_basis", "evidence_ids", "hard_gates_passed"]))
    got = candidates.score_table(df).collect()
    assert [(r.final_score, r.score_band, r.penalties, r.experiment_eligible) for r in got[:3]] == [("100.00", "priority", "", True), ("48.00", "reject", "unverified_metric", False), ("0.00", "reject", "high_safety_dependency", False)]
    assert got[3].status == "ERR_DIMENSION" and got[4].penalties == "" and got[4].final_score == "20.00"


def test_query_pack_first_wins_and_ids_are_dense(spark):
    rows = spark.createDataFrame([(i, "Camp", "tie", "f", "fan", "a") for i in range(3)] + [(3, "camp ", "tie", "g", "fan", "a")], "r long, activity string, task string, friction_family string, product_territory string, activity_id string")
    out = candidates.dedup_queries(candidates.query_pack(rows, candidates.templates(spark, [(f"t{i}", "g", "{activity} {task} " + x) for i, x in enumerate(["a", "b", "{friction_family}", "a  "])]), "US", 2026)).collect()
    assert sorted(r.query_id for r in out) == [f"query-{i:04d}" for i in range(1, len(out) + 1)] and len(out) == 4
    bad = spark.createDataFrame([(0, "t", "g", "{activity} {oops}")], "t int, template_id string, evidence_goal string, template string")
    assert {r.status for r in candidates.query_pack(rows, bad, "US", 2026).collect()} == {"ERR_PLACEHOLDER"}


def test_poison_rows_are_reported(spark):
    df = spark.createDataFrame([("s1", ["e"], "m"), ("s2", [], None)], "id string, derived_from array<string>, model_id string")
    rules = [dq.Rule("parents", "error", F.size("derived_from") > 0), dq.Rule("no_model", "error", F.col("model_id").isNull(), F.col("model_id"))]
    got = {(r.rule, r.row_key, r.detail) for r in dq.run_rules(df, "t", "id", rules).collect()}
    assert got == {("no_model", "s1", "m"), ("parents", "s2", "")}
    t = one(dq.totals([dq.run_rules(df, "t", "id", rules), dq.duplicate_keys(df, "t", "id")]))
    assert (t.errors, t.warnings, t.ok) == (2, 0, False)


def test_differences_tolerate_what_is_asked(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, None)], "k int, v double")
    b = spark.createDataFrame([(1, 0.5 + 1e-13), (2, 0.6), (4, 1.0), (3, None)], "k int, v double")
    assert {r.k for r in dq.differences(a, b, ["k"], {"v": 1e-12}).collect()} == {2, 4}


def test_trace_ends_on_cycles_and_shared_parents(spark):
    e = spark.createDataFrame([("a", "1", "b.v1", "2", "v"), ("a", "1", "b", "3", "v"), ("b", "2", "c", "4", "v"), ("b", "3", "c", "4", "v"), ("c", "4", "a", "1", "v")], "child_kind string, child_id string, parent_kind string, parent_id string, version_tag string")
    roots = spark.createDataFrame([("a", "1"), ("b", "3")], "kind string, id string")
    got = {(r.root_id, r.kind, r.id): r.depth for r in lineage.trace(roots, e).collect()}
    assert got == {("1", "a", "1"): 0, ("1", "b", "2"): 1, ("1", "b", "3"): 1, ("1", "c", "4"): 2, ("3", "b", "3"): 0, ("3", "c", "4"): 1, ("3", "a", "1"): 2, ("3", "b", "2"): 3}


def test_failures(spark):
    df = spark.createDataFrame([(403, None), (401, "NETWORK_TIMEOUT"), (429, None), (404, None), (418, None), (None, "BROWSER_CRASH"), (None, "ROBOTS_DISALLOWED"), (None, "X"), (None, None)], "s int, e string")
    got = [tuple(r.c) for r in df.select(audits.classify(F.col("s"), F.col("e")).alias("c")).collect()]
    assert [g[1] for g in got] == ["BLOCKED", "BLOCKED", "RETRY_WAIT", "FAILED", "FAILED", "RETRY_WAIT", "BLOCKED", "FAILED", "FAILED"] and got[-1][0] == "UNKNOWN_FAILURE"
    b = spark.createDataFrame([(1, "http", "X", None), (9, "browser", "X", None), (1, "none", "X", 9.0), (3, "http", "HTTP_429", 7.5)], "a int, l string, c string, r double")
    assert [r[0] for r in b.select(audits.backoff(F.col("a"), F.col("l"), F.col("c"), F.col("r"))).collect()] == [2.0, 45.0, 2.0, 7.5]


def test_fair_take_starves_no_group(spark):
    df = spark.createDataFrame([(i, "big", 0) for i in range(100)] + [(200 + i, "small", 2) for i in range(3)], "task_id int, job_id string, priority int").withColumn("lane", F.lit("x"))
    got = audits.fair_take(df, 20, {0: 8.0, 2: 1.0}, ["task_id"]).collect()
    assert len(got) == 20 and sum(r.job_id == "small" for r in got) == 2


def test_search_finds_the_nearest_and_zero_vectors_score_zero(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    for block in (1, 100):
        got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 6)) for r in evidence.cosine_top_k(v, v.filter("vec_id < 2"), 3, block).collect()}
        assert got == {(0, 1): (0, 1.0), (0, 2): (1, 1.0), (0, 3): (2, 0.0), (1, 1): (0, 1.0), (1, 2): (1, 1.0), (1, 3): (2, 0.0)}


def test_packing_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("j", 1, 5), ("j", 2, 6), ("j", 3, 1), ("k", 1, 99)], "job_id string, rank int, tokens int")
    assert {(r.job_id, r["rank"]) for r in evidence.pack_bundle(df, 10).filter("included").collect()} == {("j", 1)}


def test_page_links_and_canonical(spark):
    html = '<link rel="canonical" href="c/d"><a href="#x">a</a><a href="/r">b</a><a href="s?q">c</a><a href="//h/p">d</a><a href="mailto:a@b">e</a><a href="/r">f</a>'
    df = spark.createDataFrame([("https://WWW.Ex.com/a/b.html", html)], "u string, h string")
    r = one(df.select(pages.links(F.col("h"), F.col("u")).alias("l"), pages.canonical(F.col("h"), F.col("u")).alias("c"), pages.domain(F.col("u")).alias("d")))
    assert r.l == ["https://WWW.Ex.com/r", "https://WWW.Ex.com/a/s?q", "https://h/p", "mailto:a@b"]
    assert (r.c, r.d) == ("https://WWW.Ex.com/a/c/d", "ex.com")


def test_addresses_of_any_length_are_joined(spark):
    from sparkloom.operators import pages

    base = "https://a.org" + "/x" * 200_000
    rows = [(base + "/y.html", "z"), ("https://a.org", "z"), ("https://a.org/", "z"), ("https://a.org/p?q=/r/s", "z"), ("https://a.org/p/o#/r/s", "z"), ("https://a.org?u=/b", "z")]
    got = [r[0] for r in spark.createDataFrame(rows, "b string, h string").select(pages.absolute(F.col("h"), F.col("b"))).collect()]
    assert got == [base + "/z", "https://a.org/z", "https://a.org/z", "https://a.org/z", "https://a.org/p/z", "https://a.org/z"]


def test_a_set_hash_is_free_of_order_and_partitions(spark):
    from sparkloom.operators import keys

    of = lambda ids, n: spark.createDataFrame([(i,) for i in ids], "i string").repartition(n).agg(keys.merged_set_hash(F.col("i"))).first()[0]
    ids = [f"id{k}" for k in range(300)]
    assert of(ids, 1) == of(ids[::-1], 7) != of(ids[1:], 3)
    assert of([], 1) != of(["id0"], 1) and of(["a", "b"], 2) != of(["ab"], 1)


def test_recollection_keys_and_edges_need_no_lists(spark):
    t = lambda d: dt.datetime(2026, 1, d)
    rows = [("n1", "s1", t(2)), ("n1", "s2", t(1)), ("n1", "s2", t(1)), ("n1", "s3", t(9)), ("n2", "s4", t(9))]
    signals = spark.createDataFrame(rows, "niche_id string, signal_id string, expires_at timestamp")
    at = F.lit("2026-01-05").cast("timestamp")
    e = {r.niche_id: r for r in decide.evaluate(signals, at).collect()}
    assert [(e[n].n_active, e[n].n_expired, e[n].needs_recollection) for n in ("n1", "n2")] == [(1, 2, True), (1, 0, False)]
    again = {r.niche_id: r.expired_set for r in decide.evaluate(signals.orderBy(F.desc("signal_id")), at).collect()}
    assert again == {n: e[n].expired_set for n in e}
    tasks = decide.recollection(decide.evaluate(signals, at), spark.createDataFrame([("j", "n1", "q1"), ("j", "n2", "q2")], "job_id string, niche_id string, query_spec_id string"))
    edges = decide.recollection_edges(tasks, decide.expired_ids(signals, at)).collect()
    assert sorted((r.parent_kind, r.parent_id) for r in edges) == [("query_spec", "q1"), ("signal", "s1"), ("signal", "s2")]


def test_listed_recollection_keys_hash_the_sorted_ids_without_a_row_that_holds_them(spark):
    t = lambda d: dt.datetime(2026, 1, d)
    ids = [f"s{k}" for k in range(3000)]
    rows = [("n1", s, t(1)) for s in ids] + [("n1", "later", t(9)), ("n2", "s", t(9)), ("n3", "x", t(1)), ("n3", "x", t(1)), (None, "y", t(1)), ("n4", None, t(1))]
    signals = spark.createDataFrame(rows, "niche_id string, signal_id string, expires_at timestamp")
    queries = spark.createDataFrame([("j", f"n{n}", f"q{n}_{k}") for n in range(1, 5) for k in range(3)] + [("j", None, "q")], "job_id string, niche_id string, query_spec_id string")
    at = F.lit("2026-01-05").cast("timestamp")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {(n, f"q{n[1]}_{k}"): "idem_rec_" + sha("|".join(["recollect", *sorted(of), f"q{n[1]}_{k}"])) for n, of in (("n1", ids), ("n3", ["x", "x"])) for k in range(3)}
    made = decide.recollection_listed(signals, at, queries)
    assert {(r.niche_id, r.query_spec_id): r.idempotency_key for r in made.collect()} == want
    assert {r.task_id for r in made.collect()} == {"tsk_rec_" + sha(f"recollect|j|{q}")[:12] for _, q in want}
    assert "collect_list" not in made._jdf.queryExecution().toString()


def test_recollection_edges_are_counted_without_being_made(spark):
    t = lambda d: dt.datetime(2026, 1, d)
    signals = spark.createDataFrame([(f"n{k % 3}", f"s{k}", t(1 if k % 2 else 9)) for k in range(60)], "niche_id string, signal_id string, expires_at timestamp")
    queries = spark.createDataFrame([("j", f"n{k % 4}", f"q{k}") for k in range(20)] + [("j", "n1", "q1")], "job_id string, niche_id string, query_spec_id string")
    at = F.lit("2026-01-05").cast("timestamp")
    tasks, ids = decide.recollection(decide.evaluate(signals, at), queries), decide.expired_ids(signals, at)
    edges = decide.recollection_edges(tasks, ids).groupBy(F.col("child_id").alias("task_id"), "parent_kind").agg(F.count("*").alias("n"), F.min("parent_id").alias("first_id"), F.max("parent_id").alias("last_id"))
    counted = decide.recollection_edge_counts(tasks, ids)
    assert sorted(counted.collect()) == sorted(edges.collect())
    assert any(r.n == 20 for r in counted.collect())  # a task that is there twice


def test_fresh_evaluate_gives_the_expired_ids(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    rows = QUERIES["fresh_evaluate"](spark, d).collect()
    listed = {(r.niche_id, i) for r in rows for i in r.expired_ids.split(";") if i}
    assert listed and listed == {(r.niche_id, r.signal_id) for r in QUERIES["fresh_expired_ids"](spark, d).collect()}


def test_first_queries_are_found_by_one_number_each(spark):
    rows = [(5, 1, "a  b"), (3, 2, "A b"), (3, 0, " a b "), (9, 0, "c"), (None, 4, "c"), (7, 1, None), (8, 0, None), (3, 0, "d"), (3, 0, "D")]
    pack = spark.createDataFrame([(*r, "x", "i", "g", "s") for r in rows], "r long, t int, query string, activity_id string, template_id string, evidence_goal string, status string")
    want = {" a b ": 3, "D": 3, None: 7}
    for few in (0, 100):  # by a shuffle, by a broadcast
        made = candidates.dedup_queries(pack.filter("r IS NOT NULL AND query IS NULL OR r < 9"), few=few).collect()
        assert {r.query for r in made} == set(want) and sorted(r.query_id for r in made) == ["query-0001", "query-0002", "query-0003"]


def test_walks_move_the_edges_they_can_meet_only(spark):
    e = [("line", "l1", "order", "o1"), ("order", "o1", "customer", "c1"), ("customer", "c1", "order", "o2"), ("order", "o2", "spec", "s"), ("part", "p", "spec", "s2"), (None, "x", "spec", "s")]
    edges = spark.createDataFrame(e, "child_kind string, child_id string, parent_kind string, parent_id string")
    start = spark.createDataFrame([("order", "o1"), (None, "x")], "kind string, id string")
    assert sorted(r.child_id for r in lineage._within(edges, start).collect()) == ["c1", "o1", "o2"]
    assert lineage._within(edges, start, most=2).count() == len(e)
    found = lineage.trace(start.filter("kind IS NOT NULL"), edges).collect()
    assert sorted((r.id, r.depth) for r in found) == [("c1", 1), ("o1", 0), ("o2", 2), ("s", 3)]
