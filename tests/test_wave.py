"""Operators on long sequences, graphs, near vectors, prose, gates, budgets, seasons and circuits."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import sql
from sparkloom.operators import audits, candidates, coverage, dq, evidence, graph, joins, lineage, near, profiles, score, season, sequences, signals
from sparkloom.sources import io
from sparkloom.streaming import jobs

T0 = dt.datetime(2026, 1, 1)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_join_like_others(spark, how):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, 999)], "k int, v int").cache()
    right = spark.createDataFrame([(k, k * 10) for k in range(0, 300, 2)] + [(1, 10), (1, 11)], "k int, w int")
    want = sorted(map(str, left.join(right, ["k"], how).collect()))
    for limits in ({}, {"floor": 50}, {"floor": 0, "most": 3}, {"floor": 50, "rows_a_key": 1}):
        got = joins.hot_join(left, right, ["k"], how, **limits)
        assert sorted(map(str, got.select("k", "v", "w").collect())) == want


def test_components_of_chains_stars_and_cycles(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5002), (5002, 5000)] + [(r.randint(6000, 6100), r.randint(6000, 6100)) for _ in range(40)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()} == root


def test_lineage_of_any_depth(spark):
    n = 110
    e = spark.createDataFrame([("x", str(i), "x" if i < n - 1 else "query_spec", str(i + 1), f"v{i}") for i in range(n)], "child_kind string, child_id string, parent_kind string, parent_id string, version_tag string")
    roots = spark.createDataFrame([("x", "0")], "kind string, id string")
    assert lineage.trace(roots, e).agg(F.max("depth"), F.count("*")).first()[:] == (n, n + 1)


def test_replay_pins_the_shortest_path(spark):
    e = spark.createDataFrame([("x", "0", "x", "1", "a"), ("x", "1", "query_spec", "q", "b"), ("x", "0", "x", "2", "c"), ("x", "2", "x", "3", "d"), ("x", "3", "query_spec", "q", "e"), ("x", "3", "query_spec", "r", "f")], "child_kind string, child_id string, parent_kind string, parent_id string, version_tag string")
    plan = {p.leaf_id: (p.depth, p.pins) for p in lineage.replay_plan(spark.createDataFrame([("x", "0")], "kind string, id string"), e, "query_spec").collect()}
    assert plan == {"q": (2, "x=a>query_spec=b"), "r": (3, "x=c>x=d>query_spec=f")}


def test_places_and_last_sums_against_the_definition(spark):
    r = random.Random(1)
    rows = [(k, T0 + dt.timedelta(hours=r.randint(0, 200)), i, float(r.randint(0, 9))) for i, k in enumerate(r.choices("aab", k=400))]
    df = spark.createDataFrame(rows, "k string, ts timestamp, seq int, x double")
    p = sequences.placed(df, "k", "ts", ["seq"])
    got = {x.seq: (x.n, x.total, x.s) for x in sequences.last_sums(p, "k", "n", {"s": F.col("x")}, last=7, block=20).collect()}
    for k in "ab":
        mine = sorted((t, i, x) for key, t, i, x in rows if key == k)
        for n, (_, i, _) in enumerate(mine, 1):
            assert got[i] == (n, len(mine), sum(x for *_, x in mine[max(0, n - 7) : n]))


def test_profiles_fold_every_result_and_ask_for_probes(spark):
    r = random.Random(2)
    log = [("long", T0 + dt.timedelta(minutes=17 * i), i, r.random() < 0.7) for i in range(1500)] + [("down", T0 + dt.timedelta(days=10, minutes=i), i, i == 0) for i in range(4)] + [("old", T0, 1, True)]
    got = {x.domain: x for x in profiles.success_profiles(spark.createDataFrame(log, "domain string, ts timestamp, seq int, ok boolean"), F.lit(T0 + dt.timedelta(days=20))).collect()}
    v = None
    for *_, ok in log[:1500]:
        v = float(ok) if v is None else 0.2 * ok + 0.8 * v
    assert math.isclose(got["long"].ewma, v, abs_tol=1e-12) and got["long"].n == 1500 and not got["long"].reprobe
    assert (got["down"].failure_streak, got["down"].reprobe) == (3, True) and (got["old"].failure_streak, got["old"].reprobe) == (0, True)


def test_novelty_of_the_last_documents_and_stop(spark):
    docs = [("b", T0 + dt.timedelta(minutes=i), i, [f"e{i if i < 50 else i % 5}", "e0"], ["c"], [f"d{i}" if i < 150 else "d"]) for i in range(300)]
    got = {x.seq: x for x in profiles.recent_novelty(spark.createDataFrame(docs, "branch string, ts timestamp, seq int, entities array<string>, claims array<string>, domains array<string>")).collect()}
    assert got[0].novel_entities == 1.0 and got[0].novel_claims == 1.0 and not got[120].stop and got[299].stop
    assert math.isclose(got[149].novel_domains, 1.0) and got[299].novel_domains == 0 and got[299].novel_entities == 0


def test_near_vectors_collapse_as_all_pairs_would(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 32))
    x = np.concatenate([centres[r.integers(0, 40, 300)] + 0.12 * r.normal(size=(300, 32)), r.normal(size=(200, 32)), np.zeros((2, 32))]).astype(np.float32)
    unit = x.astype(float) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    root = list(range(len(x)))
    for i, j in zip(*np.nonzero(unit @ unit.T > 0.95), strict=True):
        a, b = root[i], root[j]
        root = [min(a, b) if v in (a, b) else v for v in root]
    items = spark.createDataFrame([(i, f"h{i}", v.tolist()) for i, v in enumerate(x)] + [(1000, "h7", x[7].tolist())], "id long, content_hash string, embedding array<float>")
    for block in (1024, 16):
        got = {v.id: (v.cluster, v.copies) for v in near.collapse(items, block=block).collect()}
        assert got == {i: (root[i], 2 if i == 7 else 1) for i in range(len(x))}
    assert near.collapse(items.limit(0)).count() == 0


def test_links_of_two_blocks_give_the_components_of_all_pairs():
    r = np.random.default_rng(9)
    x = np.concatenate([np.tile(r.normal(size=(1, 8)), (1500, 1)), r.normal(size=(30, 8))])
    order = r.permutation(len(x))
    pdf = pd.DataFrame({"id": order, "embedding": [x[i] for i in order]})
    apart = near._forest(0.95)(pdf.assign(own=pdf["id"] % 2))
    assert sorted(apart["a"]) == list(range(1, 1500)) and set(apart["b"]) == {0}
    one = near._forest(0.95)(pdf.assign(own=0))
    assert sorted(one["a"]) == list(range(1, 1500)) and set(one["b"]) == {0}


@pytest.mark.parametrize("n", [10, 10**6, 10**10])
def test_tables_meet_links_with_the_recall_asked_for(n):
    bits, tables = near._tables(n, 0.95, 1024, 0.999)
    assert 1 - (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables >= 0.999 and n / 2**bits <= 1024


def test_prose_rules(spark):
    cases = {
        '{"text": "fine", "cited_record_ids": ["a"]}': [], '{"text": " ", "score": 1}': ["forbidden:score", "text"], '{"cited_record_ids": "x"}': ["cited", "text"],
        '{"text": "t", "cited_record_ids": ["", "b"]}': ["cited_empty"], "no json": ["json"], '{"text": "t", "rank": 1}': [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id long, raw string")
    assert [r.v for r in df.orderBy("id").select(evidence.prose_violations(F.col("raw"), evidence.EXPLANATION_FORBIDDEN).alias("v")).collect()] == list(cases.values())
    got = evidence.explanation_violations(df, "id", "raw", spark.createDataFrame([("a",)], "record_id string")).collect()
    assert {(r.id, r.violation) for r in got if r.violation.startswith("unknown")} == {(3, "unknown:b")}
    assert df.filter("id = 5").select(evidence.prose_violations(F.col("raw"), evidence.RATIONALE_FORBIDDEN)).first()[0] == ["forbidden:rank"]


def test_decisions_need_arguments_and_the_manifest_they_cite(spark):
    rows = [("expand", {"niche_id": "n"}, "h", "h"), ("expand", {}, "h", "x"), ("stop", {}, None, "h"), ("ponder", {}, "h", "h"), (None, None, "h", "h"), ("synthesize", {"a": "b"}, "h", "h")]
    df = spark.createDataFrame(rows, "action string, args map<string,string>, asked string, cited string")
    need = {"expand": ["niche_id"], "stop": [], "synthesize": ["synthesis_id"], "escalate": ["reason"]}
    assert [r[0] for r in df.select(evidence.check_decisions(need, F.col("asked"), F.col("cited"))).collect()] == [[], ["cited_manifest_hash", "expand.niche_id"], ["manifest_hash"], ["action"], ["action_and_args"], ["synthesize.synthesis_id"]]


def test_explanations_may_not_change_scores(spark):
    s = "opportunity_id string, score double, confidence double, subscores struct<a:double>, scored_from array<string>, provenance struct<v:string>"
    o = spark.createDataFrame([(i, 0.7, 0.6, (0.1,), ["s"], ("1",)) for i in "abcd"], s)
    theirs = spark.createDataFrame([("a", 0.7, 0.6, (0.1,), ["s"], ("1",), "ok"), ("b", 0.8, 0.6, (0.1,), ["s"], ("2",), "up"), ("c", 0.7, None, (0.2,), ["s"], ("1",), "x")], s + ", explanation string")
    got = {r.opportunity_id: r for r in score.attach_explanations(o, theirs).collect()}
    assert {k: (r.explanation_status, r.changed, r.explanation) for k, r in got.items()} == {"a": ("OK", [], "ok"), "b": ("ERR_CHANGED", ["score", "provenance"], None), "c": ("ERR_CHANGED", ["confidence", "subscores"], None), "d": ("NO_EXPLANATION", [], None)}
    assert {r.score for r in got.values()} == {0.7}


def test_routes_split_and_repair_tasks_are_stable(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "id int, t string")
    good, repair = evidence.route(df, [dq.Rule("t", "error", F.length("t") > 0)], "id")
    assert [r.id for r in good.collect()] == [1] and good.columns == df.columns
    assert [(r.record_id, r.violations) for r in repair.orderBy("record_id").collect()] == [("2", ["t"]), ("3", ["t"])]
    assert repair.exceptAll(evidence.route(df.orderBy(F.desc("id")), [dq.Rule("t", "error", F.length("t") > 0)], "id")[1]).isEmpty()


def test_all_seven_gates(spark):
    rows = [("full", k, f"o{i}", f"g{i}", f"c{i % 3}", f"p{i % 2}", f"s{i % 3}") for i in range(12) for k in ("complaint", "workaround", "competitor_review", "price", "risk_review", "falsification")]
    rows += [("thin", "complaint", "o", "g", "c", "p", "s")] * 20
    got = {r.candidate_id: r for r in evidence.hard_gates(spark.createDataFrame(rows, "candidate_id string, kind string, observation_id string, independence_group string, source_class string, product string, seller string")).collect()}
    assert got["full"].promote and got["full"].failed == [] and got["full"].source_diversity == 3
    assert not got["thin"].promote and got["thin"].failed == list(evidence.GATES)


def test_rollup_shows_exemplars_and_signs(spark):
    df = spark.createDataFrame([(i, "a" if i < 9 else None, float(i % 3 - 1) if i else None) for i in range(12)], "evidence_id int, k string, sentiment double")
    got = {r.cluster: r for r in evidence.rollup(df, ["k"], most=5, exemplars=2).collect()}
    assert (got["a"].n, got["a"].negative, got["a"].neutral, got["a"].positive, got["a"].exemplars) == (9, 2, 3, 3, [0, 1]) and got[None].exemplars == [9, 10]


def test_invariants_strictly_stop_the_job(spark):
    df = spark.createDataFrame([("a", "demand", "m", 0.3, 0.3, T0, T0), ("b", "competition", "m", 0.3, 0.3, T0, None), ("c", "demand", "m", 1.2, 1.2, T0, T0)], "signal_id string, signal_type string, metric_name string, percentile double, normalized_score double, window_from timestamp, window_to timestamp")
    assert [r[0] for r in df.select(signals.invariant_violations()).collect()] == [[], ["direction", "window"], ["score"]]
    with pytest.raises(Exception, match="b: direction,window"):
        df.filter("signal_id = 'b'").select(signals.invariant_violations(strict=True)).collect()


def test_composites_need_both_parts(spark):
    df = spark.createDataFrame([("a", "listing_density", 1.0), ("a", "ad_intensity", 0.5), ("b", "listing_density", 9.0), ("c", "listing_density", 2.0), ("c", "ad_intensity", 2.0), ("a", "other", 7.0)], "niche_id string, metric_name string, value double")
    got = {r.niche_id: (r.composite and round(r.composite, 6), r.percentile, r.status) for r in signals.competition_composite(df).collect()}
    assert got == {"a": (0.8, 0.0, "OK"), "b": (None, None, "ERR_MISSING_COMPONENT"), "c": (2.0, 0.0, "OK")}


def test_equal_composites_have_places_of_their_own(spark):
    df = spark.createDataFrame([(f"n{i:02d}", m, 1.0 if i < 15 else float(i)) for i in range(21) for m in ("listing_density", "ad_intensity")], "niche_id string, metric_name string, value double")
    got = [r.percentile for r in signals.competition_composite(df).orderBy("niche_id").collect()]
    assert got == [min(max(i, 1), 19) / 20 for i in range(21)]


def test_budgets_and_limits_come_from_tables(spark):
    tasks = spark.createDataFrame([("j", "http", s) for s in ("READY", "RUNNING", "PENDING", "FAILED")] + [("j", "index", "READY")], "job_id string, lane string, state string")
    budgets = spark.createDataFrame([("j", "http", 2), ("j", "media", 1), ("k", "http", 0)], "job_id string, lane string, budget int")
    got = {(r.job_id, r.lane): (r.spent, r.reason, r.allowed) for r in audits.lane_spend(tasks, budgets).collect()}
    assert got == {("j", "http"): (2, "budget_exhausted", False), ("j", "index"): (1, "lane_not_budgeted", True), ("j", "media"): (0, "within_budget", True), ("k", "http"): (0, "budget_exhausted", False)}
    limits = spark.createDataFrame([("http", 2), ("index", 0)], "lane string, most int")
    assert {r.lane: (r.in_flight, r.reason) for r in audits.lane_in_flight(tasks, limits).collect()} == {"http": (2, "limit_reached"), "index": (1, "lane_not_gated")}


def test_retries_wait_for_open_circuits(spark):
    f = spark.createDataFrame([(i, 500, None, 1, "http", None, T0 + dt.timedelta(minutes=m), r) for i, (m, r) in enumerate([(0, "open"), (20, "open"), (0, "shut"), (0, "new")])] + [(9, 404, None, 1, "http", None, T0, "open")], "task_id int, status_code int, error_code string, attempt int, lane string, retry_after double, failed_at timestamp, route string")
    c = spark.createDataFrame([("open", "open", T0 + dt.timedelta(minutes=15)), ("shut", "closed", None)], "route string, state string, cooldown_until timestamp")
    got = {r.task_id: (r.circuit_state, r.retry_at) for r in audits.outcomes(f, circuits=c).collect()}
    assert got == {0: ("open", T0 + dt.timedelta(minutes=15)), 1: ("half_open", T0 + dt.timedelta(minutes=20, seconds=2)), 2: ("closed", T0 + dt.timedelta(seconds=2)), 3: ("closed", T0 + dt.timedelta(seconds=2)), 9: (None, None)}


def test_routes_have_their_own_cooldowns(spark):
    rows = [(r, i, T0 + dt.timedelta(seconds=i), False) for r in ("youtube:ytdlp", "other") for i in range(10)]
    got = {r.route: r.cooldown_until for r in jobs.circuit_batch(spark.createDataFrame(rows, "route string, event_id long, ts timestamp, ok boolean")).collect()}
    assert got == {"youtube:ytdlp": T0 + dt.timedelta(seconds=9 + 86_400), "other": T0 + dt.timedelta(seconds=9 + 900)}


def test_seasons_count_only_their_own_hemisphere(spark):
    cal = spark.createDataFrame([(1, "eu", "northern", "03-01", 10, 60, None), (2, "eu", "northern", "02-30", 1, 1, 1)], "season_id int, region string, hemisphere string, window_start string, purchase_lead_days int, content_lead_days int, supplier_lead_days int")
    seen = spark.createDataFrame([(1, "eu", "northern", "a"), (1, "eu", "northern", "a"), (1, "eu", "southern", "b")], "season_id int, region string, hemisphere string, source string")
    got = {r.season_id: (r.decide_by, r.n_signals, r.status) for r in season.decision_dates(cal, seen, 2027).collect()}
    assert got == {1: (dt.date(2026, 12, 31), 1, "UNCONFIRMED"), 2: (None, 0, "ERR_WINDOW")}


def test_reports_are_lines_in_order(spark):
    c = spark.createDataFrame([("k1", "T", "10.00", "reject")], "candidate_id string, title string, final_score string, score_band string")
    e = spark.createDataFrame([("k1", "supporting", 2, "b|c\nd"), ("k1", "supporting", 1, "a"), ("zz", "neutral", 3, "x")], "candidate_id string, polarity string, evidence_id int, observation string")
    lines = candidates.render(c, candidates.evidence_split(e)).orderBy("candidate_id", "section", "line").collect()
    assert [r.text for r in lines] == ["# T", "Score: 10.00 (reject)", "## Supporting evidence", "| 1 | a |", "| 2 | b/c d |", "## Contradicting evidence", "_none_", "## Neutral evidence", "_none_"]


def test_report_over_tables(spark):
    t = {"a": spark.createDataFrame([(1, 9), (1, 2), (2, None)], "k int, p int"), "b": spark.createDataFrame([(2,)], "id int")}
    got = dq.validate(t, {"a": dq.TableRules("k", ["k", "gone"], [dq.int_range("p", 0, 5)], [("p", "b", "id")], 5)})
    assert sorted((r.rule, r.row_key) for r in got.collect()) == [("duplicate_keys", "1"), ("foreign_key:p", "1"), ("foreign_key:p", "2"), ("int_range:p", "1"), ("int_range:p", "2"), ("required_columns", "gone"), ("row_floor", "a")]


def test_tier_effects_cap_and_list_gaps(spark):
    s = spark.createDataFrame([("n", k, t, c) for k, t, c in [("demand", "hostile", 0.9), ("pain", "open", 0.8), ("growth", "open", 0.9), ("competition", "hostile", 0.7), ("content", "open", 0.3)]], "niche_id string, signal_type string, tier string, confidence double")
    conf = spark.createDataFrame([("n", 0.777)], "niche_id string, confidence double")
    r = coverage.tier_effects(s, conf, ["open"], hard_required_tiers=("open", "defended", "hostile")).first()
    assert (r.hostile_dependent, r.capped_confidence) == (True, 0.5) and {g.signal_type for g in r.coverage_gaps} == {"demand", "pain", "growth", "content"}


def test_raw_pages_are_decoded(spark):
    rows = [("u1", "<p>é".encode()), ("u2", b"<META http-equiv=x charset=ISO-8859-1><p>\xe9"), ("u3", b" "), (None, b"x"), ("u4", None)]
    got = {r.url: (r.html, r.n_bytes, r.status) for r in io.html_pages(spark.createDataFrame(rows, "url string, content binary")).collect()}
    assert got["u1"] == ("<p>é", 5, "OK") and got["u2"][0].endswith("<p>é") and got["u3"][2] == "EMPTY" and got[None][2] == "NO_URL" and got["u4"][1:] == (0, "EMPTY")


def test_sql_functions_are_the_expressions(spark):
    from sparkloom.functions import expressions as X

    sql.register(spark)
    df = spark.createDataFrame([(n, k, t, T0 - dt.timedelta(days=d), v, c) for n, k, t, d, v, c in [(5, "demand", "open", 3, 0.9, 0.4), (500, "pain", "hostile", 90, 0.1, 1.7), (5, "nope", "open", 0, 0.5, None)]], "n long, k string, t string, w timestamp, v double, c double")
    got = df.select(F.expr(f"signal_confidence(n, k, t, w, timestamp '{T0}')"), X.signal_confidence(F.col("n"), F.col("k"), F.col("t"), F.col("w"), F.lit(T0)), F.expr("tier_weight(t)"), X.tier_weight(F.col("t")), F.expr("shrink_toward_neutral(v, c)"), X.shrink(F.col("v"), F.col("c"))).collect()
    for r in got:
        for a, b in zip(r[::2], r[1::2], strict=True):
            assert a == b or math.isclose(a, b, abs_tol=1e-12)


def test_audits_deal_their_rows_over_a_stated_number_of_tasks(spark):
    a = spark.createDataFrame([(1, ["x"]), (2, ["x"]), (2, ["x"]), (3, []), (None, ["x"])], "artifact_id long, derived_from array<string>")
    e = spark.createDataFrame([(1, "x"), (1, "x"), (3, "y")], "child_id long, parent_id string")
    lost = audits.orphans(a, e)
    assert lost.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r.subject or "", r.detail) for r in lost.collect()) == [("", "1"), ("2", "1"), ("2", "1")]
    assert sorted((r.subject or "", r.detail) for r in audits.inline_reference_gaps(a, e).collect()) == [("", "x"), ("2", "x"), ("2", "x")]
