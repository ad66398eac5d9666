import random
import tracemalloc

import numpy as np
import pandas as pd
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import simhash

from .fixtures import docs, empty


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_hash_is_the_jvm_s(spark):
    assert spark.sql("select hex(xxhash64('a b c dé')) h").first().h == f"{xxhash.xxh64_intdigest('a b c dé'.encode(), 42):X}"


def test_against_brute_force(spark):
    rows = docs(spark).select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    root = brute(fps)
    want = {}
    for r, g in zip(rows, root, strict=True):
        if r.doc_id is not None:
            want[g] = min(want.get(g, r.doc_id), r.doc_id)
    expect = sorted((str(r.doc_id), f"{f:016x}", str(want.get(g))) for r, f, g in zip(rows, fps, root, strict=True))
    for block in (2048, 2):
        got = simhash.near_duplicates(docs(spark), block=block).collect()
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expect


def test_finer_ranges_find_the_same_links(spark):
    r = np.random.default_rng(8)
    centres = r.integers(0, 2**63, 12, dtype=np.uint64)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in set(r.integers(0, 64, k).tolist())) for c in centres for k in (0, 1, 2, 3, 4, 4, 5, 6)})
    want = {f: fps[g] for f, g in zip(fps, brute(fps), strict=True)}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for shared in (1, 2, 3):
        roots = {r.node % 2**64: r.root for r in simhash.components(simhash.links(df, shared=shared)).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(roots.get(f, f), set()).add(f)
        expect = {}
        for f in fps:
            expect.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_ranges_grow_with_the_number_of_fingerprints():
    assert simhash._ranges(10**5, 4, 2048) == (5, 1) and simhash._ranges(10**9, 4, 2048) == (6, 2) and simhash._ranges(10**11, 4, 2048) == (7, 3)


def test_a_chain_of_hundreds_is_one_component(spark):
    n = 400
    got = simhash.components(spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")).collect()
    assert len(got) == n + 1 and {r.root for r in got} == {0}


def test_first_of_each_keeps_one_and_all_columns(spark):
    d = docs(spark)
    kept = simhash.first_of_each(d)
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 13 not in ids and 4 in ids and 5 not in ids
    assert ids.count(None) == 1 and len(ids) == len(set(ids))
    assert simhash.first_of_each(empty(spark)).count() == 0


def test_chains_reach_across_files(spark):
    # A chain whose neighbours differ by 4 bits: one component, although its ends are far apart.
    chain = [0]
    for i in range(12):
        chain.append(chain[-1] ^ (0b1111 << (4 * i)))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in chain], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    assert len(roots) == 13 and len(set(roots.values())) == 1


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 7), st.integers(1, 150))
def test_bit_slices_find_all_close_pairs(seed, radius, n):
    r = np.random.default_rng(seed)
    centre = r.integers(0, 2**63, dtype=np.uint64)
    fp = np.array([centre ^ np.uint64(sum(1 << int(b) for b in set(r.integers(0, 64, r.integers(0, 6)).tolist()))) for _ in range(n)], np.uint64)
    group = np.sort(r.integers(0, 3, n))
    side, cross = r.integers(0, 2, n), np.array([g == 1 for g in group])
    i, j = simhash.close_pairs(fp, group, side, cross, radius)
    got = {(int(a), int(b)) for a, b in zip(i, j, strict=True)}
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if group[a] == group[b] and int(fp[a] ^ fp[b]).bit_count() <= radius and (not cross[a] or side[a] != side[b])}
    assert got == want and len(i) == len(got)


def test_links_of_near_groups_take_bounded_memory():
    r = np.random.default_rng(3)
    near = lambda n: np.uint64(12345) ^ (np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64))
    # A group of 3000 in which each pair is close (4.5 million pairs) and 250 groups of 100 that have hardly any.
    pdf = pd.DataFrame({"r": 0, "k": np.r_[np.zeros(3000, int), np.repeat(np.arange(1, 251), 100)], "lo": 0, "hi": 0, "own": 0})
    pdf["fp"] = np.r_[near(3000), r.integers(0, 2**63, 25_000, dtype=np.uint64)].view(np.int64)
    tracemalloc.start()
    found = pd.concat(simhash._links(7)(iter([pdf])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All of the group hang on its first row.
    first = found[found["a"].isin(pdf["fp"][:3000])]
    assert set(first["b"]) == {pdf["fp"][0]} and set(first["a"]) | {pdf["fp"][0]} == set(pdf["fp"][:3000])
    assert peak < 100e6


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_similar_texts_are_linked_and_clean_ones_are_not(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    rows, want = [], {}
    for g in range(60):
        base = r.choices(words, k=r.randint(60, 300))
        for c in range(3):
            text = list(base)
            for _ in range(len(base) // 60 if c else 0):  # each changed word changes five shingles
                text[r.randrange(len(text))] = f"x{r.random()}"
            rows.append((len(rows), " ".join(text)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    close = [(a, b) for a in range(len(rows)) for b in range(a) if a // 3 == b // 3 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {x.doc_id: x.component_id for x in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in close) >= 0.97 * len(close) > 60
    assert all(got[i] // 3 == i // 3 for i in got)


def test_near_texts_of_odd_rows(spark):
    out = simhash.first_of_each(docs(spark), shingle=5, radius=7, similar=0.8)
    ids = [x.doc_id for x in out.collect()]
    assert out.columns == docs(spark).columns and {1, 4, 8, 12} <= set(ids) and not {2, 3, 5, 6, 13} & set(ids)
    assert simhash.first_of_each(empty(spark), shingle=5, radius=7, similar=0.8).count() == 0


def test_sketches_agree_as_often_as_minima(spark):
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**63, 300, dtype=np.uint64) for _ in range(6)]
    sets += [np.r_[s[:200], rng.integers(0, 2**63, 20, dtype=np.uint64)] for s in sets]
    least = [simhash.minima(s) for s in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    rows = spark.createDataFrame([(i, j, simhash.sketch(least[i]), simhash.sketch(least[j])) for i, j in pairs], "i int, j int, x array<long>, y array<long>")
    nibble = lambda v: (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)
    for r in rows.select("i", "j", simhash.agreeing(F.col("x"), F.col("y")).alias("n")).collect():
        assert r["n"] == int((nibble(least[r["i"]]) == nibble(least[r["j"]])).sum())
        if r["i"] == r["j"]:
            assert r["n"] == 60
    assert simhash.minima(np.zeros(0, np.uint64)) is None and simhash.sketch(None) == [] and simhash.band_keys(None) == []


def test_no_similar_pair_is_lost_by_sketches():
    # All pairs of one base text with edits: what is 0.8 alike agrees in enough minima, far unlike pairs do not.
    rng = np.random.default_rng(5)
    lost = far = 0
    for _ in range(400):
        base = rng.integers(0, 2**63, 400, dtype=np.uint64)
        other = base.copy()
        other[rng.permutation(400)[:44]] = rng.integers(0, 2**63, 44, dtype=np.uint64)  # a similarity of 0.8
        apart = np.r_[base[:100], rng.integers(0, 2**63, 300, dtype=np.uint64)]  # 0.14
        agree = lambda p, q: 60 - sum(bin((d | d >> 1 | d >> 2 | d >> 3) & 0x1111111111111111).count("1") for d in ((int(a) ^ int(b)) & (2**64 - 1) for a, b in zip(simhash.sketch(simhash.minima(p)), simhash.sketch(simhash.minima(q)), strict=True)))
        lost += agree(base, other) < simhash.AGREE
        far += agree(base, apart) >= simhash.AGREE
    assert lost == 0 and far < 4


def test_no_pair_of_similar_texts_is_left_out(spark):
    # Pairs of a similarity of just over 0.8, of which bands of minima miss some, over one passage that many texts share, and texts of unlike lengths.
    r = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(400):
        base = [f"w{r.random()}" for _ in range(r.randint(60, 200))]
        other = list(base)
        if g % 3:
            for c in range(max(1, len(base) // 50)):  # apart from each other, so that each changed word changes five shingles
                other[len(base) // 8 + 40 * c] = f"x{r.random()}"
        else:
            other = other[: -(len(other) // 6)]
        head = passage if g % 4 == 0 else []
        rows += [(2 * g, " ".join(head + base)), (2 * g + 1, " ".join(head + other))]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    close = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {x.doc_id: x.component_id for x in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(close) > 300 and not [(a, b) for a, b in close if got[a] != got[b]]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 60), st.integers(0, 12), st.integers(0, 12))
def test_similar_sets_share_a_shingle_of_their_prefixes_where_it_is_asked_for(seed, n, more, fewer):
    rng = np.random.default_rng(seed)
    p = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    q = np.unique(np.r_[rng.permutation(p)[: max(1, len(p) - fewer)], rng.integers(0, 2**63, more, dtype=np.uint64)])
    both = len(np.intersect1d(p, q))
    heavy = np.unique(rng.choice(np.r_[p, q], rng.integers(0, n + 1)))
    place = rng.permutation(len(heavy))
    a, b = (simhash.prefix(x, 0.8, heavy, place).tolist() for x in (p, q))
    if both >= 0.8 * (len(p) + len(q) - both):
        asked = -(-4 * (len(p) + len(q)) // 9) + 1 - -(-4 * max(len(p), len(q)) // 5)
        shared = [(i, b.index(x)) for i, x in enumerate(a) if x in b]
        assert len(shared) >= asked >= 1 and any(len(a) - i >= asked and len(b) - j >= asked for i, j in shared)


def test_components_of_many_edges(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(500, i) for i in range(501, 560)] + [(i, 520) for i in range(530, 560)] + [(900, 900)]
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert {x.node: x.root for x in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()} == low


def watch(monkeypatch):
    """How many rows each table that the search stores has, by name."""
    stored, rows = simhash._stored, {}

    def count(df, path):
        out = stored(df, path)
        rows.setdefault(path.rpartition("/")[2], []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "_stored", count)
    return rows


def test_texts_that_share_a_shingle_by_chance_are_not_compared(spark, monkeypatch):
    # Each two neighbours share five words, of the sort that similar texts meet by; the last two texts are similar.
    r = random.Random(5)
    new = lambda n: [f"w{r.random()}" for _ in range(n)]
    texts, last = [], new(5)
    for _ in range(60):
        mine = new(5)
        texts.append(last + new(40) + mine)
        last = mine
    texts += [x[:10] + new(1) + x[10:] for x in texts[-1:]] + [texts[0][:-2]]
    rows = watch(monkeypatch)
    got = {x.doc_id: x.component_id for x in simhash.near_texts(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(60)} | {60: 59, 61: 0}
    assert sum(rows["pairs"]) <= 2  # those whose fingerprints lie apart


def test_many_alike_texts_are_compared_in_rounds(spark, monkeypatch):
    # All pairs of a group are 0.7 to 0.9 alike: pairs of whole texts are far more than the texts.
    r = random.Random(8)
    base = [f"w{r.random()}" for _ in range(400)]
    texts = []
    for _ in range(14):
        text = list(base)
        for at in r.sample(range(10, 390, 10), 4 + len(texts) % 3):
            text[at] = f"x{r.random()}"
        texts.append(text)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    close = {(a, b) for a in range(14) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    size = sum(len(" ".join(x)) for x in texts)
    monkeypatch.setattr(simhash, "ROUND", size, raising=False)
    rows = watch(monkeypatch)
    near = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    docs = near.select("doc_id", "text").unionByName(near.limit(3))  # repeated rows change nothing
    marks = simhash._marks(docs, 5).select("t", "doc_id").distinct().collect()
    ids = {x.t: x.doc_id for x in marks}
    seen = []
    links = simhash.similar_links

    def kept(*a):
        out = links(*a)
        seen.extend((ids[x.a], ids[x.b]) for x in out.collect())
        return out

    monkeypatch.setattr(simhash, "similar_links", kept)
    monkeypatch.setattr(simhash, "links", lambda fps, *a: fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("false"))  # no two are close by fingerprint
    simhash.near_texts(docs).collect()
    assert {(max(x), min(x)) for x in seen} == close and 10 < len(close) < 91
    assert len(rows["half"]) > 2 and sum(rows["half"]) == sum(rows["pairs"]) and max(rows["half"]) <= 14 * 3


def test_heavy_shingles_come_last_however_many_there_are(spark):
    rows = [([k << 23 | k for k in range(2000)] + [5 << 40 | 7] * 60,)] * 4 + [([9 << 30 | 3000],)] * 3
    levels = simhash.heavy_levels(spark.createDataFrame(rows, "some array<long>"))
    assert levels.shape == (simhash.SLOTS,) and (np.flatnonzero(levels) == np.arange(2000)).all()
    assert levels[7] == int(8 * np.log2(240)) and (levels[np.r_[0:7, 8:2000]] == 16).all()
