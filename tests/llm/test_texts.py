"""Sharding, extraction, personal data, decontamination and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import decontam, extract, pii, sharding
from sparkloom.llm.packing import word_ids
from sparkloom.llm.queries import vocabulary

from .fixtures import docs, empty, prose


def test_shards(spark):
    d = docs(spark)
    got = sharding.shards(d, vocabulary("word_bpe_49k.json"), count=4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in d.collect())
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert sharding.shards(empty(spark), vocabulary("word_bpe_49k.json")).count() == 0


def test_hot_group_is_split_and_bytes_are_even(spark):
    rows = [(i, "hot copy " * 20) for i in range(3000)] + [(None, "hot copy " * 20) for _ in range(500)] + [(5000 + i, prose(5 + i % 90, i)) for i in range(3000)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("word_bpe_49k.json"), lane_rows=500).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 16 and size.max() - size.min() < 0.005 * size.mean()
    assert got[got.doc_id >= 5000].groupby("text_crc32").shard.nunique().max() == 1  # small groups stay together
    assert got[got.doc_id < 3000].shard.nunique() > 4


@pytest.mark.parametrize("lane_rows", [20_000, 2000])
def test_bytes_tokens_and_rows_are_even_together(spark, lane_rows):
    ids = word_ids(vocabulary("word_bpe_49k.json")).ids
    rows = [(i, prose(3 + i * 7 % 110, i) + "!?" * (i % 9)) for i in range(6000)] + [(6000 + i, "9 8 7 6 5 " * 30) for i in range(700)] + [(6700 + i, prose(1500, i)) for i in range(40)]
    tokens = {i: len(ids(t)) // 4 for i, t in rows}
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("word_bpe_49k.json"), lane_rows=lane_rows).toPandas()
    sums = got.assign(tokens=got.doc_id.map(tokens), rows=1).groupby("shard")[["size", "tokens", "rows"]].sum()
    assert len(got) == len(rows) and len(sums) == 16
    spread = (sums.max() - sums.min()) / sums.mean()
    assert spread["size"] < 0.005 and spread["tokens"] < 0.01 and spread["rows"] < 0.01 + 2 / sums["rows"].mean(), spread


def test_swaps_never_make_it_worse():
    for seed in range(10):
        r = np.random.default_rng(seed)
        v = r.lognormal(size=(300, 3)) * [1, 1, 0] + [0, 0, 1]
        v /= v.sum(axis=0)
        residual = np.full((6, 3), 1 / 6)
        bins = sharding.place(v, residual)
        before = ((residual * sharding.SWAP_WEIGHTS) ** 2).sum()
        sharding.even_out(v, bins, residual)
        assert ((residual * sharding.SWAP_WEIGHTS) ** 2).sum() <= before
        assert np.allclose(residual, 1 / 6 - np.stack([v[bins == b].sum(axis=0) for b in range(6)]))
    alone, residual = np.zeros(1, np.int64), np.array([[-0.5] * 3, [0.5] * 3])
    sharding.even_out(np.ones((1, 3)), alone, residual)
    assert alone.tolist() == [0]  # no better place for one item


def plain_place(vectors, residual):
    """Brute force: try every shard for each group in turn."""
    out = []
    for v in vectors:
        best, found = None, None
        for b in range(len(residual)):
            if all(residual[b][d] >= v[d] for d in range(3)):
                dot = sum(residual[b][d] * v[d] * sharding.WEIGHTS[d] for d in range(3))
                if best is None or dot > best + 1e-15:
                    best, found = dot, b
        if found is None:
            found = max(range(len(residual)), key=lambda b: (sum(residual[b][d] * v[d] * sharding.WEIGHTS[d] for d in range(3)), -b))
        residual[found] = [residual[found][d] - v[d] for d in range(3)]
        out.append(found)
    return out


@pytest.mark.parametrize("seed", range(10))
def test_placing_against_brute_force(seed):
    r = np.random.default_rng(seed)
    v = r.random((60, 3)) * 0.05
    residual = r.random((5, 3)) * 0.6
    assert sharding.place(v, residual.copy()).tolist() == plain_place(v.tolist(), residual.tolist())


def test_placing_takes_the_highest_dot_product():
    residual = np.array([[0.5, 0.1, 0.5], [0.4, 0.4, 0.4], [0.9, 0.9, 0.0]])
    assert sharding.place(np.array([[0.2, 0.2, 0.2]]), residual.copy()).tolist() == [1]
    assert sharding.place(np.array([[0.6, 0.6, 0.6]]), residual.copy()).tolist() == [2]  # none fits: highest of all


PAGES = [
    ("<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One  two<br>three words here.</p><p>x</p></article><footer>f</footer></body></html>", "A & B\n\nOne two three words here.\n\nx"),
    ("<body><header>Site</header><div class='cookie-notice'>We use cookies</div><div id=content><h2>H</h2><p>Hello <b>big</b> world, a real paragraph of text.<p>Second one, with enough words to read.</div><div class=comments><p>Nice post, I liked it very much indeed!</p></div><aside>ad</aside></body>", "H\n\nHello big world, a real paragraph of text.\n\nSecond one, with enough words to read."),
    ("<ul><li><a href=a>Home</a><li><a href=b>About</a></ul><p>Plain body text with several words in it.</p><form>in</form>", "Plain body text with several words in it."),
    ("<article><header><h1>Kept</h1></header><p>Text of the article goes here.</p><script>var a='<p>no</p>'</script><style>p{}</style></article>", "Kept\n\nText of the article goes here."),
    ("<nav>never closed<article><p>Hi there</p></article>", "Hi there"), ("just text", "just text"), ("", ""), ("<script>x</script>", ""), ("<p>&eacute;&#233;&#xe9;", "ééé"), ("<p>a<!-- no --> b", "a b"),
]


@pytest.mark.parametrize(("html", "want"), PAGES)
def test_main_text(html, want):
    assert extract.main_text(html) == want


def test_every_dense_region_is_kept():
    a, b, c = (" ".join(f"{w}{i} and some more plain words" for i in range(n)) + "." for w, n in (("first", 12), ("second", 8), ("third", 3)))
    menu = "<div><a href=x>Home</a> <a href=y>All</a></div>" * 4
    assert extract.main_text(f"<body>{menu}<main><article><p>{a}</p></article><article><p>{b}</p></article></main>{menu}") == f"{a}\n\n{b}"
    assert extract.main_text(f"<body>{menu}<main><article><p>{a}</p></article><section><h2>H</h2><p>{b}</p></section></main>{menu}") == f"{a}\n\nH\n\n{b}"
    assert extract.main_text(f"<body>{menu}<div><p>{c}</p></div><div><p>{a}</p><p>{a}</p><p>{b}</p></div>{menu}") == "\n\n".join((c, a, a, b))
    assert extract.main_text(f"<body>{menu}<p>{c}</p><div><p>{a}</p><p>{a}</p><p>{b}</p></div>{menu}") == "\n\n".join((c, a, a, b))


LONG = "A real paragraph of the article with quite a few plain words in it, long enough to be dense."


@pytest.mark.parametrize("name", ["social-policy", "notice-board", "related-work", "share-prices", "comment-analysis", "hiddenGems widgetFactory"])
def test_a_word_of_a_name_does_not_lose_dense_parts_of_the_article(name):
    assert extract.main_text(f"<article><p>{LONG}</p><div class='{name}'><p>{LONG}</p><p>{LONG}</p></div></article>") == "\n\n".join([LONG] * 3)


@pytest.mark.parametrize("name", ["comments", "comment-list", "ad", "adBox", "cookie-notice", "social-share", "related", "newsletter-signup wide"])
def test_names_of_other_things_are_left_out(name):
    assert extract.main_text(f"<article><p>{LONG}</p><p>{LONG}</p><div class='{name}'><p>{LONG}</p><p>Other words.</p></div></article>") == "\n\n".join([LONG] * 2)


def test_a_sparse_element_with_a_doubtful_name_goes():
    links = "".join(f"<li><a href=x{i}>L{i}</a><b></b><i></i></li>" for i in range(8))
    assert extract.main_text(f"<article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><div class='share-this-story'><ul>{links}</ul></div></article>") == "\n\n".join([LONG] * 3)


@pytest.mark.parametrize("seed", range(20))
def test_smoothing_and_clusters_against_brute_force(seed):
    r = np.random.default_rng(seed)
    x = np.r_[r.normal(1, 0.2, r.integers(1, 30)), r.normal(5, 0.5, r.integers(1, 30))]
    weight = lambda d: np.exp(-0.5 * (d / 1.5) ** 2) if abs(d) <= 5 else 0.0
    plain = [sum(weight(i - j) * x[j] for j in range(len(x))) / sum(weight(i - j) for j in range(len(x))) for i in range(len(x))]
    assert np.allclose(extract.smooth(x), plain)
    # The border is a fixed point: halfway between the means of both sides.
    t = extract.threshold(x)
    assert abs(t - (x[x > t].mean() + x[x <= t].mean()) / 2) < 1e-6 and (x > t).tolist() == [v > 3 for v in x]


def test_extract_table(spark):
    rows = [(1, "u", PAGES[0][0], "c"), (None, None, None, "c"), (2, "u", "<p>" + "word " * 50_000, "c"), (2, "u", "<p>é😀", "c")]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(((r.page_id or 0), r.n_chars) for r in got) == [(0, 0), (1, len(PAGES[0][1])), (2, 2), (2, 249_999)]
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_smoothing_and_threshold():
    assert np.allclose(extract.smooth(np.ones(9)), 1)
    assert 2 < extract.threshold(np.array([1.0, 1, 2, 9, 10, 9])) < 9


KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def base(t):
    out = []
    for k, (kind, rx) in enumerate(KINDS):
        for m in re.finditer(rx, t):
            d = re.sub(r"\D", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return [f"{KINDS[k][0]}:{s}:{e}" for s, k, e in sorted(out)]


ODD = [None, "", "a@b.c_d@e.f x@y.z.w", "1.2.3.4.5 999.1.1.1 0001.002.3.4 1.2.3.0256", "4111 1111-1111 1111 é +1 (980) 555-6268", "9" * 20_000, "a" * 20_000 + "@b.c", "é😀 a@b.co 4111111111111111.", "@@a@b@c.d", "+12 34.56(78)90-12", "5500-0000-0000-0004 5500000000000005", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7"]


def test_personal_data_against_brute_force_and_learned_contexts(spark):
    secret = [f'so Token = "{hashlib.sha1(str(i).encode()).hexdigest()}" it' for i in range(12)] + ['so token = "key-77-abc" it', "version = 2.0.1 of it", "version: 3.1 of it"]
    texts = ODD + secret + [f"mail: user{i}@x.org or" for i in range(8)] + ["mail: user-8-at-x-org or"]
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "a@b.c", "x", "y")], "doc_id long, text string, spans string, t string")
    got = {r.doc_id: r for r in pii.detect(d).collect()}
    for i, t in enumerate(texts):
        b = base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(b).encode()).hexdigest(), t
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(x.startswith(k + ":") for x in b) for k, _ in KINDS]
        assert set(b) <= set(got[i].spans.split(",")) | {""}
    at = {t: i for i, t in enumerate(texts)}
    assert got[at['so token = "key-77-abc" it']].spans == "secret:12:22"  # an identifier of a shape never seen
    assert got[at["mail: user-8-at-x-org or"]].spans == "secret:6:21"
    assert got[at["version = 2.0.1 of it"]].spans == "" and got[at["version: 3.1 of it"]].spans == ""
    assert got[None].spans == "email:0:5"
    masked = {r.doc_id: r for r in pii.mask(d).collect()}
    assert masked[at['so token = "key-77-abc" it']].text == 'so token = "<SECRET>" it'
    assert masked[ODD.index("é😀 a@b.co 4111111111111111.")].text == "é😀 <EMAIL> <CARD>." and masked[0].text is None
    assert masked[0].spans == "x" and pii.mask(d).columns == d.columns
    assert pii.detect(empty(spark)).count() == 0 and pii.mask(empty(spark)).count() == 0


def test_a_long_value_is_whole(spark):
    keys = [("0123456789abcdef" * 400)[: 5000 - i] for i in range(5)]
    nested = "x-1=" + "a1=" * 300 + "z"  # every label inside sees the value to its end
    texts = [f"so token = {k} it" for k in keys] + [f'token="{keys[0]}"', nested]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.spans for r in pii.detect(d).orderBy("doc_id").collect()] == [f"secret:11:{5011 - i}" for i in range(5)] + ["secret:7:5007", ""]
    assert [r.text for r in pii.mask(d).orderBy("doc_id").collect()] == ["so token = <SECRET> it"] * 5 + ['token="<SECRET>"', nested]
    assert {c.end for c in pii._scan(d).filter("doc_id = 6").first().cues} == {len(nested)}


def test_labels_of_any_length_are_labels(spark):
    name = "very_long_label_" * 300
    texts = [f"x {name} = {hashlib.sha1(str(i).encode()).hexdigest()} it" for i in range(5)] + [f"x {name} = key-77-abc it", f"x not-{name}: key-77-abc it", "2fa_code_of_user: 1", "a" * 50_000 + "=1234"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = [r.spans for r in pii.detect(d).orderBy("doc_id").collect()]
    at = len(name) + 5
    assert spans[:7] == [f"secret:{at}:{at + 40}"] * 5 + [f"secret:{at}:{at + 10}", ""]


def test_base_spans_seed_as_a_whole_and_turns_reach_the_end(spark):
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "6011 0000 0000 0004"]
    seeds = [f"so contact: {n}@example.com it" for n in ("alice", "bob", "carol", "dave", "erin")] + [f"so phone: +1 (980) 555-62{i} it" for i in range(10, 16)] + [f"so pay: {c} it" for c in cards]
    unseen = ["so contact: mallory it", "so phone: reception it", "so pay: DE89 3704 0044 0532 0130 00 it", "so note: nothing it", "so pay: AB12 1.2.3.4 it"]
    # Each label of the chain shares half of its values with the next; only the first has seeds.
    chain = [f"so k{k}: {v} it" for k in range(4) for v in [f"value-{a}-{i}" if a else f"u{i}@x.org" for a in (k, k + 1) for i in range(20)]]
    texts = seeds + unseen + chain
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.spans for r in pii.detect(d).orderBy("doc_id").collect()][len(seeds) : len(seeds) + len(unseen)]
    assert got == ["secret:12:19", "secret:10:19", "secret:8:35", "", "secret:8:12,ip:13:20"]
    assert [r.text for r in pii.mask(d).orderBy("doc_id").collect()][len(seeds) + 2] == "so pay: <SECRET> it"
    assert {f"k{k}:" for k in range(4)} <= {r.label for r in pii.confident_patterns(pii._scan(d)).collect()}


def test_no_python_on_the_native_paths(spark):
    from sparkloom.llm import rules

    for plan in (rules.statistics(docs(spark)), pii._scan(docs(spark))):
        assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())


PASSAGE = prose(30, 77)


def hits(text, win):
    w = decontam.words(text)
    hit, items = set(), set()
    for n in {len(k) for k in win}:
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in win:
                hit.update(range(i, i + n))
                items |= win[tuple(w[i : i + n])]
    return len(w), len(hit), items


def test_decontamination_against_brute_force(spark):
    bench = [(1, PASSAGE, "c"), (2, "short item", "c"), (3, None, "c"), (4, "", "c"), (5, prose(9000, 2)[500:900], "c"), (5, PASSAGE, "c"), (None, prose(20, 78), "c"), (10, PASSAGE.upper(), "c")]
    b = spark.createDataFrame(bench, "item_id long, text string, spans string")
    d = docs(spark).unionByName(spark.createDataFrame([(100 + i, t, "", "", 0, 0, "", "", 0, "", "", 0, "", "") for i, t in enumerate([PASSAGE, "x " + PASSAGE.title().replace(" ", "-!\n") + " y", " ".join(PASSAGE.split()[:9]), " ".join(PASSAGE.split()[:10]), "a short item b", prose(20, 78) + " " + PASSAGE])], docs(spark).schema))
    win = decontam.windows([(i, t) for i, t, _ in bench], 10)
    for limits in ({}, {"block_chars": 300, "shard_words": 5}):
        got = decontam.decontaminate(d, b, **limits).collect()
        want = Counter()
        for r in d.collect():
            n, h, items = hits(r.text, win)
            want[(r.doc_id, n, h, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), h > 0)] += 1
        assert Counter(tuple(r) for r in got) == want
    clean = {r.doc_id: r for r in decontam.remove(d, b).collect()}
    assert 100 not in clean and clean[104].text == "a b" and clean[101].text.split() == ["x", "y"]
    assert clean[1].text == docs(spark).filter("doc_id = 1").first().text and clean[4].text is None and clean[1].spans == "x"
    assert decontam.remove(d, b).columns == d.columns
    none = spark.createDataFrame([], b.schema)
    assert decontam.remove(d, none).count() == d.count() and decontam.decontaminate(empty(spark), b).count() == 0


def test_long_items_come_in_overlapping_pieces(spark):
    item = prose(400, 91)
    w = item.split()
    b = spark.createDataFrame([(1, item), (1, item), (2, "tiny item"), (3, " ".join(w[200:260]))], "item_id long, text string")
    texts = [" ".join(w[i : i + 10]) for i in (0, 90, 95, 99, 100, 390)] + [" ".join(w[i : i + 9]) for i in (91, 95, 99)] + ["a tiny item b", item, "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    win = decontam.windows([(1, item), (2, "tiny item"), (3, " ".join(w[200:260]))], 10)
    want = {i: (n, h, len(s)) for i, t in enumerate(texts) for n, h, s in [hits(t, win)]}
    for limits in ({}, {"piece_words": 50}, {"piece_words": 11, "block_chars": 500, "shard_words": 20}):
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.decontaminate(d, b, **limits).collect()} == want


def test_columns_of_any_name_pass_through_the_filters(spark):
    from sparkloom.llm import simhash

    names = "doc_id long, text string, n_words long, spans string, items string, new_text string, fingerprint string, _spans string"
    d = spark.createDataFrame([(1, PASSAGE + " end", 5, "s", "i", "n", "f", "t"), (2, "a@b.co and more", 6, "s", "i", "n", "f", "t"), (None, "x", 7, "s", "i", "n", "f", "t")], names)
    b = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    for out in (decontam.remove(d, b), simhash.first_of_each(d), pii.mask(d)):
        assert out.columns == d.columns
        assert sorted(map(str, ((r.doc_id, r.n_words, r.spans, r["items"], r.new_text, r.fingerprint, r["_spans"]) for r in out.collect()))) == sorted(map(str, ((r.doc_id, r.n_words, r.spans, r["items"], r.new_text, r.fingerprint, r["_spans"]) for r in d.collect())))
    for x in (decontam.remove(empty(spark), b), simhash.first_of_each(empty(spark))):
        assert x.count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_what_a_scan_finds(seed):
    r = np.random.default_rng(seed)
    sigma = int(r.integers(3, 40))
    text = r.integers(1, sigma, int(r.integers(1, 400)))
    index = decontam.FMIndex(text, sigma, 4)
    for n in (1, 2, 4):
        phrases = r.integers(1, sigma, (25, n))
        lo, hi = index.search(phrases)
        for p, a, z in zip(phrases, lo, hi, strict=True):
            found = sorted(index.locate(np.arange(a, z)).tolist())
            assert found == [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]


def test_wavelet_ranks():
    v = np.random.default_rng(1).integers(0, 13, 300)
    w = decontam.Wavelet(v, 13)
    at = np.arange(301)
    for s in range(13):
        assert (w.rank(np.full(301, s), at) == np.r_[0, np.cumsum(v == s)]).all()
    value, rank = w.access(np.arange(300))
    assert (value == v).all() and all(rank[i] == (v[:i] == v[i]).sum() for i in range(300))


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline
    from sparkloom.llm.queries import QUERIES

    toxic = " ".join(["you are an idiot and trash."] * 3)
    d = docs(spark)
    more = [(200, toxic, "en", "s", 0, 0, "", "", 0, "", "", 0, "", ""), (201, PASSAGE + " ends", "en", "s", 0, 0, "", "", 0, "", "", 0, "", ""), (202, "write to a@b.co today", "en", "s", 0, 0, "", "", 0, "", "", 0, "", "")]
    d.unionByName(spark.createDataFrame(more, d.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (200, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs_now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs_now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs_now = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs_now.columns == d.columns
        now = {r.doc_id: r.text for r in docs_now.collect()}
        assert 200 not in now and 1 in now
        assert (2 in now) == (k < 1)
        assert now[201] == (PASSAGE + " ends" if k < 2 else "ends")
        assert now[202] == ("write to a@b.co today" if k < 3 else "write to <EMAIL> today")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs_now, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(now)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(QUERIES) == 13


def test_pipeline_runs_on_odd_and_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    lab, bench = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), spark.createDataFrame([(1, PASSAGE), (None, None)], "item_id long, text string")
    for name, d in (("odd", docs(spark)), ("empty", empty(spark))):
        for table, rows in (("documents", d), ("labels", lab.limit(0) if name == "empty" else lab), ("benchmark", bench.limit(0) if name == "empty" else bench)):
            rows.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert ({r.doc_id for r in got} >= {1, 4, 8, 12, 20}) if name == "odd" else got == []


def test_texts_full_of_matches_take_time_in_proportion(spark):
    import time

    dotted = "a@b" + ".cd" * 1_000_000
    many = "".join(f"mail: u{i}@ex.com token = k{i:07d}z " for i in range(40_000))
    rows = [(1, dotted), (2, "x@y.z " * 200_000), (3, many)]
    began = time.time()
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 120
    assert (got[1].n_email, got[1].spans) == (1, f"email:0:{len(dotted)}")
    assert got[2].n_email == 200_000 and got[2].spans.endswith("email:1199994:1199999")
    assert got[3].n_email == 40_000
    for r in rows[:2]:
        found = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r[1])]
        assert got[r[0]].spans == ",".join(f"email:{a}:{b}" for a, b in found)
    masked = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert masked[1] == "<EMAIL>" and masked[2] == "<EMAIL> " * 200_000
    assert masked[3].startswith("mail: <EMAIL> token = ") and "@" not in masked[3]


@pytest.mark.parametrize("page", ["<div>some words here " * 50_000, "<td><ul>" + "<b>" * 50_000 + "<td>x</td>" * 50_000, "<p>" + "<span>deep words " * 60_000, "<div class='ad box'>" * 40_000 + "text " * 40_000])
def test_a_megabyte_of_nested_elements_takes_seconds(page):
    import time

    began = time.time()
    text = extract.main_text(page)
    assert time.time() - began < 20 and isinstance(text, str)
    if page.startswith("<div>"):
        assert text.count("some words here") > 40_000


def test_long_benchmark_words_and_shared_phrases(spark):
    """Words of any length are found whole, in blocks of any size; a digest standing in a text is no word it stands for."""
    import hashlib

    long = ["x" * 30_000 + str(i) for i in range(40)]
    item = " ".join(long)
    same = " ".join(f"w{i}" for i in range(10))
    benchmark = spark.createDataFrame([("a", item), *[(f"s{i}", same) for i in range(300)], ("n", None)], "item_id string, text string")
    digests = " ".join(hashlib.sha256(x.encode()).hexdigest() for x in long)
    texts = [item, f"before {' '.join(long[5:20]).upper()} after", digests, f"{same} and " * 200, " ".join(long[:9]), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block_chars in (4_000_000, 500):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.decontaminate(docs, benchmark, block_chars=block_chars).collect()}
        assert got == {0: (40, 40, 1), 1: (17, 15, 1), 2: (40, 0, 0), 3: (2200, 2000, 300), 4: (9, 0, 0), 5: (0, 0, 0)}


def test_a_row_meets_one_python_worker_where_passages_are_cut_and_rows_without_an_id_are_kept(spark):
    from sparkloom.llm import simhash

    cut = decontam.remove(docs(spark), spark.createDataFrame([(1, prose(30, 2))], "item_id long, text string"))
    wanted = spark.createDataFrame([("0" * 16,)], "fingerprint string")
    for df in (cut, simhash._anonymous(docs(spark), wanted, 5)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall("MapInArrow|MapInPandas|ArrowEvalPython", plan)) == 1
