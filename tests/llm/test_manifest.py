"""The manifest against a plain recursive version, for trees of all heights."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from sparkloom.llm import manifest
from sparkloom.llm.queries import OP11_SQL

from .fixtures import docs, empty


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes):
    """The top of a tree and, of each leaf, the siblings left and right on each level."""
    left, right, at = [[] for _ in nodes], [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, p in enumerate(at):
            run = p // 16 * 16
            left[leaf].append("".join(nodes[run:p]))
            right[leaf].append("".join(nodes[p + 1 : run + 16]))
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [p // 16 for p in at]
    return nodes[0], left, right


def brute(rows):
    def leaf(r, text):
        return H(field(r.doc_id), field(r.source), field(r.lang), field(r.n_chars), field(text))

    by = defaultdict(list)
    for r in rows:
        by[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, up_left, up_right = tree([trees[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        subroot, left, right = trees[s]
        for i, (_, _, h, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            a, b = left[i] + up_left[k], right[i] + up_right[k]
            x = h
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
                x = leaf(r, r.text and "".join(c.lower() if c.isascii() else c for c in r.text))
            for p, q in zip(a, b, strict=True):
                x = H(p, x, q)
            out.append((r.doc_id, h, subroot, root, H(*[p + q for p, q in zip(a, b, strict=True)]), x, x == root))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in manifest.manifest(df).collect()), key=str)


def table(spark, sizes):
    rows = []
    for s, n in sizes.items():
        rows += [(len(rows) + i if i % 7 else 1000 * len(rows) + i, f"Text {s} {i}" if i % 11 else None, None if i % 5 == 0 else "en", s, None if i % 3 == 0 else i) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 2, "": 1}, {"b": 16, "a": 17}, {"x": 255, "y": 256, "é": 257, "Z": 33}, {"big": 5000, None: 300, "one": 1}, {f"s{i}": 2 for i in range(300)}])
def test_all_heights(spark, sizes):
    df = table(spark, sizes)
    assert result(df) == brute(df.collect())


def test_odd_rows_and_empty_table(spark):
    df = docs(spark)
    assert result(df) == brute(df.collect())
    assert result(empty(spark)) == []


def test_one_document_repeated_is_cut_like_any_other(spark):
    row = (7, "Same", "en", "s", 4)
    df = spark.createDataFrame([row] * 700 + [(None, None, None, None, None)] * 300, "doc_id long, text string, lang string, source string, n_chars long")
    assert result(df) == brute(df.collect())


def test_tampering_shows_and_the_sql_agrees(spark):
    import duckdb

    df = table(spark, {"p": 400, "q": 20, None: 3})
    got = result(df)
    assert got == brute(df.collect())
    assert any(not r[6] for r in got) and any(r[6] for r in got)
    documents = df.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted((tuple(r) for r in con.execute(OP11_SQL).fetchall()), key=str) == got
