"""The audit against a plain loop over all documents and orders, whatever the order of files."""

import re
from collections import Counter
from itertools import permutations

import pytest

from sparkloom.llm import filters
from sparkloom.llm.queries import OP12_SQL

from .fixtures import docs, prose

SCHEMA = "doc_id long, text string, lang string, extra string"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    low = {}
    for r in rows:
        if r.doc_id is not None:
            low[r.text or ""] = min(low.get(r.text or "", r.doc_id), r.doc_id)
    by = {}
    for r in rows:
        t = r.text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": r.doc_id is not None and r.doc_id > low[t]}
        by.setdefault(r.lang or "", []).append(({f for f in fails if fails[f]}, r.doc_id in good, r.doc_id in toxic))
    out, shapley = [], Counter()
    for part, held in by.items():
        for o in permutations("ABCDE"):
            left = held
            for i, f in enumerate(o):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[part, f] += len(gone)
                out.append([part, "".join(o), i + 1, len(left), len(gone), sum(f in x[0] for x in held) - len(gone), sum(x[0] == {f} for x in held), sum(x[1] for x in gone), sum(x[2] for x in gone)])
    return sorted((*x, shapley[x[0], x[1][x[2] - 1]]) for x in out)


def written(df, path, files):
    df.repartition(files).write.parquet(path)
    return path


def result(spark, path, labels, n):
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in filters.audit(spark, path, lab, n).select(*COLUMNS).collect())


LABELS = [(1, 1, 0), (2, 0, 1), (3, None, 1), (3, 1, None), (13, 1, 1), (None, 1, 1), (25, 1, 0), (500, 1, 1), *[(i, i % 2, i % 3 == 0) for i in range(100, 140)]]
LABELS = [(i, q, None if t is None else int(t)) for i, q, t in LABELS]


@pytest.mark.parametrize("files_a_batch", [1, 3, None])
def test_any_batches_give_the_plain_result(spark, tmp_path, files_a_batch):
    rows = [(r.doc_id, r.text, r.lang, "x") for r in docs(spark).collect()]
    hot = prose(250, 9)
    rows += [(100 + i, hot, ["en", "de", None, ""][i % 4], "x") for i in range(60)] + [(i, hot, "fr", "x") for i in (99, 98, 97)] + [(None, hot, "en", "x"), (97, hot, "de", "x")]
    rows += [(200 + i, prose(300, i) + (" #" if i % 2 else "") + " ABC" * i * 3, "en", "x") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(spark, written(df, str(tmp_path / "d"), 7), LABELS, files_a_batch) == brute(df.collect(), LABELS)


def test_a_smaller_id_takes_back_what_was_counted(spark, tmp_path):
    path = str(tmp_path / "d")
    text = prose(250, 4)
    rows = []
    for i in (9, 7, 8, 3, 3, 5):  # one file a batch, in this order
        spark.createDataFrame([(i, text, f"l{i}", "x")], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        rows.append((i, text, f"l{i}", "x"))
    assert result(spark, path, [(3, 1, 1), (9, 1, 0)], 1) == brute(spark.createDataFrame(rows, SCHEMA).collect(), [(3, 1, 1), (9, 1, 0)])


def test_empty_table_and_the_sql(spark, tmp_path):
    import duckdb

    assert result(spark, written(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"), 1), LABELS, 1) == []
    df = spark.createDataFrame([(r.doc_id, r.text, r.lang, "x") for r in docs(spark).collect()], SCHEMA)
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").toPandas().astype("Int64"))
    con.execute("SELECT 1")
    got = sorted(tuple(r) for r in con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP12_SQL})").fetchall())
    assert got == brute(df.collect(), LABELS)
