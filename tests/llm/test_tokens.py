import random

import sentencepiece

from sparkloom.llm import tokens
from sparkloom.llm.queries import vocabulary

from .fixtures import docs, empty

PATH = vocabulary("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_counts_are_the_library_s_for_odd_texts():
    v = tokens.Vocabulary(PATH)
    r = random.Random(3)
    signs = [" ", "  ", "▁", "\n", "\t", "\r", "　", " ", "​", "<s>", "</s>", "<unk>", "<0x0A>", "中文", "é", "\U0001f600", "the", "ing", "ed", "qzx", "0123", ".,", "x" * 50, ".", ",", "a,", ")", "'", "?!", "\x00", "é"]
    for _ in range(4000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 25)))
        found = v.pre_tokens(text)
        assert sum(n * k for n, k in zip(v.sizes(list(found)), found.values(), strict=True)) == len(LIBRARY.encode(text)), repr(text)


def test_stretches_of_a_long_text_do_not_matter(monkeypatch):
    v = tokens.Vocabulary(PATH)
    text = "ab  cd\n\nef▁▁ gh " * 500 + "z" * 300 + " " * 40
    whole = v.pre_tokens(text)
    for n in (1, 7, 50):
        monkeypatch.setattr(tokens, "STRETCH", n)
        assert v.pre_tokens(text) == whole


def expected(rows):
    return sorted(((r.doc_id, len((r.text or "").encode()), len(LIBRARY.encode(r.text or ""))) for r in rows), key=str)


def test_documents_equal_the_library(spark):
    d = docs(spark)
    for often in (1_000_000, 300, 5, 0):  # all, some and no pre-tokens broadcast
        out = tokens.count_tokens(d, PATH, limit=100, often=often).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in out), key=str) == expected(d.collect())
        assert all(r.over_limit == (r.n_tokens > 100) for r in out)


def test_unbroken_text_and_hot_words(spark):
    r = random.Random(5)
    rows = [(1, "中文字" * 40_000), (2, "".join(r.choices("0123456789abcdef", k=200_000)))] + [(i, "the same words " * 30) for i in range(10, 400)]
    out = tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in out), key=str) == expected(spark.createDataFrame(rows, "doc_id long, text string").collect())


def test_empty_table(spark):
    assert tokens.count_tokens(empty(spark), PATH).count() == 0
