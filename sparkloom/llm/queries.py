"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, extract, filters, manifest, packing, pii, quality, rules, sharding, simhash, tokens, toxicity, warc
from .common import table


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; the folder is not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP3_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op9_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM v),
o AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
      FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, n)),
h AS (SELECT o.doc_id, o.i, o.n, v.item_id FROM o JOIN v ON o.p = v.p AND o.n = v.n),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
""".replace("\\\\", "\\")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def _tree_sql(leaves: str, name: str, depth: int) -> str:
    """CTEs over ``leaves`` (tree, pos, n, h), a tree of up to 16^depth leaves: {name}0 to {name}{depth}, and what stands beside each node in its run."""
    level = lambda k: f"""{name}{k} AS (SELECT tree, pos // 16 AS pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h FROM {name}{k - 1} GROUP BY tree, pos // 16, n)"""
    beside = lambda k: f"""{name}s{k} AS (SELECT tree, pos, n, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WINDOW run AS (PARTITION BY tree, pos // 16 ORDER BY pos))"""
    return ",\n".join([f"{name}0 AS (SELECT tree, pos, n, h FROM {leaves})", *map(level, range(1, depth + 1)), *map(beside, range(depth))])


def _fold_sql(start: str, name: str, depth: int, place: str, tree: str) -> str:
    """CTEs that carry ``start`` (x the node as folded, proof so far) up the levels of a tree: {name}f1 to {name}f{depth}."""
    step = lambda k: f"""{name}f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.l || f.x || s.r) ELSE f.x END AS x, CASE WHEN s.n > 1 THEN f.proof || s.l || s.r ELSE f.proof END AS proof) FROM {start if k == 0 else f"{name}f{k}"} f JOIN {name}s{k} s ON s.tree = {tree} AND s.pos = {place} // {16**k})"""
    return ",\n".join(map(step, range(depth)))


_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BYTES = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_BYTES.format(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{0}")) + ")"
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
#: Sources of up to 16^5 documents, up to 16^3 sources.
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce('+' || source, '') AS tree, {_LEAF.format("text")} AS h, {_LEAF.format(f"translate(text, {_UPPER})")} AS low, {_CRC32} AS crc FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_tree_sql("e", "t", 5)},
u AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, h, tree AS of FROM t5),
{_tree_sql("u", "v", 3)},
g AS (SELECT doc_id, e.h AS leaf, e.tree, e.pos, u.h AS subroot, u.pos AS place, CASE WHEN crc % 5 = 0 THEN low ELSE e.h END AS x, '' AS proof FROM e JOIN u ON u.of = e.tree),
{_fold_sql("g", "t", 5, "f.pos", "f.tree")},
{_fold_sql("tf5", "v", 3, "f.place", "''")}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = r.h AS verified FROM vf3, v3 r
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY x) AS low FROM t),
m AS (SELECT part, doc_id, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * (length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(x) AS INT)
    + 8 * CAST(regexp_matches(x, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > low, false) AS INT) AS mask FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS docs, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bs FROM f f1, f f2, f f3, f f4, f f5 WHERE len(list_distinct([f1.b, f2.b, f3.b, f4.b, f5.b])) = 5),
s AS (SELECT filter_order, step, bs[step] AS own, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
r AS (SELECT part, filter_order, step, own,
    coalesce(sum(docs) FILTER (mask & own = 0 AND mask & before = 0), 0) AS kept, coalesce(sum(docs) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS removed,
    coalesce(sum(docs) FILTER (mask & own <> 0 AND mask & before <> 0), 0) AS redundant, coalesce(sum(docs) FILTER (mask = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_simhash_near_dedup, op3_warc_archive, op4_quality_classifier, op5_toxicity_grammar, op6_html_extraction, op7_quality_rules, op8_pii_bootstrap, op9_vector_sharding, op10_benchmark_decontamination, op11_merkle_manifest, op12_filter_audit, op13_token_counts)}
ORACLE: dict[str, str] = {"op3_warc_archive": OP3_SQL, "op10_benchmark_decontamination": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op12_filter_audit": OP12_SQL}
