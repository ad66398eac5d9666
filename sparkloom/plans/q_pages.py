"""Queries on pages, media and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import pages as G
from sparkloom.sources import io
from sparkloom.sources.shared import cut, new_folder

from . import bindings as B
from .catalog import register


def _clean(x: str) -> str:
    u = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        u = f"replace({u}, '{name}', '{sign}')"
    return f"trim(regexp_replace({u}, '\\s+', ' ', 'g'))"


def _tag(tag: str) -> str:
    return f"nullif({_clean(f'regexp_extract(html, {chr(39)}(?is)<{tag}[^>]*>(.*?)</{tag}>{chr(39)}, 1)')}, '')"


_TITLE = f"coalesce({_tag('h1')}, {_tag('title')})"
_T = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
for _x in G.DROPPED:
    _T = f"regexp_replace({_T}, '(?is)<{_x}(?:\\s[^>]*)?>.*?</{_x}>', ' ', 'g')"
_BODY = f"array_to_string(list_filter(list_transform(string_split_regex({_T}, '{G.BLOCK}'), lambda x: {_clean('x')}), lambda x: x <> ''), chr(10) || chr(10))"
_MD = f"m AS (SELECT *, {_TITLE} AS title, {_BODY} AS body FROM pages), md AS (SELECT *, CASE WHEN title IS NULL OR body LIKE '#%' THEN body WHEN body = '' THEN '# ' || title ELSE '# ' || title || chr(10) || chr(10) || body END AS text_md FROM m)"
_DOM = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '')"
_ABS = "CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN h LIKE '//%' THEN regexp_extract(url, '^([a-zA-Z]+:)', 1) || h WHEN h LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || h ELSE CASE WHEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+(?:/[^/?#]*)*/)', 1) <> '' THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+(?:/[^/?#]*)*/)', 1) ELSE regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || '/' END || h END"
_LINKS = f"lk AS (SELECT page_id, string_agg(a, ' ' ORDER BY i) AS links FROM (SELECT page_id, a, min(i) AS i FROM (SELECT page_id, i, {_ABS} AS a FROM (SELECT page_id, url, unnest(l) AS h, generate_subscripts(l, 1) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*href=[\"'']([^\"'']*)[\"'']', 1) AS l FROM pages)) WHERE h <> '' AND h NOT LIKE '#%') GROUP BY page_id, a) GROUP BY page_id)"
_TOK = "CASE WHEN trim(regexp_replace({0}, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' ')) END"


def P(spark, d):
    return B.table(spark, d, "pages")


@register("page_domain", f"SELECT page_id, {_DOM} AS domain FROM pages")
def page_domain(spark, d):
    return P(spark, d).select("page_id", G.domain(F.col("url")).alias("domain"))


_LINKED = "concat('<link rel=\"canonical\" href=\"/c/', CAST(page_id AS VARCHAR), '\">', html)"


@register("page_canonical_url", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || '/c/' || page_id ELSE url END AS canonical_url FROM pages")
def page_canonical_url(spark, d):
    html = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<link rel="canonical" href="/c/'), F.col("page_id").cast("string"), F.lit('">'), "html")).otherwise(F.col("html"))
    return P(spark, d).withColumn("html", html).select("page_id", G.canonical(F.col("html"), F.col("url")).alias("canonical_url"))


@register("page_title", f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_title(spark, d):
    return P(spark, d).select("page_id", G.title(F.col("html")).alias("title"))


@register("page_links", f"WITH {_LINKS} SELECT page_id, links FROM lk")
def page_links(spark, d):
    return P(spark, d).select("page_id", F.array_join(G.links(F.col("html"), F.col("url")), " ").alias("links")).filter("links <> ''")


@register("page_text", f"WITH {_MD} SELECT page_id, text_md FROM md")
def page_text(spark, d):
    return P(spark, d).select("page_id", G.text_md(F.col("html")).alias("text_md"))


_CLASS = ("article", "forum_thread", "review_page", "marketplace_listing")


def _classed(spark, d):
    cls = F.element_at(F.array(*[F.lit(c) for c in _CLASS]), (F.col("page_id") % 4 + 1).cast("int"))
    more = F.concat(F.lit('<span class="byline">By '), F.col("page_id").cast("string"), F.lit('</span><div data-author="u'), F.col("page_id").cast("string"), F.lit('" data-asin="B0'), F.col("page_id").cast("string"), F.lit('">'), (F.col("page_id") % 90).cast("string"), F.lit(" replies 1,0"), (10 + F.col("page_id") % 90).cast("string"), F.lit(" ratings $"), (10 + F.col("page_id") % 90).cast("string"), F.lit(".50 "), (F.col("page_id") % 70).cast("string"), F.lit(" verified reviews</div>"))
    return P(spark, d).withColumns({"html": F.concat(more, "html"), "source_class": cls})


@register("page_author", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'By ' || page_id WHEN 1 THEN 'u' || page_id WHEN 2 THEN 'aggregate' END AS author FROM pages")
def page_author(spark, d):
    return _classed(spark, d).select("page_id", G.author(F.col("html"), F.col("source_class")).alias("author"))


@register("page_platform_fields", f"WITH {_MD} SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'source_class=article;word_count=' || {_TOK.format('text_md')} WHEN 1 THEN 'reply_count=' || page_id % 90 || ';source_class=forum_thread' WHEN 2 THEN 'review_count=' || page_id % 70 || ';source_class=review_page' ELSE 'asin=B0' || page_id || ';price_usd=' || 10 + page_id % 90 || '.50;rating_count=10' || 10 + page_id % 90 || ';source_class=marketplace_listing' END AS fields FROM md")
def page_platform_fields(spark, d):
    p = _classed(spark, d).join(P(spark, d).select("page_id", F.col("html").alias("plain")), "page_id")
    f = p.select("page_id", G.platform_fields(F.col("html"), F.col("source_class"), G.text_md(F.col("plain"))).alias("f"))
    return f.select("page_id", F.array_join(F.array_sort(F.transform(F.map_entries("f"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("fields"))


@register("page_tokens", f"SELECT doc_id, CAST({_TOK.format('text')} AS BIGINT) AS tokens FROM documents")
def page_tokens(spark, d):
    return B.table(spark, d, "documents").select("doc_id", G.tokens(F.col("text")).alias("tokens"))


@register("page_assemble", f"WITH {_MD}, {_LINKS} SELECT 'pg_' || substr(sha256(url), 1, 16) AS page_id, url, url AS canonical_url, {_DOM} AS domain, title, 'sha256:' || sha256(text_md) AS content_hash, CAST({_TOK.format('text_md')} AS BIGINT) AS token_count, coalesce(links, '') AS links, 'tsk_' || md.page_id AS derived_from FROM md LEFT JOIN lk ON lk.page_id = md.page_id")
def page_assemble(spark, d):
    p = G.assemble(P(spark, d), F.concat(F.lit("tsk_"), F.col("page_id").cast("string")))
    return p.select("page_id", "url", "canonical_url", "domain", "title", "content_hash", "token_count", F.array_join("links", " ").alias("links"), F.array_join("derived_from", ";").alias("derived_from"))


def _vtt(spark, d):
    """Conversations as captions: a cue per turn."""
    c = B.table(spark, d, "conversations")
    line = F.concat(F.col("turn").cast("string"), F.lit("\n00:01.000 --> 00:02.000\n"), F.regexp_replace("text", r"\s+", " "), F.lit(" \n"))
    return c.groupBy(F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("video_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("body")).select("video_id", F.concat(F.lit("WEBVTT\n\n"), "body").alias("vtt"))


_VTT = "vt AS (SELECT 'v' || conv_id AS video_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (t <> '') AS txt FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations) GROUP BY conv_id)"


@register("vtt_text", f"WITH {_VTT} SELECT video_id, txt AS transcript FROM vt")
def vtt_text(spark, d):
    return _vtt(spark, d).select("video_id", G.vtt_text(F.col("vtt")).alias("transcript"))


@register("src_vtt", f"WITH {_VTT} SELECT video_id, len(string_split(txt, chr(10) || chr(10))) AS cues FROM vt")
def src_vtt(spark, d):
    return _vtt(spark, d).select("video_id", F.size(F.split(G.vtt_text(F.col("vtt")), "\n\n")).cast("long").alias("cues"))


@register("media_page", f"WITH {_VTT}, md AS (SELECT video_id, '# Video ' || video_id || chr(10) || chr(10) || 'About ' || video_id || coalesce(chr(10) || chr(10) || nullif(txt, ''), '') AS text_md FROM vt) SELECT video_id, 'pg_' || substr(sha256('https://v.example/' || video_id), 1, 16) AS page_id, text_md, CAST({_TOK.format('text_md')} AS BIGINT) AS token_count FROM md")
def media_page(spark, d):
    v = _vtt(spark, d)
    meta = v.select("video_id", F.concat(F.lit("https://v.example/"), "video_id").alias("url"), F.concat(F.lit("Video "), "video_id").alias("title"), F.concat(F.lit("About "), "video_id").alias("description"))
    return G.media_page(meta, v).select("video_id", "page_id", "text_md", "token_count")


@register("query_slug", "SELECT p_partkey, regexp_replace(lower(trim(p_name || '  ' || p_type)), '\\s+', '_', 'g') AS slug FROM part")
def query_slug(spark, d):
    return B.table(spark, d, "part").select("p_partkey", G.query_slug(F.concat_ws("  ", "p_name", "p_type")).alias("slug"))


_RES = "rs AS (SELECT lower(regexp_extract(url, '/([a-z]{2})/', 1)) AS query, CASE WHEN page_id % 3 = 0 THEN 'unknown' ELSE 'e' || page_id % 3 END AS engine, CASE WHEN page_id % 10 = 9 THEN NULL ELSE url END AS url, page_id FROM pages)"


def _results(spark, d):
    """Pages as search answers by language, twenty results at most in each: nested in an array."""
    r = F.struct(F.when(F.col("page_id") % 10 != 9, F.col("url")).alias("url"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("e"), (F.col("page_id") % 3).cast("string"))).alias("engine"), "page_id")
    return P(spark, d).groupBy(F.lower(F.regexp_extract("url", "/([a-z]{2})/", 1)).alias("query"), (F.col("page_id") / 20).cast("long").alias("_answer")).agg(F.collect_list(r).alias("results")).drop("_answer")


@register("src_search_results", f"WITH {_RES} SELECT query, url, engine, page_id FROM rs WHERE url IS NOT NULL")
def src_search_results(spark, d):
    return G.search_rows(_results(spark, d))


@register("discover_urls", f"WITH {_RES}, q AS (SELECT DISTINCT 'qs_' || substr(sha256('job|' || query || '|' || engine), 1, 16) AS query_spec_id, query, engine, url FROM rs WHERE url IS NOT NULL), t AS (SELECT *, 'tsk_' || substr(sha256('job|' || query_spec_id || '|' || url), 1, 12) AS task_id FROM q) SELECT query_spec_id, query, engine, url, task_id, 'idem_' || sha256('fetch|' || query_spec_id || '|' || url) AS idempotency_key, 'query_spec' AS parent_kind, false AS again FROM t")
def discover_urls(spark, d):
    # Half of the answers, then all of them, then all once more: the stored tables, and whether the last run added anything.
    results = cut(G.search_rows(_results(spark, d)))
    known = G.Discovery(spark, f"{new_folder(spark)}/discovery")
    known.add(results.filter("page_id % 2 = 0"), F.lit("job"))
    known.add(results, F.lit("job"))
    again = known.add(results, F.lit("job")).select("idempotency_key", F.col("inserted").alias("again"))
    specs, edges = known.specs.read().select("query_spec_id", "query", "engine"), known.edges.read().select(F.col("child_id").alias("task_id"), F.col("parent_id").alias("query_spec_id"), "parent_kind")
    tasks = known.tasks.read().join(specs, "query_spec_id").join(edges, ["task_id", "query_spec_id"]).join(again, "idempotency_key")
    return tasks.select("query_spec_id", "query", "engine", "url", "task_id", "idempotency_key", "parent_kind", "again")


@register("est_tokens", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def est_tokens(spark, d):
    return B.table(spark, d, "documents").select("doc_id", G.est_tokens(F.col("text")).alias("tokens"))


@register("src_html_pages", "SELECT url, CAST(strlen(html) AS BIGINT) AS n_bytes, length(html) AS n_chars, sha256(html) AS content_hash, CASE WHEN trim(coalesce(url, '')) = '' THEN 'NO_URL' WHEN trim(coalesce(html, '')) = '' THEN 'EMPTY' ELSE 'OK' END AS status FROM pages")
def src_html_pages(spark, d):
    files = P(spark, d).select("url", F.col("html").cast("binary").alias("content"))
    return io.html_pages(files).select("url", "n_bytes", F.length("html").cast("long").alias("n_chars"), "content_hash", "status")


@register("request_fingerprint", "SELECT page_id, sha256('GET' || chr(10) || lower(regexp_extract(b, '^([a-zA-Z]+://[^/?]*)', 1)) || regexp_extract(b, '^[a-zA-Z]+://[^/?]*([^?]*)', 1) || chr(10) || array_to_string(list_sort(string_split(regexp_extract(b, '\\?(.*)$', 1), '&')), '&') || chr(10) || '') AS fingerprint FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS b FROM pages)")
def request_fingerprint(spark, d):
    return P(spark, d).select("page_id", G.request_fingerprint(F.col("url"), F.lit("get"), F.lit("")).alias("fingerprint"))


@register("chunk_text", "WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS t FROM documents) SELECT doc_id, CAST(i / 90 AS INTEGER) AS chunk, array_to_string(t[i + 1:i + 100], ' ') AS body FROM (SELECT doc_id, t, unnest(range(0, greatest(len(t) - 10, 1), 90)) AS i FROM w WHERE len(t) > 0)")
def chunk_text(spark, d):
    return G.chunks(B.table(spark, d, "documents"), "doc_id", size=100, overlap=10)
