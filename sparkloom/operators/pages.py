"""Page fields as built-in string expressions. The text rule is regular: no look-around, so other engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.shared import cut
from sparkloom.sources.tables import KeyedTable

DROPPED = ("script", "style", "nav", "footer", "head", "aside", "form", "noscript")
BLOCK = r"(?i)</?(?:p|h[1-6]|div|article|section|main|body|html|li|ul|ol|table|tr|td|th|blockquote|header)(?:\s[^>]*)?>"


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def unescape(text: Column) -> Column:
    """The five common character references; the ampersand last."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def clean(text: Column) -> Column:
    """Without tags, references decoded, white space as one space."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(text, r"<[^>]*>", " ")), r"\s+", " "))


def title(html: Column) -> Column:
    of = lambda tag: F.nullif(clean(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    return F.coalesce(of("h1"), of("title"))


def absolute(href: Column, base: Column) -> Column:
    """A link joined to its page's address: absolute, protocol-relative, rooted or relative."""
    root = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+/(?:[^?#]*/)?)", 1)  # no repeated group: addresses of any length
    return F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z]+:)", 1), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(root, F.lit("/"))), href))


def canonical(html: Column, url: Column) -> Column:
    tag = F.regexp_extract(html, r"(?is)(<link[^>]*rel=[\"']canonical[\"'][^>]*>)", 1)
    href = F.regexp_extract(tag, r"(?is)href=[\"']([^\"']*)[\"']", 1)
    return F.when(href != "", absolute(href, url)).otherwise(url)


def links(html: Column, url: Column) -> Column:
    """Absolute links, first-seen order, each once; those within the page are left out."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href=[\"']([^\"']*)[\"']"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(found, lambda h: (h != "") & ~h.startswith("#")), lambda h: absolute(h, url)))


def body(html: Column) -> Column:
    """Blocks outside of menus, scripts and the like, joined by a blank line."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in DROPPED:
        t = F.regexp_replace(t, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>", " ")
    return F.array_join(F.filter(F.transform(F.split(t, BLOCK), clean), lambda x: x != ""), "\n\n")


def text_md(html: Column) -> Column:
    head, rest = title(html), body(html)
    return F.when(head.isNull() | rest.startswith("#"), rest).when(rest == "", F.concat(F.lit("# "), head)).otherwise(F.concat(F.lit("# "), head, F.lit("\n\n"), rest))


def tokens(text: Column) -> Column:
    """White-space words; 0 for a blank text."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def author(html: Column, source_class: Column) -> Column:
    post = clean(F.regexp_extract(html, r"(?is)data-author=[\"']([^\"']*)[\"']", 1))
    byline = clean(F.regexp_extract(html, r"(?is)class=[\"']byline[\"'][^>]*>(.*?)<", 1))
    return F.nullif(F.when(source_class == "forum_thread", post).when(source_class == "article", byline).when(source_class == "review_page", F.lit("aggregate")).otherwise(F.lit("")), F.lit(""))


def platform_fields(html: Column, source_class: Column, text: Column) -> Column:
    """map<string,string> of what the class of page states."""
    plain = clean(html)
    number = lambda rx: F.nullif(F.regexp_replace(F.regexp_extract(plain, rx, 1), ",", ""), F.lit(""))
    entries = F.array(
        F.struct(F.lit("source_class").alias("k"), source_class.alias("v")),
        F.struct(F.lit("word_count").alias("k"), F.when(source_class == "article", tokens(text).cast("string")).alias("v")),
        F.struct(F.lit("reply_count").alias("k"), F.when(source_class == "forum_thread", number(r"(\d+)\s+replies")).alias("v")),
        F.struct(F.lit("asin").alias("k"), F.when(source_class == "marketplace_listing", F.nullif(F.regexp_extract(html, r"data-asin=[\"']([^\"']*)[\"']", 1), F.lit(""))).alias("v")),
        F.struct(F.lit("price_usd").alias("k"), F.when(source_class == "marketplace_listing", number(r"\$([0-9]+(?:\.[0-9]{2})?)")).alias("v")),
        F.struct(F.lit("rating_count").alias("k"), F.when(source_class == "marketplace_listing", number(r"([\d,]+)\s+ratings")).alias("v")),
        F.struct(F.lit("review_count").alias("k"), F.when(source_class == "review_page", number(r"(\d+)\s+verified reviews")).alias("v")),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def assemble(pages: DataFrame, task_id: Column) -> DataFrame:
    """Page artifacts of (url, html): ids, fields and hash in one narrow pass."""
    text = text_md(F.col("html"))
    p = pages.withColumn("text_md", text)
    return p.select(F.concat(F.lit("pg_"), F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 16)).alias("page_id"), "url", canonical(F.col("html"), F.col("url")).alias("canonical_url"), domain(F.col("url")).alias("domain"), title(F.col("html")).alias("title"), "text_md", links(F.col("html"), F.col("url")).alias("links"), F.concat(F.lit("sha256:"), F.sha2(F.col("text_md").cast("binary"), 256)).alias("content_hash"), tokens(F.col("text_md")).alias("token_count"), F.array(task_id).alias("derived_from"), F.lit("page.v1").alias("schema_version"))


def vtt_text(vtt: Column) -> Column:
    """Captions without header, times and cue numbers, joined by a blank line."""
    lines = F.transform(F.split(vtt, r"\r\n|\n|\r"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: (x != "") & (x != "WEBVTT") & ~F.contains(x, F.lit("-->")) & ~x.rlike(r"^\d+$")), "\n\n")


def media_page(metadata: DataFrame, captions: DataFrame) -> DataFrame:
    """Pages of videos: title, description and transcript."""
    j = metadata.join(captions, "video_id", "left")
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), F.nullif(F.col("description"), F.lit("")), F.nullif(vtt_text(F.coalesce("vtt", F.lit(""))), F.lit("")))
    return j.select("video_id", F.concat(F.lit("pg_"), F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 16)).alias("page_id"), "title", text.alias("text_md"), tokens(text).alias("token_count"))


def query_slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", "_")


def discover(results: DataFrame, job_id: Column) -> DataFrame:
    """Fetch tasks of search results (query, engine, url): stable ids, one row per job, query and url."""
    engine = F.coalesce("engine", F.lit("unknown"))
    spec = F.concat(F.lit("qs_"), F.substring(F.sha2(F.concat_ws("|", job_id, "query", engine), 256), 1, 16))
    r = results.filter(F.col("url").isNotNull() & (F.col("url") != "")).withColumn("query_spec_id", spec)
    return r.select("query_spec_id", "query", engine.alias("engine"), "url", F.concat(F.lit("tsk_"), F.substring(F.sha2(F.concat_ws("|", job_id, "query_spec_id", "url"), 256), 1, 12)).alias("task_id"), F.concat(F.lit("idem_"), F.sha2(F.concat_ws("|", F.lit("fetch"), "query_spec_id", "url"), 256)).alias("idempotency_key")).distinct()


class Discovery:
    """Stored query specs, fetch tasks and edges; what a search finds again adds nothing to any of them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.specs = KeyedTable(spark, f"{path}/query_specs", "query_spec_id string, job_id string, query string, engine string", ["query_spec_id"], 16)
        self.tasks = KeyedTable(spark, f"{path}/tasks", "task_id string, idempotency_key string, query_spec_id string, url string", ["idempotency_key"], 16)
        self.edges = KeyedTable(spark, f"{path}/edges", "child_kind string, child_id string, parent_kind string, parent_id string", ["child_kind", "child_id", "parent_kind", "parent_id"], 16)

    def add(self, results: DataFrame, job_id: Column) -> DataFrame:
        """Store what is new of search results; returns the tasks with ``inserted``. Specs come first, edges last, so a
        run that stops leaves no edge without its ends; run again, it adds the rest."""
        found = cut(discover(results, job_id))
        self.specs.insert(found.select("query_spec_id", job_id.cast("string").alias("job_id"), "query", "engine"))
        tasks = self.tasks.insert(found)
        self.edges.insert(found.select(F.lit("task").alias("child_kind"), F.col("task_id").alias("child_id"), F.lit("query_spec").alias("parent_kind"), F.col("query_spec_id").alias("parent_id")))
        return tasks


def est_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def request_fingerprint(url: Column, method: Column, body_text: Column) -> Column:
    """A hash of a request; host and scheme in lower case, no fragment, parameters in order."""
    bare = F.regexp_replace(url, r"#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([a-zA-Z]+://[^/?]*)", 1))
    path = F.regexp_extract(bare, r"^[a-zA-Z]+://[^/?]*([^?]*)", 1)
    params = F.array_join(F.array_sort(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")), "&")
    return F.sha2(F.concat_ws("\n", F.upper(method), F.concat(head, path), params, body_text), 256)


def chunks(docs: DataFrame, key: str, size: int = 100, overlap: int = 10) -> DataFrame:
    """(key, chunk, body): the words of each text in runs of ``size``, each of which begins with the last ``overlap`` of the one before."""
    t = docs.select(key, F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("t")).filter(F.size("t") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("t") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return t.select(key, "t", F.posexplode(starts).alias("chunk", "i")).select(key, "chunk", F.array_join(F.slice("t", F.col("i") + 1, F.lit(size)), " ").alias("body"))


def search_rows(answers: DataFrame) -> DataFrame:
    """One row per usable result of search answers (query, results: array of structs with url and engine); a missing engine is ``unknown``."""
    r = answers.select("query", F.explode("results").alias("r")).filter(F.col("r.url").isNotNull())
    return r.select("query", "r.url", F.coalesce("r.engine", F.lit("unknown")).alias("engine"), *[F.col(f"r.{c}") for c in answers.schema["results"].dataType.elementType.names if c not in ("url", "engine")])
