"""Personal data: fixed patterns, and contexts learned from them by bootstrapping.

Base spans come from four patterns, found per row by built-in functions: the
pieces between matches give their places. Seeds are the base spans, each as a
whole, and long mixed hexadecimal keys. A label before a value ("token =", "phone:") is a lexical
pattern; patterns and the values they stand before form a graph over all
documents, scored in turns until they settle: a pattern by the share of its values believed in, a
value by the patterns that name it. Values of confident patterns are spans too,
whatever they look like. Only labels and hashes of values shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.joins import hot_join

from .common import cut, text_key

KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL = "[A-Za-z0-9._%+-]"
# Each is the stated pattern with possessive repeats where nothing could be given back, so that long runs
# neither recurse nor get scanned from each of their places.
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"[0-9-]*+[A-Za-z_][A-Za-z0-9_-]*+"
#: A label of one or two words of any length and a sign, then the value, perhaps quoted. A label begins where a word
#: does, so that a long word is read once.
CUE = rf"(?<![A-Za-z0-9_-])(?:{WORD}\x20)?{WORD}\x20?[:=#]\x20?[\"']?(?=[A-Za-z0-9+])"
#: What a value goes on over, to its end: of any length, four characters at least.
RUN = r"^[^\s\"'<>,;!|&$%#*)]*+"
GROUP = r"(?=[A-Za-z]*+[0-9]|[A-Z]{4}(?![A-Za-z0-9]))[A-Za-z0-9]{1,8}+(?![A-Za-z0-9])"
#: Or two and more short groups with blanks between: each has a digit or is four capitals.
GROUPS = rf"{GROUP}(?:\x20{GROUP})++"
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _matches(text: Column, pattern: str, wanted: Column) -> Column:
    """array<struct<start, m>> of the matches of rows where ``wanted`` holds; null elsewhere."""
    p = F.lit(pattern)
    return F.when(wanted, F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap")))


def _running(items: str, kind: str, zero: str, emit: str, after: str) -> str:
    """What ``emit`` gives for each item x in turn; c.at is the state, from ``zero`` on, which ``after`` moves.

    Items go in blocks of 128, as appending to an array copies it.
    """
    block = f"aggregate(b, struct(cast(array() AS array<{kind}>) AS out, a.at AS at), (c, x) -> struct(array_append(c.out, {emit}) AS out, {after} AS at), c -> c)"
    blocks = "transform(sequence(0, greatest(size(v) - 1, 0) div 128), k -> slice(v, k * 128 + 1, 128))"
    return f"transform(array({items}), v -> flatten(aggregate({blocks}, struct(cast(array() AS array<array<{kind}>>) AS out, {zero} AS at), (a, b) -> transform(array({block}), z -> struct(array_append(a.out, z.out) AS out, z.at AS at))[0], a -> a.out)))[0]"


def _placed(found: str) -> str:
    """The start of each match: the lengths of all pieces and matches before it."""
    starts = _running(f"transform({found}.m, (m, i) -> struct(length({found}.gap[i]) AS gap, length(m) AS own))", "int", "0", "c.at + x.gap", "c.at + x.gap + x.own")
    return f"zip_with({starts}, {found}.m, (start, m) -> struct(start AS start, m AS m))"


#: Characters of the pieces that a text is held in where parts of it are taken, as taking a part reads what is before it.
PIECE = 1000
PIECES = f"regexp_extract_all(t, '(?s).{{1,{PIECE}}}', 0)"


def _part(pieces: str, start: str, length: str) -> str:
    """``length`` characters of a text from ``start`` (from 0) on."""
    return f"substring(array_join(slice({pieces}, ({start}) div {PIECE} + 1, ({start} + {length}) div {PIECE} - ({start}) div {PIECE} + 1), ''), ({start}) % {PIECE} + 1, {length})"


DIGITS = "regexp_replace(e.m, '[^0-9]', '')"
LUHN = "aggregate(transform(split(reverse(" + DIGITS + "), ''), (c, j) -> CASE WHEN c = '' THEN 0 WHEN j % 2 = 0 THEN cast(c AS int) WHEN cast(c AS int) > 4 THEN 2 * cast(c AS int) - 9 ELSE 2 * cast(c AS int) END), 0, (a, x) -> a + x) % 10 = 0"
VALID = {
    "email": "true",
    "ip": "forall(split(e.m, '\\\\.'), q -> length(ltrim('0', q)) <= 3 AND cast(right(concat('0', ltrim('0', q)), 4) AS int) <= 255)",
    "card": f"length({DIGITS}) BETWEEN 14 AND 19 AND ({LUHN})",
    "phone": f"length({DIGITS}) BETWEEN 10 AND 15",
}


def base_spans(docs: DataFrame) -> DataFrame:
    """Add ``spans`` (start, kind number, end; by start, then kind) to rows with a non-null column ``t``."""
    t = F.col("t")
    has = {"email": F.instr(t, "@") > 0, "ip": t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), "card": t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": t.rlike(r"\+[0-9]")}
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        docs = docs.withColumn(f"_{kind}", _matches(t, pattern, has[kind]))
    for kind in KINDS[:4]:
        docs = docs.withColumn(f"_{kind}", F.expr(_placed(f"_{kind}")))
    every = ", ".join(f"coalesce(transform(filter(_{k}, e -> {VALID[k]}), e -> struct(e.start AS start, {i} AS kind, e.start + length(e.m) AS end)), cast(array() AS {SPANS}))" for i, k in enumerate(KINDS[:4]))
    return docs.withColumn("spans", F.expr(f"array_sort(concat({every}))")).drop(*[f"_{k}" for k in KINDS[:4]])


def _quoted(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cues(docs: DataFrame) -> DataFrame:
    """Add ``cues``: array<struct<labels, start, end, value, seed, free>> of the labelled values in ``t``; free ones overlap no base span.

    A value has two lexical patterns: its label's last word, and both words. It
    is the base span that begins there, else groups free of base spans, else a run.
    """
    found = _matches(F.col("t"), CUE, F.col("t").rlike(r"[:=#] ?[\"']?[A-Za-z0-9+]"))
    docs = docs.withColumn("_cue", found)
    # How far a value runs is added up from the last cue to the first: a run that fills a gap goes on into the next cue.
    run = lambda of: f"length(regexp_extract({of}, {_quoted(RUN)}, 0))"
    parts = f"transform(_cue.m, (x, i) -> struct(length(x) AS n, {run('x')} AS own, length(_cue.gap[i + 1]) AS room, {run('_cue.gap[i + 1]')} AS run))"
    length = "IF(x.run < x.room, x.run, x.run + c.at)"
    sizes = f"reverse({_running(f'reverse({parts})', 'int', '0', length, f'IF(x.own < x.n, x.own, x.n + {length})')})"
    grouped = F.when(F.col("t").rlike(r"[:=#] ?[\"']?[A-Za-z0-9]{1,8}\x20[A-Z0-9a-z]"), F.regexp_extract_all(F.col("t"), F.lit(f"{CUE}(?=({GROUPS}|))"), F.lit(1))).otherwise(F.expr("cast(array() AS array<string>)"))
    docs = docs.withColumn("_size", F.expr(sizes)).withColumn("_cue", F.expr(_placed("_cue"))).withColumn("_groups", grouped)
    label = "regexp_replace(lower(c.m), ' ?([:=#]) ?[\"\\']?$', '$1')"
    docs = docs.withColumn("_cue", F.expr(f"transform(arrays_zip(_cue.start, _cue.m, _size, _groups), c -> struct({label} AS label, c.start + length(c.m) AS start, c._size AS size, coalesce(length(c._groups), 0) AS wide))"))
    # Spans and cues in one order: what a cue's base span is, how far spans before it reach, where the next one begins.
    events = "array_sort(concat(transform(spans, s -> struct(s.start AS at, 0 AS what, s.end AS end)), transform(_cue, c -> struct(c.start AS at, 1 AS what, 0 AS end))))"
    zero = "struct(-9 AS p, 0 AS e, -9 AS q, 0 AS f, 0 AS far)"
    whole = "array_max(filter(array(IF(c.at.p >= x.at - 1, struct(c.at.e AS end, c.at.p AS start), NULL), IF(c.at.q >= x.at - 1, struct(c.at.f AS end, c.at.q AS start), NULL)), w -> w IS NOT NULL))"
    after = "IF(x.what = 1, c.at, struct(x.at AS p, IF(x.at = c.at.p, greatest(c.at.e, x.end), x.end) AS e, IF(x.at = c.at.p, c.at.q, c.at.p) AS q, IF(x.at = c.at.p, c.at.f, c.at.e) AS f, greatest(c.at.far, x.end) AS far))"
    before = _running("_events", "struct<whole:struct<end:int,start:int>,far:int>", zero, f"IF(x.what = 1, struct({whole} AS whole, c.at.far AS far), NULL)", after)
    beyond = _running("reverse(_events)", "int", "2147483647", "IF(x.what = 1, c.at, NULL)", "IF(x.what = 1, c.at, x.at)")
    docs = docs.withColumn("_events", F.expr(events)).withColumn("_before", F.expr(f"filter({before}, x -> x IS NOT NULL)")).withColumn("_next", F.expr(f"reverse(filter({beyond}, x -> x IS NOT NULL))"))
    docs = docs.withColumn("_cue", F.expr("transform(arrays_zip(_cue, _before, _next), z -> struct(z._cue.label AS label, z._cue.start AS start, z._cue.size AS size, z._cue.wide AS wide, z._before.whole AS whole, z._before.far AS far, z._next AS next))"))
    size = "IF(c.wide > c.size AND c.far <= c.start AND c.next >= c.start + c.wide, c.wide, c.size)"
    docs = docs.withColumn("_cue", F.expr(f"transform(_cue, c -> struct(c.label AS label, c.start AS start, {size} AS size, c.whole AS whole, c.far AS far, c.next AS next))"))
    docs = docs.withColumn("_cue", F.expr("transform(filter(_cue, c -> c.whole IS NOT NULL OR c.size >= 4), c -> struct(c.label AS label, coalesce(c.whole.start, c.start) AS start, coalesce(c.whole.end, c.start + c.size) AS end, c.whole IS NOT NULL AS base, c.whole IS NULL AND c.far <= c.start AND c.next >= c.start + c.size AS free))"))
    valued = f"transform(array({PIECES}), p -> transform(_cue, c -> struct(c.label AS label, c.start AS start, c.end AS end, c.base AS base, c.free AS free, {_part('p', 'c.start', '(c.end - c.start)')} AS value)))[0]"
    docs = docs.withColumn("_cue", F.when(F.size("_cue") > 0, F.expr(valued)))
    seed = "c.base OR (c.value rlike '^[0-9a-fA-F]{24,}$' AND c.value rlike '[0-9]' AND c.value rlike '[a-fA-F]')"
    return docs.withColumn("cues", F.expr(f"transform(_cue, c -> struct(array_distinct(array(regexp_extract(c.label, '[^ ]+$', 0), c.label)) AS labels, c.start AS start, c.end AS end, xxhash64(c.value) AS value, {seed} AS seed, c.free AS free))")).drop("_cue", "_size", "_groups", "_events", "_before", "_next")


def confident_patterns(found: DataFrame, support: int = 3, least: float = 0.8, still: float = 0.001) -> DataFrame:
    """Labels whose values are personal data: rows (label, score).

    ``found`` has ``cues``. The graph joins labels and different values; a
    pattern needs ``support`` values. All documents count. Scores only rise;
    the turns end when no pattern crosses ``least`` and none rose by over ``still``.
    """
    occurrences = found.filter(F.size("cues") > 0).select(F.explode("cues").alias("c")).select(F.explode("c.labels").alias("label"), "c.value", "c.seed")
    graph = cut(occurrences.groupBy("label", "value").agg(F.max("seed").alias("seed")))
    belief = graph.groupBy("value").agg(F.max("seed").cast("double").alias("belief"))
    seeds = belief
    before = None
    while True:
        score = hot_join(graph, belief, ["value"]).groupBy("label").agg(F.sum("belief").alias("b"), F.count("*").alias("n")).filter(F.col("n") >= support).select("label", (F.col("b") / (F.col("n") + 0.5)).alias("score"))
        score = cut(score)
        if before is not None:
            rise = score.join(before, "label").filter((F.col("score") - F.col("before") > still) | ((F.col("score") >= least) & (F.col("before") < least)))
            if rise.isEmpty():
                return score.filter(F.col("score") >= least)
        before = score.withColumnRenamed("score", "before")
        doubt = hot_join(graph, score, ["label"]).groupBy("value").agg(F.sum(F.log1p(-0.9 * F.least("score", F.lit(0.99)))).alias("doubt"))
        belief = seeds.join(doubt, "value", "left").select("value", F.greatest("belief", F.lit(1.0) - F.exp(F.coalesce("doubt", F.lit(0.0)))).alias("belief"))


def _scan(docs: DataFrame) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    return cues(base_spans(base))


def _found(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows (k_hash, k_crc, k_len, more): spans of confident patterns by text; texts with equal keys are equal."""
    key = ["k_hash", "k_crc", "k_len"]
    some = scanned.filter(F.size("cues") > 0).groupBy(*key).agg(F.any_value("cues").alias("cues"))
    new = hot_join(cut(some.select(*key, F.explode("cues").alias("c")).filter("c.free").withColumn("label", F.explode("c.labels"))), patterns.select("label"), ["label"])
    return new.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct(F.col("c.start").alias("start"), F.lit(4).alias("kind"), F.col("c.end").alias("end")))).alias("more"))


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)), ',')")


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    A null text is empty; null ids and repeated rows stay. ``spans`` holds the
    base spans and those of learned patterns (kind ``secret``). An empty table gives
    no rows; columns other than doc_id and text are not read. Work grows with a
    text's length, not with the square of its matches.
    """
    scanned = cut(_scan(docs).select("doc_id", *text_key(F.col("t")), "spans", "cues"))
    more = _found(scanned, confident_patterns(scanned))
    key = ["k_hash", "k_crc", "k_len"]
    plain = scanned.filter(F.coalesce(F.size("cues"), F.lit(0)) <= 0).withColumn("more", F.lit(None).cast(SPANS))
    rich = hot_join(scanned.filter(F.size("cues") > 0), more, key, "left")
    out = plain.unionByName(rich).withColumn("every", F.expr(f"array_sort(concat(spans, coalesce(more, cast(array() AS {SPANS}))))"))
    count = lambda k: F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) AS bigint)")
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(_joined("spans").cast("binary"), 256).alias("base_sha256"), _joined("every").alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of a text replaced by its kind in angle brackets; overlapping spans by the first's.

    A null text stays null; null ids and repeated rows stay, all columns keep
    their names and order, whatever they are called. An empty table gives no rows.
    """
    names = docs.columns
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("t")).select("row", "t", *text_key(F.col("t")))
    scanned = cues(base_spans(keyed))
    kept = cut(scanned.select("k_hash", "k_crc", "k_len", "spans", "cues").filter((F.size("cues") > 0) | (F.size("spans") > 0)))
    more = _found(kept, confident_patterns(kept))
    key = ["k_hash", "k_crc", "k_len"]
    marked = kept.groupBy(*key).agg(F.any_value("spans").alias("spans")).join(more, key, "left")
    marked = marked.select(*key, F.expr(f"array_sort(concat(spans, coalesce(more, cast(array() AS {SPANS}))))").alias("every")).filter(F.size("every") > 0)
    tags = ", ".join(f"'<{k.upper()}>'" for k in KINDS)
    # Texts without any mark of personal data need no look-up.
    maybe = F.col("t").rlike(r"@|[0-9]\.[0-9]|[0-9][0-9().\x20-]{4}|[:=#] ?[\"']?[A-Za-z0-9+]")
    untouched = keyed.filter(~maybe).select("row.*")
    # A text that many rows share is a hot key: only the keys are counted, whole rows then stay where they are.
    out = hot_join(cut(keyed.filter(maybe)), marked, key, "left")
    # Pieces between spans, left to right; a span that begins inside the last one only moves its end.
    piece = f"IF(x.start >= c.at, concat({_part('p', 'c.at', '(x.start - c.at)')}, array({tags})[x.kind]), '')"
    shown = _running("every", "string", "0", piece, "greatest(c.at, x.end)")
    build = f"transform(array({PIECES}), p -> concat(array_join({shown}, ''), {_part('p', 'array_max(transform(every, s -> s.end))', 'length(t)')}))[0]"
    text = F.when(F.size("every") > 0, F.expr(build)).otherwise(F.col("row.text"))
    return out.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in names]).unionByName(untouched)
