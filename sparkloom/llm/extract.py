"""Main text of web pages: streaming parser events, text-to-tag ratios, smoothing and threshold clustering.

Parser events cut a page into lines (blocks of text) and remember which elements
each stands in. A line's ratio is its text per tag; ratios are smoothed with a
Gaussian, and a threshold that parts them into two clusters picks the dense
lines. The first content region is the element that holds most of the dense text;
the blocks beside it, and beside the elements around it, are regions as far as they
hold dense lines. Every line of a region is kept unless it stands in a menu, a form or
the like, or in an element whose class or id names a notice, an advert or comments:
such a name weighs by its share of the whole name against the element's density, so
that a dense part of the article is not lost for one word of its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is never main text.
SKIPPED = frozenset("aside audio button canvas dialog footer form head iframe math menu nav noscript object script select style svg template textarea title video".split())
#: Start tags that end an open element of the same kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Name parts of class and id that mark what is not the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert popup modal overlay sidebar sidebars aside nav navbar navigation menu menus breadcrumb breadcrumbs footer foot colophon comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager widget widgets toolbar masthead topbar skip copyright hidden".split()
)
HEADS = frozenset("header head".split())
_PARTS = re.compile(r"[a-z]+|\d+")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: Name parts that say nothing about what is inside.
PLAIN = frozenset("box wrap wrapper container list item items block inner outer area bar top bottom left right section content main row col column grid panel group body text page site global js is has the and".split())


def _name_weight(names: str) -> float:
    """How far class and id name what is not the article: of a name's telling parts, the share that do; of all names, the most."""
    most = 0.0
    for name in names.split():
        parts = [p for p in _PARTS.findall(_CAMEL.sub("-", name).lower()) if not p.isdigit() and p not in PLAIN]
        most = max(most, sum(p in NAMES for p in parts) / max(1, len(parts)))
    return most


class _Lines(HTMLParser):
    """Collects lines: text, tags seen before it, characters in links, the innermost open element; and elements with their parents."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # tag, element number, left out
        self.at: dict[str, list[int]] = {}  # where each tag stands in the stack
        self.blocks: list[int] = []  # where blocks but paragraphs stand
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.tags_of: list[str] = []
        self.parent: list[int] = []  # always a smaller number, or -1
        self.text: list[str] = []
        self.tags = self.linked = self.anchors = 0
        self.marks: dict[str, float] = {}
        self.weights: dict[int, float] = {}

    def _flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            self.text = []
            if text:
                _, element, out = self.stack[-1] if self.stack else ("", -1, False)
                self.lines.append((text, max(1, self.tags), self.linked, element, out))
                self.tags = 0
        self.linked = 0

    def _innermost(self, tags) -> int:
        """Where the innermost open element of these kinds stands in the stack; -1 if there is none."""
        return max((held[-1] for t in tags if (held := self.at.get(t))), default=-1)

    def _push(self, tag: str, out: bool) -> None:
        at = len(self.stack)
        self.at.setdefault(tag, []).append(at)
        if tag in BLOCKS and tag != "p":
            self.blocks.append(at)
        self.parent.append(self.stack[-1][1] if self.stack else -1)
        self.tags_of.append(tag)
        self.stack.append((tag, len(self.tags_of) - 1, out))

    def _pop_to(self, at: int) -> None:
        for tag, _, _ in self.stack[at:]:
            self.at[tag].pop()
        del self.stack[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def _left_out(self, tag: str, attrs) -> bool:
        if tag in SKIPPED:
            return True
        names = []
        for k, v in attrs:
            if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "role" and (v or "").lower() in ROLES):
                return True
            if k == "style" and v and "display:none" in v.replace(" ", "").lower():
                return True
            if k in ("class", "id") and v:
                names.append(v)
        inside = self._innermost(("article", "main")) >= 0
        if tag == "header":
            return not inside
        if not names or tag in ("html", "body", "article", "main"):
            return False
        key = " ".join(names)
        weight = self.marks.get(key)
        if weight is None:
            weight = self.marks[key] = _name_weight(key)
        if weight == 1 or (not inside and tag == "div" and not HEADS.isdisjoint(_PARTS.findall(key.lower()))):
            return True  # the whole name says so
        if weight:
            self.weights[len(self.tags_of)] = weight
        return False

    def handle_starttag(self, tag, attrs) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            elif tag == "hr":
                self._flush()
            return
        if tag in BLOCKS:
            self._flush()
            if tag not in ("html", "body"):
                self._close(("p",), self.blocks[-1] if self.blocks else -1)
        if tag in ENDS:
            self._close(ENDS[tag], self._innermost(("ul", "ol", "dl", "table")))
        if tag in ("article", "main"):  # never closed
            self._close(("nav", "header", "head"), self._innermost(("aside", "footer")))
        if tag == "body":
            self._close(("head",), -1)
        self._push(tag, (bool(self.stack) and self.stack[-1][2]) or self._left_out(tag, attrs))
        if tag == "a":
            self.anchors += 1

    def _close(self, tags, wall: int) -> None:
        """End the innermost open element of these kinds, unless a wall stands before it."""
        at = self._innermost(tags)
        if at > wall:
            self._flush()
            self._pop_to(at)

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        self.tags += 1
        at = self._innermost((tag,))
        if at < 0 or (tag not in ("article", "main", "body", "html") and at < self._innermost(("article", "main", "body"))):
            return
        if tag in BLOCKS or tag in SKIPPED or max(self.blocks[-1] if self.blocks else -1, self._innermost(("p",))) >= at:
            self._flush()
        self._pop_to(at)

    def handle_data(self, data) -> None:
        if self.stack and self.stack[-1][0] in SKIPPED and self.stack[-1][0] not in BLOCKS:
            return
        self.text.append(data)
        if any(e[0] == "a" for e in self.stack[-3:]):
            self.linked += len(data.strip())

    def finish(self) -> None:
        self.close()
        self._flush()

    def sums(self, at: list[int], values: list) -> list:
        """For each element, the values of lines in it and in all elements inside; ``at`` are the lines' own elements."""
        total = [0] * len(self.parent)
        for e, x in zip(at, values, strict=True):
            if e >= 0:
                total[e] += x
        for e in range(len(self.parent) - 1, -1, -1):
            if self.parent[e] >= 0:
                total[self.parent[e]] += total[e]
        return total

    def inside(self, some: set[int]) -> list[bool]:
        """Whether each element is one of these or in one; a last place stands for no element."""
        found = [False] * (len(self.parent) + 1)
        for e, up in enumerate(self.parent):
            found[e] = e in some or (up >= 0 and found[up])
        return found


def smooth(ratio: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; the ends are weighted by what there is."""
    r = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(ratio, kernel)[r : r + len(ratio)] / np.convolve(np.ones(len(ratio)), kernel)[r : r + len(ratio)]


def threshold(values: np.ndarray, rounds: int = 20) -> float:
    """The border of two clusters: halfway between the means of those above and below it."""
    t = float(values.mean())
    for _ in range(rounds):
        high, low = values[values > t], values[values <= t]
        if not len(high) or not len(low):
            break
        new = (high.mean() + low.mean()) / 2
        if abs(new - t) < 1e-9:
            break
        t = float(new)
    return t


HOLDERS = BLOCKS - {"p", "li", "h1", "h2", "h3", "td", "tr", "pre", "blockquote"}


def main_text(html: str | None) -> str:
    """The article's blocks, joined by a blank line; empty if there is none. The work grows with the page, however deep it nests."""
    if not html:
        return ""
    p = _Lines()
    p.feed(html)
    p.finish()
    lines, tags_of = p.lines, p.tags_of
    if not lines:
        return ""
    at = [x[3] for x in lines]
    size = np.array([len(x[0]) for x in lines], float)
    own = np.log1p(size * np.array([not x[4] for x in lines]) / np.array([x[1] for x in lines]))
    ratio = smooth(own)
    kept = np.array([not x[4] for x in lines])
    if not kept.any():
        return ""
    border = threshold(ratio)
    if p.weights:  # elements whose name weighs more than their density: mean smoothed ratio against the border
        ratios, sizes = p.sums(at, (ratio * size).tolist()), p.sums(at, size.tolist())
        sparse = p.inside({e for e, w in p.weights.items() if sizes[e] and ratios[e] / sizes[e] < 2 * w**2 * border})
        kept &= ~np.array([sparse[e] for e in at])
        if not kept.any():
            return ""
    dense = kept & ((ratio > border) if (ratio > border).any() else kept)
    if not dense.any():
        dense = kept
    weight = p.sums(at, [int(s) if d else 0 for s, d in zip(size, dense, strict=True)])
    total = int(size[dense].sum())
    # The first region: an article or main element with most of the dense text, else the innermost element with nearly all.
    region = max((e for e, w in enumerate(weight) if w and tags_of[e] in ("article", "main") and 2 * w >= total), default=-1)
    if region < 0:
        region = max((e for e, w in enumerate(weight) if w and tags_of[e] in HOLDERS and 10 * w >= 9 * total), default=-1)
    around: set[int] = set()
    up = region
    while up >= 0:
        around.add(up)
        up = p.parent[up]
    regions, alone = {region}, set()
    if region >= 0:
        # Further regions: of each block beside those, the innermost element with all of its lines that are dense by themselves too.
        within = p.inside({region})
        more = [i for i in np.flatnonzero(dense & (own > border)) if not within[at[i]]]
        beside = [-1] * len(tags_of)
        for e, up in enumerate(p.parent):
            if e not in around:
                beside[e] = e if up < 0 or up in around else beside[up]
        held = p.sums([at[i] for i in more], [1] * len(more))
        best: dict[int, int] = {}
        for e, b in enumerate(beside):
            if b >= 0 and held[e] and held[e] == held[b] and tags_of[e] in HOLDERS:
                best[b] = e  # inner ones come later
        for i in more:
            b = beside[at[i]] if at[i] >= 0 else -1
            if b in best:
                regions.add(best[b])
            else:
                alone.add(i)
    chosen_in = p.inside(regions)
    chosen = [i for i in np.flatnonzero(kept) if region < 0 or i in alone or chosen_in[at[i]]]
    # Lists of links that nothing marks: elements of sparse lines, nearly all of it in links.
    where = [at[i] for i in chosen]
    linked, chars, parts = p.sums(where, [lines[i][2] for i in chosen]), p.sums(where, [len(lines[i][0]) for i in chosen]), p.sums(where, [1] * len(chosen))
    menus = p.inside({e for e, t in enumerate(tags_of) if t in ("ul", "ol", "div", "table", "dl") and e not in around and parts[e] > 1 and linked[e] >= 0.8 * chars[e] and chars[e] < 0.3 * total})
    return "\n\n".join(lines[i][0] for i in chosen if not menus[at[i]])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and n_chars (code points).

    A null html has an empty text. Null ids and urls and repeated rows stay; an
    empty table gives no rows; other columns, also one named text, are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) for h in b["html"].tolist()]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).mapInPandas(run, "page_id long, url string, text string, n_chars long")
