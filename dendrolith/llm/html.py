"""Main-content extraction from HTML by text-to-tag ratios.

The standard library's parser streams events; block-level tags end a line. Each line has a text-to-tag ratio, its
characters over the tags met in it, counted as nothing inside furniture (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments). The ratios are smoothed with a Gaussian kernel, and lines above a share of the mean
smoothed ratio form the content clusters. The region is the deepest element that holds nearly all clustered text,
widened to its enclosing article or main element; its lines outside furniture are the text. Where no article or main
element is found, blocks of several links without a dense line are menus, whatever they are called.

What counts as furniture: tags and roles that HTML has for it, hidden elements, and elements that have a class or an id
made up of furniture words only (``cookie-notice``, not ``popular-uprising``). Forms, dialogs and elements that only their
names make furniture are judged by the clusters first: one that holds half or more of the clustered text, with no article or
main element beside it that holds any, is a wrapper around the content (a page-wide form, a ``div`` called ``modal``) and is
no furniture. Inside an article, paragraphs, headings, cells and items go by a name only if it is one of adverts or reader
comments, and sections not by words that say something else as well (``notice``, ``popular``). A header inside an article
belongs to it. Furniture that is never closed by its own end tag ends at the next paragraph, heading, article or main
element, so that a forgotten end tag costs no article.

Before it is parsed a page is made whole: a tag ends within LONGEST characters a quoted value or is text, a comment without
an end is none, and script or style without an end reaches to the end of the page. So the parser never looks ahead in vain,
every event takes constant time but for the elements that it closes, and a page takes time in proportion to its length.

Edge cases: a null, empty or text-free page gives the empty text. Unclosed and wrongly nested tags, end tags without a
start, unknown references and truncated pages are read as far as they go; an end tag of a phrase does not close the
block around it. Repeated pages and null page_id give a row each; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrolith.llm.common import slices, table

SIGMA = 1.5
#: Share of the mean smoothed ratio above which a line is content.
THRESHOLD = 0.4
#: Share of the clustered text that the region must hold.
HELD = 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that end furniture that was left open.
FRESH = frozenset("p h1 h2 h3 h4 h5 h6 article main".split())
REGION = frozenset("article main section div td body html blockquote center table".split())
NEVER = frozenset("nav header footer aside form menu dialog".split())
#: Elements whose text is no text of the page.
SILENT = frozenset("head title script style noscript template svg math button select textarea input iframe object canvas audio video map datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav menu nav navbar navigation navi breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond reply replies disqus share sharing social related recommended recommendations widget widgets toolbar pagination pager skip popular trending".split()
)
COMMENT = frozenset("comment comments commentlist discussion discussions feedback reactions reply replies responses talkback disqus".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion".split())
#: Words that also name something inside an article, and elements that are its flow.
DOUBTFUL = frozenset("alert banner header menu modal notice notices overlay popular skip social trending widget widgets".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr figure figcaption".split())
#: Furniture by tag or role, by a name or as a form, and reader comments by name.
HARD, SOFT, READERS = range(3)
#: Share of the clustered text that makes soft furniture a wrapper.
WRAPS = 0.5
#: Of a quoted attribute value.
LONGEST = 4096
WHOLE_TAG = re.compile(r"""</?[a-zA-Z](?:[^"'<>]++|"[^"]{0,%d}+"|'[^']{0,%d}+'|["'])*+>""" % (LONGEST, LONGEST))
RAW = re.compile(r"<(script|style)\b", re.IGNORECASE)
#: Words that say where or how, not what.
PLACE = frozenset("area bar block body bottom box col column container content first global inner item last left link links list main middle outer page primary right secondary section site small sticky text thread top wrap wrapper".split())
PARTS = re.compile(r"[a-z]+")
#: Nested furniture beyond this depth is not told apart.
DEEPEST = 16


class Furniture:
    """An element whose lines are left out; unless ``sound``, only up to the line ``until``."""

    __slots__ = ("depth", "kind", "outer", "sound", "until", "wraps")

    def __init__(self, outer: Furniture | None, kind: int):
        self.outer, self.kind = outer, kind
        self.wraps = False
        self.depth = outer.depth + 1 if outer else 1
        self.sound = False
        self.until: int | None = None


class Line:
    __slots__ = ("chars", "excluded", "inside", "linked", "links", "ratio", "region", "tags", "text")

    def __init__(self, text: str, tags: int, linked: int, links: int, inside: Furniture | None, region: int):
        self.text, self.tags, self.linked, self.links, self.inside, self.region = text, tags, linked, links, inside, region
        self.chars = len(text)
        self.excluded, self.ratio = False, 0.0


class LineReader(HTMLParser):
    """Turns parser events into lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds: list[str] = [""]  # of regions; 0 is the page
        self.parents: list[int] = [0]
        self.stack: list[tuple[str, int, Furniture | None, Furniture | None]] = []  # tag, region around, furniture around, own furniture
        self.open_blocks: Counter[str] = Counter()
        self.open_phrases: list[Counter[str]] = [Counter()]  # of each open block
        self.region = 0
        self.inside: Furniture | None = None
        self.silent = self.links = 0
        self.pieces: list[str] = []
        self.tags = self.linked = self.anchors = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.anchors, self.inside, self.region))
        self.pieces = []
        self.tags = self.linked = self.anchors = 0

    def furniture(self, tag: str, attrs: list[tuple[str, str | None]]) -> Furniture | None:
        if self.inside and self.inside.depth >= DEEPEST:
            return None
        inside = self.open_blocks["article"] or self.open_blocks["main"]
        if tag in NEVER and not (tag == "header" and self.open_blocks["article"]):
            return Furniture(self.inside, SOFT if tag in ("form", "dialog") else HARD)
        words = COMMENT if tag in ("article", "main", "body", "html") else HINTS | COMMENT
        if inside and tag in FLOW:
            words = COMMENT | ADVERTS
        elif inside and tag == "section":
            words = words - DOUBTFUL
        for name, value in attrs:
            if name == "hidden":
                return Furniture(self.inside, HARD)
            if not value:
                continue
            if name in ("class", "id"):
                for own in value.lower().split():
                    parts = PARTS.findall(own)
                    if not words.isdisjoint(parts) and all(p in words or p in PLACE for p in parts):
                        return Furniture(self.inside, SOFT if COMMENT.isdisjoint(parts) else READERS)
            elif name == "role":
                if value.lower() in ROLES:
                    return Furniture(self.inside, SOFT if value.lower() in ("dialog", "form") else HARD)
            elif name == "aria-hidden":
                if value.lower() == "true":
                    return Furniture(self.inside, HARD)
            elif name == "style" and "display:none" in value.replace(" ", "").lower():
                return Furniture(self.inside, HARD)
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCK
        if block:
            self.end_line()
            if tag != "br" and self.stack and self.stack[-1][0] == "p":
                self.close_from(len(self.stack) - 1)
        if tag in FRESH:
            around = self.inside
            while around and around.until is None:
                around.until = len(self.lines)
                around = around.outer
        self.tags += 1
        if tag in VOID:
            return
        if tag == "body" and self.open_blocks["head"]:  # a body ends a head that was left open
            self.handle_endtag("head")
        own = self.furniture(tag, attrs)
        self.stack.append((tag, self.region, self.inside, own))
        if block:
            self.open_blocks[tag] += 1
            self.open_phrases.append(Counter())
        else:
            self.open_phrases[-1][tag] += 1
        self.inside = own or self.inside
        if tag in REGION:
            self.kinds.append(tag)
            self.parents.append(self.region)
            self.region = len(self.kinds) - 1
        self.silent += tag in SILENT
        if tag == "a":
            self.links += 1
            self.anchors += 1

    def close_from(self, n: int) -> None:
        if any(t in BLOCK for t, _, _, _ in self.stack[n:]):
            self.end_line()
        _, self.region, self.inside, _ = self.stack[n]
        for tag, _, _, _ in reversed(self.stack[n:]):
            if tag in BLOCK:
                self.open_blocks[tag] -= 1
                self.open_phrases.pop()
            else:
                self.open_phrases[-1][tag] -= 1
            self.silent -= tag in SILENT
            self.links -= tag == "a"
        del self.stack[n:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if not (self.open_blocks[tag] if tag in BLOCK else self.open_phrases[-1][tag]):
            return
        n = len(self.stack) - 1
        while self.stack[n][0] != tag:
            n -= 1
        own = self.stack[n][3]
        if own:
            own.sound = True
        self.close_from(n)

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        self.pieces.append(data)
        if self.links:
            self.linked += len(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, normalised at the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def leave_out(lines: list[Line], soft: bool = True) -> None:
    """Mark the lines that belong to furniture; without ``soft``, to hard furniture and to reader comments."""
    for n, x in enumerate(lines):
        x.excluded = any(not around.wraps and (soft or around.kind != SOFT) for around in surrounding(n, x))
        x.ratio = 0.0 if x.excluded else x.chars / max(1, x.tags)


def find_wrappers(lines: list[Line], kinds: list[str], parents: list[int]) -> None:
    """Soft furniture that holds the content, by the clusters of the page without soft furniture, is none."""
    own = {around for n, x in enumerate(lines) for around in surrounding(n, x) if around.kind == SOFT}
    if not own:
        return
    leave_out(lines, soft=False)
    content = [(n, x) for n, (x, is_content) in enumerate(zip(lines, clusters(lines)[0], strict=True)) if is_content]
    total = sum(x.chars for _, x in content)
    article = [False] * len(kinds)
    for n in range(1, len(kinds)):
        article[n] = kinds[n] in ("article", "main") or article[parents[n]]
    held: Counter[Furniture] = Counter()
    told: Counter[Furniture] = Counter()  # inside an article or main element
    for n, x in content:
        for around in surrounding(n, x):
            held[around] += x.chars
            told[around] += x.chars * article[x.region]
    in_articles = sum(x.chars for _, x in content if article[x.region])
    for around in own:
        around.wraps = total > 0 and held[around] >= WRAPS * total and told[around] == in_articles


def surrounding(n: int, line: Line) -> Iterator[Furniture]:
    """The furniture around the n-th line that has not ended by then."""
    around = line.inside
    while around:
        if around.sound or around.until is None or n < around.until:
            yield around
        around = around.outer


def clusters(lines: list[Line]) -> tuple[list[bool], float]:
    """Which lines are content by their smoothed ratio, and the ratio it takes."""
    level = smoothed(np.array([x.ratio for x in lines]))
    least = THRESHOLD * float(level.mean())
    return [bool(s > 0 and s >= least and not x.excluded) for s, x in zip(level, lines, strict=True)], least


def content_lines(lines: list[Line], kinds: list[str], parents: list[int]) -> list[Line]:
    if not lines:
        return []
    find_wrappers(lines, kinds, parents)
    leave_out(lines)
    if all(x.excluded for x in lines):
        leave_out(lines, soft=False)
    content, least = clusters(lines)
    held = [0] * len(kinds)
    for x, is_content in zip(lines, content, strict=True):
        held[x.region] += x.chars * is_content
    for n in range(len(kinds) - 1, 0, -1):  # elements are numbered as they open, so the inner ones come last
        held[parents[n]] += held[n]
    if not held[0]:
        return []
    region = max(n for n, chars in enumerate(held) if chars >= HELD * held[0])
    named = region
    while named and kinds[named] not in ("article", "main"):
        named = parents[named]
    region = named or region
    inside = [False] * len(kinds)
    for n in range(len(kinds)):
        inside[n] = n == region or n > 0 and inside[parents[n]]
    kept = [x for x in lines if inside[x.region] and not x.excluded]
    if not named:
        dense, links = [False] * len(kinds), [0] * len(kinds)
        for x in lines:
            dense[x.region] |= x.ratio >= least
            links[x.region] += x.links
        kept = [x for x in kept if 2 * x.linked <= x.chars or links[x.region] < 2 or dense[x.region]]
    return kept


def made_whole(html: str) -> str:
    """The page with tags that end, comments and scripts taken out, and every other opening bracket as text."""
    out, at, comments = [], 0, True
    while (start := html.find("<", at)) >= 0:
        out.append(html[at:start])
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4) if comments else -1
            comments = end >= 0
            at = end + 3 if comments else start + 4
        elif html[start + 1 : start + 2] in ("!", "?"):
            end = html.find(">", start, start + LONGEST)
            at = end + 1 if end >= 0 else start + 2
        elif found := WHOLE_TAG.match(html, start):
            at = found.end()
            raw = RAW.match(found[0])
            if not raw:
                out.append(found[0])
            elif not found[0].endswith("/>") or raw[1].lower() == "script":
                end = re.compile("</" + raw[1], re.IGNORECASE).search(html, at)
                if not end:
                    return "".join(out)
                at = end.start()
                closing = WHOLE_TAG.match(html, at)
                at = closing.end() if closing else at + len(end[0])
        else:
            out.append("&lt;")
            at = start + 1
    out.append(html[at:])
    return "".join(out)


def main_text(html: str) -> str:
    reader = LineReader()
    reader.feed(made_whole(html))
    reader.close()
    reader.end_line()
    return " ".join(x.text for x in content_lines(reader.lines, reader.kinds, reader.parents))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to (page_id, url, text, n_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            texts = [main_text(h.as_py() or "") for h in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
