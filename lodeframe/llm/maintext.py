"""Main text of web pages: line-block distribution.

The page's markup is stripped into lines, one for each block of text, leaving out elements
that by definition never hold the article (navigation, footers, forms, scripts) and blocks whose class or id says nothing
else than that ('share', 'share-buttons', but not 'elementor-widget' or 'market-share'; on headings no
name counts, on sections and inline elements no id, as ids are made from headings' words, and
inside an article only ids of two such words or more). Each line has a weight: its length without links, and `LINE` for being a line, so
that a short paragraph among others is text too. Markup weighs in by two factors: where paragraphs, headings and the like hold a third
of the page's text, lines of bare blocks count an eighth; where elements that mark an article do, lines outside them count a twentieth.

The weights are summed over sliding windows of `WINDOW` lines. A region starts where the sums surge to a threshold and ends where
they dive below it, less the light lines at its edges that only a heavy neighbour lifted. The region of most weight is the main text, whole.

Defined cases: a null or empty page, or one without text, gives ''; markup may be cut off or
left open anywhere; a page is one row's work whatever its length; of equal regions the first counts; repeated rows and null
ids are rows like any other; an empty table gives no row; further columns of the input, whatever their names, are left out.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: weight of a line beside its length; the most weight of a line; sum of a window that counts as a surge; weight of a line that may stand at an edge
LINE, HEAVY, SURGE, EDGE = 30, 200, 60, 25
#: factors of lines of bare blocks, and of lines outside marked articles; each where the other lines hold at least that share of the text
BARE, OUTSIDE, MARKED = 0.12, 0.05, 1 / 3

RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "svg", "object")
NEVER = {"nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "datalist", "label", "audio", "video", "canvas", "map", "head"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "link", "mark", "meta", "meter", "nobr", "output", "progress", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "source", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "note", "tablist"}
#: elements whose lines are text, and those of them that aren't parents of others
LEAVES = {"p", "pre", "blockquote", "li", "dd", "dt", "td", "th", "figcaption", "caption", "h1", "h2", "h3", "h4", "h5", "h6"}
PARTS = {"p", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}
ARTICLE, MAIN = {"article"}, {"main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: words of class or id
AWAY = set(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification "
    "alert disclaimer newsletter subscribe subscription signup sidebar sidebars aside nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar "
    "footer foot comment comments commentlist respond replies disqus discussion share sharing social related recommended recommendations popular trending widget widgets "
    "popup modal overlay login search masthead topbar skip copyright".split()
)
#: these may stand with words of AWAY in one name
FURNITURE = set("area bar block body bottom box btn button buttons container content global group header icon icons inner left link links list main module page post posts primary right row secondary section site slot thread title top unit wrap wrapper".split())
#: these say that a block is beside the element, not that it is one
BESIDE = {"with", "has", "no", "without", "hide", "hidden"}

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*)))?""")
_ENDS = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


def _beside(name: str, value: str, tag: str, inside: bool) -> bool:
    """Whether a class or id says that its element is not the article's."""
    if tag in HEADINGS or name == "id" and (tag == "section" or tag in INLINE):
        return False
    for word in value.split():
        parts = [p for p in re.split(r"[-_:]+", word) if p]
        away = AWAY.intersection(parts)
        if parts == ["header"] and not inside:
            return True
        if away and not BESIDE.intersection(parts) and all(p in AWAY or p in FURNITURE for p in parts) and (name == "class" or not inside or len(away) > 1):
            return True
    return False


def _kind(tag: str, attributes: str, inside: bool) -> str:
    """'away' for what never holds the article, 'main' and 'article' for what marks it, else ''."""
    if tag in NEVER or tag == "header" and not inside:
        return "away"
    kind = "article" if tag in ARTICLE else "main" if tag in MAIN else ""
    if "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return "away"
            if name == "role":
                if value in ROLES:
                    return "away"
                kind = "main" if value == "main" else "article" if value == "article" else kind
            elif name == "itemprop" and value == "articlebody":
                kind = "article"
            elif name in ("class", "id") and tag not in ("html", "body", "main"):
                if _beside(name, value, tag, inside):
                    return "away"
    return kind


def lines_of(page: str) -> tuple[list[str], list[int], list[bool], list[bool]]:
    """Texts of the page's blocks, their lengths without links, whether they are in an article, and whether bare (in no paragraph or the like)."""
    texts: list[str] = []
    sizes: list[int] = []
    articles: list[bool] = []
    bare: list[bool] = []
    open_: list[tuple[str, int, str]] = []  # block elements: name, number, kind
    marked: list[int] = []  # numbers of open article elements
    buffer: list[str] = []
    linked, in_link, number = 0, 0, 0
    block = ""  # the element that began last
    away, depth = "", 0  # the element that is being left out, and how often it is open
    away_comments = False

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(_html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                texts.append(text)
                sizes.append(max(0, len(text) - linked))
                articles.append(bool(marked))
                bare.append(block not in LEAVES)
            linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at and not away:
            buffer.append(page[at:stop])
            if in_link:
                linked += stop - at
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in _ENDS and not closing:
            if not attributes.rstrip().endswith("/"):
                e = _ENDS[tag].search(page, at)
                if e is None and tag == "title":  # an open title ends with its line
                    at = page.find("\n", at) if "\n" in page[at:] else end
                else:
                    at = e.end() if e else end
            continue
        if away:
            if not closing and tag in ("article", "main", "body") and not away_comments and tag != away:
                away = ""  # left open before the article began
            else:
                if tag == away and tag not in VOID:
                    depth += -1 if closing else 1
                    if not depth:
                        away = ""
                continue
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag in INLINE and closing:
            continue
        kind = "" if closing else _kind(tag, attributes, bool(marked))
        if tag in INLINE and kind != "away":
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            block = "" if tag not in PARTS else block
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    for _, n, k in open_[i:]:
                        if k and marked and marked[-1] == n:
                            marked.pop()
                    del open_[i:]
                    break
            continue
        if kind == "away":
            if not attributes.rstrip().endswith("/"):
                away, depth = tag, 1
                away_comments = bool(re.search(r"comment|respond|disqus|discussion|repl", attributes, re.I))
            continue
        if tag == "p" or tag in ("li", "td", "th", "tr", "dt", "dd", "option") and open_ and open_[-1][0] == tag:
            while open_ and open_[-1][0] == "p" or open_ and tag != "p" and open_[-1][0] == tag:
                _, ended, _ = open_.pop()
                if marked and marked[-1] == ended:
                    marked.pop()
        block = tag
        if tag not in PARTS:
            number += 1
            open_.append((tag, number, kind))
            if kind == "article" or kind == "main" and not marked:
                marked.append(number)
    flush()
    return texts, sizes, articles, bare


def weights(sizes: list[int], articles: list[bool], bare: list[bool]) -> np.ndarray:
    """A line's length without links, and LINE, by the factors of its markup; a line of links alone weighs nothing, in an article EDGE."""
    x, inside, plain = np.asarray(sizes, dtype=np.float64), np.asarray(articles, dtype=bool), ~np.asarray(bare, dtype=bool)
    factor = np.ones(len(x))
    for part, other in ((plain, BARE), (inside, OUTSIDE)):
        if part.any() and x[part].sum() >= MARKED * x.sum():
            factor[~part] *= other
            factor[inside] = 1.0
    return np.where(x > 0, np.minimum(x + LINE, HEAVY) * factor, np.where(inside, EDGE, 0.0))


def core(x: np.ndarray, window: int = WINDOW, surge: float = SURGE, edge: float = EDGE) -> tuple[int, int]:
    """[start, end) of the region of most weight between a surge and a dive of the window sums."""
    x = np.asarray(x, dtype=np.float64)
    if not len(x):
        return 0, 0
    sums = np.convolve(x, np.ones(window))[window - 1 :]  # lines i to i + window - 1
    if not sums.max():
        return 0, len(x)
    high = np.concatenate(([0], (sums >= min(surge, sums.max())).astype(np.int8), [0]))
    starts, ends = np.flatnonzero(np.diff(high) > 0), np.flatnonzero(np.diff(high) < 0)
    ends = np.minimum(ends + window - 1, len(x))  # a window may start before its text, and end after it
    total = np.concatenate(([0], np.cumsum(x)))
    best = int(np.argmax(total[ends] - total[starts]))
    a, b = int(starts[best]), int(ends[best])
    edge = min(edge, x[a:b].max())
    while x[a] < edge:
        a += 1
    while x[b - 1] < edge:
        b -= 1
    return a, b


def extract(page: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    """The main text of a page, a line for each block."""
    if not page:
        return ""
    texts, sizes, articles, bare = lines_of(page)
    a, b = core(weights(sizes, articles, bare), window, surge)
    return "\n".join(texts[a:b])


def main_text(pages: DataFrame, window: int = WINDOW, surge: float = SURGE) -> DataFrame:
    """Of pages (page_id, url, html): page_id, url, text, n_chars; one row a page, no shuffle."""
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py(), window, surge) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
