"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of the greatest score: paths from there on are content.
THRESHOLD = 0.5
#: What the ratios of a path count for where the page itself says that it isn't the article.
DOUBT = 0.15
#: Gaussian weights over a text node's neighbours.
_KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2)

# Element names by their role in a page.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg object canvas select".split())
_ASIDE = frozenset("nav footer aside form button menu dialog header head".split())
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"),
}
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hr main menu nav ol p pre section table ul".split()
)
_CONTAINERS = frozenset("html body main article section div td table blockquote center".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BY_CLASS = frozenset("div section ul ol dl table fieldset details center".split())
_BOILERPLATE = re.compile(
    r"(?:^|\s)(?!with-|has-|no-)(?:[\w]+[-_])*(?:ads?|adverts?|advertisement|sponsored|promo|banner|cookies?|consent|gdpr|popup|modal|newsletter|"
    r"subscribe|sidebar|sidenav|menu|nav|navbar|navigation|breadcrumbs?|masthead|footer|share|social|toolbar|pagination|pager|login|signup)"
    r"(?:[-_][\w]+)*(?=$|\s)",
    re.I,
)
_HEADER = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.I)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|respond)(?=$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_TAG = re.compile(
    r"<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>])*+)>?)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
#: How sure a page is that an element isn't the article's: by a class or id (which an article within it
#: overrules), by its name or role, and for certain: hidden, or readers' comments.
_SURE_CLASS, _SURE_NAME, _CERTAIN = 1, 2, 3


def _apart(name: str, attributes: str, within: bool) -> int:
    """How sure the page is that an element isn't the article's; 0 if it says nothing. A header
    within an article is the article's own."""
    found = _SURE_NAME if name in _ASIDE else 0
    if not attributes.strip():
        return found
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id") and name in _BY_CLASS:
            if _COMMENTS.search(value):
                return _CERTAIN
            if _BOILERPLATE.search(value) or not within and _HEADER.search(value):
                found = max(found, _SURE_CLASS)
        elif key == "role" and value.lower() in _ROLES:
            found = max(found, _SURE_NAME)
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return _CERTAIN
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return _CERTAIN
    return found


class Page:
    """The blocks of text of a page in order, and its elements as a tree.

    ``texts``, and for each its tag path (a number), its innermost element and its characters in links;
    for each element its parent (-1: none), name and how sure the page is that it isn't the article's.
    A path is known by its parent's number and its last name, so that depth costs nothing. Inline elements
    don't end a block and aren't in paths; what browsers close unasked (p, li, td ...) is closed here too.
    """

    def __init__(self, html: str):
        self.texts: list[str] = []
        self.path: list[int] = []
        self.inside: list[int] = []
        self.linked: list[int] = []
        self.parent: list[int] = []
        self.names: list[str] = []
        self.apart: list[int] = []
        self._read(html)

    def _read(self, html: str) -> None:
        paths: dict[tuple[int, str], int] = {}
        stack: list[tuple[str, int, int, int, bool]] = []  # name, element, path, how sure, in an article
        count: dict[str, int] = defaultdict(int)
        parts: list[str] = []
        linked = in_link = at = 0

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                if text:
                    self.texts.append(text)
                    self.path.append(stack[-1][2] if stack else -1)
                    self.inside.append(stack[-1][1] if stack else -1)
                    self.linked.append(min(linked, len(text)))
                parts.clear()
            linked = 0

        def pop() -> None:
            count[stack.pop()[0]] -= 1

        while at < len(html):
            found = _TAG.search(html, at)
            upto = found.start() if found else len(html)
            if upto > at:
                parts.append(html[at:upto])
                linked += (upto - at) * (in_link > 0)
            if not found:
                break
            at = found.end()
            closing, name, attributes = found.groups()
            if not name:
                continue
            name = name.lower()
            if name in _INLINE:
                if name == "a":
                    in_link = 0 if closing else 1
                continue
            if name in _VOID:
                parts.append("\n")
                continue
            flush()
            in_link = 0
            if closing:
                if count[name]:
                    while stack[-1][0] != name:
                        pop()
                    pop()
                continue
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if attributes.endswith("/") and name not in _CONTAINERS and name not in _CLOSES_P:
                continue
            if stack and name in _CLOSES_P and stack[-1][0] == "p":
                pop()
            while stack and stack[-1][0] in _CLOSES.get(name, ()):
                pop()
            _, element, path, around, within = stack[-1] if stack else ("", -1, -1, 0, False)
            if name in ("article", "main"):
                sure, within = around if around > _SURE_CLASS else 0, True
            else:
                sure = max(around, _apart("div" if name == "header" and within else name, attributes, within))
            stack.append((name, len(self.names), paths.setdefault((path, name), len(paths)), sure, within))
            count[name] += 1
            self.parent.append(element)
            self.names.append(name)
            self.apart.append(sure)
        flush()

    def sure(self) -> np.ndarray:
        """For each block how sure the page is that it isn't the article's."""
        return np.array([self.apart[e] if e >= 0 else 0 for e in self.inside])

    def innermost(self, blocks: np.ndarray) -> int:
        """The innermost element that holds all of ``blocks``; -1 if there is none."""
        held = [0] * len(self.names)
        for b in blocks.tolist():
            if self.inside[b] >= 0:
                held[self.inside[b]] += 1
        for e in range(len(held) - 1, -1, -1):
            if held[e] == len(blocks):
                return e
            if self.parent[e] >= 0:
                held[self.parent[e]] += held[e]
        return -1

    def under(self, element: int) -> np.ndarray:
        """Whether each block is in ``element``."""
        of = [False] * len(self.names)
        for e in range(element, len(self.names)):
            of[e] = e == element or self.parent[e] >= 0 and of[self.parent[e]]
        return np.array([e >= 0 and of[e] for e in self.inside], dtype=bool)


def path_scores(page: Page) -> np.ndarray:
    """For each block the fused ratios of its tag path.

    Of each path the length of text outside links and the number of punctuation marks, each per block of
    the path; their square roots, smoothed over the neighbouring blocks (which may lower them only)
    and scaled by the largest, are averaged over both ratios and over the blocks of the path.
    What the page itself sets apart counts for DOUBT of that, or nothing if it is certain.
    """
    path = np.array(page.path) + 1
    blocks = np.bincount(path, minlength=path.max(initial=0) + 1)
    outside = np.array([len(t) - n for t, n in zip(page.texts, page.linked)], dtype=float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in page.texts], dtype=float)
    fused = np.zeros(len(path))
    for amount in (outside, marks):
        ratio = np.sqrt(np.bincount(path, amount, len(blocks)) / np.maximum(blocks, 1))[path]
        if len(path) > 4:
            around = np.convolve(ratio, _KERNEL, "same") / np.convolve(np.ones(len(path)), _KERNEL, "same")
            ratio = np.minimum(ratio, around)
        fused += ratio / max(ratio.max(initial=0), 1e-9) / 2
    score = (np.bincount(path, fused, len(blocks)) / np.maximum(blocks, 1))[path]
    return score * np.array([1, DOUBT, DOUBT, 0])[page.sure()]


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by one space.

    The blocks of the tag paths whose score reaches THRESHOLD of the greatest are content; the article is the innermost
    container that holds all of them, or the outermost article or main element around them. Of
    its blocks go those that the ratios reject and that the page sets apart too (a menu, an advert, ...), and
    what is hidden or readers' comments; short blocks, headings and captions stay. Where content fills no
    container under body, it goes from the first to the last of its blocks, with the headings around them.
    Null, empty and textless pages give the empty string.
    """
    page = Page(html or "")
    if not page.texts:
        return ""
    scores, sure = path_scores(page), page.sure()
    content = (scores > 0) & (scores >= THRESHOLD * scores.max())
    if not content.any():
        return ""
    at = np.nonzero(content)[0]
    article = page.innermost(at)
    while article >= 0 and page.names[article] not in _CONTAINERS:
        article = page.parent[article]
    above = article
    while above >= 0:
        if page.names[above] in ("article", "main"):
            article = above
        above = page.parent[above]
    if article < 0 or page.names[article] in ("html", "body"):
        k = np.arange(len(sure))
        heading = np.array([e >= 0 and page.names[e] in _HEADINGS for e in page.inside])
        kept = heading | (k >= at[0]) & (k <= at[-1])
    else:
        kept = page.under(article)
    kept &= content | (sure == 0)
    return " ".join(t for t, k in zip(page.texts, kept) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row: the main text of the whole html and its code
    points. Ids and urls are passed on as they are, nulls and repeats too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [main_text(h.as_py()) for h in batch.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(rows, "page_id long, url string, text string, n_chars long")
