"""Main text of web pages by line-block distribution.

Markup is stripped so that every block becomes a line; what is surely not the article
(menus, notices, forms, scripts, comments ...) leaves empty lines behind. The lengths of the
lines, without link text, are summed over a sliding window of lines: a surge is where the
sums rise from nothing to at least a threshold, a dive where they fall back to nothing, and
the text between a surge and its dive is kept.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.common import each_text

#: Lines in a window, and the characters outside links that make a surge.
WINDOW, SURGE = 3, 80
#: A character inside an article or main element counts as much as this many elsewhere.
INSIDE = 4

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z))",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that are no article text wherever they stand.
ASIDE = frozenset(
    "nav footer aside form button select dialog menu object canvas audio video fieldset head".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
#: Parts of a class or id that mark an element as no article text, wherever it stands.
STRONG = frozenset(
    "ad ads adv adsense share sharing social related recommended recommendations subscribe "
    "subscription signup modal overlay footer sidenav menu nav navbar navigation pagination pager "
    "copyright disclaimer notice notices notification consent gdpr paywall login skip replies "
    "respond".split()
)
#: Stems: a part that begins or ends with one is such a part too.
STEMS = (
    "comment", "advert", "sponsor", "sidebar", "cookie", "newsletter", "breadcrumb", "disqus",
    "popup", "promo", "banner", "comments", "navbar", "topmenu", "mainmenu",
)
#: The same, unless it stands in the article or the name also speaks of content.
WEAK = frozenset("header masthead topbar toolbar widget widgets alert tools search".split())
CONTENT = frozenset("content article post entry main story body text".split())
#: A name such as has-sidebar or no-ads describes what the element holds.
MODIFIERS = frozenset("has with no without is".split())
ARTICLE = frozenset(("article", "main"))
CONTAINERS = frozenset(("article", "main", "body", "html"))
#: Elements that lines stand in, but that hold no part of a page of their own.
PARAGRAPHS = INLINE | frozenset(
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th "
    "figure figcaption center body html".split()
)
#: An opening tag of the second kind ends an open element of the first.
IMPLIED_END = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figcaption figure footer form "
        "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "option": frozenset(("option",)),
}


def no_article(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element is no article text; inside: whether it stands in the article."""
    if name in ASIDE or name == "header" and not inside:
        return True
    if name in ("body", "html") or len(attrs) < 4:
        return False
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none", found.get("style", ""), re.IGNORECASE):
        return True
    for label in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = {p.lower() for p in PART.findall(label)}
        comment = any(p.startswith("comment") for p in parts)
        if parts & MODIFIERS or name in ARTICLE and not comment:
            continue
        if "content" in parts and "sidebar" in parts:  # holds both
            continue
        if parts & STRONG or any(p.startswith(STEMS) or p.endswith(STEMS) for p in parts):
            return True
        if parts & WEAK and not inside and not parts & CONTENT:
            return True
    return False


class Lines:
    """The lines of a page: text, length outside links, whether it is in an article, container.

    containers are numbers of the open elements that hold parts of a page, the innermost last;
    0 is the page.
    """

    def __init__(self):
        self.containers: list[int] = [0]
        self.container: list[int] = []
        self.text: list[str] = []
        self.weight: list[int] = []
        self.inside: list[bool] = []
        self.any_inside = False
        self.parts: list[str] = []
        self.open_weight = 0

    def add(self, text: str, linked: bool) -> None:
        self.parts.append(text)
        self.open_weight += 0 if linked else len(text.strip())

    def end(self, inside: bool) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.text.append(text)
                self.weight.append(self.open_weight)
                self.inside.append(inside)
                self.any_inside |= inside
                self.container.append(self.containers[-1])
            self.parts, self.open_weight = [], 0

    def gap(self, inside: bool) -> None:
        self.end(inside)
        if self.text and self.text[-1]:
            self.text += [""] * WINDOW
            self.weight += [0] * WINDOW
            self.inside += [False] * WINDOW
            self.container += [0] * WINDOW


class OpenElements:
    """The elements that are open: (name, skipped, inside), the innermost last.

    Where each name and each container was opened is kept, so that neither an end tag that
    closes nothing nor an article looks through all of them.
    """

    def __init__(self):
        self.stack = [("", False, False)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.holders: list[int] = []
        self.hidden: list[int] = []

    def push(self, name: str, skipped: bool, inside: bool) -> None:
        depth = len(self.stack)
        self.stack.append((name, skipped, inside))
        self.places[name].append(depth)
        if name in CONTAINERS:
            self.holders.append(depth)
        if skipped:
            self.hidden.append(depth)

    def cut(self, depth: int) -> None:
        """Close the element at this depth and all in it."""
        for name, *_ in self.stack[depth:]:
            self.places[name].pop()
        del self.stack[depth:]
        for depths in (self.holders, self.hidden):
            while depths and depths[-1] >= depth:
                depths.pop()

    def closed_by(self, name: str) -> int:
        """How deep the element that an end tag closes is, or 0; only containers reach out of one."""
        depth = self.places[name][-1] if self.places[name] else 0
        within = name in CONTAINERS or not self.holders or self.holders[-1] < depth
        return depth if within else 0


def lines_of(page: str) -> Lines:
    lines, elements = Lines(), OpenElements()
    stack, links = elements.stack, elements.places["a"]
    containers, at, count = lines.containers, 0, 0
    while match := TOKEN.search(page, at):
        _, skipped, inside = stack[-1]
        if match.start() > at and not skipped:
            lines.add(html.unescape(page[at : match.start()]), bool(links))
        at = match.end()
        name = (match["name"] or "").lower()
        if not name:
            continue
        if match["close"]:
            if name not in INLINE and not skipped:
                lines.end(inside)
            if depth := elements.closed_by(name):
                elements.cut(depth)
                del containers[depth:]
                if (skipped, inside) != stack[-1][1:]:
                    lines.gap(inside and not skipped)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        while stack[-1][0] in IMPLIED_END and name in IMPLIED_END[stack[-1][0]]:
            was = stack[-1][1:]
            lines.end(was[1])
            elements.cut(len(stack) - 1)
            containers.pop()
            if was != stack[-1][1:]:
                lines.gap(was[1] and not was[0])
        _, skipped, inside = stack[-1]
        if name not in INLINE and not skipped:
            lines.end(inside)
        if name in VOID or match["attrs"].endswith("/>"):
            continue
        now = skipped or no_article(name, match["attrs"], inside), inside or name in ARTICLE
        if skipped and name in ARTICLE and not lines.any_inside:
            # The first article inside a div that should be none: the div was not closed.
            root = stack[elements.hidden[0]][0]
            now = root not in ("div", "section") or no_article(name, match["attrs"], inside), True
        if now != (skipped, inside):
            lines.gap(inside and not skipped)
        elements.push(name, *now)
        count += 1
        containers.append(containers[-1] if name in PARAGRAPHS else count)
    _, skipped, inside = stack[-1]
    if not skipped:
        lines.add(html.unescape(page[at:]), bool(links))
    lines.end(inside)
    return lines


def surges(weight: np.ndarray, least: int) -> tuple[list[tuple[int, int]], list[bool]]:
    """The runs of lines between a rise from nothing and the fall back, and which surge."""
    padded = np.concatenate([np.zeros(WINDOW - 1, int), weight, np.zeros(WINDOW, int)])
    sums = np.convolve(padded, np.ones(WINDOW, int), "valid")  # window i ends at line i
    edges = np.flatnonzero(np.diff(np.concatenate([[0], sums > 0, [0]])))
    runs = [(a, b) for a, b in edges.reshape(-1, 2).tolist()]
    surging = [bool(sums[a:b].max() >= least) for a, b in runs]
    if runs and not any(surging):
        surging[max(range(len(runs)), key=lambda n: sums[slice(*runs[n])].sum())] = True
    return runs, surging


def kept_blocks(lines: Lines) -> list[str]:
    """The lines between surges and dives.

    Lines inside articles are the text, unless the surging runs elsewhere have over INSIDE
    times as many characters: then the articles are teasers in a page whose text stands
    elsewhere, and all lines count alike. A run that does not surge is kept with a
    neighbouring one that is if both have lines of one container.
    """
    if not any(lines.text):
        return []
    weight, filled = np.array(lines.weight), np.array([bool(t) for t in lines.text])
    inside = np.array(lines.inside)
    if inside.any():
        within = np.where(inside, np.maximum(weight, filled), 0)
        elsewhere = np.where(inside, 0, weight)
        runs, surging = surges(elsewhere, SURGE)
        other = sum(int(elsewhere[a:b].sum()) for (a, b), s in zip(runs, surging, strict=True) if s)
        if other < SURGE or other <= INSIDE * int(within.sum()):
            # Every line of an article is its text, links and short lines too.
            return [t for t, i in zip(lines.text, lines.inside, strict=True) if t and i]
    runs, surging = surges(weight, SURGE)
    held = [{c for c in lines.container[a:b] if c} for a, b in runs]
    whole = surging.copy()
    for order in (range(1, len(runs)), range(len(runs) - 2, -1, -1)):
        step = order.step
        for n in order:
            if not whole[n] and whole[n - step] and (shared := held[n] & held[n - step]):
                whole[n], held[n] = True, shared
    return [
        t
        for (a, b), kept, alike, s in zip(runs, whole, held, surging, strict=True)
        if kept
        for t, c in zip(lines.text[a:b], lines.container[a:b], strict=True)
        if t and (s or c in alike)
    ]


def _make() -> Callable:
    def one(page: str) -> tuple:
        blocks = kept_blocks(lines_of(page))
        return blocks, " ".join(blocks)

    return lambda pages: map(one, pages)


def main_text(pages: DataFrame, markup: str = "html") -> DataFrame:
    """Adds `article`: struct<blocks, text> to every page, and keeps the rest.

    Character references are decoded, white space in a block becomes one space, blocks are
    joined by one space in page order. On a page with article or main elements the article
    is all lines inside them, unless surging lines elsewhere are over INSIDE times as long;
    there and on other pages the surge threshold decides, and where nothing reaches it, the
    largest run of lines is taken. Null and empty pages have no blocks and the text "".
    Plain text without markup is kept. Rows are independent: repeated rows give repeated
    results, an empty table an empty one. A column `article` of the input is replaced.
    """
    return pages.withColumn(
        "article", each_text(_make, "blocks array<string>; text string")(F.col(markup))
    )


def page_texts(pages: DataFrame) -> DataFrame:
    """Per page its main text and that text's length in code points."""
    return main_text(pages.select("page_id", "url", "html")).select(
        "page_id",
        "url",
        F.col("article.text").alias("text"),
        F.length("article.text").cast("bigint").alias("n_chars"),
    )
