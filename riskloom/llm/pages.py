"""Main text of HTML pages from parser events, text-to-tag ratios and a threshold.

The parser's events are cut into lines, one for each block. The ratio of a line's characters to
its tags, cut off at a bound so that no long paragraph outweighs the rest, is smoothed with a
Gaussian over its neighbours; lines at or above the standard deviation of the smoothed ratios are
content, and a container most of whose text is content is taken whole, so that the short lines of
an article stay. An article is one container with all that it holds. Menus, forms and the like are
left out by element and by the names that pages give them.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

SIGMA = 1.0
RADIUS = 2
# Characters a tag from which on a line is a paragraph; more is no further evidence.
ENOUGH = 100.0
# Elements that never hold main text, and words of class, id and role that mark such parts.
BOILERPLATE = frozenset("head nav footer aside form button select textarea script style noscript template iframe svg object dialog menu".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu nav "
    "navbar navigation newsletter notice notices popup promo promoted promotion related replies share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget complementary contentinfo dialog search alert".split())
# Words that may go with one of NAMES in a hyphenated name; with any other word it names something else ("related-work", "with-sidebar").
QUALIFIERS = frozenset(
    "area articles bar block blog body bottom bottoms box btn button buttons center column container desktop entry form global group header icon icons "
    "inner item items label left line link links list main mobile outer page panel popular post posts primary region respond right row secondary "
    "section sections site slot sticky sub text title top unit user users view wrap wrapper".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An element that ends an open one of these when it starts.
CLOSES = {"p": ("p",), "li": ("p", "li"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr"),
          "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "option": ("option",), "body": ("head",)}
# Elements that no name hides: articles only where they are not within another one.
KEPT = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def named(attribute: str, value: str) -> bool:
    """Whether a class, an id or a role is a name of boilerplate, or an aria-label as a whole is."""
    for token in [value] if attribute == "aria-label" else value.split():
        found = _WORD.findall(token.lower())
        if not NAMES.isdisjoint(found) and all(w in NAMES or w in QUALIFIERS for w in found):
            return True
    return False


class Lines(HTMLParser):
    """Collects (pieces, tags, container, unit) of every block outside boilerplate elements.

    A piece is a text and the innermost named element that holds it; ``texts`` decides on those at
    the end. The unit is the outermost article that holds the block, else the innermost main.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[tuple[str, int]], int, int, int]] = []
        self.stack: list[tuple[str, bool, int, int, int]] = []  # tag, boilerplate, container, named element, unit
        self.buffer: list[tuple[str, int]] = []
        self.tags = self.made = 0
        self.outer = [0]  # of each named element the one around it; 0 is the page
        self.marks: list[int] = []  # the named element around each h1 and main
        self.articles: dict[int, int] = {}  # the named element around each unit that is an article
        self.units: set[int] = set()

    @property
    def hidden(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    def flush(self) -> None:
        if self.buffer and any(not t.isspace() for t, _ in self.buffer):
            _, _, container, _, unit = self.stack[-1] if self.stack else ("", False, 0, 0, 0)
            self.lines.append((self.buffer, max(1, self.tags), container, unit))
        self.buffer, self.tags = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        ends = CLOSES.get(tag, ("p",) if tag in BLOCKS else ())
        if ends:
            for at in range(len(self.stack) - 1, -1, -1):
                open_tag = self.stack[at][0]
                if open_tag in ends:
                    del self.stack[at:]
                    break
                if open_tag in BLOCKS or open_tag in BOILERPLATE:
                    break
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.buffer.append((" ", self.stack[-1][3] if self.stack else 0))
            return
        hidden = self.hidden or tag in BOILERPLATE
        _, _, container, name, unit = self.stack[-1] if self.stack else ("", False, 0, 0, 0)
        if not hidden and tag not in ("html", "body"):
            hidden = tag == "header" and not any(t in ("article", "main") for t, *_ in self.stack) or any(n == "hidden" for n, _ in attrs)
            if tag not in KEPT and not (tag == "article" and unit not in self.articles):
                if any(n in ("class", "id", "role", "aria-label") and v and named(n, v) for n, v in attrs):
                    self.outer.append(name)
                    name = len(self.outer) - 1
        if tag in CONTAINERS:
            self.made += 1
            container = self.made
        if not hidden:
            if tag in ("h1", "main"):
                self.marks.append(name)
            if tag == "main" and unit not in self.articles:
                unit = container
                self.units.add(unit)
            elif tag == "article" and unit not in self.articles:
                unit = container
                self.units.add(unit)
                self.articles[unit] = name
        self.stack.append((tag, hidden, container, name, unit))

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                if tag in BOILERPLATE:
                    self.flush()
                del self.stack[at:]
                return

    def handle_data(self, data):
        if not self.hidden:
            self.buffer.append((data, self.stack[-1][3] if self.stack else 0))

    def close(self):
        super().close()
        self.flush()

    def around(self, name: int) -> list[int]:
        """A named element and all named ones around it."""
        out = []
        while name:
            out.append(name)
            name = self.outer[name]
        return out

    def texts(self) -> list[tuple[str, int, int, int]]:
        """(text, tags, container, unit) of the lines without what names hide.

        A name hides nothing if its element holds a main, an h1 or the longest article. Where the page has none of
        these outside it, neither does one that holds most of the text.
        """
        shown = set()
        if len(self.outer) > 1:
            sizes, of_article = [0] * len(self.outer), dict.fromkeys(self.articles, 0)
            total = 0
            for pieces, _, _, unit in self.lines:
                for text, name in pieces:
                    n = len(text.strip())
                    total += n
                    for around in self.around(name):
                        sizes[around] += n
                    if unit in of_article:
                        of_article[unit] += n
            marks = [*self.marks, *([self.articles[max(of_article, key=of_article.__getitem__)]] if of_article else [])]
            for mark in marks:
                shown.update(self.around(mark))
            if not marks:
                shown.update(name for name in range(1, len(self.outer)) if 2 * sizes[name] > total)
        hides = [not shown.issuperset(self.around(name)) for name in range(len(self.outer))]
        out = []
        for pieces, tags, container, unit in self.lines:
            text = _SPACE.sub(" ", "".join(t for t, name in pieces if not hides[name])).strip()
            if text:
                out.append((text, tags, container, unit))
        return out


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian mean over ``radius`` neighbours on each side; at the ends over those there are."""
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    near = np.convolve(ratios, weights)[radius : radius + len(ratios)]
    return near / np.convolve(np.ones(len(ratios)), weights)[radius : radius + len(ratios)]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.texts()
    if not lines:
        return ""
    sizes = np.array([len(t) for t, *_ in lines], dtype=float)
    ratios = np.minimum(sizes / np.array([n for _, n, *_ in lines]), ENOUGH)
    near = smoothed(ratios)
    cut = near.std()
    content = near >= cut
    own = content & (ratios >= cut)
    held: dict[int, list[float]] = {}
    units = [unit or container for _, _, container, unit in lines]
    for size, yes, unit in zip(sizes, content, units):
        of = held.setdefault(unit, [0.0, 0.0])
        of[0] += size
        of[1] += size * yes
    whole = {unit for unit, (size, yes) in held.items() if 2 * yes >= size}
    # The page's longest article, or its main text if it has none, is what the page is about.
    about = [u for u in held if u in parser.articles] or [u for u in held if u in parser.units]
    if about:
        whole.add(max(about, key=lambda u: held[u][0]))
    return "\n\n".join(line[0] for line, unit, yes in zip(lines, units, own) if yes or unit in whole)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html; other columns are ignored).

    Null, empty and text-less pages give an empty text. Repeated rows each return one.
    """

    def make():
        def of(batch):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64())}

        return of

    return per_batch(
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")),
        "page_id long, url string, text string, n_chars long", make, rows=256)
