"""Main text of web pages from the standard library's streaming parser events.

A page becomes lines, one per block element; each has a text-to-tag ratio (characters over tags met in it). The ratios are
smoothed with a Gaussian and clustered by a threshold between dense and sparse lines. The content region is the element
that holds the dense lines: the page's articles (or its main element) where it has them, else the innermost element that
holds all lines that are dense by themselves and after smoothing. The headings right before that element are kept, and of
the lines directly in an element around it the earlier headings and those that smoothing makes dense. Every line of the
region is kept, short ones too; menus, page headers and footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are left out wherever they stand.

Edge cases: null and empty html give an empty text; unclosed and stray tags are tolerated; pages of any length are read to
the end, in pieces; repeated rows are extracted each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, ship

#: Elements whose text is never content; headings; elements that hold others; and so on.
NEVER = frozenset("script style head noscript template svg math canvas iframe object select button form nav aside dialog menu textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOLDERS = frozenset("article main section div td body".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whole class, id or role names of what is not content; of them, those that mark it outside articles only.
MARKED = re.compile(
    r"(?:js-|is-|c-|m-|site-|page-|post-|article-|entry-|main-|top-|bottom-|left-|right-|global-|the-)*"
    r"(?:ads?|ad[-_](?:\w+)|advert\w*|sponsor\w*|promo\w*|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|cookies?|consent|gdpr|notices?|banner|pop-?up|modal"
    r"|newsletter|subscribe|share|sharing|social|comments?|commentlist|reply|replies|disqus|respond|related|recommend\w*|widget|masthead|toolbar|pager|pagination|skip)"
    r"(?:[-_](?:bar|box|section|area|wrap|wrapper|container|list|block|inner|links?|menu|form|thread|posts?|articles?|content|primary|secondary|main|banner|notice|modal|popup|overlay|message|top|bottom|left|right|items?|widget|unit|slot|label|\d+))*",
)
MARKED_OUTSIDE = re.compile(r"(?:site|page|global|main|top)?[-_]?(?:header|footer|topbar)(?:[-_]\w+)*")
PIECE = 1 << 16
SIGMA = 1.0


class Lines(HTMLParser):
    """Collects (text, tags, holder, heading) lines; holders form a tree (parent, tag)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []
        self.holders: list[tuple[int, str]] = [(-1, "")]
        self.stack: list[tuple[str, bool, int]] = []  # tag, whether it hides its text, holder
        self.open: dict[str, int] = {}  # how often each tag stands in the stack
        self.hidden = 0
        self.inside = 0  # articles or mains around
        self.holder = 0
        self.heading = False
        self.parts: list[str] = []
        self.tags = 0

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.holder, self.heading))
            self.parts = []
        self.tags = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in INLINE:
            if tag == "br" and self.parts:
                self.parts.append(" ")
            return
        self.flush()
        self.heading = tag in HEADINGS
        if tag in VOID or tag == "p" or tag == "li" and not attrs:
            return
        if tag == "body":
            while self.stack:  # an unclosed head hides nothing
                self.pop()
        if (tag == "article" or tag == "main") and self.hidden:
            while self.stack and self.stack[-1][0] in ("nav", "header", "footer", "aside", "ul", "ol", "div") and self.stack[-1][1]:
                self.pop()  # an unclosed menu does not swallow the article
        hide = tag in NEVER or tag == "footer" or tag == "header" and not self.inside
        if not hide and attrs and tag not in ("body", "html", "main", "article"):
            names = [x.lower() for k, v in attrs if v and k in ("class", "id", "role") for x in v.split()]
            hide = any(MARKED.fullmatch(x) or MARKED_OUTSIDE.fullmatch(x) and not self.inside for x in names)
        if hide or tag in HOLDERS or self.stack:
            self.stack.append((tag, hide, self.holder))
            self.open[tag] = self.open.get(tag, 0) + 1
            self.hidden += hide
            if tag in HOLDERS:
                self.inside += tag in ("article", "main")
                self.holders.append((self.holder, tag))
                self.holder = len(self.holders) - 1

    def pop(self):
        tag, hide, self.holder = self.stack.pop()
        self.open[tag] -= 1
        self.hidden -= hide
        self.inside -= tag in ("article", "main")

    def handle_endtag(self, tag):
        if tag in INLINE:
            return
        self.flush()
        self.heading = False
        if self.open.get(tag):
            while self.stack:
                top = self.stack[-1][0]
                self.pop()
                if top == tag:
                    break

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag in INLINE:
            self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def dense(ratios: list[float]) -> tuple[list[bool], list[bool]]:
    """Lines whose smoothed ratio lies on the upper side of the threshold that parts the two clusters, and those of them
    whose own ratio does too."""
    w = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(3)]
    n = len(ratios)
    smooth = []
    for i in range(n):
        total = weight = 0.0
        for k in range(-2, 3):
            if 0 <= i + k < n:
                total += w[abs(k)] * ratios[i + k]
                weight += w[abs(k)]
        smooth.append(math.log1p(total / weight))
    low, high = min(smooth), max(smooth)
    for _ in range(20):
        cut = (low + high) / 2
        above, below = [x for x in smooth if x >= cut], [x for x in smooth if x < cut]
        if not above or not below:
            return [True] * n, [True] * n
        low, high, was = sum(below) / len(below), sum(above) / len(above), cut
        if abs((low + high) / 2 - was) < 1e-9:
            break
    cut = (low + high) / 2
    rich = [x >= cut for x in smooth]
    own = [r and math.log1p(x) >= cut for r, x in zip(rich, ratios)]
    return rich, own if any(own) else rich


def main_text(html: str | None) -> str:
    if not html:
        return ""
    p = Lines()
    for a in range(0, len(html), PIECE):
        p.feed(html[a : a + PIECE])
    p.close()
    p.flush()
    lines, holders = p.lines, p.holders
    if not lines:
        return ""
    # holders come after those around them: sums go up by one pass from the last, marks down by one from the first
    ups = [up for up, _ in holders]
    rich, own = dense([len(t) / max(1, tags) for t, tags, _, _ in lines])
    mass, cores = [0] * len(holders), [0] * len(holders)
    for (t, _, h, _), d, o in zip(lines, rich, own):
        mass[h] += len(t) * d
        cores[h] += o
    for i in range(len(holders) - 1, 0, -1):
        mass[ups[i]] += mass[i]
        cores[ups[i]] += cores[i]

    def within(roots: set[int]) -> list[bool]:
        out = []
        for i, up in enumerate(ups):
            out.append(i in roots or up >= 0 and out[up])
        return out

    for kind in ("article", "main"):
        roots = {i for i, (_, tag) in enumerate(holders) if tag == kind and mass[i]}
        if roots:
            into = within(roots)
            return "\n".join(t for t, _, h, _ in lines if into[h])
    root = max(i for i, n in enumerate(cores) if n == cores[0])  # holders that have all dense lines lie in one another
    into, above, i = within({root}), {root}, root
    while i:
        i = ups[i]
        above.add(i)
    first = next(i for i, (_, _, h, _) in enumerate(lines) if into[h])
    near = first
    while near and lines[near - 1][3]:
        near -= 1
    return "\n".join(
        t for i, (t, _, h, heading) in enumerate(lines) if into[h] or near <= i < first or h in above and (rich[i] or heading and i < first)
    )


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _extract(batches):
    for b in batches:
        for a in range(0, b.num_rows, 256):
            part = b.slice(a, 256)
            yield batch_of(TEXTS, [part.column(0), part.column(1), [main_text(h.as_py()) for h in part.column(2)]])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages(page_id, url, html)``; no shuffle."""
    ship(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string")
