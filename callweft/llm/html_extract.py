"""HTML extraction by tree scoring.

A page becomes a tree of its elements. Each paragraph passes points for its length and its commas to
its container and half of them to the container above; a container's points are discounted by the share
of its text inside links. Names of class, id and role only lower the points that pass through a
container. The best container and the siblings that score well beside it are kept, level by level upwards;
containers inside it that pass on next to nothing because of their names are left out.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element groups of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: An element of the key is closed by the start of one of these, up to the list or table around it.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol menu dl table select html body article div section td th".split())
#: Elements that are never part of an article, forms only where they don't hold most of the page's text. A header is one
#: unless it stands in an article or section, or among the paragraphs of another element.
DROPPED = frozenset("head script style noscript template iframe svg canvas object nav menu footer aside form button select textarea dialog".split())
PARTS = frozenset("article section main".split())
#: Words of class, id and role that tell of a part beside the article.
TELLING = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets ad ads adv advert adverts advertisement"
    " advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter"
    " subscribe subscription share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond discussion"
    " login signup signin search form toolbar pagination pager skip contentinfo complementary".split()
)
#: Words that may stand beside a telling one; a name with any other word tells nothing.
NEUTRAL = frozenset("the a of and box list wrap wrapper section area container block inner outer row col bar links link posts post articles items item group main page site top bottom left right side content text js c".split())
#: Share of their points that blocks below a container with a telling name pass on.
LOWERED = 0.1
#: Elements whose names lower nothing: text blocks, and what holds the whole page.
PLAIN = frozenset("html body main p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th figcaption address".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S
)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
LEAST_LENGTH = 25
COMMA = re.compile("[,،、，]")


def telling(attrs: str) -> bool:
    """Whether a class, id or role names a part beside the article: a telling word, and no words but neutral ones with it."""
    for found in NAMES.findall(attrs):
        for name in " ".join(found).split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if w]
            if not TELLING.isdisjoint(words) and all(w in TELLING or w in NEUTRAL for w in words):
                return True
    return False


class Page:
    """Elements (parent, tag, lowered) and text blocks (element, text, characters inside links) of a page."""

    def __init__(self, html: str, forms: bool = False, heads: frozenset[int] = frozenset()):
        """``forms``: read forms like other elements; ``heads``: numbers of headers that are read too."""
        self.dropping = DROPPED - {"form"} if forms else DROPPED
        self.in_forms = 0  # characters that were left out for a form around them alone
        self.heads, self.n_headers = heads, 0
        self.headers: list[tuple[int, int]] = []  # element around, number: headers that were left out
        self.parent, self.tag, self.lowered = [-1], ["#root"], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self.open: list[int] = [0]
        self.holders: list[int] = [0]  # the open elements that aren't inline
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # by tag: where its open elements stand in self.open
        self.pieces: list[str] = []
        self.links = self.in_link = 0
        self.dropped = 0  # place in self.open of the outermost dropped element
        at, end = 0, len(html)
        while at < end:
            match = TOKEN.search(html, at)
            if not match:
                self.text(html[at:])
                break
            if match.start() > at:
                self.text(html[at : match.start()])
            at = match.end()
            tag = match["tag"]
            if not tag:
                continue
            tag = tag.lower()
            if match["end"]:
                self.close_to((tag,), SCOPE if tag in INLINE or tag == "p" else ())
                continue
            self.start(tag, match["attrs"])
            if tag in RAW:
                stop = re.compile(f"</{tag}[\\s/>]", re.I).search(html, at)
                at = stop.start() if stop else end
        self.flush()

    def text(self, raw: str) -> None:
        if self.dropped:
            if self.tag[self.open[self.dropped]] == "form" and not any(self.places[t] for t in DROPPED if t != "form"):
                self.in_forms += len(raw.strip())
            return
        self.pieces.append(raw)
        if self.in_link:
            self.links += len(raw)

    def is_page_header(self, tag: str) -> bool:
        return tag == "header" and self.n_headers not in self.heads and not any(self.places[t] for t in PARTS)

    def flush(self) -> None:
        if self.pieces:
            raw = "".join(self.pieces)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                self.blocks.append((self.holders[-1], text, min(self.links, len(text))))
            self.pieces.clear()
        self.links = 0

    def pop(self) -> None:
        tag = self.tag[self.open.pop()]
        self.places[tag].pop()
        if tag == "a":
            self.in_link -= 1
        if len(self.open) == self.dropped:
            self.dropped = 0
        if tag not in INLINE:
            self.flush()
            self.holders.pop()

    def close_to(self, tags, stop) -> None:
        """Close the innermost open element of these tags with all inside it, if none of ``stop`` is in between."""
        at = max((self.places[t][-1] for t in tags if self.places[t]), default=0)
        if at and not any(self.places[t] and self.places[t][-1] > at for t in stop):
            while len(self.open) > at:
                self.pop()

    def start(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P:
            self.close_to(("p",), SCOPE)
        if tag in IMPLIED:
            self.close_to(IMPLIED[tag], SCOPE - {"td", "th"} if tag == "tr" else SCOPE - set(IMPLIED[tag]))
        if tag in VOID:
            if tag == "br":
                self.text(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.lowered.append(bool(attrs) and tag not in PLAIN and telling(attrs))
        self.n_headers += tag == "header"
        if not self.dropped and (tag in self.dropping or self.is_page_header(tag)):
            if tag == "header":
                self.headers.append((self.open[-1], self.n_headers))
            if tag in INLINE:
                self.text(" ")
            self.dropped = len(self.open)
        self.open.append(len(self.tag) - 1)
        self.places[tag].append(len(self.open) - 1)
        if tag == "a":
            self.in_link += 1
        if tag not in INLINE:
            self.holders.append(self.open[-1])


PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th figcaption address".split())
LISTS = frozenset("ul ol table".split())
TITLES = frozenset(("h1", "h2"))
#: Elements whose siblings aren't looked at, and the points that such an element starts with.
WHOLE = frozenset("article main".split())
PRIOR = 5.0
#: Least share of the kept points that a sibling needs.
BESIDE = 0.2


class Scores:
    """Points and text lengths of a page's elements; parents stand before their children, so sums run backwards once."""

    def __init__(self, page: Page):
        n = len(page.tag)
        parent = page.parent
        weight = [1.0] * n
        for i in range(1, n):
            weight[i] = LOWERED if page.lowered[i] else weight[parent[i]]
        points, self.total, self.length, self.links = [0.0] * n, [0.0] * n, [0] * n, [0] * n
        for node, text, inside in page.blocks:
            self.length[node] += len(text)
            self.links[node] += inside
            if len(text) >= LEAST_LENGTH:
                worth = weight[node] * (1 + len(text) / 100 + len(COMMA.findall(text))) * (1 - inside / len(text))
                self.total[node] += worth
                holder = parent[node] if page.tag[node] in PARAGRAPHS else node
                points[holder] += worth
                if parent[holder] >= 0:
                    points[parent[holder]] += worth / 2
        for i in range(n - 1, 0, -1):
            self.total[parent[i]] += self.total[i]
            self.length[parent[i]] += self.length[i]
            self.links[parent[i]] += self.links[i]
        for i in range(n):
            if page.tag[i] in WHOLE and self.length[i]:
                points[i] += PRIOR * weight[i]
        self.score = [p * (1 - self.density(i)) for i, p in enumerate(points)]

    def density(self, node: int) -> float:
        """Share of an element's text that stands inside links."""
        return self.links[node] / self.length[node] if self.length[node] else 0.0


def kept_elements(page: Page, scores: Scores) -> set[int]:
    """The best container with what scores well beside it, and beside the containers around it.

    Siblings with a share of its points stay on every level up to the article or main element around it, text blocks
    without many links beside itself and beside its parent, and before it parts that hold the page's headline.
    """
    parent = page.parent
    best = max(range(len(parent)), key=lambda i: (scores.score[i], -i))
    if not scores.score[best]:
        return {0}
    children: dict[int, list[int]] = {}
    titled = [tag in TITLES for tag in page.tag]
    for i in range(len(parent) - 1, 0, -1):
        titled[parent[i]] |= titled[i]
        if scores.length[i]:
            children.setdefault(parent[i], []).append(i)
    kept, points, node, level = {best}, scores.total[best], best, 0
    while node > 0 and page.tag[node] not in WHOLE:
        for i in children[parent[node]]:
            if i != node and scores.density(i) < 0.5:
                plain = scores.density(i) < 0.25 and not page.lowered[i]
                block = level < 2 and plain and (page.tag[i] in PARAGRAPHS or (i < node and titled[i]))
                if block or scores.total[i] >= max(2.0, BESIDE * points):
                    kept.add(i)
                    points += scores.total[i]
        node, level = parent[node], level + 1
    return kept


def parsed(html: str) -> Page:
    """The page; read again where most of its text stands in a form, or where a header stands among an element's paragraphs.

    Such a header, beside two paragraphs or more of its own parent, is an article's; others outside articles are the page's.
    """
    page = Page(html)
    forms = page.in_forms > sum(len(text) for _, text, _ in page.blocks)
    page = Page(html, forms) if forms else page
    paragraphs = Counter(page.parent[node] for node, text, _ in page.blocks if page.tag[node] == "p" and len(text) >= LEAST_LENGTH)
    heads = frozenset(number for around, number in page.headers if paragraphs[around] > 1)
    return Page(html, forms, heads) if heads else page


def main_text(html: str | None) -> str:
    """The article's blocks, one a line; empty if there is none."""
    if not html:
        return ""
    page = parsed(html)
    if not page.blocks:
        return ""
    scores = Scores(page)
    kept = kept_elements(page, scores)
    most = max(scores.total[i] for i in kept)
    within = [0 in kept] + [False] * (len(page.tag) - 1)
    for i in range(1, len(page.tag)):
        beside = page.lowered[i] and scores.total[i] <= BESIDE * most or page.tag[i] in LISTS and scores.density(i) > 0.8
        within[i] = (within[page.parent[i]] or i in kept) and not beside
    return "\n".join(text for node, text, _ in page.blocks if within[node])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) per page row.

    Character references are decoded, white space inside a block becomes one space, blocks stand in page
    order with one line end between them. Null or empty html gives an empty text, null ids and urls stay
    null, repeated rows each get a row, an empty table gives no rows, other columns are ignored.
    """

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series([main_text(h) for h in htmls], dtype=object)

    out = pages.select("page_id", "url", text("html").alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
