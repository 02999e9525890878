"""Main-text extraction by the maximum-scoring subsequence of words and tags.

A page becomes a sequence of words and tags.  Words score above zero and tags below, by their
kind and context (the block, links, whether an element says that it is the content), with weights
that are log odds counted on labelled pages; words of elements
that are marked as boilerplate score below zero too, and an end tag has a weight of its own.
One linear scan finds the contiguous region with the largest sum.  The region is then rounded to
whole elements: from the least element around it outwards, as long as it has at least half of
the words there and no end tag is crossed with which, on the labelled pages, the content ends.
What is marked as boilerplate inside (adverts, notices, forms, comments...) is left out; where
the mark is a name that sections of an article may have as well ('related', 'search'...), only
if the scan's scores do not speak for the element.

Labelled pages are those that mark their article themselves (an ``article`` or ``main``
element): the unmarked words inside are content, the others are not.  Counts are gathered from at most
``LABELLED_PAGES`` rows.

Defined results: null or empty html gives an empty text; a page without words too; repeated
rows give repeated results; of equally good regions the first is taken; an empty table gives an
empty result; columns other than the id, url and html are not read.  Broken pages are read to
their end: a tag that the end cuts off is no text, a quote that is never closed ends with its
tag.  Time and memory are linear in a page's length, however long, broken or nested it is.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows

#: Bound of the sample that weights are counted on.
LABELLED_PAGES = 2000

# Element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
DROPPED = frozenset("nav footer aside form script style noscript iframe svg math template button select textarea head dialog menu object embed canvas video audio map title datalist xmp noembed noframes".split())
CONTENT = frozenset(("article", "main"))
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar note status".split())
#: Names that say boilerplate as a whole class or id, in lower case with hyphens.
DROPPED_NAMES = re.compile(
    r"ad|ads|adv|advert|adverts|advertisements?|advertising|advertorial|adsense|adbox|banner|sponsor|sponsors|sponsored|promo|promos|promoted|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|sidebar|aside|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|comments?|disqus|replies|respond|toolbar|pagination|pager|login|hidden|skip|outbrain|taboola"
    r"|(?:cookies?|gdpr|consent)-(?:notice|banner|bar|popup|modal|overlay|message|alert|consent|box)"
    r"|(?:ad|ads|advert|adsense|advertisement|sponsor|sponsored|promo|google)-(?:ad|ads|banner|box|block|slot|unit|container|wrapper|text|links?|widget)|banner-(?:ad|ads)"
    r"|(?:related|recommended|popular|recent)-(?:posts?|articles?|stories|links|news|content)"
    r"|(?:share|sharing|social)-(?:share|sharing|buttons?|links?|icons?|bar|widget|menu)"
    r"|(?:main|site|page|top|primary|secondary|global|footer|header|mobile|left|right)-(?:nav|navbar|navigation|menu|footer|sidebar)"
    r"|(?:nav|navigation)-(?:bar|menu|links?|list)|menu-bar|side-bar|side-?nav|(?:post|posts|page)-(?:nav|navigation|pagination)"
    r"|comments?-(?:list|form|section|area|thread|wrapper|body|text|content|meta)|disqus-thread"
    r"|(?:newsletter|subscribe|subscription|signup|sign-up|login|search)-(?:form|box|bar|widget|signup)"
    r"|(?:pop-up|skip-link|skip-links|skip-to-content|skip-nav|sr-only|screen-reader-text|visually-hidden)"
)
#: Names that sections of an article have as well: they mark an element which the scan scores low.
WEAK_NAMES = re.compile(r"related|recommended|recommendations|share|sharing|social|search|menu|teaser|widget")
#: Elements that hold the article's own headings and paragraphs: an id on them is a slug.
SLUGGED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
HEADERS = frozenset(("header", "site-header", "global-header"))

#: What may begin a tag or comment; a plain tag as a whole, whose quotes hold no angle brackets.
OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)([^<>\"']*+(?:\"[^\"<>]*+\"[^<>\"']*+|'[^'<>]*+'[^<>\"']*+)*+)>|[a-zA-Z!?/])")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Used where no page is labelled: a word's and a tag's score.
PLAIN = ({}, {})
WORD_SCORE, LINK_WORD_SCORE, MARKED_WORD_SCORE, TAG_SCORE = 1.0, 0.05, -0.5, -1.0
#: An end tag with this weight or less ends the content on the labelled pages.
CONTENT_END = -3.0
#: Before the name of a context or tag within an ``article`` or ``main`` element.
WITHIN = "@"
#: An element with a weak name is kept if its events' scores sum up to this.
WEAK_SCORE = 20.0


def tokens(source: str) -> Iterator[tuple[int, int, str, str]]:
    """The tags of a page: (start, end, name with a slash before an end tag's, attributes).

    Comments, declarations and end tags without a name have an empty name.  A tag ends at the
    first ``>`` outside quotes; a quote without a partner is none.  Where such a search has once
    come to the page's end, tags end at the first ``>`` from there on.  The generator is sent the
    position to go on from, or None.
    """
    at, last = 0, source.rfind(">")
    partner = {q: source.rfind(q) for q in "\"'"}
    quoted = True
    while m := OPENING.search(source, at):
        start = m.start()
        if m[2]:
            end, name, attributes = m.end(), m[1] + m[2].lower(), m[3]
        elif source.startswith("<!--", start):
            stop = source.find("-->", start + 4)
            end = len(source) if stop < 0 else stop + 3
            name = attributes = ""
        elif start > last:  # the page's end cuts the tag off
            end, name, attributes = len(source), "", ""
        else:
            slash = source.startswith("/", start + 1)
            word = NAME.match(source, start + 1 + slash)
            close = -1
            pos = word.end() if word else start + 1
            while word and quoted:
                stop = STOP.search(source, pos)
                if stop is None or stop.start() > last:
                    quoted = False
                elif stop[0] == ">":
                    close = stop.start()
                    break
                elif stop.start() >= partner[stop[0]]:
                    break
                else:
                    pos = source.index(stop[0], stop.end()) + 1
            if close < 0:
                close = source.find(">", start)
            end = close + 1
            name = ("/" if slash else "") + word[0].lower() if word else ""
            attributes = source[word.end() : close] if word else ""
        to = yield start, end, name, attributes
        at = end if to is None else to


class Page:
    """A parsed page: elements (tag, parent, marked...) and the sequence of events.

    An event is (kind, element, words, text): kind 0 is a run of text, 1 a tag by its name, an
    end tag's after a slash.  Elements are in document order, so a parent comes before its
    children.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.marked, self.weak, self.link, self.within = ["#root"], [0], [False], [False], [False], [False]
        self.block = [0]
        self.events: list[tuple[int, int, int, str]] = []
        # open elements; their depths by tag; the depths of those that aren't inline
        self.stack, self.depths, self.solid = [0], {}, []
        self._parse(source)
        self._drop()

    def _parse(self, source: str) -> None:
        at, lower = 0, None
        found = tokens(source)
        token = next(found, None)
        while token:
            start, end, name, attributes = token
            if start > at:
                self._text(source[at:start], self.stack[-1])
            at, to = end, None
            if name.startswith("/"):
                if self.depths.get(name[1:]):
                    self._cut(self.depths[name[1:]][-1])
                    self._tag(name, self.stack[-1])
            elif name:
                self._imply(name)
                element = self._element(name, attributes, self.stack[-1])
                self._tag(name, element)
                if name in RAW:
                    lower = source.lower() if lower is None else lower
                    if len(lower) == len(source):
                        stop = lower.find(f"</{name}", at)
                    else:  # lower-casing changed the length: search in the source itself
                        close = re.compile(f"</{name}", re.I).search(source, at)
                        stop = close.start() if close else -1
                    close = source.find(">", stop) if stop >= 0 else -1
                    at = to = len(source) if close < 0 else close + 1
                elif name not in VOID and not (attributes.endswith("/") and name in ("svg", "path")):
                    self._push(name, element)
            token = next(found, None) if to is None else _sent(found, to)
        if at < len(source):
            self._text(source[at:], self.stack[-1])

    def _push(self, name: str, element: int) -> None:
        self.depths.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.solid.append(len(self.stack))
        self.stack.append(element)

    def _cut(self, depth: int) -> None:
        """End the open elements from ``depth`` on."""
        while len(self.stack) > depth:
            name = self.tag[self.stack.pop()]
            self.depths[name].pop()
            if name not in INLINE:
                self.solid.pop()

    def _imply(self, name: str) -> None:
        """End tags that may be left out: p before a block, an item before the next item."""
        if name not in CLOSES_P and name not in CLOSED_BY_SAME:
            return

        def nearest(*names: str) -> int:
            return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

        if name in CLOSES_P and self.solid and nearest("p") == self.solid[-1]:
            self._cut(self.solid[-1])
        if name in CLOSED_BY_SAME:
            same = nearest(*(("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)))
            if same > nearest(*CLOSED_BY_SAME[name]):
                self._cut(same)

    def _element(self, name: str, attributes: str, parent: int) -> int:
        within = self.within[parent]
        marked, weak = name in DROPPED or name == "header" and not within, False
        if attributes and not marked:
            for a in ATTRIBUTE.finditer(attributes):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                    marked = True
                elif key == "role":
                    marked |= value.lower() in DROPPED_ROLES
                elif key in ("class", "id") and not (key == "id" and name in SLUGGED):
                    for whole in value.split():
                        whole = re.sub(r"[_\-:]+", "-", CAMEL.sub("-", whole).lower()).strip("-")
                        marked |= bool(DROPPED_NAMES.fullmatch(whole)) or whole in HEADERS and not within
                        weak |= bool(WEAK_NAMES.fullmatch(whole))
            if name in ("html", "body", "article", "main"):
                marked = weak = False
        self.tag.append(name)
        self.parent.append(parent)
        self.marked.append(marked)
        self.weak.append(weak and not marked)
        self.within.append(within or name in CONTENT)
        self.link.append(name == "a" or self.link[parent])
        element = len(self.tag) - 1
        self.block.append(self.block[parent] if name in INLINE else element)
        return element

    def _text(self, text: str, element: int) -> None:
        self.events.append((0, element, len(text.split()), text))

    def _tag(self, name: str, element: int) -> None:
        self.events.append((1, element, 0, name))

    def _drop(self) -> None:
        """Whether each element is marked or in one that is.  What holds the article itself is never marked by its name."""
        holds = [False] * len(self.tag)
        for e in range(len(self.tag) - 1, 0, -1):
            if self.tag[e] in CONTENT or holds[e]:
                holds[self.parent[e]] = True
        self.weak = [w and not h for w, h in zip(self.weak, holds, strict=True)]
        self.dropped = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            self.dropped[e] = self.dropped[self.parent[e]] or self.marked[e] and not holds[e]

    def weigh(self, score: list[float]) -> None:
        """Drop the elements with weak names for which the events' scores don't speak."""
        if any(self.weak):
            total = [0.0] * len(self.tag)
            for (_, e, _, _), s in zip(self.events, score, strict=True):
                total[e] += s
            for e in range(len(self.tag) - 1, 0, -1):
                total[self.parent[e]] += total[e]
            for e in range(1, len(self.tag)):
                self.dropped[e] |= self.dropped[self.parent[e]] or self.weak[e] and total[e] < WEAK_SCORE

    def kind(self, element: int) -> str:
        return ("a/" if self.link[element] else "") + self.tag[self.block[element]]


def _sent(found: Iterator, to: int) -> tuple | None:
    try:
        return found.send(to)
    except StopIteration:
        return None


def label_counts(source: str) -> Counter:
    """Of one labelled page: words by context and tags by name, in its content and outside: in the
    article, but for what is marked as boilerplate there, and in the rest."""
    page, out = Page(source), Counter()
    inside = [False] * len(page.tag)
    for e in range(1, len(page.tag)):
        inside[e] = inside[page.parent[e]] or page.tag[e] in CONTENT
    if not any(inside):
        return out
    for kind, e, words, text in page.events:
        content = inside[e] and not page.dropped[e]
        names, n = (("t", text), 1) if kind else (("w", page.kind(e)), words)
        if n:
            out[*names, content] += n
            if page.within[e]:  # by name, and all together for names that no labelled page has there
                out[names[0], WITHIN + names[1], content] += n
                out[names[0], WITHIN, content] += n
    return out


def weights_from(counts: Counter) -> tuple[dict[str, float], dict[str, float]]:
    """Log odds as scores: above zero for words, below for tags."""
    total = {k: 1 + sum(v for (a, n, i), v in counts.items() if (a, i) == k and not n.startswith(WITHIN)) for k in (("w", True), ("w", False), ("t", True), ("t", False))}
    words, tags = {}, {}
    for a, name in {(a, n) for a, n, _ in counts}:
        odds = math.log((counts[a, name, True] + 1) / total[a, True]) - math.log((counts[a, name, False] + 1) / total[a, False])
        if a == "w":
            words[name] = min(3.0, max(0.01, 1 + odds))
        else:
            tags[name] = max(-6.0, min(-0.1, odds - 1))
    return words, tags


def scores(page: Page, weights: tuple[dict[str, float], dict[str, float]]) -> list[float]:
    """The score of each event of a page."""
    words, tags = weights

    def word(e: int) -> float:
        if page.dropped[e]:
            return MARKED_WORD_SCORE
        if page.within[e] and WITHIN in words:
            return words.get(WITHIN + page.kind(e), words[WITHIN])
        return words.get(page.kind(e), LINK_WORD_SCORE if page.link[e] else WORD_SCORE)

    def tag(e: int, name: str) -> float:
        if page.within[e] and WITHIN in tags:
            return tags.get(WITHIN + name, tags[WITHIN])
        return tags.get(name, TAG_SCORE)

    return [tag(e, text) if kind else n * word(e) if n else 0.0 for kind, e, n, text in page.events]


def region(score: list[float]) -> tuple[int, int] | None:
    """First and last event of the contiguous run with the largest sum, by one linear scan; the
    first of equals.  None if no sum is above zero."""
    best, chosen, total, start = 0.0, None, 0.0, 0
    for i, s in enumerate(score):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, chosen = total, (start, i)
    return chosen


def extract(source: str | None, weights: tuple[dict[str, float], dict[str, float]] = PLAIN) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = Page(source)
    score = scores(page, weights)
    page.weigh(score)
    found = region(score)
    if not found:
        return ""
    first, last = found
    texts = [i for i in range(first, last + 1) if page.events[i][2] and not page.dropped[page.events[i][1]]]
    if not texts:
        return ""
    top = _common_ancestor(page, page.events[texts[0]][1], page.events[texts[-1]][1])
    top = _whole(page, top, sum(page.events[i][2] for i in texts), weights[1])
    if top:
        inside = [False] * len(page.tag)
        inside[top] = True
        for e in range(top + 1, len(page.tag)):
            inside[e] = inside[page.parent[e]]
        chosen = range(len(page.events))
    else:
        inside, chosen = [True] * len(page.tag), range(first, last + 1)
    blocks: list[str] = []
    held: list[str] = []
    for i in chosen:
        kind, e, _, text = page.events[i]
        if kind and text.lstrip("/") not in INLINE and held:
            blocks.append("".join(held))
            held = []
        if inside[e] and not page.dropped[e]:
            if kind == 0:
                held.append(entities.unescape(text))
            elif text == "br":
                held.append(" ")
    blocks.append("".join(held))
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def _common_ancestor(page: Page, a: int, b: int) -> int:
    while a != b:
        if a > b:
            a = page.parent[a]
        else:
            b = page.parent[b]
    return a


def _whole(page: Page, top: int, words: int, tags: dict[str, float]) -> int:
    """The element that the region is rounded to, 0 for none: the widest below the body in which
    the region has at least half of the words, within the end tags that end the content."""
    if page.tag[top] in ("#root", "html", "body"):
        return 0
    under = [0] * len(page.tag)
    for kind, e, n, _ in page.events:
        if not kind and not page.dropped[e]:
            under[e] += n
    for e in range(len(page.tag) - 1, 0, -1):
        under[page.parent[e]] += under[e]
    while page.parent[top] and page.tag[page.parent[top]] not in ("html", "body") and 2 * words >= under[page.parent[top]]:
        if tags.get("/" + page.tag[top], TAG_SCORE) <= CONTENT_END and page.tag[top] not in INLINE:
            break
        top = page.parent[top]
    return top


def learn_weights(pages: DataFrame, limit: int = LABELLED_PAGES) -> tuple[dict[str, float], dict[str, float]]:
    """Scores from at most ``limit`` pages that mark their article (least hash of the id first)."""

    def make():
        def rows(batch: dict[str, list]) -> Iterator[tuple]:
            total: Counter = Counter()
            for source in batch["html"]:
                total.update(label_counts(source or ""))
            for (a, name, inside), n in total.items():
                yield a, name, inside, n

        return rows

    marked = pages.select("page_id", "html").where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    # of repeated ids the row with the least html, so the sample has ``limit`` rows at most
    chosen = marked.groupBy("page_id").agg(F.min(F.xxhash64("html")).alias("least")).orderBy(F.xxhash64("page_id"), "page_id").limit(limit)
    sample = marked.join(F.broadcast(chosen), "page_id").where(F.xxhash64("html") == F.col("least")).dropDuplicates(["page_id"])
    counted = map_rows(sample, make, "a string, name string, inside boolean, n long").groupBy("a", "name", "inside").agg(F.sum("n").alias("n"))
    return weights_from(Counter({(r.a, r.name, r.inside): r.n for r in counted.collect()}))


def extract_main_text(pages: DataFrame, weights: tuple[dict, dict] | None = None) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` from its whole html."""
    weights = learn_weights(pages) if weights is None else weights

    def make():
        def rows(batch: dict[str, list]) -> Iterator[tuple]:
            for page_id, url, source in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                text = extract(source, weights)
                yield page_id, url, text, len(text)

        return rows

    return map_rows(pages.select("page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long")
