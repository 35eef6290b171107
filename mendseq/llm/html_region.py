"""Main text of web pages: the maximum-scoring run of words and tags.

Words score positive and tags negative, or words negative where the markup says that
no article is there. One scan finds the contiguous run with the largest sum. Weights
come from pages that label their article with an ``article`` element.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendseq.llm.common import arrow_map, hashed_sample, rows_of

# The sample of labelled pages that weights come from, and the longest one taken.
SAMPLE, SAMPLE_CHARS = 2000, 100_000
# Words under an element before its share counts, and the share up to which it is no part of an article.
LEAST_WORDS, FOREIGN_SHARE = 20, 0.05
TAG, FOREIGN_TAG = 0.2, 40.0

# Elements and names that are no part of an article where no labelled page tells.
FOREIGN = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "title", "head", "figcaption"}
FOREIGN_NAME = re.compile(
    r"(^|[-_ ])(ad|ads|advert\w*|banner|cookies?|notice|sidebar|comments?|share|social|promo\w*|related|newsletter|"
    r"breadcrumbs?|menu|nav\w*|footer|header|subscribe|sponsor\w*|popup|modal)($|[-_ ])", re.I)
# An article begins here whatever element before was never closed.
ANEW = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Elements that hold paragraphs' words, but no paragraphs beside foreign elements.
PARAGRAPH = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "figure", "table",
             "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}
# What parts a page whose paragraphs are in no element of their own.
PAGE, PARTING = {"", "html", "body"}, {"nav", "header", "footer", "menu", "head", "title"}
# Implied end tags. An element ends the open ones named first, up to one of those named second.
SCOPE = {"table", "td", "th", "caption", "button", "object"}
LISTS = {"ul", "ol", "menu", "dl"}
CELLS, GROUPS = {"td", "th"}, {"thead", "tbody", "tfoot", "colgroup", "caption"}
IMPLIED = ({"li": ({"li"}, SCOPE | LISTS), "dt": ({"dt", "dd"}, SCOPE | LISTS), "dd": ({"dt", "dd"}, SCOPE | LISTS),
            "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
            "tr": (CELLS | {"tr", "caption", "colgroup"}, {"table"})}
           | dict.fromkeys(CELLS, (CELLS, {"tr", "table"})) | dict.fromkeys(GROUPS, (CELLS | GROUPS | {"tr"}, {"table"})))
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure",
                  "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p",
                  "pre", "section", "table", "ul", "li", "dt", "dd"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
          "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}

# A quote counts only where an attribute's value begins; svg alone may end with its own tag.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<svg(?=[\s/])[^<>]*/>"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)>|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I)
_NAME = re.compile(r"""\b(?:class|id)\s*=\s*["']?([^"'>]+)""", re.I)
# White space as HTML and Unicode have it.
_SPACE = re.compile(r"\s+")


def element_key(name: str, rest: str) -> str:
    """The element with its class or id, as weights are kept by."""
    found = _NAME.search(rest) if rest else None
    return f"{name}.{found[1].strip().lower()}" if found else name


@dataclass
class Weights:
    """By element: the share of the words under it that belong to an article."""
    shares: dict[str, float] = field(default_factory=dict)

    def share(self, key: str) -> float:
        found = self.shares.get(key)
        if found is not None:
            return found
        name, _, named = key.partition(".")
        if name in FOREIGN or named and FOREIGN_NAME.search(named):
            return 0.0
        return self.shares.get(name, 1.0) if not named else 1.0

    def tag(self, key: str) -> float:
        return -(TAG + FOREIGN_TAG * (1 - self.share(key)) ** 2)


class _Told(Weights):
    """Knows only what pages told; all other elements are an article's."""

    def share(self, key: str) -> float:
        return self.shares.get(key, 1.0)


class Element:
    """An element of a page, linked to the one around it; iterates over the keys from itself outwards."""

    __slots__ = ("key", "name", "parent", "number", "first", "labelled", "holder")

    def __init__(self, key: str = "", parent: Element | None = None, number: int = 0, first: bool = True):
        self.key, self.name, self.parent, self.number = key, key.partition(".")[0], parent, number
        # Whether none around it has its key, and whether an article is around it.
        self.first, self.labelled = first, self.name == "article" or parent is not None and parent.labelled
        # The innermost one that holds paragraphs.
        self.holder = parent.holder if self.name in PARAGRAPH or self.name in INLINE else self

    def __iter__(self):
        at = self
        while at.parent is not None:
            yield at.key
            at = at.parent


class _Open:
    """The open elements, with the places of each name, so that none is searched for."""

    def __init__(self, share):
        self.stack, self.places, self.keys, self.foreign = [Element()], defaultdict(list), Counter(), []
        self.share, self.number = share, 0

    @property
    def top(self) -> Element:
        return self.stack[-1]

    def push(self, key: str) -> Element:
        self.number += 1
        element = Element(key, self.top, self.number, not self.keys[key])
        self.places[element.name].append(len(self.stack))
        if self.share(key) <= FOREIGN_SHARE:
            self.foreign.append(len(self.stack))
        self.keys[key] += 1
        self.stack.append(element)
        return element

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            element = self.stack.pop()
            self.places[element.name].pop()
            self.keys[element.key] -= 1
        while self.foreign and self.foreign[-1] >= place:
            self.foreign.pop()

    def last(self, names: set[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)

    def end_implied(self, closed: set[str], barriers: set[str]) -> None:
        """Ends the outermost of the named elements that no barrier encloses, and all inside it."""
        open_ = [self.places[n] for n in closed if self.places[n]]
        if open_:
            barrier = self.last(barriers)
            found = [places[i] for places in open_ if (i := bisect_right(places, barrier)) < len(places)]
            if found:
                self.pop_to(min(found))

    def start(self, name: str, key: str) -> Element:
        if name in ENDS_PARAGRAPH:
            self.end_implied({"p"}, SCOPE)
        if name in IMPLIED:
            self.end_implied(*IMPLIED[name])
        if name in ANEW and self.foreign:
            kept = [e.key for e in self.stack[self.foreign[0]:] if self.share(e.key) > FOREIGN_SHARE]
            self.pop_to(self.foreign[0])
            for k in kept:
                self.push(k)
        return self.push(key)

    def end(self, name: str) -> Element | None:
        """The element that an end tag ends, if it ends one."""
        places = self.places[name]
        barriers = {"table"} if name in CELLS | GROUPS | {"tr"} else SCOPE | LISTS if name == "li" else SCOPE
        if not places or places[-1] < self.last(barriers - {name}) and name not in ("table", *ANEW):
            return None
        element = self.stack[places[-1]]
        self.pop_to(places[-1])
        return element


def tokens(page: str, share) -> list[tuple[str, str, Element]]:
    """(tag key, text, element): tags have no text, texts no key.

    The element is the innermost one around a text and the one whose tag it is.
    Elements nest as deeply as the page has them.
    """
    out, open_ = [], _Open(share)
    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            out.append(("", m["text"], open_.top))
        elif m["name"]:
            name = m["name"].lower()
            if m["close"]:
                ended = open_.end(name)
                out.append((ended.key, "", ended) if ended else (name, "", open_.top))
                continue
            element = open_.start(name, element_key(name, m["rest"]))
            out.append((element.key, "", element))
            if name in VOID or (m["rest"] or "").endswith("/"):
                open_.pop_to(len(open_.stack) - 1)
    return out


class _Marks:
    """What the weights say about elements, found once for each."""

    def __init__(self, weights: Weights):
        self.weights, self.known = weights, {}

    def of(self, element: Element) -> tuple[Element | None, bool]:
        """The outermost foreign element around it, and whether it is inside an article."""
        path = []
        while element.parent is not None and element not in self.known:
            path.append(element)
            element = element.parent
        outer, inside = self.known.get(element, (None, False))
        for element in reversed(path):
            own = self.weights.share(element.key) <= FOREIGN_SHARE
            outer, inside = outer or (element if own else None), inside or element.name in ANEW and not own
            self.known[element] = outer, inside
        return outer, inside


def learn(pages: list[str]) -> Weights:
    """Shares of the words of labelled pages; an element without enough words has none.

    Words count for the elements around them only down to the outermost foreign one, so
    that links and lists are not foreign because menus consist of them.
    """
    given = [[(len(text.split()), element) for key, text, element in tokens(page, Weights().share) if not key] for page in pages]
    weights = _Told()
    for _ in range(2):
        inside, total = Counter(), Counter()
        for words in given:
            marks, sums = _Marks(weights), {}
            for n, element in words:
                found = sums.setdefault(marks.of(element)[0] or element, [0, 0])
                found[0] += n
                found[1] += n * element.labelled
            # From the innermost outwards: numbers grow inwards.
            at = sorted((-e.number, e) for e in sums)
            while at:
                _, e = heappop(at)
                if e.parent is None:
                    continue
                if e.first:
                    total[e.key] += sums[e][0]
                    inside[e.key] += sums[e][1]
                if e.parent not in sums:
                    sums[e.parent] = [0, 0]
                    heappush(at, (-e.parent.number, e.parent))
                sums[e.parent][0] += sums[e][0]
                sums[e.parent][1] += sums[e][1]
        weights = _Told({k: inside[k] / n for k, n in total.items() if n >= LEAST_WORDS})
    return Weights(weights.shares)


def enclosed(found: list[tuple[str, str, Element]], marks: _Marks) -> set[Element]:
    """Foreign elements between paragraphs of one and the same element, which belongs to the text."""
    free, between, before = set(), {}, None
    for key, text, element in found:
        outer = marks.of(element)[0]
        if outer is not None:
            between[outer] = None
        elif not key and text.strip():
            holder = element.holder
            if before is holder:
                free.update(e for e in between if e.parent.holder is holder
                            and (holder.name not in PAGE or e.name not in PARTING))
            between, before = {}, holder
    return free


def best_region(found: list[tuple[str, str, Element]], weights: Weights) -> tuple[int, int]:
    """[start, end) of the run of tokens with the largest sum; the first of equal ones.

    What is foreign inside of an article, or between paragraphs of one element, costs
    nothing but the tags of any element, and all tags between two words there cost what
    one does, so that nothing parts what is before and after; ``main_text`` leaves out
    what is foreign.
    """
    best, at, total, start, paid = 0.0, (0, 0), 0.0, 0, False
    marks = _Marks(weights)
    free = enclosed(found, marks)
    for i, (key, text, element) in enumerate(found):
        outer, inside = marks.of(element)
        if key and (inside or outer in free):
            total -= 0.0 if paid else TAG
            paid = True
        elif key:
            total += weights.tag(key)
        else:
            paid = paid and (outer is not None or not text.strip())
            total += (1.0 if outer is None else 0.0 if inside or outer in free else -1.0) * len(text.split())
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, at = total, (start, i + 1)
    return at


def main_text(page: str | None, weights: Weights) -> str:
    """The blocks of the best region, one in a line; what is foreign inside it is left out."""
    found = tokens(page or "", weights.share)
    start, end = best_region(found, weights)
    marks = _Marks(weights)
    blocks, block = [], []

    def finish() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(block))).strip()
        if text:
            blocks.append(text)
        block.clear()

    for key, text, element in found[start:end]:
        name = key.partition(".")[0]
        if not key:
            if marks.of(element)[0] is None:
                block.append(text)
        elif name == "br":
            block.append(" ")
        elif name not in INLINE:
            finish()
    finish()
    return "\n".join(blocks)


def fit(pages: DataFrame) -> Weights:
    """Learns from a bounded sample, chosen by a hash, of the pages that label their article."""
    labelled = pages.where(F.col("html").contains("<article") & (F.length("html") <= SAMPLE_CHARS)).select("page_id", "html")
    sample = hashed_sample(labelled, "page_id", SAMPLE, labelled.count()).toArrow()
    return learn(sample.sort_by([("page_id", "ascending"), ("html", "ascending")]).column("html").to_pylist())


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    A null page is an empty one; its text is empty, as is that of a page without words
    outside of foreign elements. Repeated rows each get a row, other columns are left
    out, an empty table gives no rows.
    """
    def start():
        def work(batch):
            ids, urls, given = rows_of(batch, "page_id", "url", "html")
            texts = [main_text(page, weights) for page in given]
            return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
    return arrow_map(given, start, "page_id long, url string, text string, n_chars long")
