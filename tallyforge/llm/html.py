"""Main text of web pages from flat text blocks.

A page is read as a run of text blocks, cut at block-level tags. Each block is described by
its words, its link density, the same of the block before and after it, and by what its
open elements say of it (article or main part; menu, footer, form, comments and so on). A
class word, or a form, tells of menus and the like only while the page's text, by words and
link density, or its main part, doesn't lie in it. A decision tree, grown on the small
labelled table below, decides which blocks are the text.

Cases: a null or empty page, or one without a block of text, gives an empty string; a page
is read whole however long; one that ends inside a tag loses that tag only, as does an
element that is left out with its content but never closed (scripts and styles run to the
end of the page); equal rows give equal text; no rows give no rows; rows keep their ids, repeated or not; other columns are
not read.
"""

from __future__ import annotations

import functools
import itertools
import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import table

#: What may begin at a ``<``: a comment, a script or style, a tag with its attributes, a declaration. Nothing in it is tried twice.
COMMENT_END = re.compile(r"-->|\Z")
OPENED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
ATTRIBUTES = re.compile(r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>")
LOST = re.compile(r"[^<>]*+>?")
#: Elements left out with all they hold, if they are closed; in the first no tags are read, and two of them run to the page's end otherwise.
RAW = frozenset("script style title textarea iframe noscript".split())
TO_THE_END = frozenset("script style".split())
LEFT_OUT = frozenset("template desc canvas select button audio video".split())
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
INLINE = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics annotation svg g text tspan path circle rect line polyline polygon ellipse use defs symbol object param a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input meta link base label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words in class, id or role, that tell of what stands around an article.
AROUND = frozenset("nav aside footer".split())
#: Elements that stand around an article unless the page's text lies in them, as for a class word.
MAY_BE_AROUND = frozenset("form menu dialog fieldset".split())
AROUND_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disclaimer discussion footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets complementary contentinfo alert".split()
)
#: Of these words, those of what readers wrote.
READERS_WORDS = frozenset("comment comments commentlist discussion replies reply respond".split())
#: First and last words of a class that tells of a page's layout, state or subject, not of what stands in the element.
STATE_BEFORE = frozenset("has no with without is not tag category cat hide show layout".split())
STATE_AFTER = frozenset("open opened close closed active inactive enabled disabled visible layout".split())
WITHIN = frozenset("article main".split())
WITHIN_WORDS = frozenset("article articlebody articlecontent content entry main post postbody postcontent story storybody".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS, CELLS = frozenset("li dd dt".split()), frozenset("td th".split())
#: Of these an open one ends where the next begins, if it is a paragraph or of the same name.
PARAGRAPHS = frozenset({"p", *ITEMS, *HEADINGS})


@dataclass(eq=False)
class Sign:
    """A class word, or an element, that may mean that its text stands around an article; what lies in it decides. ``parent``: the sign around it."""

    readers: bool
    parent: Sign | None = None
    words: int = 0
    within: int = 0
    main: bool = False
    article: bool = False
    around: bool = False

    def outweighed(self, words: int, within: int) -> bool:
        """Whether the page's text lies in it; ``words`` and ``within`` are those of the whole page, all and of the article's parts."""
        if self.readers:
            return within == self.within and 10 * (words - self.words) < self.words
        return self.main or 2 * self.words > words or self.article and 4 * self.words > words


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    around: bool = False
    within: bool = False
    heading: bool = False
    listed: bool = False
    text: str = ""
    words: int = 0
    density: float = 0.0
    sign: Sign | None = None


@dataclass
class Open:
    """An open element that isn't inline, with what it and those around it say: how many of them stand around, within, are items of a list; the innermost sign."""

    name: str
    around: int = 0
    within: int = 0
    listed: int = 0
    sign: Sign | None = None
    #: The innermost table or cell, itself included, and whether that is a cell whose attributes tell something.
    cell: str = ""
    tells: bool = False


@dataclass
class Token:
    """A tag, comment or left-out element: where it begins and ends, its element's name, if it is a tag, and its attributes."""

    start: int
    end: int
    name: str = ""
    closing: bool = False
    attributes: str = ""


class Reader:
    """The tags and comments of a page from ``at`` on, one by one, in one pass: a tag that is never closed is lost up to the next one, and is looked for once."""

    def __init__(self, page: str):
        self.page, self.at, self.last, self.broken = page, 0, page.rfind(">"), False

    def __iter__(self) -> Iterator[Token]:
        page = self.page
        while (at := page.find("<", self.at)) >= 0:
            self.at = at + 1
            if page.startswith("<!--", at):
                token = Token(at, COMMENT_END.search(page, at + 4).end())
            elif m := OPENED.match(page, at):
                rest = None if self.broken or at > self.last else ATTRIBUTES.match(page, m.end())
                # a quote is open to the page's end: from here on tags end at the next bracket
                self.broken |= rest is None and at <= self.last
                end = rest.end() if rest else LOST.match(page, m.end()).end()
                whole = page[end - 1] == ">"
                token = Token(at, end, m[2].lower() if whole else "", bool(m[1]), page[m.end() : end - 1] if whole else "")
            elif page.startswith(("!", "?"), at + 1):
                token = Token(at, page.find(">", at) + 1 or len(page))
            else:
                continue
            self.at = token.end
            yield token


def tokens(page: str) -> list[Token]:
    """The tags of a page, with each element that is left out as one token; of those that aren't closed, only the tag."""
    found: list[Token] = []
    opened: dict[str, list[int]] = {}
    endless: set[str] = set()
    reader = Reader(page)
    for token in reader:
        name = token.name
        closed = token.attributes.endswith("/")
        if name in RAW and not token.closing and not closed and name not in endless:
            if (end := RAW_ENDS[name].search(page, token.end)) and (after := page.find(">", end.end())) >= 0:
                reader.at = token.end = after + 1
            elif name in TO_THE_END:
                reader.at = token.end = len(page)
            else:
                endless.add(name)
        found.append(token)
        if name in LEFT_OUT and not closed:
            if not token.closing:
                if name in ("button", "select"):  # these don't nest: one that is still open has no end
                    opened.pop(name, None)
                opened.setdefault(name, []).append(len(found) - 1)
            elif opened.get(name):
                first = opened[name].pop()
                found[first].end = token.end
                del found[first + 1 :]
                for other in opened:
                    while opened[other] and opened[other][-1] >= first:
                        opened[other].pop()
    return found


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    found: list[Block] = []
    stack = [Open("")]
    #: How many elements of a name are open; all signs, each after the one around it.
    names: Counter[str] = Counter()
    signs: list[Sign] = []
    links, breaks = 0, 0
    now = Block()

    def close() -> None:
        nonlocal now
        text = " ".join(references.unescape("".join(now.parts)).split())
        if text:
            now.text, now.words = text, text.count(" ") + 1
            now.density = min(1.0, len(references.unescape(" ".join(now.linked)).split()) / now.words)
            top = stack[-1]
            now.around, now.within, now.listed, now.sign = top.around > 0, top.within > 0, top.listed > 0, top.sign
            now.heading = any(x.name in HEADINGS for x in stack[-2:])
            found.append(now)
        now = Block()

    def enter(name: str, around: bool, within: bool, sign: Sign | None) -> None:
        top = stack[-1]
        if sign:
            sign.parent = top.sign
            signs.append(sign)
        elif name in WITHIN and top.sign:
            top.sign.main |= name == "main"
            top.sign.article |= name == "article"
        inner = name if name == "table" or name in CELLS else top.cell
        tells = bool(around or within or sign) if name in CELLS else name != "table" and top.tells
        stack.append(Open(name, top.around + around, top.within + within, top.listed + (name in ITEMS), sign or top.sign, inner, tells))
        names[name] += 1

    def leave(name: str) -> None:
        """Ends the innermost element of a name that is open, and all in it."""
        while names[name]:
            names[stack[-1].name] -= 1
            if stack.pop().name == name:
                return

    def say(text: str) -> None:
        nonlocal breaks
        if text:
            now.parts.append(text)
            if links:
                now.linked.append(text)
            if not text.isspace():
                breaks = 0

    at, silent = 0, False
    for token in tokens(page):
        if not silent:
            say(page[at : token.start])
        at, name = token.end, token.name
        silent = name == "option" and not token.closing
        if not name or name == "option" or name in RAW or name in LEFT_OUT:
            continue
        ends = token.closing
        if name == "a":
            links = 0 if ends else 1
        elif name == "br":
            breaks += 1
            if breaks >= 2:
                close()
            else:
                now.parts.append(" ")
        elif name in CELLS:
            told = (False, False, None) if ends else _signs(name, token.attributes, stack[-1].within > 0)
            # cells are parts of a row, but for those whose attributes tell something, which are blocks
            if stack[-1].cell in CELLS:
                if stack[-1].tells:
                    close()
                leave(stack[-1].cell)
            if any(told):
                close()
            else:
                now.parts.append(" ")
            if not ends:
                enter(name, *told)
        elif name in INLINE:
            continue
        else:
            close()
            links = 0
            if ends:
                leave(name)
            elif name not in VOID:
                if name in PARAGRAPHS and stack[-1].name in PARAGRAPHS and stack[-1].name in ("p", name):
                    leave(stack[-1].name)
                enter(name, *_signs(name, token.attributes, stack[-1].within > 0))
    if not silent:
        say(page[at:])
    close()
    _weigh(found, signs)
    return found


def _weigh(found: list[Block], signs: list[Sign]) -> None:
    """Blocks under signs that the page's own text doesn't outweigh stand around. What lies in a sign is added up from the innermost, what it means comes down from the outermost."""
    if not signs:
        return
    words = within = 0
    for b in found:
        if not b.around and b.words >= 4 and b.density < LINK_CUTS[0]:
            words += b.words
            within += b.words * b.within
            if b.sign:
                b.sign.words += b.words
                b.sign.within += b.words * b.within
    for x in reversed(signs):
        if x.parent:
            x.parent.words += x.words
            x.parent.within += x.within
            x.parent.main |= x.main
            x.parent.article |= x.article
    for x in signs:
        x.around = x.parent is not None and x.parent.around or not x.outweighed(words, within)
    for b in found:
        b.around |= b.sign is not None and b.sign.around


def _signs(name: str, attributes: str, inside: bool) -> tuple[bool, bool, Sign | None]:
    around, within = name in AROUND, name in WITHIN
    sign = Sign(False) if name in MAY_BE_AROUND or name == "header" and not inside else None
    if attributes and not attributes.isspace():
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id", "role"):
                for word in value.split() if name not in ("body", "html") else ():
                    parts = [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", word).lower()) if x]
                    words = {*parts, *re.split(r"[^a-z]+", word.lower())}
                    within |= bool(words & WITHIN_WORDS)
                    if words & AROUND_WORDS and not (len(parts) > 1 and (parts[0] in STATE_BEFORE or parts[-1] in STATE_AFTER)):
                        if key == "role":
                            around = True
                        elif sign is None or words & READERS_WORDS:
                            sign = Sign(bool(words & READERS_WORDS))
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                around = True
    return around, within, sign


#: Words and link density are told by class: up to 3, 12, 25 words or more; under 1/3, under 2/3 linked or more.
WORD_CUTS, LINK_CUTS = (3.5, 12.5, 25.5), (1 / 3, 2 / 3)


def features(found: list[Block]) -> np.ndarray:
    """Classes of words and density, of the block before, of the block after; around, within, heading, listed, legal."""
    rows = np.zeros((len(found), 11), int)
    for i, b in enumerate(found):
        rows[i, 6:] = b.around, b.within, b.heading, b.listed, b.text[:1] == "©" or b.text[:9].lower() == "copyright"
    rows[:, 0] = np.searchsorted(WORD_CUTS, [b.words for b in found])
    rows[:, 1] = np.searchsorted(LINK_CUTS, [b.density for b in found], "right")
    rows[1:, 2:4] = rows[:-1, :2]
    rows[:-1, 4:6] = rows[1:, :2]
    return rows


#: Blocks labelled by hand: the features in their order, then 1 for main text. A star stands for every class.
LABELLED = """
* * * 0 * 0 1 * * 0 0 0
* * * 2 * 2 1 0 0 1 0 0
* 0 * * * * 0 1 * * 0 1
* 1 * * * * 0 1 * * 0 1
* 2 * * * * 0 1 * * 0 1
3 0 * * * * 0 0 0 0 0 1
3 1 * 0 * 0 0 0 0 0 0 1
3 2 * * * * 0 0 0 * 0 0
2 0 * 0 * 0 0 0 0 0 0 1
2 0 * 2 * 2 0 0 0 0 0 0
2 1 * * * * 0 0 0 * 0 0
2 2 * * * * 0 0 0 * 0 0
1 0 3 0 * 0 0 0 0 0 0 1
1 0 2 0 * 0 0 0 0 0 0 1
1 0 1 0 3 0 0 0 0 0 0 1
1 0 1 0 2 0 0 0 0 0 0 1
1 0 0 * 0 * 0 0 0 0 0 0
1 0 * 2 * 2 0 0 0 0 0 0
1 1 * * * * 0 0 0 * 0 0
1 2 * * * * 0 0 0 * 0 0
0 0 3 0 * 0 0 0 0 0 0 1
0 0 2 0 2 0 0 0 0 0 0 1
0 0 2 0 3 0 0 0 0 0 0 1
0 0 0 * * * 0 0 0 * 0 0
0 0 1 2 * * 0 0 0 * 0 0
0 1 * * * * 0 0 0 * 0 0
0 2 * * * * 0 0 0 * 0 0
0 0 * * 3 0 0 0 1 0 0 1
0 0 * * 2 0 0 0 1 0 0 1
1 0 * * 3 0 0 0 1 0 0 1
1 0 * * 2 0 0 0 1 0 0 1
2 0 * * 3 0 0 0 1 0 0 1
0 0 * * 0 2 0 0 1 0 0 0
1 0 * * 0 2 0 0 1 0 0 0
0 0 * 0 * 0 0 0 0 0 1 0
1 0 * 0 * 0 0 0 0 0 1 0
2 0 * 0 * 0 0 0 0 0 1 0
1 0 * 0 * 0 * 0 0 0 1 0
"""
_CLASSES = (4, 3, 4, 3, 4, 3, 2, 2, 2, 2, 2)


def labelled_rows() -> np.ndarray:
    rows = []
    for line in LABELLED.strip().split("\n"):
        *values, label = line.split()
        rows += itertools.product(*(range(n) if v == "*" else (int(v),) for v, n in zip(values, _CLASSES, strict=True)), (int(label),))
    return np.array(rows)


class Tree:
    """A binary decision tree grown by Gini impurity until no split helps."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.leaf = int(2 * y.sum() >= len(y))
        self.column = -1
        best = (2 * y.mean() * (1 - y.mean()) * len(y), -1, 0.0)
        for column in range(x.shape[1]):
            values = np.unique(x[:, column])
            for cut in (values[:-1] + values[1:]) / 2:
                low = x[:, column] <= cut
                impurity = sum(2 * p.mean() * (1 - p.mean()) * len(p) for p in (y[low], y[~low]))
                if impurity < best[0] - 1e-9:
                    best = impurity, column, cut
        if best[1] >= 0:
            _, self.column, self.cut = best
            low = x[:, self.column] <= self.cut
            self.low, self.high = Tree(x[low], y[low]), Tree(x[~low], y[~low])

    def predict(self, rows: np.ndarray) -> np.ndarray:
        if self.column < 0:
            return np.full(len(rows), self.leaf)
        low = rows[:, self.column] <= self.cut
        out = np.empty(len(rows), int)
        out[low], out[~low] = self.low.predict(rows[low]), self.high.predict(rows[~low])
        return out


@functools.cache
def tree() -> Tree:
    rows = labelled_rows()
    return Tree(rows[:, :-1], rows[:, -1])


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, tree().predict(features(found)), strict=True) if keep)


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html): page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = batch.slice(part, 500)
                texts = [main_text(x.as_py()) for x in rows.column(2)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
