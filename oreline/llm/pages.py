"""The main text of web pages: a page's blocks of text are labelled by one minimum cut.

A logistic classifier of how a block's text looks, and the marks that its elements bear (their tags, roles, classes and ids), give each
block a cost for being content and one for being boilerplate. Neighbours, and blocks of the same element, are bound by costs for
parting; so a short line within an article stays with it, and a long one in a list of links doesn't. The classifier is trained on the
blocks of a bounded sample of pages whose marks leave no doubt, and sees only their text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from oreline.llm.common import hash60, logistic, schema_with, slices, smallest
from oreline.llm.mincut import Network

#: A comment, a declaration, or a tag with its name and attributes; quoted values may hold ``>``.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"\s+")
PART_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content is never text of the page.
UNSEEN = set("script style noscript template textarea title iframe object svg math canvas select option datalist audio video head".split())
#: Elements that end at their own end tag only, whatever stands in them.
RAW = {name: re.compile(rf"</{name}[\s>]", re.I) for name in ("script", "style", "textarea", "title", "iframe", "noscript")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag ends, if it is open below the nearest of the other elements.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
ENDS_PARAGRAPH = BLOCKS - {"body", "html", "button", "caption", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot", "optgroup"}

#: Marks of boilerplate that hold for all that is in an element, and marks that an article within it overrules.
FIRM_TAGS, FIRM_ROLES = {"nav", "aside", "menu", "button", "dialog"}, {"navigation", "complementary", "contentinfo", "search", "menu", "menubar", "alert", "alertdialog", "dialog", "toolbar"}
SOFT_TAGS, SOFT_ROLES = {"form", "header", "footer", "fieldset", "address", "search"}, {"banner", "form"}
FIRM_NAMES = set(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promos promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside comment comments commentlist reply replies respond disqus cookie cookies consent gdpr newsletter subscribe subscription signup popup modal share sharing social related recommended recommendations pagination pager masthead".split()
)
SOFT_NAMES = set("header footer banner notice notices notification alert widget widgets toolbar search login copyright legal disclaimer skip form".split())
MAIN_NAMES = set("article content main post story entry prose".split())
#: What an article element may be in place of the article of a page, and names of a page's layout.
NO_ARTICLES, LAYOUT_NAMES = set("ad advert comment comments promo related reply sponsored teaser".split()), set("has layout no with without wrapper".split())

#: Costs in nats: what a mark says, the most that a text's looks say, and what parting neighbours or siblings costs.
MARK, ARTICLE, LOOKS, NEXT, SAME = 9.0, 4.0, 2.5, 1.2, 0.8
#: The classifier where no page of the sample has marks: bias last; features as in ``looks``.
DEFAULT = (0.9, -4.0, 0.8, 0.6, -1.0, -0.6, -0.8, -0.4)


@dataclass(slots=True)
class Block:
    text: str
    letters: int
    linked: int
    heading: bool
    item: bool
    parent: int
    mark: float


class Page:
    """The blocks of a page, and for each element that holds any its parent."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.parents: list[int] = [-1]
        #: Open elements: name, number among those that hold blocks, mark, whether an article may still overrule it, whether unseen.
        self.open: list[tuple[str, int, float, bool, bool]] = [("", 0, 0.0, True, False)]
        self.within: Counter[str] = Counter()
        self.unseen = 0
        self.texts: list[str] = []
        self.linked = 0
        self._read(source)

    def _push(self, name: str, number: int, mark: float, may: bool, hidden: bool) -> None:
        self.open.append((name, number, mark, may, hidden))
        self.within[name] += 1
        self.unseen += hidden

    def _drop(self, place: int) -> None:
        """Close the open elements from ``place`` on."""
        for o in self.open[place:]:
            self.within[o[0]] -= 1
            self.unseen -= o[4]
        del self.open[place:]

    def _flush(self) -> None:
        """End the block that is being read."""
        text = SPACES.sub(" ", html.unescape("".join(self.texts))).strip() if self.texts else ""
        if text:
            _, parent, mark, _, _ = self.open[-1]
            heading = any(self.within[f"h{i}"] for i in range(1, 7))
            item = self.within["li"] > 0 or self.within["dd"] > 0
            self.blocks.append(Block(text, len(text), min(self.linked, len(text)), heading, item, parent, mark))
        self.texts.clear()
        self.linked = 0

    def _read(self, source: str) -> None:
        at = 0
        while True:
            tag = MARKUP.search(source, at)
            if not self.unseen:
                piece = source[at : tag.start()] if tag else source[at:]
                if piece:
                    self.texts.append(piece)
                    if self.within["a"] and not piece.isspace():
                        self.linked += len(piece)
            if tag is None:
                break
            at = tag.end()
            if tag.group(2) is None:
                continue
            name = tag.group(2).lower()
            if tag.group(1):
                self._end(name)
            else:
                self._start(name, tag.group(3))
                if name in RAW:  # nothing in it is markup
                    end = RAW[name].search(source, at)
                    at = len(source) if end is None else end.start()
        self._flush()

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.texts.append(" ")
        if name in VOID:
            if name == "hr":
                self._flush()
            return
        is_block = name in BLOCKS
        if is_block:
            self._flush()
            self._imply(name)
        _, number, mark, may, _ = self.open[-1]
        hidden = name in UNSEEN
        if is_block:
            mark, may, hidden = self._marked(name, attributes, mark, may)
            number = len(self.parents)
            self.parents.append(self.open[-1][1])
        elif "hidden" in attributes or "none" in attributes:
            hidden = hidden or self._marked(name, attributes, mark, may)[2]
        elif attributes.endswith("/"):
            return
        self._push(name, number, mark, may, hidden)

    def _end(self, name: str) -> None:
        if not self.within[name]:
            if name == "p":
                self._flush()
            return
        place = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == name)
        if name in BLOCKS:
            self._flush()
        elif any(o[0] in BLOCKS for o in self.open[place:]):
            # An inline element that ends outside the block in which it began: only it ends.
            after = self.open[place + 1 :]
            self._drop(place)
            for o in after:
                self._push(*o)
            return
        self._drop(place)

    def _imply(self, name: str) -> None:
        """Close what the start of ``name`` ends."""
        if self.within["p"] and name in ENDS_PARAGRAPH:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] == "p":
                    self._drop(i)
                    break
                if self.open[i][0] in BLOCKS:
                    break
        while name in IMPLIED:
            ends, within = IMPLIED[name]
            place = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i][0] in ends or self.open[i][0] in within), 0)
            if not place or self.open[place][0] in within:
                return
            self._drop(place)

    @staticmethod
    def _marked(name: str, attributes: str, mark: float, may: bool) -> tuple[float, bool, bool]:
        """Mark of an element within one of ``mark``, whether an article may still overrule it, and whether it is unseen."""
        role, names, hidden = "", set(), name in UNSEEN
        if attributes and not attributes.isspace():
            for key, *values in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), next((v for v in values if v), "")
                if key == "role":
                    role = value.strip().lower()
                elif key in ("class", "id"):
                    names.update(part.lower() for part in PART_OF_NAME.findall(value))
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    hidden = True
        if hidden or name in ("html", "body"):
            return mark, may, hidden
        if not may:  # within firm boilerplate
            return mark, may, hidden
        main = name in ("article", "main") or role in ("main", "article")
        if names & LAYOUT_NAMES:  # such names say what else the page has
            names = set()
        if name in FIRM_TAGS or role in FIRM_ROLES or names & (NO_ARTICLES if main else FIRM_NAMES):
            return -MARK, False, hidden
        if main:
            return ARTICLE, True, hidden
        if name == "header" and mark > 0:  # an article's own head holds its title
            return mark, may, hidden
        if name in SOFT_TAGS or role in SOFT_ROLES or names & SOFT_NAMES:
            return -MARK, True, hidden
        if names & MAIN_NAMES and mark >= 0:
            return max(mark, ARTICLE / 2), True, hidden
        return mark, may, hidden


def looks(block: Block) -> tuple[float, ...]:
    """How a block's text looks, whatever elements it is in."""
    text = block.text
    words = text.count(" ") + 1
    ends = text.rstrip("\"'”’»)%$#*&")[-1:] in ".!?…。！？:"
    signs = sum(text.count(c) for c in "|©·»›•→")
    return math.log1p(words) - 2.0, block.linked / block.letters, float(ends), min(1.0, 10.0 * (text.count(",") + text.count(".")) / words), float(block.item), min(3.0, float(signs)), float(words <= 3 and not block.heading)


def label_page(page: Page, weights: tuple[float, ...]) -> list[bool]:
    """Whether each block is content, by the minimum cut.

    A block's gain from being content is what its looks and marks say. It is bound to the block before it, less so the more elements lie
    between them, and to the element that holds it, which is bound to its own parent; elements have no gain of their own.
    """
    blocks = page.blocks
    gains = []
    for b in blocks:
        z = sum(w * x for w, x in zip(weights, looks(b))) + weights[-1]
        if b.heading and not b.linked:
            z = max(z, 0.0)  # a heading is short whatever it stands above
        gains.append(max(-LOOKS, min(LOOKS, z)) + b.mark)
    if all(g > 0 for g in gains) or all(g <= 0 for g in gains):
        return [g > 0 for g in gains]  # nothing to part
    holders: dict[int, int] = {}
    net_nodes, chain = len(blocks), []
    for b in blocks:
        node = b.parent
        while node >= 0 and node not in holders:
            holders[node] = net_nodes
            chain.append(node)
            net_nodes += 1
            node = page.parents[node]
    net = Network(net_nodes)
    for i, (b, g) in enumerate(zip(blocks, gains)):
        net.lean(i, g)
        net.bind(i, holders[b.parent], SAME)
        if i:
            net.bind(i - 1, i, NEXT / (1 + steps_between(page.parents, blocks[i - 1].parent, b.parent)))
    for node in chain:
        if page.parents[node] >= 0:
            net.bind(holders[node], holders[page.parents[node]], SAME / 2)
    return net.source_side()[: len(blocks)]


def steps_between(parents: list[int], a: int, b: int) -> int:
    """Elements to leave and enter on the way from ``a`` to ``b``; a parent's number is below its children's."""
    steps = 0
    while a != b:
        if a > b:
            a = parents[a]
        else:
            b = parents[b]
        steps += 1
    return steps


def main_text(source: str, weights: tuple[float, ...]) -> str:
    """Content blocks in page order, joined by line feeds."""
    page = Page(source)
    return "\n".join([b.text for b, keep in zip(page.blocks, label_page(page, weights)) if keep])


def fit_pages(pages: DataFrame, text: str = "html", pages_read: int = 2000) -> list[float]:
    """Weights of the classifier, bias last, from the blocks of the ``pages_read`` pages of smallest MD5 (repeated pages count once).

    Blocks in an article or main element, with no mark of boilerplate, are content; blocks with such a mark are not; others don't
    take part. A page's blocks of a label share a weight of one page. Without both labels the weights are ``DEFAULT``.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, "_html"):
            rows = []
            for t in texts:
                found: dict[int, list] = {}
                for b in Page(t).blocks:
                    if b.mark == ARTICLE or b.mark < 0:
                        found.setdefault(int(b.mark > 0), []).append(looks(b))
                for y, x in found.items():  # the mean and a spread of a page's blocks stand for them
                    x = np.array(x)
                    picked = np.unique(np.linspace(0, len(x) - 1, 8).astype(int))
                    rows += [(y, v) for v in x[np.lexsort(x.T)][picked].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.list_(pa.float64()))], names=["y", "x"])

    drawn = smallest(pages.filter(F.col(text).isNotNull()).select(hash60(F.col(text)).alias("_draw"), F.lit(1).alias("_one")), "_draw", pages_read)
    limit = drawn.agg(F.max("_draw")).first()[0]
    if limit is None:
        return list(DEFAULT)
    sample = pages.select(F.col(text).alias("_html")).withColumn("_draw", hash60(F.col("_html"))).filter(F.col("_draw") <= limit)
    counted = sample.mapInArrow(_first_of_each(measure), "y int, x array<double>").groupBy("y", "x").agg(F.lit(1).alias("one")).orderBy("y", "x").collect()
    y, x = np.array([r.y for r in counted]), np.array([r.x for r in counted], float)
    if len(set(y.tolist())) < 2:
        return list(DEFAULT)
    weights = logistic(x, y, l2=1.0)
    weights[-1] -= math.log(y.mean() / (1 - y.mean()))  # either label is as likely beforehand
    return weights.tolist()


def _first_of_each(measure):
    """``measure`` over the different texts of a batch: copies of a page need no second look."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def different() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("_html").unique()], names=["_html"])

        return measure(different())

    return run


def extract_pages(pages: DataFrame, weights: list[float], source: str = "html", name: str = "text") -> DataFrame:
    """``pages`` without ``source``, with the main text (null or empty page, or none found: empty) and ``n_chars``, its code points.

    Character references are decoded, white space within a block is one space, blocks are joined by a line feed. Each row is worked on by
    itself, repeated rows alike; columns called ``name`` or ``n_chars`` are replaced.
    """
    keep = [c for c in pages.columns if c not in (source, name, "n_chars")]
    weights = tuple(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, source):
            found = [main_text(t, weights) for t in texts]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*keep, name, "n_chars"])

    return pages.select(*keep, source).mapInArrow(run, schema_with(pages.select(*keep), f"`{name}` string, n_chars bigint"))
