"""HTML extraction by minimum-cut labelling.

A page becomes a graph. Its nodes are the text blocks (runs of text between block-level tags) and the
elements whose tag, class, id or role tells content or boilerplate. A linear classifier gives each node a
cost of being content and one of being boilerplate, its capacities to the two terminals: text blocks by
length, links, punctuation and tag, elements by their cue, once for each block inside. Edges are what it
costs to part two nodes: a block and the nearest such element around it, such an element and the next one
around it (DOM proximity), blocks that follow each other, less the farther apart they stand in the DOM,
and blocks of one parent. The maximum flow between the terminals gives the cheapest labelling; blocks on
the content side of the cut are joined in page order. No block inherits a score: what an element tells
reaches its blocks over the edges of the cut alone.

Pages are read in one pass: a tag that the page's end cuts off is dropped, a quote that is never closed
ends at the next ``>``. Unclosed and misnested tags are repaired the way browsers do for paragraphs;
scripts, styles, comments and other invisible text never form blocks. Null html counts as empty and gives
an empty text. Repeated rows are handled alike; extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as tx

_OPENS = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|!--|!\[CDATA\[|[!?])")
#: The rest of a tag up to its end; a quote counts only as the beginning of a value.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+")
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("script style noscript template title textarea select option svg math iframe object video audio canvas".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption head".split()
)
_SPACED = frozenset("br td th img".split())
_INLINE = frozenset("p b i a span em strong".split())
_BARRIER = frozenset("article main td body".split())

#: Words of classes, ids and roles that tell boilerplate or content.
_BAD = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar sidebars widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead footer foot copyright legal disclaimer comment comments commentlist respond replies reply discussion disqus "
    "share sharing social follow related recommended recommendations trending popular teaser more tags tag byline meta author rating search toolbar skip hidden print complementary contentinfo".split()
)
_GOOD = frozenset("article content main post entry story text body prose maincontent articlebody".split())
_TAG_CUE = {"nav": -10.0, "footer": -10.0, "aside": -10.0, "form": -10.0, "menu": -10.0, "dialog": -10.0, "button": -10.0, "search": -10.0, "fieldset": -6.0, "header": -8.0, "article": 5.0, "main": 4.0, "address": -3.0}
_BLOCK_SCORE = {"p": 0.7, "h1": 1.5, "h2": 0.8, "h3": 0.6, "h4": 0.4, "blockquote": 0.5, "pre": 0.5, "li": -0.2, "td": -0.2}

#: Costs are whole numbers of this part.
_SCALE = 16
#: What it costs to part a block from the element around it that bears a cue, above any block's own cost, and such elements.
_HELD, _NESTED = 6 * _SCALE, 8 * _SCALE
#: What it costs to part blocks that follow each other, at most, the same across the border of an element with a cue, and blocks of one parent.
_NEXT, _ACROSS, _SIBLING = 2 * _SCALE, _SCALE // 2, _SCALE


@lru_cache(maxsize=65_536)
def cue(tag: str, attributes: str) -> float:
    """What an element tells of the text inside: above 0 content, below 0 boilerplate."""
    score = _TAG_CUE.get(tag, 0.0)
    if attributes and tag not in ("html", "body", "p", "a", "span", "b", "i", "em", "strong"):
        bad = good = hidden = False
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.lower()
            if name in ("class", "id", "role"):
                words = set(_WORD.findall(value))
                bad |= bool(words & _BAD)
                good |= bool(words & _GOOD)
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "")
            else:
                hidden |= "false" not in value
        if hidden:
            score -= 12.0
        elif tag in ("article", "main"):
            score -= 15.0 * (bad and not good)
        elif bad:
            score -= 10.0
        elif good and score >= 0:
            score += 3.0
    return score


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}", re.I)


class Block:
    """A run of text: its tag, how much of it is linked, the element with a cue around it, its parent and how far the block before it is."""

    __slots__ = ("apart", "around", "linked", "parent", "tag", "text")

    def __init__(self, text: str, linked: int, tag: str, around: int, parent: int, apart: int):
        self.text, self.linked, self.tag, self.around, self.parent, self.apart = text, linked, tag, around, parent, apart


class Reader:
    """One pass over a page: ``blocks``, and of each element with a cue the cue and the next such element around it (-1: none)."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.cues: list[tuple[float, int]] = []
        #: Open elements: tag, number, whether block-level, the nearest element with a cue.
        self.stack: list[tuple[str, int, bool, int]] = [("", 0, True, -1)]
        self.open: dict[str, list[int]] = {"": [0]}
        self.barriers: list[int] = []
        self.levels: list[int] = [0]
        self.parts: list[str] = []
        self.linked = self.links = self.number = 0
        self.low = self.last = 0
        self._read(page)

    def _push(self, tag: str, attributes: str) -> None:
        self.number += 1
        around = self.stack[-1][3]
        told = cue(tag, attributes)
        if tag == "header" and around >= 0 and self.cues[around][0] > 0:
            told = max(told, -2.0)
        if told:
            self.cues.append((told, around))
            around = len(self.cues) - 1
        at = len(self.stack)
        self.stack.append((tag, self.number, tag in _BLOCK, around))
        self.open.setdefault(tag, []).append(at)
        if tag in _BARRIER:
            self.barriers.append(at)
        if tag in _BLOCK:
            self.levels.append(at)

    def _cut(self, to: int) -> None:
        """Close the open elements from a place on."""
        while len(self.stack) > to:
            tag, _, is_block, _ = self.stack.pop()
            self.open[tag].pop()
            if tag in _BARRIER:
                self.barriers.pop()
            if tag == "a":
                self.links = max(0, self.links - 1)
            if is_block:
                self.levels.pop()
        self.low = min(self.low, len(self.levels))

    def _flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            self.parts.clear()
            if text:
                deep = len(self.levels)
                shared = min(self.low, deep)
                own = self.stack[self.levels[-1]]
                parent = self.stack[self.levels[-2]][1] if deep > 1 else 0
                self.blocks.append(Block(text, min(self.linked, len(text)), own[0], self.stack[-1][3], parent, max(0, self.last + deep - 2 * shared - 2)))
                self.last = self.low = deep
            self.linked = 0

    def _end_tag(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        found = self.open.get(tag)
        if found and (tag not in _INLINE or not self.barriers or self.barriers[-1] < found[-1]):
            self._cut(found[-1])

    def _start_tag(self, tag: str, attributes: str) -> None:
        if tag in _SPACED:
            self.parts.append(" ")
        if tag in _BLOCK:
            self._flush()
            for k in range(len(self.stack) - 1, 0, -1):
                name = self.stack[k][0]
                if name == "p" or name == "li" == tag or name == tag and tag in ("dt", "dd", "tr"):
                    self._cut(k)
                    break
                if self.stack[k][2]:
                    break
        if tag not in _VOID:
            self.links += tag == "a"
            self._push(tag, attributes)

    def _read(self, page: str) -> None:
        page = page.removesuffix("</").removesuffix("<")
        at, size = 0, len(page)
        unclosed: set[str] = set()
        while True:
            found = _OPENS.search(page, at)
            begin = found.start() if found else size
            if begin > at:
                self.parts.append(page[at:begin])
                if self.links:
                    self.linked += begin - at
            if found is None:
                break
            at, tag = found.end(), found[2]
            if tag is None:
                # comments, CDATA and declarations end at their own mark or with the page
                mark = {"<!--": "-->", "<![CDATA[": "]]>"}.get(found[0], ">")
                end = page.find(mark, begin + 2 if mark == "-->" else at)
                if end < 0:
                    break
                at = end + len(mark)
                continue
            end = _REST.match(page, at).end()
            if end < size and page[end] != ">":
                end = page.find(">", end)
            if end < 0 or end >= size:
                break
            attributes, at, tag = page[at:end], end + 1, tag.lower()
            if found[1]:
                self._end_tag(tag)
            elif tag in _SKIPPED and not attributes.endswith("/"):
                close = None if tag in unclosed else _closing(tag).search(page, at)
                if close is None:
                    if tag in ("script", "style", "title", "textarea"):
                        break
                    unclosed.add(tag)
                    continue
                at = page.find(">", close.start()) + 1 or size
            else:
                self._start_tag(tag, attributes)
        self._flush()


def classify(block: Block) -> float:
    """By a block's own text and tag; above 0: likelier content. Its two costs are the positive and the negative part."""
    n = len(block.text)
    score = _BLOCK_SCORE.get(block.tag, 0.0)
    score += 1.5 if n >= 200 else 0.8 if n >= 80 else 0.0 if n >= 25 else -0.8
    if block.linked > 0.5 * n:
        score -= 3.0
    if block.text[-1] in ".!?\"'”»…" and n >= 25:
        score += 0.4
    if "©" in block.text or "All rights reserved" in block.text:
        score -= 2.0
    if block.tag in ("div", "body", "", "html", "section"):
        score -= 0.5
    return score


def minimum_cut(unary: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of the nodes: True on the source's side of a minimum cut.

    ``unary`` above 0 is a node's capacity from the source, below 0 to the sink; edges hold both ways. Flow
    is sent along the shortest paths left, all of one length at a time (Dinic).
    """
    n = len(unary)
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[int] = []
    for a, b, w in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += (b, a)
        room += (w, w)
    left = list(unary)
    while True:
        # distances from the nodes that still have flow to give
        level = [-1] * n
        queue = [i for i in range(n) if left[i] > 0]
        for i in queue:
            level[i] = 0
        reached = -1
        for i in queue:
            if 0 <= reached <= level[i]:
                break
            for e in near[i]:
                j = to[e]
                if room[e] > 0 and level[j] < 0:
                    level[j] = level[i] + 1
                    if left[j] < 0 and reached < 0:
                        reached = level[j]
                    queue.append(j)
        if reached < 0:
            return [x >= 0 for x in level]
        tried = [0] * n
        for start in range(n):
            if left[start] <= 0:
                continue
            path: list[int] = []
            at = start
            while left[start] > 0:
                if left[at] < 0:
                    flow = min(left[start], -left[at], min(room[e] for e in path))
                    left[start] -= flow
                    left[at] += flow
                    back = len(path)
                    for k in range(len(path) - 1, -1, -1):
                        e = path[k]
                        room[e] -= flow
                        room[e ^ 1] += flow
                        if not room[e]:
                            back = k
                    if back < len(path):
                        at = to[path[back] ^ 1]
                        del path[back:]
                    continue
                ways = near[at]
                k = tried[at]
                while k < len(ways) and (room[ways[k]] <= 0 or level[to[ways[k]]] != level[at] + 1):
                    k += 1
                tried[at] = k
                if k < len(ways):
                    path.append(ways[k])
                    at = to[ways[k]]
                elif path:
                    at = to[path.pop() ^ 1]
                    tried[at] += 1
                else:
                    break


def graph_of(read: Reader) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Costs and edges: first the blocks, then the elements with a cue."""
    n = len(read.blocks)
    inside = [0] * len(read.cues)
    for block in read.blocks:
        if block.around >= 0:
            inside[block.around] += 1
    edges = []
    for k in range(len(read.cues) - 1, -1, -1):
        around = read.cues[k][1]
        if around >= 0 and inside[k]:
            inside[around] += inside[k]
            edges.append((n + k, n + around, _NESTED * inside[k]))
    last: dict[int, int] = {}
    for i, block in enumerate(read.blocks):
        if block.around >= 0:
            edges.append((i, n + block.around, _HELD))
        if i:
            crossed = read.blocks[i - 1].around != block.around
            edges.append((i - 1, i, max(1, (_ACROSS if crossed else _NEXT) // (1 + block.apart))))
        if last.get(block.parent, i) < i - 1:
            crossed = read.blocks[last[block.parent]].around != block.around
            edges.append((last[block.parent], i, _ACROSS if crossed else _SIBLING))
        last[block.parent] = i
    costs = [round(_SCALE * classify(b)) for b in read.blocks]
    return costs + [round(_SCALE * told * k) for (told, _), k in zip(read.cues, inside, strict=True)], edges


def labelled(page: str) -> list[tuple[Block, bool]]:
    """The blocks of a page and whether the cut puts them to the content."""
    read = Reader(page)
    unary, edges = graph_of(read)
    return list(zip(read.blocks, minimum_cut(unary, edges), strict=False))


def main_text(page: str | None) -> str:
    """The content blocks of a page, two line feeds between them."""
    return "\n\n".join(b.text for b, keep in labelled(page or "") if keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.pieces(batch, "html", 4 << 20):
                texts = [main_text(page) for page in piece.column(piece.schema.get_field_index("html")).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(piece.schema.get_field_index("page_id")), piece.column(piece.schema.get_field_index("url")), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    pages = pages.select("page_id", "url", "html")
    return pages.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
