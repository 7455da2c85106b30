"""Main text of web pages, found with a tree-structured graphical model over the DOM.

Every element and every block of text is a node that is content or not. What is seen at a node (its tag, the
words of its class and id, how much of its text is links, how the text ends) depends on the node's own state,
and the state of a child on that of its parent. Both tables are counted on labelled pages. For a new page,
messages run from the leaves to the root and back, which gives the exact probability that a node is content
given everything seen on the page; blocks of text above one half are kept.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .labelled_pages import labelled_pages

# Fixed values of HTML, SVG and MathML: elements without an end tag, without visible text, and inside lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template title head iframe textarea select option button".split())
RAW = frozenset("script style title textarea".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var"
    " audio canvas map object picture svg video"
    " circle clippath defs ellipse g image line lineargradient mask path pattern polygon polyline radialgradient rect stop symbol text textpath tspan use"
    " maction math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext"
    " mtr munder munderover semantics".split()
)
#: Inside lines and without an end tag.
INLINE_VOID = frozenset("area embed img param source track wbr".split())
#: Inside lines and never seen; in SVG its notes, style and script as well.
UNSEEN, UNSEEN_IN_SVG = frozenset("annotation annotation-xml".split()), frozenset("desc metadata script style title".split())
#: Inside lines, but drawn apart from what stands around them.
APART = frozenset("audio canvas object svg text tspan video".split())
#: Start tags that end an open paragraph, and elements that end an open one of the same kind.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
ENDS_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",)}

#: Elements that group blocks. Content starts and ends at them more often than at paragraphs and the like.
GROUPS = frozenset("html body div main article section aside header footer nav form table td ul ol dl figure fieldset details center".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    """An element, or a block of text (tag '#')."""

    tag: str
    parent: int
    names: tuple[str, ...] = ()
    hidden: bool = False
    parts: list[str] = field(default_factory=list)
    size: int = 0
    linked: int = 0
    text: str = ""
    label: str | None = None


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first; node 0 is the root. Takes any string; what isn't closed ends with its parent."""
    nodes = [Node("", -1)]
    stack = [0]  # open block elements
    block = -1  # the open text block
    opened: Counter = Counter()
    inline: list[str] = []
    end = len(page)
    at = 0
    while at < end:
        token = _TOKEN.match(page, at)
        at = token.end()
        name = token.group(2)
        if name is None:
            text = token.group()
            if text[0] != "<" or text == "<":
                if not nodes[stack[-1]].hidden:
                    if block < 0:
                        nodes.append(Node("#", stack[-1]))
                        block = len(nodes) - 1
                    nodes[block].parts.append(text)
                    if "a" in inline:
                        nodes[block].linked += len(text)
            continue
        tag = name.lower()
        if tag in INLINE_VOID:
            continue
        if tag in UNSEEN or (tag in UNSEEN_IN_SVG and "svg" in inline):
            if not token.group(1) and not token.group(3).endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag in INLINE:
            if token.group(1):
                if tag in inline:
                    del inline[len(inline) - 1 - inline[::-1].index(tag)]
            elif not token.group(3).endswith("/"):
                inline.append(tag)
            if tag in APART and block >= 0:
                nodes[block].parts.append(" ")
            continue
        if tag == "br":
            if block >= 0:
                nodes[block].parts.append(" ")
            continue
        block = -1
        inline.clear()
        if token.group(1):
            while opened[tag]:  # close down to the nearest open element of this kind
                last = nodes[stack.pop()].tag
                opened[last] -= 1
                if last == tag:
                    break
            continue
        if tag in ENDS_ITSELF or tag in ENDS_PARAGRAPH:
            closes = ENDS_ITSELF.get(tag, ("p",))
            if nodes[stack[-1]].tag in closes:
                opened[nodes[stack.pop()].tag] -= 1
        attributes = token.group(3)
        names, label = [], None
        for a in _ATTRIBUTE.finditer(attributes):
            names += _WORD.findall((a.group(2) or a.group(3) or a.group(4) or "").lower())
        if "data-label" in attributes:
            label = "content" if 'data-label="content"' in attributes else "other"
        nodes.append(Node(tag, stack[-1], tuple(dict.fromkeys(names)), nodes[stack[-1]].hidden or tag in HIDDEN, label=label))
        if tag in VOID or attributes.endswith("/"):
            continue
        stack.append(len(nodes) - 1)
        opened[tag] += 1
        if tag in RAW:
            close = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = close.start() if close else end
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
        node = nodes[i]
        if node.tag == "#":
            node.text = _SPACE.sub(" ", html.unescape("".join(node.parts))).strip()
            node.size = len(node.text)
            node.linked = min(node.linked, node.size)
        if i:
            nodes[node.parent].size += node.size
            nodes[node.parent].linked += node.linked
    return nodes


LISTS = frozenset("ul ol dl table".split())


def kind_of(node: Node) -> str:
    """Which table of parent and child states a node falls under."""
    return "text" if node.tag == "#" else "group" if node.tag in GROUPS else "block"


def features(node: Node) -> Iterator[str]:
    """What is seen at a node, apart from its neighbours."""
    if node.tag != "#":
        yield f"tag {node.tag}"
        for name in node.names:
            yield f"name {name}"
        if node.tag in LISTS and node.size:
            yield f"list links {4 * node.linked // node.size}"
        return
    yield f"links {4 * node.linked // max(1, node.size)}"
    yield f"stop {node.size > 0 and node.text[-1] in '.!?…'}"


@dataclass
class TreeModel:
    """Log tables, index 0 for other and 1 for content."""

    start: tuple[float, float]
    child: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    seen: dict[str, tuple[float, float]]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for every node, by sum-product over the tree."""
        n = len(nodes)
        seen, child = self.seen, self.child
        kinds = [kind_of(node) for node in nodes]
        up = []
        for node in nodes:
            a = b = 0.0
            for name in features(node):
                pair = seen.get(name)
                if pair:
                    a += pair[0]
                    b += pair[1]
            up.append([a, b])
        messages = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            (c00, c01), (c10, c11) = child[kinds[i]]
            a, b = up[i]
            m = (_add(c00 + a, c01 + b), _add(c10 + a, c11 + b))
            messages[i] = m
            to = up[nodes[i].parent]
            to[0] += m[0]
            to[1] += m[1]
        belief = [(0.0, 0.0)] * n
        out = [0.0] * n
        for i in range(n):
            if i:
                # What the parent knows without this child, sent through the potential.
                (c00, c01), (c10, c11) = child[kinds[i]]
                pa0, pa1 = belief[nodes[i].parent]
                pa0, pa1 = pa0 - messages[i][0], pa1 - messages[i][1]
                a, b = _add(pa0 + c00, pa1 + c10), _add(pa0 + c01, pa1 + c11)
            else:
                a, b = self.start
            a, b = a + up[i][0], b + up[i][1]
            top = max(a, b)
            belief[i] = (a - top, b - top)
            out[i] = 1 / (1 + math.exp(min(700.0, a - b)))
        return out


def _add(x: float, y: float) -> float:
    """log(exp(x) + exp(y))"""
    if x < y:
        x, y = y, x
    return x + math.log1p(math.exp(y - x))


def fit(pages: list[str], smoothing: float = 0.2) -> TreeModel:
    """Counts the tables on pages whose elements carry data-label="content" or "other"; what is inside inherits it.

    What was never seen in training says nothing about a node.
    """
    state_counts: Counter = Counter()
    pairs: Counter = Counter()
    seen: Counter = Counter()
    totals: Counter = Counter()
    kind_seen: dict[str, str] = {}
    for page in pages:
        nodes = parse(page)
        states: list[int] = []
        for node in nodes:
            inherited = states[node.parent] if node.parent >= 0 else 0
            states.append(inherited if node.label is None else int(node.label == "content"))
        for node, state in zip(nodes, states, strict=True):
            kind = kind_of(node)
            if node.parent >= 0:
                pairs[kind, states[node.parent], state] += 1
            else:
                state_counts[state] += 1
            if node.hidden:
                continue
            totals[kind, state] += 1
            for name in features(node):
                seen[name, state] += 1
                kind_seen[name] = "list" if name.startswith("list ") else kind
            if node.tag in LISTS:
                totals["list", state] += 1
    child = {}
    for kind in ("text", "group", "block"):
        rows = []
        for parent in (0, 1):
            counts = [pairs[kind, parent, s] + smoothing for s in (0, 1)]
            rows.append(tuple(math.log(c / sum(counts)) for c in counts))
        child[kind] = tuple(rows)
    table = {}
    for name in {n for n, _ in seen}:
        # How often it is seen at a node of its kind in either state.
        chance = [(seen[name, s] + smoothing) / (totals[kind_seen[name], s] + 2 * smoothing) for s in (0, 1)]
        table[name] = (math.log(chance[0]), math.log(chance[1]))
    first = [state_counts[s] + smoothing for s in (0, 1)]
    return TreeModel(tuple(math.log(c / sum(first)) for c in first), child, table)


@functools.cache
def default_model() -> TreeModel:
    """The model of the built-in labelled pages."""
    return fit(labelled_pages())


def main_text(page: str | None, model: TreeModel, threshold: float = 0.5) -> str:
    """Blocks of content in page order, one on a line."""
    nodes = parse(page or "")
    chances = model.marginals(nodes)
    return "\n".join(node.text for node, p in zip(nodes, chances, strict=True) if node.text and p > threshold)


def _extract(model: TreeModel, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, model, threshold) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    return run


def extract_text(
    pages: DataFrame, id_col: str, url_col: str, html_col: str, model: TreeModel | None = None, threshold: float = 0.5
) -> DataFrame:
    """Main text of pages: (id, url, text).

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
    joined by one newline. Null and empty pages have empty text, as have pages without content. Broken markup
    is read as far as it goes: an element that isn't closed ends with its parent, a tag that isn't closed
    ends with the page. Nesting may be of any depth. Rows are independent; repeated rows are rows of their
    own, other columns are ignored.
    """
    ship(pages.sparkSession)
    cut = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    run = _extract(default_model() if model is None else model, threshold)
    found = cut.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string")
    return found.toDF(id_col, url_col, "text")
