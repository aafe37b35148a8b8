"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a binary variable: is its own text article text? Its features (tag, names, ancestors, length, share of
links) give a unary potential, and each parent and child share a pairwise one, by the kind of both. Messages passed from
the leaves to the root and back give exact marginals; blocks of at least 0.5 are the text. Weights are fitted to labelled
pages by the gradient of the exact likelihood, which needs the same marginals.
"""

from __future__ import annotations

import html as _html
import json
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, tidied
from tessera.llm.html_pages import MARK, labelled_pages

#: Fixed values of HTML: elements without content; scripts, styles, metadata and form controls, whose text is no page text; those of them that hold
#: raw text; inline elements; and elements below which all are inline.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template iframe textarea select button head title noframes datalist".split())
RAW = frozenset("script style textarea title iframe noframes".split())
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big button canvas cite code data datalist del dfn em font i ins kbd label map mark math meter noscript object optgroup option output picture progress q rp rt ruby s samp "
    "select slot small span strike strong sub sup svg template time tt u var video".split()
)
ALL_INLINE = ("math", "svg")
#: Inline elements whose end tag ends blocks left open in them, too.
_WHOLE = frozenset("audio button canvas datalist math noscript object select svg template video".split())
#: Start tags that leave a head open; any other, and text, ends it.
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_SPACE = " \t\n\f\r"
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul dialog".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)|/)")
_ENDS = re.compile(r"""[>"']""")
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PARTS = re.compile(r"[a-z]+")
_ANCESTORS = frozenset("nav header footer aside form dialog menu article main section ul ol table blockquote figure".split())
_ROOTS = frozenset(("html", "body", ""))
_KINDS = {**dict.fromkeys(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "tr", "ul", "ol", "pre", "blockquote", "table", "dd", "dt", "tbody", "thead"), 1), **dict.fromkeys(("article", "main"), 2), **dict.fromkeys(("nav", "aside", "footer", "header", "form", "dialog", "menu"), 3)}
KINDS = 8  # of the child, four, below a root or not


@dataclass
class Page:
    """Block elements in page order (0 is the root) and their runs of text. labels: of training pages only."""

    tags: list[str]
    parents: list[int]
    names: list[list[str]]
    labels: list[int | None]
    runs: list[tuple[int, str, int]]  # element, text, characters in links


class _TagEnds:
    """Where a tag ends: at the first > outside quotes, or -1 without one. What a search passes is kept, so all searches together are linear in the page."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.known: dict[int, int] = {}  # of a quote's place

    def after(self, at: int) -> int:
        passed: list[int] = []
        while True:
            m = _ENDS.search(self.source, at)
            if m is None or m[0] == ">":
                end = -1 if m is None else m.start()
                break
            place = m.start()
            if place in self.known:
                end = self.known[place]
                break
            passed.append(place)
            at = self.source.find(m[0], place + 1) + 1
            if at == 0:  # not closed
                end = -1
                break
        self.known.update(dict.fromkeys(passed, end))
        return end


def parse(html: str | None, mark: str | None = None) -> Page:
    """Builds the tree of block elements as browsers would, near enough; no input makes it fail.

    mark: the attribute that holds a training page's labels. Without it no attribute is read but class, id and role.
    """
    page = Page([""], [-1], [[]], [None], [])
    stack: list[tuple[str, int, bool]] = [("", 0, True)]  # open elements, and if they are blocks; an inline one has its block's number
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements in the stack, by tag
    blocks = [0]  # places of those that are not inline
    silent = links = 0
    pieces: list[str] = []
    linked = 0
    source = html or ""
    labelled = re.compile(rf'(?<![\w-]){mark}="(\d)"') if mark else None

    def text(raw: str) -> None:
        nonlocal linked
        if stack[-1][0] == "head" and raw.strip(_SPACE):
            leave_head()
        if not silent and raw:
            pieces.append(raw)
            linked += len(raw) if links else 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            run = " ".join(_html.unescape("".join(pieces)).split())
            if run:
                page.runs.append((stack[-1][1], run, linked))
            pieces.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal silent, links
        while len(stack) > depth:
            tag = stack[-1][0]
            if stack[-1][2]:
                flush()
                blocks.pop()
            stack.pop()
            places[tag].pop()
            silent -= tag in SILENT
            links -= tag == "a"

    def push(tag: str, number: int, block: bool) -> None:
        places[tag].append(len(stack))
        if block:
            blocks.append(len(stack))
        stack.append((tag, number, block))

    def add(tag: str, names: list[str], label: int | None) -> None:
        page.tags.append(tag)
        page.parents.append(stack[-1][1])
        page.names.append(names)
        page.labels.append(label)
        push(tag, len(page.tags) - 1, True)

    def leave_head() -> None:
        """At what cannot be in a head, the head ends and a body begins."""
        pop_to(len(stack) - 1)
        if not places["body"]:
            add("body", [], None)

    ends = _TagEnds(source)
    at, end = 0, len(source)
    while at < end:
        m = _OPEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        if m[1]:
            at = source.find("-->", m.end()) + 3
            at = end if at == 2 else at
            continue
        close = ends.after(m.end()) if m[4] else -1
        if close < 0:  # a declaration, </ without a name, a tag with an unclosed quote or none at all: to the next >, or all that is left
            at = source.find(">", m.end()) + 1 or end
            continue
        tag, closing, attributes = m[4].lower(), m[3], source[m.end() : close]
        at = close + 1
        if closing:
            if tag == "br":
                pieces.append(" ")
                continue
            # An inline element ends if it was opened in this block; a block ends with all that is open in it.
            if places[tag] and (stack[places[tag][-1]][2] or places[tag][-1] > blocks[-1] or tag in _WHOLE):
                pop_to(places[tag][-1])
            continue
        if stack[-1][0] == "head" and tag not in _IN_HEAD:
            if tag == "body":
                pop_to(len(stack) - 1)
            else:
                leave_head()
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            closed = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
            at = end if closed is None else (source.find(">", closed.end()) + 1 or end)
            continue
        if tag in ("html", "body") and places[tag]:
            continue
        if tag == "head" and (pieces or page.runs or any(t not in ("", "html") for t in page.tags)):  # a head comes first, and once
            continue
        if tag in _CLOSES_P:
            if stack[blocks[-1]][0] == "p":
                pop_to(blocks[-1])
        elif tag in _CLOSED_BY:
            inside = max((places[t][-1] for t in _SCOPE[tag] if places[t]), default=0)
            if tag in ("tr", "tbody", "tfoot"):  # the outermost in its table
                cut = min((places[t][k] for t in _CLOSED_BY[tag] if (k := bisect_right(places[t], inside)) < len(places[t])), default=0)
            else:
                cut = max((places[t][-1] for t in _CLOSED_BY[tag] if places[t]), default=0)
            if cut > inside:
                pop_to(cut)
        silent += tag in SILENT
        if tag in INLINE or any(places[t] for t in ALL_INLINE):
            links += tag == "a"
            push(tag, stack[-1][1], False)
            continue
        flush()
        if tag == "body" and silent:  # something in the head was not closed
            silent = 0
            still = [x for x in stack[1:] if x[0] not in SILENT]
            del stack[1:], blocks[1:]
            places.clear()
            for x in still:
                push(*x)
        names: list[str] = []
        label = None
        for value in _NAMES.findall(attributes) if attributes else ():
            names += _PARTS.findall("".join(value).lower())
        if labelled and (found := labelled.search(attributes)):
            label = int(found[1])
        add(tag, names, label)
    flush()
    return page


def _bin(n: float, edges: tuple[float, ...]) -> int:
    return sum(n >= e for e in edges)


def node_features(page: Page) -> list[list[str]]:
    """Names of the active features of every element."""
    n = len(page.tags)
    own, link, ends = [0] * n, [0] * n, [False] * n
    for k, run, linked in page.runs:
        own[k] += len(run)
        link[k] += min(linked, len(run))
        ends[k] = run[-1] in ".!?…\"”»"
    under, under_link, children, texts = own[:], link[:], [0] * n, [0] * n
    for k in range(n - 1, 0, -1):
        p = page.parents[k]
        under[p] += under[k]
        under_link[p] += under_link[k]
        children[p] += 1
        texts[p] += own[k] > 0
    above: list[frozenset[str]] = [frozenset()] * n
    out = []
    for k in range(n):
        tag, p = page.tags[k], page.parents[k]
        f = ["1", "t:" + tag]
        f += ["n:" + x for x in page.names[k]]
        if p >= 0:
            more = {"t:" + page.tags[p]} if page.tags[p] in _ANCESTORS else set()
            more |= {"n:" + x for x in page.names[p]}
            above[k] = above[p] | more if more else above[p]
            f += ["u" + x for x in above[k]]
            f.append("p:" + page.tags[p])
        share = under_link[k] / under[k] if under[k] else 0.0
        f.append(f"l:{_bin(share, (0.01, 0.2, 0.5, 0.9))}")
        f.append(f"s:{_bin(under[k], (1, 25, 80, 200, 1000))}")
        if own[k]:
            f.append(f"o:{_bin(own[k], (10, 40, 100, 300))}:{int(ends[k])}")
            f.append(f"ol:{_bin(link[k] / own[k], (0.01, 0.3, 0.9))}:{tag}")
        if children[k]:
            f.append(f"c:{_bin(texts[k], (1, 2, 4))}")
        out.append(f)
    return out


@dataclass
class Forest:
    """Many pages' elements as one forest: parents before children."""

    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]
    row: np.ndarray
    column: np.ndarray
    starts: list[int]


def forest(pages: list[Page], index: dict[str, int], grow: bool = False) -> Forest:
    parent, kind, depth, row, column, starts = [], [], [], [], [], []
    for page in pages:
        base = len(parent)
        starts.append(base)
        for k, (tag, p, names) in enumerate(zip(page.tags, page.parents, node_features(page), strict=True)):
            parent.append(base + p if p >= 0 else -1)
            depth.append(depth[base + p] + 1 if p >= 0 else 0)
            kind.append(_KINDS.get(tag, 0) + 4 * (p >= 0 and page.tags[p] in _ROOTS))
            for name in names:
                i = index.setdefault(name, len(index)) if grow else index.get(name)
                if i is not None:
                    row.append(base + k)
                    column.append(i)
    deep = np.array(depth, np.int64)
    order = np.argsort(deep, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(deep))[:-1]) if len(deep) else []
    return Forest(np.array(parent, np.int64), np.array(kind, np.int64), levels, np.array(row, np.int64), np.array(column, np.int64), starts)


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray  # of features, for content
    pair: np.ndarray  # [kind, parent, child]

    def to_json(self) -> str:
        """For a file: pages need be labelled and the model fitted only once."""
        return json.dumps({"names": list(self.index), "weights": self.weights.tolist(), "pair": self.pair.tolist()})

    @staticmethod
    def from_json(text: str) -> Model:
        got = json.loads(text)
        return Model({name: i for i, name in enumerate(got["names"])}, np.array(got["weights"]), np.array(got["pair"]))

    def unary(self, f: Forest) -> np.ndarray:
        out = np.zeros((len(f.parent), 2))
        out[:, 1] = np.bincount(f.row, self.weights[f.column], len(f.parent))
        return out


def sum_product(f: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact marginals of every element (n, 2), and of every element with its parent (n, parent, child), by levels."""
    belief = unary.copy()  # of the subtree
    up = np.zeros_like(unary)  # message to the parent
    edge = pair[f.kind]
    for level in reversed(f.levels[1:]):
        up[level] = np.logaddexp(edge[level, :, 0] + belief[level, None, 0], edge[level, :, 1] + belief[level, None, 1])
        low, to = f.parent[level].min(), f.parent[level]
        for y in (0, 1):
            got = np.bincount(to - low, up[level, y])
            belief[low : low + len(got), y] += got
    full = belief.copy()
    for level in f.levels[1:]:
        rest = full[f.parent[level]] - up[level]  # what the parent knows without this child
        full[level] = belief[level] + np.logaddexp(edge[level, 0] + rest[:, :1], edge[level, 1] + rest[:, 1:])
    marginal = np.exp(full - np.logaddexp(full[:, :1], full[:, 1:]))
    joint = np.zeros((len(f.parent), 2, 2))
    for level in f.levels[1:]:
        j = (full[f.parent[level]] - up[level])[:, :, None] + edge[level] + belief[level][:, None, :]
        j = np.exp(j - j.max(axis=(1, 2), keepdims=True))
        joint[level] = j / j.sum(axis=(1, 2), keepdims=True)
    return marginal, joint


def fit(pages: list[str], mark: str = MARK, steps: int = 250, rate: float = 0.1, decay: float = 3e-4) -> Model:
    """Adam on the penalised exact log-likelihood of pages whose attribute `mark` has the labels: 1 for article text, 0 for other, of an element and those below it."""
    parsed = [parse(p, mark) for p in pages]
    index: dict[str, int] = {}
    f = forest(parsed, index, grow=True)
    y = np.zeros(len(f.parent), np.int64)
    for base, page in zip(f.starts, parsed, strict=True):
        for k, label in enumerate(page.labels):
            y[base + k] = label if label is not None else y[base + page.parents[k]] if k else 0
    # Names seen on few elements say nothing about other pages.
    seen = np.bincount(f.column, minlength=len(index))
    rare = seen < 8
    w, pair = np.zeros(len(index)), np.zeros((KINDS, 2, 2))
    child = f.parent >= 0
    observed = np.zeros_like(pair)
    np.add.at(observed, (f.kind[child], y[f.parent[child]], y[child]), 1)
    m, v = np.zeros(w.size + pair.size), np.zeros(w.size + pair.size)
    for t in range(1, steps + 1):
        model = Model(index, w, pair)
        marginal, joint = sum_product(f, model.unary(f), pair)
        gw = np.bincount(f.column, (y - marginal[:, 1])[f.row], len(w)) / len(pages) - decay * w
        gw[rare] = 0
        expected = np.stack([np.bincount(f.kind[child], joint[child, a, b], KINDS) for a in (0, 1) for b in (0, 1)], 1).reshape(pair.shape)
        gp = (observed - expected) / len(pages) - decay * pair
        g = np.concatenate([gw, gp.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, pair = w + step[: len(w)], pair + step[len(w) :].reshape(pair.shape)
    kept = {name: i for name, i in index.items() if not rare[i]}
    return Model({name: j for j, name in enumerate(kept)}, w[list(kept.values())], pair)


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(labelled_pages())


def content(pages: list[Page], model: Model) -> list[str]:
    f = forest(pages, model.index)
    marginal, _ = sum_product(f, model.unary(f), model.pair)
    return ["\n\n".join(run for k, run, _ in page.runs if marginal[base + k, 1] >= 0.5) for base, page in zip(f.starts, pages, strict=True)]


def extract_text(pages: DataFrame, model: Model | None = None, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url"), batch_nodes: int = 20_000) -> DataFrame:
    """The columns in carry, text and n_chars of every row, from the whole html.

    Blocks are joined by two newlines; white space in a block is one space. A null or empty page, and one without
    article text, has the empty text. Repeated rows stay. An empty table gives an empty result. Very long pages are parsed
    whole, one at a time; what is held of a page is in proportion to it. Columns outside carry are not read, so their names may clash;
    a carried column named text or n_chars gives way to the result's.
    """
    carry = tuple(c for c in carry if c.lower() not in ("text", "n_chars"))
    small_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(model or default_model())
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{html_col}`").alias("html"))
    schema = rows.select("row", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, waiting, n = [], [], 0
            for i in range(batch.num_rows):
                waiting.append(parse(batch.column("html")[i].as_py()))
                n += len(waiting[-1].tags)
                if n >= batch_nodes:
                    texts += content(waiting, held.value)
                    waiting, n = [], 0
            texts += content(waiting, held.value) if waiting else []
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])

    return rows.mapInArrow(tidied(run), schema).select("row.*", "text", "n_chars")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
