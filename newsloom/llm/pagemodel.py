"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a node with the label content or not. A node's own look (tag, words of its
class and id, amount of text, links, sentences) gives its potential; a potential for each edge, by the kind of
the child, couples parent and child. Sum-product messages go up the tree and down again and give each node's
exact marginal. The weights are fitted on labelled pages by gradient steps on their likelihood, whose
expectations are the same marginals. Messages of all pages of a batch are computed level by level with numpy.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "template", "svg", "math", "select", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "ruby",
    "rt", "rp", "picture", "object", "video", "audio", "canvas", "map", "noscript", "nobr", "center",
}
CLOSES = {  # an open element of these kinds ends where one of the key begins
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
TAGS = [
    "html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt",
    "dd", "nav", "header", "footer", "aside", "form", "fieldset", "button", "table", "tr", "td", "th", "blockquote", "pre",
    "figure", "figcaption", "address", "menu", "dialog", "details", "summary", "other",
]
HINTS = [  # stems of class and id words
    "article", "content", "post", "entry", "story", "main", "body", "text", "blog", "page", "prose", "column", "lead", "headline", "title",
    "nav", "menu", "header", "masthead", "foot", "side", "widget", "ad", "advert", "banner", "sponsor", "promo", "cookie",
    "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "comment", "repl", "discuss", "disqus", "respon", "share",
    "social", "relat", "recommend", "popular", "breadcrumb", "crumb", "pag", "form", "login", "search", "subscrib", "newsletter",
    "signup", "copyright", "legal", "tool", "skip", "meta", "tag", "author", "byline", "caption", "quote", "note",
]
LENGTHS = [0, 1, 25, 60, 120, 240, 600, 1500]  # code points
N_TAGS, N_HINTS, N_LEN = len(TAGS), len(HINTS), len(LENGTHS)
OTHER = ["link_some", "link_half", "link_all", "sentence", "sentences", "comma", "copyright", "first", "top", "many_children",
         "inside_link_list", "bias"]
N_FEATURES = N_TAGS + N_HINTS + 2 * N_LEN + len(OTHER)
KINDS = {"p": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "li": 3, "ul": 3, "ol": 3, "td": 4, "tr": 4, "table": 4, "div": 5, "section": 5,
         "article": 6, "main": 6, "nav": 7, "footer": 7, "aside": 7, "form": 7, "header": 8}
N_KINDS = 10  # 9: has a class or id word of HINTS
_tag_number = {t: i for i, t in enumerate(TAGS)}
_hint_cache: dict[str, list[int]] = {}


def _hints(attributes: str) -> list[int]:
    """Numbers of the hints that class, id and role name."""
    if not attributes:
        return []
    found = _hint_cache.get(attributes)
    if found is None:
        value = " ".join(v.strip("\"'") for _, v in ATTRIBUTE.findall(attributes))
        words = WORD.findall(CAMEL.sub(r"\1 \2", value).lower())
        found = sorted({
            i for w in words for i, h in enumerate(HINTS)
            if (w in ("ad", "ads", "adsense", "adsbygoogle", "adbox", "adslot") if h == "ad" else w == h if h in ("pag", "tag", "side") and len(w) < 3
                else w.startswith(h))})
        if len(_hint_cache) > 50_000:
            _hint_cache.clear()
        _hint_cache[attributes] = found
    return found


@dataclass
class Page:
    tags: list[str]
    parents: list[int]
    hints: list[list[int]]
    blocks: list[tuple[int, str]]  # node and text, in page order
    links: list[int]  # code points in links, of the node's own text


def parse(page: str | None) -> Page:
    """The tree of block elements. Inline elements belong to the block around them; end tags close the nearest open
    element of their name, elements of CLOSES and `p` end where the next one begins; unknown elements are blocks."""
    tags, parents, hints, links = ["other"], [-1], [[]], [0]
    blocks: list[tuple[int, str]] = []
    stack = [0]
    pieces: list[str] = []
    in_link = False
    linked = 0
    text = page or ""

    def flush() -> None:
        nonlocal linked
        if pieces:
            joined = "".join(pieces)
            joined = " ".join((entities.unescape(joined) if "&" in joined else joined).split())
            if joined:
                blocks.append((stack[-1], joined))
                links[stack[-1]] += min(linked, len(joined))
            pieces.clear()
        linked = 0

    at, n = 0, len(text)
    search = TOKEN.search
    while at < n:
        token = search(text, at)
        end = token.start() if token else n
        if end > at:
            pieces.append(text[at:end])
            if in_link:
                linked += end - at
        if not token:
            break
        at = token.end()
        name = token[2] or token[5]
        if not name:
            continue
        name = name.lower()
        closing = bool(token[1] or token[4])
        if name == "br":
            pieces.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                in_link = not closing
            continue
        if closing:
            if name in RAW:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] == name:
                    flush()
                    del stack[i:]
                    in_link = False
                    break
            continue
        attributes = token[3] or token[6] or ""
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in RAW:
            if name == "head":  # ends with its end tag, or where the body begins
                over = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(text, at)
                at = over.end() if over else at
            elif not attributes.rstrip().endswith("/"):
                over = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(text, at)
                at = over.end() if over else n
            pieces.append(" ")
            continue
        flush()
        in_link = False
        ends = CLOSES.get(name)
        top = tags[stack[-1]]
        if top == "p" or (top[0] == "h" and top[1:].isdigit() and name[0] == "h" and name[1:].isdigit()):
            stack.pop()
            top = tags[stack[-1]]
        while ends and top in ends:
            stack.pop()
            top = tags[stack[-1]]
        tags.append(name)
        parents.append(stack[-1])
        hints.append(_hints(attributes))
        links.append(0)
        stack.append(len(tags) - 1)
    flush()
    return Page(tags, parents, hints, blocks, links)


_bucket = np.array(LENGTHS[1:])


class Forest:
    """Nodes of several pages with their active features, ordered by depth."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.tags) for p in pages]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n = int(self.first[-1])
        base = np.repeat(self.first[:-1], sizes)
        local = np.array([x for p in pages for x in p.parents], np.int64)
        self.parent = np.where(local < 0, -1, local + base)
        own = np.zeros(n, np.int64)
        stops = np.zeros(n, np.int64)
        commas = np.zeros(n, np.int64)
        copyright_ = np.zeros(n, bool)
        for start, p in zip(self.first, pages, strict=False):
            for node, text in p.blocks:
                i = start + node
                own[i] += len(text)
                stops[i] += text.count(". ") + text.count("! ") + text.count("? ") + text.endswith((".", "!", "?"))
                commas[i] += text.count(",")
                copyright_[i] |= text.startswith(("©", "(c)", "Copyright"))
        link = np.array([x for p in pages for x in p.links], np.int64)
        depth = np.zeros(n, np.int64)
        total, linked = own.copy(), link.copy()
        parent = self.parent.tolist()
        deep = depth.tolist()
        for i, q in enumerate(parent):
            if q >= 0:
                deep[i] = deep[q] + 1
        self.depth = np.array(deep, np.int64)
        self.levels = [np.flatnonzero(self.depth == d) for d in range(int(self.depth.max(initial=0)) + 1)] if self.depth.max(initial=0) < 200 else self._levels()
        for level in reversed(self.levels[1:]):
            np.add.at(total, self.parent[level], total[level])
            np.add.at(linked, self.parent[level], linked[level])
        children = np.zeros(n, np.int64)
        np.add.at(children, self.parent[self.parent >= 0], 1)
        names = [t for p in pages for t in p.tags]
        tag = np.array([_tag_number.get(t, N_TAGS - 1) for t in names], np.int64)
        hints = [h for p in pages for h in p.hints]
        rows, cols = [np.arange(n)], [tag]

        def active(flag: np.ndarray, column: int | np.ndarray) -> None:
            where = np.flatnonzero(flag)
            rows.append(where)
            cols.append(np.full(len(where), column) if np.isscalar(column) else column[where])

        counts = np.array([len(h) for h in hints])
        rows.append(np.repeat(np.arange(n), counts))
        cols.append(np.array([N_TAGS + i for h in hints for i in h], np.int64))
        at = N_TAGS + N_HINTS
        every = np.ones(n, bool)
        active(every, at + np.searchsorted(_bucket, own, "right"))
        active(every, at + N_LEN + np.searchsorted(_bucket, total, "right"))
        at += 2 * N_LEN
        share = linked / np.maximum(total, 1)
        number = {name: at + i for i, name in enumerate(OTHER)}
        active((share > 0.1) & (share <= 0.5), number["link_some"])
        active((share > 0.5) & (share <= 0.9), number["link_half"])
        active(share > 0.9, number["link_all"])
        active(stops == 1, number["sentence"])
        active(stops > 1, number["sentences"])
        active(commas > 0, number["comma"])
        active(copyright_, number["copyright"])
        active(self.depth <= 2, number["top"])
        active(children > 5, number["many_children"])
        up = np.maximum(self.parent, 0)
        active((share[up] > 0.6) & (self.parent >= 0), number["inside_link_list"])
        active(np.isin(np.arange(n), self.first[:-1] + 1), number["first"])
        active(every, number["bias"])
        rows_, cols_ = np.concatenate(rows), np.concatenate(cols)
        order = np.argsort(rows_, kind="stable")
        self.columns = cols_[order].astype(np.int64)
        self.starts = np.searchsorted(rows_[order], np.arange(n))
        self.rows = rows_[order]
        self.kind = np.where(counts > 0, 9, np.array([KINDS.get(t, 0) for t in names], np.int64))

    def _levels(self) -> list[np.ndarray]:
        order = np.argsort(self.depth, kind="stable")
        bounds = np.searchsorted(self.depth[order], np.arange(int(self.depth.max()) + 2))
        return [order[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]


@dataclass
class Model:
    unary: np.ndarray  # N_FEATURES: log odds of content
    pair: np.ndarray  # N_KINDS x 2 x 2: by kind of the child, label of parent and child


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = np.maximum(a, b)
    return m + np.log(np.exp(a - m) + np.exp(b - m))


def marginals(forest: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of every node, and P(parent label, own label) of every node (n x 2 x 2; no use at roots).

    Upward: a node tells its parent, for each label of the parent, the weight of its subtree. Downward: a parent
    tells the child the weight of all the rest.
    """
    n = len(forest.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.add.reduceat(model.unary[forest.columns], forest.starts) if n else 0
    pair = model.pair[forest.kind]
    below = own.copy()  # own potential and all messages from children
    message = np.zeros((n, 2))
    for level in reversed(forest.levels[1:]):
        b = below[level]
        for label in (0, 1):
            message[level, label] = _log_sum(pair[level, label, 0] + b[:, 0], pair[level, label, 1] + b[:, 1])
        np.add.at(below, forest.parent[level], message[level])
    belief = below.copy()
    joint = np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        rest = belief[forest.parent[level]] - message[level]
        both = rest[:, :, None] + pair[level] + below[level][:, None, :]
        belief[level] = _log_sum(both[:, 0, :], both[:, 1, :])
        both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
        joint[level] = both / both.sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), joint


def fit(pages: list[Page], labels: list[np.ndarray], *, steps: int = 250, rate: float = 0.3, ridge: float = 2e-3) -> Model:
    """Weights of the greatest likelihood of the labels (0 or 1 for every node), by Adagrad with a ridge."""
    model = Model(np.zeros(N_FEATURES), np.zeros((N_KINDS, 2, 2)))
    if not pages:
        return model
    forest = Forest(pages)
    y = np.concatenate(labels).astype(float)
    child = np.flatnonzero(forest.parent >= 0)
    observed = np.zeros((N_KINDS, 2, 2))
    np.add.at(observed, (forest.kind[child], y[forest.parent[child]].astype(int), y[child].astype(int)), 1.0)
    seen_u, seen_p = np.full(N_FEATURES, 1e-8), np.full((N_KINDS, 2, 2), 1e-8)
    for _ in range(steps):
        p, joint = marginals(forest, model)
        g = np.bincount(forest.columns, (p - y)[forest.rows], N_FEATURES) / len(pages) + ridge * model.unary
        expected = np.zeros_like(observed)
        np.add.at(expected, forest.kind[child], joint[child])
        h = (expected - observed) / len(pages) + ridge * model.pair
        seen_u += g * g
        seen_p += h * h
        model.unary -= rate * g / np.sqrt(seen_u)
        model.pair -= rate * h / np.sqrt(seen_p)
    return model


def labels_of(page: Page, main: str) -> np.ndarray:
    """Labels of the nodes of a page whose main text is known: a node with text is content if its blocks are in the
    main text, any other if most of the text below it is."""
    wanted = set(main.split("\n"))
    good, all_ = np.zeros(len(page.tags)), np.zeros(len(page.tags))
    own = np.full(len(page.tags), -1)
    for node, text in page.blocks:
        good[node] += len(text) * (text in wanted)
        all_[node] += len(text)
    own = np.where(all_ > 0, good * 2 > all_, -1)
    for i in range(len(page.tags) - 1, 0, -1):
        good[page.parents[i]] += good[i]
        all_[page.parents[i]] += all_[i]
    return np.where(own >= 0, own, good * 2 > all_).astype(int)


def train(labelled: pd.DataFrame) -> Model:
    """A model from pages `html, main`: main is the blocks of the main text, joined by newlines. The pages are fitted
    on the driver: a few hundred are enough for some 150 weights."""
    pages = [parse(h) for h in labelled["html"]]
    return fit(pages, [labels_of(p, m) for p, m in zip(pages, labelled["main"], strict=True)])


def main_texts(pages: list[Page], model: Model, threshold: float = 0.5) -> list[str]:
    if not pages:
        return []
    forest = Forest(pages)
    p, _ = marginals(forest, model)
    return ["\n".join(text for node, text in page.blocks if p[start + node] >= threshold)
            for start, page in zip(forest.first, pages, strict=False)]


AT_ONCE = 200  # pages whose messages are computed together


def extract(pages: DataFrame, model: Model, *, keep: list[str]) -> DataFrame:
    """`keep` columns, `text` (the main text, empty if none) and `n_chars` of every page; a null page is empty.

    White space inside a block is one space, blocks are joined by newlines in page order. A page without any content
    block has an empty text; repeated pages are repeated.
    """
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                texts = main_texts([parse(h.as_py()) for h in part.column(len(keep))], model)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return pages.select(*keep, F.col("html").cast("string").alias("_html")).mapInArrow(run, f"{schema}, text string, n_chars bigint")
