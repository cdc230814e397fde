"""Pages as arrays of elements, and selectors as expressions over them.

One small Arrow-batched function turns a page into its visible text and its
elements; everything else (selectors, blocks, discovery) is done by Spark on those
two columns. Elements are in document order; `start` and `stop` mark an element's
text inside the page text, `last` is its last descendant, `depth` the number of its ancestors,
`prev` its previous element sibling (-1: none), `dpos` its place in the order by (depth, no), and
`attrs` its attributes (first of a name wins, an attribute without value is '').
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from newsloom.functions.text import col, strip

# The parser travels with the tasks: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRINGS = T.ArrayType(T.StringType())
NODE = T.StructType([
    T.StructField("no", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("classes", STRINGS),
    T.StructField("href", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("stop", T.IntegerType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("prev", T.IntegerType()),
    T.StructField("dpos", T.IntegerType()),
])
PAGE = T.StructType([T.StructField("text", T.StringType()), T.StructField("nodes", T.ArrayType(NODE))])

# Elements without an end tag (HTML standard), and elements whose text is not shown.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style template".split())


class _Elements(HTMLParser):
    """Collects elements. An end tag closes the nearest open element of its name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.text, self.length = [], [], [], 0
        self.opened = Counter()  # open elements by tag
        self.youngest = {}  # last child element of each parent so far (-1: the top level)

    def handle_starttag(self, tag, attrs):
        a = {}
        for name, value in attrs:
            a.setdefault(name, value or "")
        parent = self.open[-1] if self.open else -1
        prev = self.youngest.get(parent, -1)
        no = len(self.nodes)
        self.youngest[parent] = no
        self.nodes.append({
            "no": no, "parent": parent, "last": no, "depth": len(self.open),
            "tag": tag, "id": a.get("id") or None, "classes": (a.get("class") or "").split(),
            "href": a["href"] if "href" in a else None, "start": self.length, "stop": self.length,
            "attrs": a, "prev": prev, "dpos": 0,
        })
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)
            self.opened[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def _close(self):
        node = self.nodes[self.open.pop()]
        self.opened[node["tag"]] -= 1
        node["last"], node["stop"] = len(self.nodes) - 1, self.length

    def handle_endtag(self, tag):
        if self.opened[tag]:
            while self.nodes[self.open[-1]]["tag"] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if not (self.open and self.nodes[self.open[-1]]["tag"] in HIDDEN):
            self.text.append(data)
            self.length += len(data)

    def finish(self):
        self.close()
        while self.open:
            self._close()
        for place, node in enumerate(sorted(self.nodes, key=lambda n: (n["depth"], n["no"]))):
            node["dpos"] = place
        return "".join(self.text), self.nodes


def _parse(html: str | None):
    page = _Elements()
    page.feed(html or "")
    return page.finish()


@F.pandas_udf(PAGE)
def parse_page(html: pd.Series) -> pd.DataFrame:
    """One column of pages; holds the elements of a whole batch (see `parse_pages` for tables)."""
    return pd.DataFrame([_parse(h) for h in html], columns=["text", "nodes"])


RUN_PAGES, RUN_CHARS = 64, 500_000  # pages and characters of html whose elements a worker holds at once
_TEXT, _NODES = pa.string(), to_arrow_type(T.ArrayType(NODE))


def _page_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches with `text` and `nodes` in place of `html`, a bounded run of pages at a time."""
    for batch in batches:
        place = batch.schema.get_field_index("html")
        page, at, chars = batch.column(place), 0, 0
        names = [c for c in batch.schema.names if c != "html"]
        texts, nodes = [], []
        for i in range(len(page)):
            html = page[i].as_py()
            text, found = _parse(html)
            texts.append(text)
            nodes.append(pa.array([found], _NODES))
            chars += len(html or "")
            if len(texts) == RUN_PAGES or chars >= RUN_CHARS or i + 1 == len(page):
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array(texts, _TEXT), pa.concat_arrays(nodes)],
                    [*names, "text", "nodes"])
                texts, nodes, at, chars = [], [], i + 1, 0


def parse_pages(pages: DataFrame) -> DataFrame:
    """`pages` with `text` and `nodes` in place of `html`. A worker holds the elements of one run of
    pages, whatever the number of pages or the size of a batch."""
    kept = T.StructType([f for f in pages.schema.fields if f.name != "html"])
    return pages.mapInArrow(_page_runs, kept.add("text", T.StringType()).add("nodes", T.ArrayType(NODE)))


# Compiled selectors: a list of complex selectors, each a chain of compound steps. `comb` joins a step to
# the one before it: '' (first), ' ' descendant, '>' child, '+' next sibling, '~' later sibling.
ATTR = T.StructType([T.StructField("name", T.StringType()), T.StructField("op", T.StringType()),
                     T.StructField("value", T.StringType())])
STEP = T.StructType([
    T.StructField("comb", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("classes", STRINGS), T.StructField("attrs", T.ArrayType(ATTR)),
])
COMPILED = T.ArrayType(T.ArrayType(STEP))

_NAME = r"-?[_a-zA-Z -\U0010ffff][-_a-zA-Z0-9 -\U0010ffff]*"
_STRING = r""""[^"\\]*"|'[^'\\]*'"""
_TOKEN = re.compile(rf"""
    (?P<comb>\s*[>+~]\s*) | (?P<comma>\s*,\s*) | (?P<ws>\s+) | (?P<tag>\*|{_NAME}) | \#(?P<id>-?[-_a-zA-Z0-9 -\U0010ffff]+) | \.(?P<cls>{_NAME})
    | \[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>{_STRING}|{_NAME}|-?[0-9][-_a-zA-Z0-9]*)\s*)?\]
""", re.VERBOSE)


def compile_css(selector: str | None) -> list | None:
    """A CSS selector as steps, or None when its syntax is not supported (pseudo-classes, namespaces,
    escapes, attribute flags) or not valid. Supported: `*`, tags, `#id`, `.class`, `[a]`, `[a=v]`,
    `[a~=v]`, `[a|=v]`, `[a^=v]`, `[a$=v]`, `[a*=v]`, the combinators ` `, `>`, `+`, `~`, and lists."""
    if selector is None:
        return None
    text, pos = selector.strip(), 0
    chains, chain, step, comb = [], [], None, ""
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if m is None:
            return None
        pos = m.end()
        kind = m.lastgroup if m.lastgroup != "value" else "attr"
        if m.group("attr") is not None:
            kind = "attr"
        if kind in ("ws", "comb", "comma"):
            if step is None:
                return None
            chain.append(step)
            step = None
            if kind == "comma":
                chains.append(chain)
                chain, comb = [], ""
            else:
                comb = m.group(kind).strip() or " "
            continue
        if step is None:
            step = {"comb": comb, "tag": "", "id": "", "classes": [], "attrs": []}
        if kind == "tag":
            if step["tag"] or step["id"] or step["classes"] or step["attrs"]:
                return None
            step["tag"] = m.group("tag").lower()
        elif kind == "id":
            step["id"] = m.group("id")
        elif kind == "cls":
            step["classes"].append(m.group("cls"))
        else:
            value = m.group("value")
            if value is not None and value[:1] in "'\"":
                value = value[1:-1]
            step["attrs"].append({"name": m.group("attr").lower(), "op": m.group("op") or "", "value": value or ""})
    if step is None:
        return None
    chain.append(step)
    chains.append(chain)
    return chains


def _compile(kind: str | None, selector: str | None) -> list | None:
    if kind == "css":
        return compile_css(selector)
    if kind == "xpath" and selector is not None:  # of an xpath only the last step counts, as a tag
        return [[{"comb": "", "tag": selector.strip().split("/")[-1], "id": "", "classes": [], "attrs": []}]]
    return None


@F.pandas_udf(COMPILED)
def _compiled(kind: pd.Series, selector: pd.Series) -> pd.Series:
    seen = {}
    out = []
    for k, v in zip(kind, selector):
        if (k, v) not in seen:
            seen[k, v] = _compile(k, v)
        out.append(seen[k, v])
    return pd.Series(out)


def selector_steps(selector_type: str, selector: str) -> Column:
    """Selector text (arguments are SQL) as compiled steps; null for unsupported syntax or other kinds,
    which then matches nothing. Literal selectors are compiled here, columns by a small Arrow function."""
    kind, sel = F.expr(selector_type), F.expr(selector)
    literal = re.fullmatch(r"'((?:[^'\\]|\\.)*)'", selector.strip()), re.fullmatch(r"'(\w+)'", selector_type.strip())
    if all(literal):
        value = literal[0].group(1).replace("\\'", "'").replace("\\\\", "\\")
        return _literal(_compile(literal[1].group(1), value))
    return _compiled(kind, sel)


def _literal(chains: list | None) -> Column:
    """Compiled steps as a literal column."""
    if chains is None:
        return F.lit(None).cast(COMPILED)
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast(STRINGS)
    attrs = lambda xs: F.array(*[F.struct(*[F.lit(a[f]).alias(f) for f in ("name", "op", "value")]) for a in xs]).cast(
        T.ArrayType(ATTR))
    step = lambda x: F.struct(F.lit(x["comb"]).alias("comb"), F.lit(x["tag"]).alias("tag"), F.lit(x["id"]).alias("id"),
                              strings(x["classes"]).alias("classes"), attrs(x["attrs"]).alias("attrs"))
    return F.array(*[F.array(*[step(x) for x in chain]) for chain in chains]).cast(COMPILED)


def xpath_tag(selector: Column | str) -> Column:
    return F.element_at(F.split(col(selector), "/"), -1)


def _fits(node: str, step: str) -> str:
    """SQL test of an element against one compound step."""
    value = f"element_at({node}.attrs, a.name)"
    return f"""(({step}.tag IN ('', '*') OR {step}.tag = {node}.tag)
        AND ({step}.id = '' OR coalesce({step}.id = {node}.id, false))
        AND forall({step}.classes, c -> array_contains({node}.classes, c))
        AND forall({step}.attrs, a -> coalesce(CASE a.op
            WHEN '' THEN {value} IS NOT NULL
            WHEN '=' THEN {value} = a.value
            WHEN '~=' THEN array_contains(split({value}, '[ \\t\\n\\r\\f]+'), a.value)
            WHEN '|=' THEN {value} = a.value OR startswith({value}, a.value || '-')
            WHEN '^=' THEN a.value <> '' AND startswith({value}, a.value)
            WHEN '$=' THEN a.value <> '' AND endswith({value}, a.value)
            WHEN '*=' THEN a.value <> '' AND contains({value}, a.value)
        END, false)))"""


def _scan(first: str) -> str:
    """Running maximum of `v` over an array of (d, v) structs, restarted wherever `d` changes.

    Log-step doubling: pass k merges each place with the one 2^k before it, so ceil(log2 n) passes
    of one `transform` each; no pass copies a growing array."""
    shift = "shiftleft(1, k)"
    return f"""aggregate(filter(sequence(0, 30), k -> {shift} < size({first})), {first},
        (a, k) -> transform(a, (x, i) -> CASE WHEN i >= {shift} AND get(a, i - {shift}).d = x.d
            THEN struct(x.d AS d, greatest(x.v, get(a, i - {shift}).v) AS v) ELSE x END))"""


def _step(step: str, flags: str, nodes: str) -> str:
    """SQL marks of the elements that fit `step` and stand in its relation to an element in `flags`.

    Descendant: the running maximum of `last` over marked elements in document order reaches the
    element. Later sibling: in the order by (depth, no), the latest marked element of the same depth
    before it lies after its parent (every element of that depth between the two is a sibling)."""
    below = _scan(f"transform({nodes}, n -> struct(0 AS d, CASE WHEN get({flags}, n.no) THEN n.last ELSE -1 END AS v))")
    level = _scan(f"""transform(array_sort(transform({nodes}, n -> struct(n.depth AS d, n.no AS no))),
        x -> struct(x.d AS d, CASE WHEN get({flags}, x.no) THEN x.no ELSE -1 END AS v))""")
    ran = f"CASE {step}.comb WHEN ' ' THEN {below} WHEN '~' THEN {level} END"
    return f"""get(transform(array({ran}), r -> transform({nodes}, n -> {_fits('n', step)} AND CASE {step}.comb
        WHEN '' THEN true
        WHEN ' ' THEN n.no > 0 AND get(r, n.no - 1).v >= n.no
        WHEN '>' THEN n.parent >= 0 AND get({flags}, n.parent)
        WHEN '+' THEN n.prev >= 0 AND get({flags}, n.prev)
        WHEN '~' THEN n.dpos > 0 AND get(r, n.dpos - 1).d = n.depth AND get(r, n.dpos - 1).v > n.parent
    END)), 0)"""


def matching(steps: str, block: str | None = None, nodes: str = "nodes") -> Column:
    """Elements that match any selector of the list, in document order, each once.

    Arguments name columns. Each step of a chain is one pass over the elements in order, which marks
    the elements that fit the step and stand in its relation to an element marked by the pass before
    (its parent or previous sibling by one look-up, an ancestor or earlier sibling through a running
    maximum, see `_step`). With `block`, only descendants of that element are returned (the outer
    steps may match outside it). Work per page and step: O(n log n) in its n elements.
    """
    scope = f"n.no > {block}.no AND n.no <= {block}.last AND" if block else ""
    chain = f"aggregate(chain, array_repeat(false, size({nodes})), (flags, step) -> {_step('step', 'flags', nodes)})"
    marked = f"transform({steps}, chain -> {chain})"
    either = f"transform({nodes}, n -> exists(marks, f -> get(f, n.no)))"
    return F.expr(f"""
        CASE WHEN {steps} IS NOT NULL THEN
            get(transform(array({marked}), marks -> transform(array({either}), final ->
                filter({nodes}, n -> {scope} get(final, n.no)))[0]), 0)
        END""")


def within(nodes: Column | str, node: Column) -> Column:
    """Descendants of an element."""
    return F.filter(col(nodes), lambda n: (n["no"] > node["no"]) & (n["no"] <= node["last"]))


def text_of(text: Column | str, node: Column) -> Column:
    return strip(F.substring(col(text), node["start"] + 1, node["stop"] - node["start"]))
