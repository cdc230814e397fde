"""CSS selectors with lists, combinators and attribute tests, against hand-worked answers."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import html
from newsloom.functions.html import compile_css
from newsloom.operators.extraction import page_nodes, select_all

PAGE = """<html><body>
<nav><ul><li class="a first">One</li><li>Two</li><li data-x="b c">Three</li><li lang="en-GB">Four</li></ul></nav>
<div id="main" class="post wide"><h2>Sub</h2><p>P1 <span>in</span></p><div><p>P2</p></div><p>P3</p></div>
<a href="/x">rel</a><a href="http://y.org/z.pdf">abs</a><a>none</a>
<footer>End</footer></body></html>"""

CASES = {
    "li": ["One", "Two", "Three", "Four"],
    "h2, footer, h2": ["Sub", "End"],
    "footer, h2": ["Sub", "End"],
    "#main > p": ["P1 in", "P3"],
    "#main p": ["P1 in", "P2", "P3"],
    "div > div > p": ["P2"],
    "li + li": ["Two", "Three", "Four"],
    "li.first ~ li": ["Two", "Three", "Four"],
    "li.first + li + li": ["Three"],
    "h2 ~ p": ["P1 in", "P3"],
    "h2 + p span": ["in"],
    "[data-x]": ["Three"],
    "li[data-x~=c]": ["Three"],
    "li[data-x~=b]": ["Three"],
    "li[data-x=b]": [],
    "li[lang|=en]": ["Four"],
    "a[href^='/']": ["rel"],
    'a[href$=".pdf"]': ["abs"],
    "a[href*=y]": ["abs"],
    "a[href]": ["rel", "abs"],
    "a[href^='']": [],
    ".post.wide h2": ["Sub"],
    "div.post.narrow h2": [],
    "UL > LI.a": ["One"],
    "* > footer": ["End"],
}


def test_compile_refuses_what_it_does_not_know():
    for bad in ["li:first-child", "a >", ", a", "a,,b", "", "ns|a", "a[href=x i]", "p::before", "a\\:b", "[a='x]"]:
        assert compile_css(bad) is None, bad
    assert [len(c) for c in compile_css("a b > c, d")] == [3, 1]


def test_selectors_on_a_page(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    rows = select_all(page_nodes(pages), list(CASES) + ["li:nth-child(2)"]).collect()
    got = {(r.page_id, r.selector): r for r in rows}
    for sel, want in CASES.items():
        r = got[1, sel]
        assert r.supported and r.n_matches == len(want), sel
        assert r.all_text == ("\n".join(want) if want else None), sel
        assert r.first_text == (want[0] if want else None), sel
        assert got[2, sel].n_matches == 0
    refused = got[1, "li:nth-child(2)"]
    assert not refused.supported and refused.n_matches == 0 and refused.all_text is None


def test_deep_and_flat_pages_stay_near_linear(spark):
    import time

    deep = "<div>" + "<p>x</b>" * 20_000  # every paragraph inside the one before
    flat = "<ul>" + "<li>x</li>" * 20_000 + "</ul>"
    pages = spark.createDataFrame([(1, deep), (2, flat)], "page_id long, html string")
    nodes = page_nodes(pages)
    start = time.time()
    got = {(r.page_id, r.selector): r.n_matches for r in select_all(nodes, ["div p", "p p", "li ~ li", "p + p", "ul > li"]).collect()}
    assert got[1, "div p"] == 20_000 and got[1, "p p"] == 19_999 and got[1, "p + p"] == 0
    assert got[2, "li ~ li"] == 19_999 and got[2, "ul > li"] == 20_000
    assert time.time() - start < 120


def test_pages_are_parsed_in_bounded_runs():
    import pyarrow as pa

    pages = [f"<p id='a{i}'>t{i}</p>" for i in range(3 * html.RUN_PAGES)] + [None, "<b>" + "x" * html.RUN_CHARS + "</b>", "<i>y</i>"]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(len(pages))), "html": pages})
    runs = list(html._page_runs(iter([batch])))
    assert max(r.num_rows for r in runs) == html.RUN_PAGES and len(runs) == 5
    rows = [r for run in runs for r in run.to_pylist()]
    assert [r["page_id"] for r in rows] == list(range(len(pages)))
    assert [(r["text"], [n["tag"] for n in r["nodes"]]) for r in rows[:2]] == [("t0", ["p"]), ("t1", ["p"])]
    assert [(r["text"][:1], len(r["nodes"])) for r in rows[-3:]] == [("", 0), ("x", 1), ("y", 1)]
