"""Language, quality and page models: held-out accuracy, exact marginals, edge cases."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import bytewise as B
from newsloom.llm import langid, pagemodel, qualitytrees
from newsloom.llm.labelledpages import labelled_pages
from newsloom.llm.queries import QUERIES


def test_languages_are_told_apart_on_held_out_documents(spark, sf):
    got = QUERIES["op1_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").toPandas()
    held = got[got["held_out"] & got["lang"].notna()]
    assert len(got) == 200 and (held["lang_pred"] == held["lang"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_language_edge_cases(docs_of, spark):
    r = random.Random(1)
    text = lambda chars: " ".join("".join(r.choices(chars, k=5)) for _ in range(20))
    rows = [(i, text("abcde") if i % 2 else text("vwxyz"), "xx" if i % 2 else "yy") for i in range(120)]
    rows += [(500, None, "xx"), (501, "123 !", "yy"), (None, text("abc"), None)]
    model = langid.train(docs_of(rows), per_class=40)
    assert model.classes == ["xx", "yy"] and 0.02 <= model.temperature <= 20
    assert (model.weights == 0).mean() > 0.5  # the L1 part
    ask = docs_of([(1, None), (2, ""), (3, "12 %"), (4, text("abcde").upper()), (5, "wxyz " * 30_000), (5, "wxyz"), (None, "x")])
    got = [tuple(x) for x in langid.predict(ask.selectExpr("*", "1 AS score", "'q' AS lang_pred"), model).collect()]
    assert [g[:2] for g in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "xx"), (5, "yy"), (5, "yy"), (None, "yy")]
    assert got[0][2] == 0 and all(0.5 < g[2] <= 1 for g in got[3:])
    assert langid.predict(ask.limit(0), model).collect() == []
    nothing = langid.train(docs_of([(1, "abc", None)]))
    assert {x["lang_pred"] for x in langid.predict(ask, nothing).collect()} == {"und"}


def test_temperature_calibrates():
    r = np.random.default_rng(2)
    z = r.normal(size=(4000, 3)) * 2
    p = langid._softmax(z)
    truth = np.array([r.choice(3, p=x) for x in p])
    assert abs(langid._temperature(z * 5, truth) - 5) < 0.6


def test_quality_scores_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_quality_trees"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert held["quality"].nunique() == 2 and (held["predicted"] == held["quality"]).mean() > 0.93


def test_quality_edge_cases(docs_of, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (4, 7, 0), (99_999, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    docs = docs_of([(i, "a fine sentence of words. " * (1 + i % 5) if i % 2 else "$$ %% || 12 " * (1 + i % 7)) for i in range(60)]
                   + [(100, None), (100, ""), (None, "x"), (101, "long words " * 40_000)])
    trees = qualitytrees.train(docs, labels)
    got = qualitytrees.score(docs.selectExpr("*", "1 AS predicted"), trees).collect()
    assert len(got) == 64 and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)
    assert sum(x["predicted"] == x["doc_id"] % 2 for x in got[:60]) > 55
    assert got[60]["score"] == got[61]["score"]
    assert qualitytrees.score(docs.limit(0), trees).collect() == []
    flat = qualitytrees.train(docs, labels.limit(0))
    assert {x["score"] for x in qualitytrees.score(docs, flat).collect()} == {0.5}


def test_flat_trees_split_like_rules():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > -0.2)).astype(float)
    trees = qualitytrees.grow(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95


def test_statistics_by_hand():
    data, at = B.buffers(pa.array(["Ab c!\nab é 12", None, "\n\n"]))
    s = qualitytrees.statistics(data, at)
    of = {n: i for i, n in enumerate(qualitytrees.STATISTICS)}
    assert s[0, of["log_chars"]] == np.log1p(13) and s[0, of["log_words"]] == np.log1p(5)
    assert s[0, of["distinct_share"]] == 0.8 and s[0, of["digits_share"]] == 2 / 13 and s[0, of["longest_word"]] == 2
    assert s[0, of["stop_words_share"]] == 0.2 and not s[1].any() and s[2, of["lines_share"]] == 1.0
    alone = qualitytrees.statistics(*B.buffers(pa.array(["Ab c!\nab é 12"])))
    assert np.allclose(alone[0], s[0])


def test_marginals_are_exact():
    """All labellings of a small tree."""
    page = pagemodel.parse('<body><div class="menu"><p>a<ul><li>b<li>c</ul></div><article><p>One. Two.<p>d</article></body>')
    r = np.random.default_rng(4)
    model = pagemodel.Model(r.normal(size=pagemodel.N_FEATURES), r.normal(size=(pagemodel.N_KINDS, 2, 2)))
    forest = pagemodel.Forest([page, page])
    p, _ = pagemodel.marginals(forest, model)
    n = len(page.tags)
    unary = np.add.reduceat(model.unary[forest.columns], forest.starts)[:n]
    total, each = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        w = sum(unary[i] for i in range(n) if y[i]) + sum(model.pair[forest.kind[i], y[page.parents[i]], y[i]] for i in range(1, n))
        total += np.exp(w)
        each += np.exp(w) * np.array(y)
    assert np.allclose(p[:n], each / total) and np.allclose(p[n:], each / total)


@pytest.fixture(scope="module")
def page_model():
    return pagemodel.train(labelled_pages())


def test_main_texts_of_unseen_layouts(page_model):
    test = labelled_pages(150, seed=123)
    found = pagemodel.main_texts([pagemodel.parse(h) for h in test["html"]], page_model)
    good = missed = wrong = 0
    for got, want in zip(found, test["main"], strict=True):
        a, b = set(got.split("\n")), set(want.split("\n"))
        good, missed, wrong = good + len("".join(a & b)), missed + len("".join(b - a)), wrong + len("".join(a - b))
    assert good / (good + missed) > 0.95 and good / (good + wrong) > 0.95


def test_page_text_rules(spark, page_model):
    body = "<p>The first&nbsp;block, with <b>bold\n words</b> &amp; more.<br>It goes on &lt;here&gt;. And on, at some length.</p>"
    html = (f"<!doctype html><title>t</title><script>var a='<p>no</p>'</script><nav><a href='/'>x</a></nav><article><h1>A head line</h1>{body}"
            "<!-- <p>gone</p> --><style>p{}</style><p>Second block, not closed. It says something as well.<p>Third block. It is the last one."
            "<div class='ad'>Buy this</div></article><section id='comments'><p>What a post, I liked it. Really.</p></section><footer>&copy; me</footer>")
    deep = "<p><b>" * 50_000
    rows = [(1, "u", html), (2, None, None), (3, "u", ""), (3, "u", deep + "x"), (4, "u", "<div>" * 3000 + "y"), (5, "u", "no <markup < 'at all")]
    got = pagemodel.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text"),
                            page_model, keep=["page_id", "url"]).collect()
    assert got[0]["text"] == ("A head line\nThe first block, with bold words & more. It goes on <here>. And on, at some length.\n"
                              "Second block, not closed. It says something as well.\nThird block. It is the last one.")
    assert got[1]["text"] == got[2]["text"] == "" and len(got) == 6 and all(x["n_chars"] == len(x["text"]) for x in got)
