"""Selectors, health, tables, feeds, robots, pages, exports and streams on small rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from newsloom.operators import extraction, health, robots, selectors, tables, training
from newsloom.sources import config, export, feeds
from newsloom.sources.tables import Tables
from newsloom.streaming import health as live_health
from newsloom.streaming import ingest as live
from newsloom.streaming import selectors as live_selectors
from workload import inputs

DAY = dt.datetime(2024, 1, 1)
AS_OF = "2024-02-01 00:00:00"


def trials(spark, outcomes, selector=".x"):
    return spark.createDataFrame(
        [(1, "css", selector, "title", DAY + dt.timedelta(minutes=i), o == "T") for i, o in enumerate(outcomes)],
        "source_id long, selector_type string, selector string, target_element string, ts timestamp, success boolean",
    )


@pytest.mark.parametrize("outcomes, want", [("T", 0.7), ("F", 0.3), ("TF", 0.54), ("TFT", 0.641333)])
def test_selector_score(spark, outcomes, want):
    assert round(selectors.selector_scores(trials(spark, outcomes)).first().score, 6) == want


def test_selector_score_of_a_learned_pattern(spark):
    t = trials(spark, "T")
    seed = t.select(*selectors.KEY).withColumn("score", F.lit(0.5))
    assert round(selectors.selector_scores(t, seed).first().score, 6) == 0.9


def test_selector_score_beyond_the_tail_equals_the_full_fold(spark):
    outcomes = "".join("T" if (i * 7919) % 5 else "F" for i in range(1500))
    good, score = 0, None
    for k, o in enumerate(outcomes, 1):
        good += o == "T"
        score = (0.7 if o == "T" else 0.3) if score is None else 0.8 * good / k + 0.2 * score
    row = selectors.selector_scores(trials(spark, outcomes)).first()
    assert row.score == pytest.approx(score, abs=1e-15) and row.success_count == good


def test_ranking_in_pieces_equals_the_window(spark):
    p = spark.range(3000).select(
        (F.col("id") * 97).alias("id"), F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7).alias("source_id"),
        F.when(F.col("id") % 2 == 0, "title").otherwise("content").alias("target_element"),
        F.when(F.col("id") % 5 == 0, 0.5).when(F.col("id") % 41 == 0, None).otherwise((F.col("id") * 7919 % 1013) / 1013.0).alias("score"),
    )
    rank = lambda **o: {r.id: r["rank"] for r in selectors.selector_ranking(p, **o).collect()}
    assert rank(max_rows=10) == rank() and len(rank()) == 3000


def test_recommendations(spark):
    s = spark.createDataFrame(
        [(1, "a", 0.4, 6), (2, "b", 0.4, 5), (3, "c", 0.5, 9), (4, "d", 0.1, 9), (5, "e", None, 9)],
        "id long, name string, success_rate double, access_count long",
    )
    p = spark.createDataFrame([(1, 0.7), (4, 0.71)], "source_id long, score double")
    got = {r.source_id: r.recommendation for r in health.health_recommendations(s, p).collect()}
    assert got == {1: "manual_selectors", 4: "retrain", 5: "manual_selectors"}


def test_health_summary_without_sources(spark):
    none = spark.createDataFrame([], "success_rate double")
    assert health.health_summary(none).first().health_percentage == 0


def test_retrain_unknown_source(spark):
    s = spark.createDataFrame([(1, "a", 1)], "id long, name string, adaptive_config_version int")
    p = spark.createDataFrame([(1, 1, True), (2, 1, False)], "id long, source_id long, is_learned boolean")
    _, _, result = selectors.retrain_source(s, p, 9)
    assert result.first().status == "error" and "9" in result.first().message
    s2, p2, result = selectors.retrain_source(s, p, 1)
    assert result.first().status == "success" and s2.first().adaptive_config_version == 2
    assert [r.id for r in p2.collect()] == [2]


def batch(spark, urls):
    return spark.createDataFrame(
        [(7, f"t{i}", f"c{i}", u, DAY + dt.timedelta(hours=i), ["x"]) for i, u in enumerate(urls)],
        "source_id long, title string, content string, url string, published timestamp, categories array<string>",
    )


@pytest.mark.parametrize("small", [True, False])
def test_new_content_is_idempotent(spark, tmp_path, small):
    store = Tables(spark, str(tmp_path))
    first = tables.new_content(store.read("content"), batch(spark, ["u1", "u2", "u1"]), as_of=AS_OF, small_batch=small)
    store.append("content", first)
    stored = store.read("content")
    assert {r.url: r.title for r in stored.collect()} == {"u1": "t2", "u2": "t1"}
    assert tables.new_content(stored, batch(spark, ["u1", "u2"]), as_of=AS_OF, small_batch=small).count() == 0
    more = tables.new_content(stored, batch(spark, ["u3", "u1"]), as_of=AS_OF, small_batch=small).collect()
    assert [(r.id, r.url) for r in more] == [(3, "u3")]


def test_table_versions(spark, tmp_path):
    store = Tables(spark, str(tmp_path))
    assert store.read("keywords").count() == 0
    assert store.replace("keywords", spark.createDataFrame([("a",)], "word string")) == 1
    assert store.replace("keywords", spark.createDataFrame([("a",), ("b",)], "word string")) == 2
    store.append("keywords", spark.createDataFrame([("c",)], "word string"))
    assert sorted(r.word for r in store.read("keywords").collect()) == ["a", "b", "c"]


def test_keyword_table_small_and_large_give_the_same(spark, sf):
    from newsloom.operators.listing import by_keyword_table

    content = inputs.content(spark, sf)
    words = spark.createDataFrame([(w,) for w in ("The", "nicht")], "word string")
    ids = lambda **o: sorted(r.id for r in by_keyword_table(content, words, **o).select("id").collect())
    assert ids() == ids(max_words=1) != []


def test_training_retention_never_above_limit(spark):
    s = spark.range(300).select("id", (F.col("id") % 3 % 2).alias("source_id"), F.lit(DAY).alias("date_collected"))
    counts = {r.source_id: r.samples for r in training.samples_per_source(training.keep_training(s, per_source=20)).collect()}
    assert counts == {0: 20, 1: 20}


def test_config_first_entry_wins(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"sources": [
        {"name": "One", "type": "webpage", "url": "u1", "categories": ["a"], "article_selector": "div.post"},
        {"name": "Two", "type": "rss", "url": "u1"},
        {"name": "Odd", "type": "ftp", "url": "u2"},
    ], "update_interval": 3600}))
    listed = config.sources_from_config(spark, str(path))
    assert [r.name for r in listed.orderBy("position").collect()] == ["One", "Two", "Odd"]
    s = spark.createDataFrame([(1, "old", "u1", "rss"), (2, "x", "u2", "rss"), (3, "y", "u3", "webpage")], "id long, name string, url string, source_type string")
    merged = config.merge_source_config(s, listed)
    got = {r.id: (r.name, r.source_type, r.article_selector, r.categories) for r in merged.collect()}
    assert got == {1: ("One", "webpage", "div.post", ["a"]), 2: ("Odd", "ftp", None, None), 3: ("y", "webpage", None, None)}
    rss, web, unknown = config.dispatch(merged)
    assert (rss.count(), web.count(), unknown.count()) == (0, 2, 1)


def test_atom_and_rss_feeds(spark):
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="h"/><summary>s</summary>
      <category term="z"/><updated>2024-01-02T03:04:05Z</updated></entry></feed>"""
    rss = """<rss><channel><item><description>d &amp; e</description><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item>
      <item><title>B</title><link>l</link><pubDate>nonsense</pubDate></item></channel></rss>"""
    df = spark.createDataFrame([(1, atom), (2, rss), (3, "not xml")], "source_id long, xml string")
    got = [tuple(r) for r in feeds.feed_items(df, as_of=AS_OF).orderBy("source_id", "position").collect()]
    late = dt.datetime(2024, 2, 1)
    assert got == [
        (1, 0, "T", "s", "h", dt.datetime(2024, 1, 2, 3, 4, 5), ["z"]),
        (2, 0, "No title", "d & e", "", dt.datetime(2024, 1, 2, 10), []),
        (2, 1, "B", "", "l", late, []),
    ]


def test_robots(spark):
    body = "User-agent: a\nUser-agent: mozilla # both\nAllow: /x/y\nDisallow: /x\n\nUser-agent: *\nDisallow: /\n"
    files = spark.createDataFrame([("h", 200, body), ("gone", 404, "x"), ("stars", 200, "Disallow: /\nUser-agent: *\nDisallow: *")], "host string, status int, body string")
    pages = spark.createDataFrame(
        [(1, "http://h/x/y/z"), (2, "http://h/x/q"), (3, "http://h"), (4, "http://gone/a"), (5, "http://none/a"), (6, "http://stars/a")],
        "id long, url string",
    )
    rules = robots.robots_rules(files)
    ask = lambda agent: {r.id: r.allowed for r in robots.robots_allowed(pages, rules, agent=agent).collect()}
    assert ask("Mozilla/5.0 (X11)") == {1: True, 2: False, 3: True, 4: True, 5: True, 6: False}
    assert ask("other/1") == {1: False, 2: False, 3: False, 4: True, 5: True, 6: False}


GOLDEN = [
    (1, 1, "http://h/p", """<body><div class="wrap"><h1 id="t1" class="post-title big">The title</h1></div>
      <div class="entry-content" id="c1"><section class="s1"><p>One.</p><p>Two.</p><p>Three.</p></section>
      <div class="s2"><p>Four.</p></div><script>var x = "<p>no</p>";</script></div></body>"""),
    (2, 1, "http://h/list", """<body><article><h2>First</h2><p>Text <b>bold</b></p><a href="/a">x</a></article>
      <article><p>No head</p><a href="http://o/b">x</a></article><article><h2>Third</h2></article></body>"""),
    (3, 2, "http://h/empty", ""),
]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(GOLDEN, "page_id long, source_id long, url string, html string")


def test_blocks(spark, golden):
    got = [tuple(r) for r in extraction.extract_blocks(golden).select("page_id", "title", "content", "url").orderBy("page_id", "url", "title").collect()]
    assert got == [
        (2, "First", "Text bold", "http://h/a"), (2, "Third", "", "http://h/list"), (2, "No title", "No head", "http://o/b"),
    ] or sorted(got) == sorted([
        (2, "First", "Text bold", "http://h/a"), (2, "No title", "No head", "http://o/b"), (2, "Third", "", "http://h/list"),
    ])
    assert extraction.extract_blocks(golden, max_items=1).count() == 1


PATTERN_SCHEMA = "id long, source_id long, selector_type string, selector string, target_element string, score double"


def test_adaptive_extraction(spark, golden):
    patterns = spark.createDataFrame([
        (1, 1, "css", ".nothing", "title", 0.9), (2, 1, "css", "div.wrap h1", "title", 0.5), (3, 1, "xpath", "//div/h1", "title", 0.4),
        (4, 1, "css", ".entry-content", "content", 0.5), (5, 1, "other", "p", "content", 0.9),
    ], PATTERN_SCHEMA)
    run = extraction.adaptive_extract(golden, patterns, as_of=AS_OF, min_content_length=10)
    rows = {(r.page_id, r.title): r for r in run.articles.collect()}
    assert set(rows) == {(1, "The title"), (2, "First"), (2, "No title"), (2, "Third")}
    assert "no" not in rows[(1, "The title")].content and rows[(1, "The title")].extraction_quality == 0.3
    log = {(r.selector, r.success) for r in run.trials.where("source_id = 1").collect()}
    assert (".nothing", False) in log and ("div.wrap h1", True) in log and (".entry-content", True) in log
    assert {(r.source_id, r.success) for r in run.attempts.collect()} == {(1, True), (2, False)}
    found = [(r.target_element, r.selector) for r in run.discovered.orderBy("target_element", "position").collect()]
    assert found == [
        ("content", "#c1"), ("content", ".entry-content"), ("content", ".s1 p"),
        ("title", "#t1"), ("title", ".post-title"), ("title", ".wrap h1"),
    ]
    assert run.samples.first().successful_selectors.title.selector == "div.wrap h1"
    strict = extraction.adaptive_extract(golden, patterns, as_of=AS_OF, min_content_length=10, fallback=False)
    assert [r.page_id for r in strict.articles.collect()] == [1]
    learned = selectors.save_new_selectors(
        patterns.withColumn("success_count", F.lit(0).cast("long")).withColumn("fail_count", F.lit(0).cast("long"))
        .withColumn("last_used", F.lit(None).cast("timestamp")).withColumn("is_learned", F.lit(False)),
        run.discovered, as_of=AS_OF,
    )
    assert learned.where("is_learned").count() == 5  # `.entry-content` was known


def test_update_run(spark, golden):
    from newsloom.plans.update import update_content
    from newsloom.schemas import CONTENT

    s = spark.createDataFrame(
        [(1, "web", "http://h/p", "webpage", ["w"]), (2, "gone", "http://h/e", "webpage", None), (3, "feed", "f", "rss", None), (4, "odd", "o", "ftp", None)],
        "id long, name string, url string, source_type string, categories array<string>",
    )
    rss = "<rss><channel><item><title>A</title><link>l1</link></item><item><title>B</title><link>l2</link></item></channel></rss>"
    f = spark.createDataFrame([(3, rss), (1, rss)], "source_id long, xml string")
    patterns = spark.createDataFrame([(2, 1, "css", "h1", "title", 0.5), (4, 1, "css", ".entry-content", "content", 0.5)], PATTERN_SCHEMA)
    run = update_content(s, f, golden, patterns, spark.createDataFrame([], CONTENT), as_of=AS_OF, min_content_length=10)
    assert tuple(run.summary.first()) == (4, 2, 2, 6)
    urls = {r.url: r.categories for r in run.new_content.collect()}
    assert set(urls) == {"l1", "l2", "http://h/p", "http://h/a", "http://o/b", "http://h/list"} and urls["http://h/p"] == ["w"]


@pytest.mark.parametrize("fmt", ["json", "csv", "html"])
def test_exports_read_back(spark, sf, tmp_path, fmt):
    rows = export.export_rows(inputs.content(spark, sf), inputs.sources(spark, sf), limit=20, include_duplicates=True)
    path = str(tmp_path / fmt)
    export.export_content(rows, path, fmt=fmt)
    if fmt == "html":
        lines = spark.read.text(path)
        assert lines.count() == 20 and lines.where("value like '<article>%</article>'").count() == 20
        return
    back = spark.read.json(path) if fmt == "json" else spark.read.csv(path, header=True, escape='"', multiLine=True)
    keys = lambda df: sorted((str(r.id), r.title, r.content) for r in df.collect())
    assert keys(back) == keys(rows)


def stream(spark, df, path):
    df.coalesce(2).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(query):
    query.awaitTermination(180)
    assert query.exception() is None


def test_stream_of_attempts_equals_batch(spark, sf, tmp_path):
    attempts = inputs.source_attempts(spark, sf)
    q = (live_health.running_success_rate(stream(spark, attempts, str(tmp_path / "in"))).writeStream.format("memory")
         .queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    drain(q)
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(spark.table("rates")) == order(health.source_success_rate(attempts))


def test_stream_ingest_equals_batch(spark, tmp_path):
    rows = batch(spark, [f"u{i % 30}" for i in range(60)])
    store = Tables(spark, str(tmp_path / "tables"))
    source = stream(spark, rows, str(tmp_path / "in"))
    drain(live.ingest(source, store, str(tmp_path / "cp"), as_of=AS_OF))
    stored = store.read("content")
    assert stored.count() == 30 and stored.select("id").distinct().count() == 30


def test_stream_drops_repeats(spark, tmp_path):
    rows = batch(spark, ["u1", "u2", "u3"]).withColumn("content", F.lit("Same  text"))
    q = (live.drop_repeats(stream(spark, rows, str(tmp_path / "in"))).writeStream.format("memory").queryName("firsts")
         .outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    drain(q)
    assert spark.table("firsts").count() == 1


def test_stream_of_trials_equals_batch(spark, sf, tmp_path):
    t = inputs.selector_trials(spark, sf).orderBy("ts").limit(300)
    path = str(tmp_path / "in")
    t.coalesce(1).write.parquet(path)
    source = spark.readStream.schema(t.schema).parquet(path)
    seen = {}
    q = (live_selectors.running_selector_scores(source).writeStream.outputMode("update")
         .foreachBatch(lambda df, _: seen.update({tuple(r[:4]): (r.success_count, r.fail_count, round(r.score, 9)) for r in df.collect()}))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    drain(q)
    want = {tuple(r[:4]): (r.success_count, r.fail_count, round(r.score, 9)) for r in selectors.selector_scores(t).select(*selectors.KEY, "success_count", "fail_count", "score").collect()}
    assert seen == want


def test_selectors_with_combinators_and_refused_syntax(spark):
    from newsloom.functions import html

    page = "<div class='a'><p id='x'>one</p><p class='b'>two</p></div><h1>t</h1><a rel='me' href='/'>l</a>"
    cases = {
        "p": 2, "*": 5, "div p": 2, "div.a *": 2, "p.b": 1, "#x": 1, ".a .b": 1, "*.b": 1, "h1": 1,
        "a[rel]": 1, "p:nth-of-type(2)": None, "h1, h2": 1, "div > p": 2, "p + p": 1, "": None, "p.": None,
    }
    rows = spark.createDataFrame([(page, s) for s in cases], "html string, selector string")
    rows = rows.select("selector", html.parse_page("html").alias("p")).select(
        "selector", "p.nodes", html.selector_steps("'css'", "selector").alias("steps"))
    got = {r["selector"]: r["n"] if r["n"] is None or r["n"] >= 0 else None
           for r in rows.selectExpr("selector", "nodes", "steps").select("selector", F.size(html.matching("steps")).alias("n")).collect()}
    assert got == cases


def test_unclosed_paragraphs_stay_linear(spark):
    from newsloom.functions import html

    rows = spark.createDataFrame([("<div>" + "<p>x</b>" * 50_000,)], "html string").select(html.parse_page("html").alias("p"))
    row = rows.select(F.size("p.nodes").alias("n"), F.length("p.text").alias("chars"), F.element_at("p.nodes", -1)["depth"].alias("d")).first()
    assert tuple(row) == (50_001, 50_000, 50_000)


def test_half_an_append_is_not_seen(spark, tmp_path):
    store = Tables(spark, str(tmp_path))
    word = lambda w: spark.createDataFrame([(w,)], "word string")
    store.append("keywords", word("a"))
    store.append("keywords", word("b"))
    store.append("keywords", word("c"))
    (tmp_path / "keywords" / "add=1-2" / "_SUCCESS").unlink()  # as after a lost job
    assert {r.word for r in store.read("keywords").collect()} == {"a", "b"}
    store.append("keywords", word("d"))
    assert {r.word for r in store.read("keywords").collect()} == {"a", "b", "d"}
    store.replace("keywords", word("e"))
    assert [r.word for r in store.read("keywords").collect()] == ["e"]
