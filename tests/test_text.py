"""Text rules at their limits."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.functions import urls
from newsloom.operators.sentiment import sentiment
from newsloom.operators.summary import summarize


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def n_words(n):
    return " ".join(["Word"] * n)


@pytest.mark.parametrize("text, want", [
    ("", 0.0), (n_words(2), 0.5), (n_words(3), 0.9), (n_words(30), 0.9), (n_words(31), 0.5),
    ("all lower case", 0.6), ("Some lorem title", 0.1), ("Überall große Städte", 0.9),
])
def test_title_quality(spark, text, want):
    assert one(spark, tx.element_quality(F.lit("title"), F.lit(text))) == want


SENTENCES = "This is a short one. " * 6
@pytest.mark.parametrize("text, want", [
    ("", 0.0), (n_words(19), 0.3), (n_words(20), 0.7), (SENTENCES + "\n\n" + SENTENCES, 0.85),
    (SENTENCES + "\n\nLorem. " + SENTENCES, 0.1), (n_words(30) + "\n\n" + n_words(30), 0.6),
    (" ".join(["a <b> c"] * 10) + "\n\n" + "x", 0.4), ("No. " * 20 + "\n\n" + "Yes. " * 3, 0.6),
])
def test_content_quality(spark, text, want):
    assert one(spark, tx.element_quality(F.lit("content"), F.lit(text))) == want


def test_other_elements(spark):
    assert one(spark, tx.element_quality(F.lit("summary"), F.lit("x"))) == 0.7


def test_features(spark):
    row = spark.range(1).select(*tx.quality_features(F.lit("Ab b, b\nB!"))).first()
    assert list(row) == [10.0, 4.0, 2.0, 0.2, 0.2, 1.0]
    assert list(spark.range(1).select(*tx.quality_features(F.lit(""))).first()) == [0.0, 0.0, 1.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("rate, want", [(0.5, "poor"), (0.51, "fair"), (0.8, "fair"), (0.81, "good"), (None, "poor")])
def test_health_label(spark, rate, want):
    assert one(spark, tx.health_label(F.lit(rate).cast("double"))) == want


@pytest.mark.parametrize("href, want", [
    ("/a", "https://h:8080/a"), ("a?b", "https://h:8080/a?b"), ("http://x.org/y", "http://x.org/y"),
    ("//x.org/y", "//x.org/y"), (None, "https://h:8080/dir/page"), ("", "https://h:8080/"),
])
def test_resolve_url(spark, href, want):
    assert one(spark, urls.resolve_url(F.lit(href).cast("string"), F.lit("https://h:8080/dir/page"))) == want


def test_comma_list_and_preview(spark):
    assert one(spark, tx.comma_list(F.lit("a,b"))) == ["a", "b"]
    assert one(spark, tx.comma_list(F.lit(""))) is None
    assert one(spark, tx.preview(F.lit("a\nb" * 100))) == ("a b" * 100)[:200]


LEXICON = [("good", 1.9), ("bad", -2.5), ("great", 3.1)]
def compound(s):
    return round(s / (s * s + 15) ** 0.5, 4)


@pytest.mark.parametrize("text, total", [
    ("nothing here", 0.0), ("a good day", 1.9), ("not good", 1.9 * -0.74), ("very good", 1.9 + 0.293),
    ("very bad", -2.5 - 0.293), ("slightly good", 1.9 - 0.293), ("it is GOOD", 1.9 + 0.733),
    ("good but bad", 1.9 * 0.5 - 2.5 * 1.5), ("good!!", 1.9 + 2 * 0.292), ("bad???", -2.5 - 3 * 0.18),
    ("isn't really that good", (1.9 + 0.293 * 0.95) * -0.74), ("", 0.0),
])
def test_sentiment(spark, text, total):
    lexicon = spark.createDataFrame(LEXICON, "token string, valence double")
    got = sentiment(spark.createDataFrame([(1, text)], "id long, content string"), lexicon).first()
    assert got.sentiment_score == compound(total)
    assert got.sentiment_label == ("positive" if compound(total) >= 0.05 else "negative" if compound(total) <= -0.05 else "neutral")


def test_summary_picks_frequent_sentences_in_text_order(spark):
    text = "Cats like milk. Dogs bark. Cats like cats and milk. Birds sing songs. Milk for cats."
    docs = spark.createDataFrame([(1, text), (2, "Too short. To cut. At all.")], "id long, content string")
    got = {r.id: r.summary for r in summarize(docs, sentences_kept=2, min_length=50, stop_words=["and", "for", "like"]).collect()}
    assert got[1] == "Cats like milk. Cats like cats and milk." and got[2] == "Too short. To cut. At all."


def test_summaries_of_lone_texts_are_made_in_the_row(spark):
    from newsloom.operators.summary import best_sentences

    texts = ["a b a. c c c. a c b! " * 9, "   " * 50, None, "One two three. " * 20]
    rows = [(i, t) for i, t in enumerate(texts * 5)] + [(None, texts[0])]
    docs = spark.createDataFrame(rows, "id long, content string")
    for frame in (best_sentences(docs, stop_words=["b"]), summarize(docs, stop_words=["b"])):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.summary for r in summarize(docs, stop_words=["b"]).collect()}
    assert got[0] == "c c c. c c c. c c c." and got[1] == texts[1] and got[2] is None
    assert got[None] == texts[0]


def test_sentences_of_texts_that_share_an_id_count_as_one_text(spark):
    from newsloom.operators.summary import best_sentences

    docs = spark.createDataFrame([(1, "x x. y."), (1, "x x. y."), (2, "x x. y.")], "id long, content string")
    got = {(r.id, r.pos): (r.score, r["rank"]) for r in best_sentences(docs, stop_words=[]).collect()}
    # twice the words, each twice as frequent, over twice the highest frequency
    assert got == {(1, 0): (4.0, 1), (1, 1): (1.0, 2), (2, 0): (2.0, 1), (2, 1): (0.5, 2)}


def test_terms_are_counted_after_summaries_in_one_session(spark):
    from newsloom.operators.tfidf import document_frequencies, term_counts, vocabulary

    docs = spark.createDataFrame([(1, "x y. x y."), (2, "y x. z"), (3, "x y"), (3, "x y")], "id long, content string")
    assert summarize(docs, min_length=1, stop_words=[]).count() == 4
    options = {"stop_words": [], "gram_range": (1, 2)}
    words = docs.withColumn("content", F.regexp_replace("content", "([xyz])", "$1$1"))
    got = {(r.id, r.term): r.tf for r in term_counts(words, ["content"], **options).collect()}
    assert got[1, "xx yy"] == 2 and got[3, "xx yy"] == 2 and got[2, "zz"] == 1 and got[1, "yy xx"] == 1
    by_counts = vocabulary(term_counts(words, ["content"], **options), words)
    straight = document_frequencies(words, ["content"], **options)
    rows = lambda frame: sorted((r.term, r.df, r.n) for r in frame.collect())
    # more rows than ids: shares are taken of the rows
    assert rows(straight) == rows(by_counts) == [("xx", 3, 3), ("xx yy", 2, 2), ("yy", 3, 3), ("yy xx", 2, 2)]


def test_weights_write_no_table_of_all_terms(spark, monkeypatch):
    """All term rows used to be written before they were weighed."""
    from newsloom.operators import tfidf

    docs = spark.createDataFrame([(1, "one two three"), (2, "one two four"), (3, None)], "id long, content string")
    written = []
    monkeypatch.setattr(tfidf, "cut_lineage", lambda df: written.append(df.columns) or df)
    got = {(r.id, r.term): round(r.weight, 6) for r in tfidf.tfidf(docs, stop_words=[]).collect()}
    assert written == [["field", "term", "df", "n", "idf"]]
    assert got == {(i, t): round(3**-0.5, 6) for i in (1, 2) for t in ("one", "two", "one two")}
