"""Quality model, topic model and the language-processing run."""

import pytest
from pyspark.sql import functions as F

from newsloom.operators import quality
from newsloom.operators.topics import article_topics, topic_counts, topic_model
from newsloom.plans.nlp import process_nlp
from workload import inputs


@pytest.fixture(scope="module")
def samples(spark, sf):
    return inputs.training_data(spark, sf)


def test_negatives_are_damaged_and_repeatable(samples):
    good = quality.training_positives(samples)
    bad = quality.damaged_negatives(good)
    assert bad.count() == 30 and {r.damage for r in bad.collect()} <= {"cut", "shuffled", "repeated"}
    again = quality.damaged_negatives(good.repartition(7))
    assert sorted(map(tuple, bad.collect())) == sorted(map(tuple, again.collect()))
    joined = bad.join(good.select("id", F.col("text").alias("whole")), "id")
    for r in joined.collect():
        if r.damage == "cut":
            assert r.text == r.whole[: int(len(r.whole) * 0.2)]
        if r.damage == "shuffled":
            assert len(r.text.split()) == len(r.whole.split()) // 2
        if r.damage == "repeated":
            assert set(r.text.split()[1:-1]) and len(r.text) % 3 == 0


def test_quality_model(samples, spark, sf, tmp_path):
    assert quality.train_quality_model(samples.limit(9)) is None
    trained = quality.train_quality_model(samples)
    own = quality.prediction_metrics(trained.predictions).first()
    assert own.accuracy == pytest.approx(trained.accuracy) and own.f1 == pytest.approx(trained.f1)
    trained.save(str(tmp_path / "model"))
    content = inputs.content(spark, sf)
    one = quality.score_quality(content, trained.model).orderBy("id").collect()
    assert one == quality.score_quality(content, quality.load_quality_model(str(tmp_path / "model"))).orderBy("id").collect()
    assert all(0 <= r.extraction_quality <= 1 for r in one)


def test_topics(spark):
    docs = spark.createDataFrame(
        [(i, "cats milk cats fur" if i % 2 else "cars road cars fuel") for i in range(20)], "id long, content string"
    )
    model = topic_model(docs, k=2, words=3, stop_words=[], gram_range=(1, 1), iterations=20)
    assert all(len(r.words) == 3 for r in model.topics().collect())
    got = article_topics(docs, model)
    topics = {r.id: r.topic for r in got.collect()}
    assert len({topics[i] for i in range(0, 20, 2)}) == 1 and len({topics[i] for i in range(1, 20, 2)}) == 1
    assert topic_counts(got, limit=2).count() == 2


def test_topics_with_the_vocabulary_in_tables(spark):
    """A vocabulary beyond `local_terms` used to be held whole on the driver."""
    words = [["apple pear plum", "steel iron zinc"][i % 2] for i in range(200)]
    docs = spark.createDataFrame([(None if i == 0 else i, f"{w} {w} once{i}") for i, w in enumerate(words)] + [(7, None)], "id long, content string")
    settings = dict(k=2, words=3, stop_words=[], gram_range=(1, 2), iterations=40)
    model = topic_model(docs, **settings, local_terms=3)
    assert model.vocabulary_size() == topic_model(docs, **{**settings, "iterations": 1}).vocabulary_size()
    assert not hasattr(model, "vectorizer") and "term" in model.lda.vocabulary.columns
    assert {r.topic: len(r.words) for r in model.topics().collect()} == {0: 3, 1: 3}
    got = article_topics(docs, model).collect()
    assert len(got) == 201 and sum(r.id == 7 for r in got) == 2 and sum(r.id is None for r in got) == 1
    topics = [{r.topic for r in got if r.id and r.id != 7 and r.id % 2 == i} for i in range(2)]
    assert len(topics[0]) == len(topics[1]) == 1 and topics[0] != topics[1]
    assert topic_model(docs, k=2, stop_words=[], min_df=1, max_df=0.001, local_terms=0) is None


def test_parts_hold_every_article_once(spark):
    """What all articles shuffle at once used to be on disk together."""
    from newsloom.operators.spreadtopics import in_parts

    made = []
    out = in_parts(spark.range(100).withColumnRenamed("id", "doc"), lambda some: made.append(some) or some, most=30)
    assert len(made) == 4 and sorted(r.doc for r in out.collect()) == list(range(100))


def test_digamma_and_inference_of_one_article():
    import numpy as np

    from newsloom.operators.spreadtopics import digamma, infer

    assert np.allclose(digamma(np.array([1.0, 0.5, 10.0, 0.01])), [-0.5772156649, -1.9635100260, 2.2517525890, -100.5608854579])
    gamma, stats = infer(np.array([3.0, 1.0]), np.array([[0.5, 0.5], [1e-9, 1e-9]]), 0.5)
    assert np.allclose(gamma, [4.5, 0.5], atol=1e-2) and np.allclose(stats.sum(axis=0), [3, 1])


def test_topics_without_vocabulary(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three four")], "id long, content string")
    assert topic_model(docs, stop_words=[]) is None


def test_language_processing_run(spark, sf):
    content = inputs.content(spark, sf).withColumn("sentiment_label", F.when(F.col("id") < 50, "neutral"))
    lexicon = spark.createDataFrame(inputs.LEXICON, "token string, valence double")
    columns, counts = process_nlp(content, lexicon, stop_words=inputs.STOP_WORDS)
    c = counts.first()
    assert c.total == content.where("id >= 50").count() and c.total == c.processed + c.errors
    assert columns.count() == c.processed and columns.where("summary is null or topics is null").count() == 0
    _, forced = process_nlp(content, lexicon, stop_words=inputs.STOP_WORDS, force=True, limit=20)
    assert forced.first().total == 20


def test_extraction_takes_the_models_word_for_the_content(samples, spark):
    from newsloom.operators.extraction import adaptive_extract

    model = quality.train_quality_model(samples).model
    body = "Words of some length stand here. They go on for a while, and then they end. " * 3
    pages = spark.createDataFrame(
        [(1, 7, "http://a/", f"<article><h1>A title of words</h1><p>{body}</p></article>")], "page_id long, source_id long, url string, html string")
    patterns = spark.createDataFrame(
        [(1, 7, "css", "h1", "title", 0.9), (2, 7, "css", "p", "content", 0.9)],
        "id long, source_id long, selector_type string, selector string, target_element string, score double")
    row = adaptive_extract(pages, patterns, as_of="2024-02-01", model=model).articles.first()
    want = quality.score_quality(spark.createDataFrame([(1, row.content)], "id long, content string"), model).first()
    assert row.extraction_quality == min(0.9, want.extraction_quality)
    assert row.extraction_quality != adaptive_extract(pages, patterns, as_of="2024-02-01").articles.first().extraction_quality
