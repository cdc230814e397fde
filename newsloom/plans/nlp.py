"""Language processing of articles that have not been processed yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.listing import unprocessed
from newsloom.operators.sentiment import sentiment
from newsloom.operators.summary import summarize
from newsloom.operators.topics import article_topics, topic_model


def _long_enough(min_length: int):
    return F.coalesce(F.length("content") >= min_length, F.lit(False))


def process_counts(todo: DataFrame, *, min_length: int = 100) -> DataFrame:
    """One row: articles to process, processed, and those without enough text."""
    ok = _long_enough(min_length)
    return todo.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("processed"), F.count_if(~ok).alias("errors")
    )


def process_nlp(
    content: DataFrame,
    lexicon: DataFrame,
    *,
    limit: int | None = None,
    force: bool = False,
    min_length: int = 100,
    topics: int = 3,
    topic_words: int = 5,
    summary_sentences: int = 3,
    stop_words: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """`(columns, counts)`: sentiment, topics and summary by article id, and the run counts."""
    todo = unprocessed(content, "sentiment_label", force=force, limit=limit)
    texts = todo.where(_long_enough(min_length)).select("id", "content")
    scores = sentiment(texts, lexicon)
    briefs = summarize(texts, sentences_kept=summary_sentences, min_length=min_length, stop_words=stop_words)
    columns = scores.join(briefs, "id")
    model = topic_model(texts, k=topics, words=topic_words, stop_words=stop_words)
    if model is None:
        columns = columns.withColumn("topics", F.lit(None).cast("array<string>"))
    else:
        columns = columns.join(article_topics(texts, model).select("id", "topics"), "id", "left")
    return columns, process_counts(todo, min_length=min_length)
