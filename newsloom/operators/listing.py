"""Filtered listings of articles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.scale import is_small, salted_join
from newsloom.functions.text import content_hash, tokens
from newsloom.operators.dedup import with_source_names
from newsloom.operators.similarity import similar_to

NEWEST_FIRST = [("published", False), ("id", False)]


def has_category(names: list[str]) -> Column:
    return F.arrays_overlap("categories", F.array(*[F.lit(n) for n in names]))


def has_keyword(keywords: list[str]) -> Column:
    """Any of the keywords, as text, in title or content; case does not matter."""
    title, body = F.lower("title"), F.lower("content")
    hits = []
    for word in keywords:
        w = F.lower(F.lit(word))
        hits += [F.coalesce(F.contains(title, w), F.lit(False)), F.coalesce(F.contains(body, w), F.lit(False))]
    return reduce(lambda a, b: a | b, hits)


def by_keyword_table(content: DataFrame, keywords: DataFrame, *, max_words: int = 10_000) -> DataFrame:
    """Articles with at least one whole word from the `keywords` table (word).

    A table of up to `max_words` words is one constant list, and the articles are only
    filtered; with a larger one the words of the articles are joined.
    """
    wanted = keywords.select(F.lower("word").alias("word")).distinct()
    words = tokens(F.concat_ws(" ", "title", "content"))
    if is_small(wanted, max_words):
        return content.where(F.arrays_overlap(words, wanted.agg(F.collect_list("word")).scalar()))
    rows = content.select("id", F.explode(F.array_distinct(words)).alias("word"))
    hits = salted_join(rows, wanted, ["word"], "left_semi", spread=["id"])
    return content.join(hits.select("id").distinct(), "id", "left_semi")


def filter_content(
    content: DataFrame,
    *,
    categories: list[str] | None = None,
    keywords: list[str] | None = None,
    source_id: int | None = None,
    sentiment: str | None = None,
    min_score: float | None = None,
    max_score: float | None = None,
    min_quality: float | None = None,
    min_length: int | None = None,
    include_duplicates: bool = False,
) -> DataFrame:
    """All filters that are given; columns a filter does not need are not read for it."""
    tests: list[Column] = []
    if source_id is not None:
        tests.append(F.col("source_id") == source_id)
    if sentiment is not None:
        tests.append(F.col("sentiment_label") == sentiment)
    if min_score is not None:
        tests.append(F.col("sentiment_score") >= min_score)
    if max_score is not None:
        tests.append(F.col("sentiment_score") <= max_score)
    if min_quality is not None:
        tests.append(F.col("extraction_quality") >= min_quality)
    if min_length is not None:
        tests.append(F.length("content") >= min_length)
    if not include_duplicates:
        tests.append(~F.coalesce("is_duplicate", F.lit(False)))
    if categories:
        tests.append(has_category(categories))
    if keywords:
        tests.append(has_keyword(keywords))
    return reduce(lambda df, t: df.where(t), tests, content)


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("published"), F.desc("id")]


def list_content(
    content: DataFrame,
    sources: DataFrame,
    *,
    limit: int | None = 10,
    offset: int = 0,
    similar_to_id: int | None = None,
    similarity: dict | None = None,
    **filters,
) -> DataFrame:
    """One page of articles with `source_name`, newest first.

    With `similar_to_id` the page starts with that article, followed by those similar
    to it, the most similar first.
    """
    if similar_to_id is None:
        page = filter_content(content, **filters).orderBy(*newest_first())
    else:
        found = similar_to(content, similar_to_id, **(similarity or {}))
        kept = filter_content(content.where(F.col("id") != similar_to_id), **filters)
        rows = kept.unionByName(content.where(F.col("id") == similar_to_id))
        page = rows.join(found, "id").orderBy(F.desc("is_main"), F.desc("similarity"), "id")
    if offset:
        page = page.offset(offset)
    if limit is not None:
        page = page.limit(limit)
    order = newest_first() if similar_to_id is None else [F.desc("is_main"), F.desc("similarity"), F.col("id")]
    return with_source_names(page, sources).orderBy(*order)


def article_by_id(content: DataFrame, sources: DataFrame, article_id: int) -> DataFrame:
    return with_source_names(content.where(F.col("id") == article_id), sources)


def non_empty(content: DataFrame, column: str = "content") -> DataFrame:
    return content.where(F.col(column).isNotNull() & (F.col(column) != ""))


def unprocessed(content: DataFrame, mark: str, *, force: bool = False, limit: int | None = None) -> DataFrame:
    """Articles whose `mark` column is not filled yet (all with `force`), oldest ids first."""
    todo = content if force else content.where(F.col(mark).isNull())
    return todo if limit is None else todo.orderBy("id").limit(limit)


def with_hash(content: DataFrame) -> DataFrame:
    return content.withColumn("content_hash", content_hash("content"))
