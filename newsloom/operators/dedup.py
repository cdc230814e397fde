"""Exact duplicates: articles with the same fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.scale import cut_lineage, few_join, lookup_join, salted_join
from newsloom.functions.text import content_hash


def exact_duplicates(content: DataFrame, *, keep_newest: bool = True, **skew) -> DataFrame:
    """`id, content_hash, copies, survivor_id, is_duplicate` of every article.

    The survivor of a set of copies is its newest (or oldest) article, ties by id.
    Only fingerprints travel, never the text, and a fingerprint shared by many
    articles is reduced before the shuffle and joined back over several tasks.
    """
    pick = F.max if keep_newest else F.min
    if "content_hash" in content.columns:
        marks = content.select("id", "published", "content_hash")
    else:
        # fingerprints are written down, so the texts are read once
        marks = cut_lineage(content.select("id", "published", content_hash("content").alias("content_hash")))
    sets = (
        marks.where(F.col("content_hash").isNotNull())
        .groupBy("content_hash")
        .agg(pick(F.struct("published", "id")).alias("best"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    joined = salted_join(
        marks.select("id", "content_hash"),
        sets.select("content_hash", F.col("best.id").alias("survivor_id"), F.col("n").alias("copies")),
        ["content_hash"],
        "left",
        spread=["id"],
        counts=sets.select("content_hash", "n"),
        **skew,
    )
    survivor = F.coalesce("survivor_id", "id")
    return joined.select(
        "id",
        "content_hash",
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        survivor.alias("survivor_id"),
        (survivor != F.col("id")).alias("is_duplicate"),
    )


def duplicate_stats(content: DataFrame, groups: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: duplicates, groups, articles in groups, largest group, space saved.

    `content` carries `is_duplicate`, `groups` is the table of similarity groups.
    """
    size = F.octet_length("content")
    totals = content.agg(
        F.count_if("is_duplicate").alias("exact_duplicates"),
        F.coalesce(F.sum(F.when(F.col("is_duplicate"), size)), F.lit(0)).alias("_bytes"),
    )
    of_groups = groups.agg(
        F.count(F.lit(1)).alias("similarity_groups"),
        F.coalesce(F.sum("article_count"), F.lit(0)).alias("articles_in_similarity_groups"),
        # the largest group, the smallest id among equals
        F.max(
            F.struct(
                F.col("article_count").alias("count"),
                (-F.col("id")).alias("neg_id"),
                F.col("main_article_id").alias("main"),
            )
        ).alias("_largest"),
    )
    # both frames have exactly one row
    one = totals.withColumn("_one", F.lit(1)).join(
        F.broadcast(of_groups.withColumn("_one", F.lit(1))), "_one"
    )
    flat = one.select(
        "exact_duplicates",
        "similarity_groups",
        "articles_in_similarity_groups",
        (-F.col("_largest.neg_id")).alias("largest_group_id"),
        F.col("_largest.count").alias("largest_group_count"),
        F.col("_largest.main").alias("largest_main_id"),
        F.round(F.col("_bytes") / 1024, 2).alias("space_saved_kb"),
        F.round(F.col("_bytes") / 1024 / 1024, 2).alias("space_saved_mb"),
    )
    titles = content.select(F.col("id").alias("largest_main_id"), F.col("title").alias("largest_title"), "source_id")
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("largest_source"))
    with_title = few_join(flat, titles, "largest_main_id")
    return few_join(with_title, names, "source_id").drop("source_id")


def recent_duplicates(content: DataFrame, sources: DataFrame, *, limit: int = 5) -> DataFrame:
    """Titles and sources of the duplicates added last."""
    latest = (
        content.where("is_duplicate")
        .select("id", "title", "source_id", "added")
        .orderBy(F.desc("added"), F.desc("id"))
        .limit(limit)
    )
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    return few_join(latest, names, "source_id").select("id", "title", "source", "added")


def space_saved(content: DataFrame) -> DataFrame:
    """Bytes held by duplicates, in KB and MB."""
    saved = F.coalesce(F.sum(F.octet_length("content")), F.lit(0))
    return content.where("is_duplicate").agg(
        F.count(F.lit(1)).alias("duplicates"),
        F.round(saved / 1024, 2).alias("kb"),
        F.round(saved / 1024 / 1024, 2).alias("mb"),
    )


def with_source_names(content: DataFrame, sources: DataFrame, **limits) -> DataFrame:
    """Add `source_name` by `source_id`."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return lookup_join(content, names, ["source_id"], "left", spread=["id"], **limits)
