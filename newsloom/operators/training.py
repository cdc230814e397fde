"""The table of training samples: what is kept, and when a new model is due."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.scale import dense_ids, lookup_join
from newsloom.functions.text import clip_html


def keep_training(samples: DataFrame, *, per_source: int = 50) -> DataFrame:
    """The newest `per_source` samples of every source, ties by id.

    Only ids and dates are ranked; the group limit works before the shuffle, so a
    source with very many samples sends `per_source` of them from each task.
    """
    newest = W.partitionBy("source_id").orderBy(F.desc("date_collected"), F.desc("id"))
    kept = (
        samples.select("id", "source_id", "date_collected")
        .withColumn("place", F.row_number().over(newest))
        .where(F.col("place") <= per_source)
        .select("id")
    )
    return lookup_join(samples, kept, ["id"], "left_semi", spread=["id"])


def append_training_samples(samples: DataFrame, found: DataFrame, *, as_of, per_source: int = 50) -> DataFrame:
    """Snapshot with new samples added and the oldest beyond the limit dropped.

    `found`: source_id, url, html, article_content, article_title, successful_selectors. Rows
    without title or content are no samples; the page is clipped.
    """
    good = found.where("article_content <> '' and article_title <> ''").select(
        "source_id",
        F.coalesce(clip_html("html"), F.lit("")).alias("html_sample"),
        "article_content",
        "article_title",
        "successful_selectors",
        F.lit(as_of).cast("timestamp").alias("date_collected"),
        "url",
    )
    start = samples.agg(F.coalesce(F.max("id"), F.lit(0)))
    fresh = dense_ids(good, "url", start).select(*samples.columns)
    return keep_training(samples.unionByName(fresh), per_source=per_source)


def samples_per_source(samples: DataFrame) -> DataFrame:
    return samples.groupBy("source_id").agg(F.count(F.lit(1)).alias("samples"))


def samples_since(sources: DataFrame, samples: DataFrame, source_id: int) -> DataFrame:
    """One row: samples of all sources collected after the source was last trained.

    A source that was never trained counts every sample.
    """
    stamp = sources.where(F.col("id") == source_id).agg(F.max("last_updated")).scalar()
    return samples.select("date_collected").where(F.isnull(stamp) | (F.col("date_collected") > stamp)).agg(
        F.count(F.lit(1)).alias("new_samples")
    )


def retrain_due(sources: DataFrame, samples: DataFrame, *, every: int = 100) -> DataFrame:
    """`id, due`: at least `every` samples are newer than the stamp of the source.

    That holds exactly when the `every`-th newest sample is newer, so one top-n over
    the samples answers it for all sources.
    """
    newest = samples.select("date_collected").orderBy(F.desc_nulls_last("date_collected")).limit(every)
    enough = newest.agg(F.count("date_collected")).scalar() >= every
    nth = newest.agg(F.min("date_collected")).scalar()
    newer = F.isnull("last_updated") | (F.col("last_updated") < nth)
    return sources.select("id", (enough & newer).alias("due"))


def stamp_trained(sources: DataFrame, due: DataFrame, *, as_of) -> DataFrame:
    """Sources with `last_updated` set where a new model was due."""
    flags = due.select("id", "due")
    stamp = F.when(F.col("due"), F.lit(as_of).cast("timestamp")).otherwise(F.col("last_updated"))
    return sources.join(flags, "id", "left").withColumn("last_updated", stamp).select(*sources.columns)
