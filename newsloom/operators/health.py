"""Success rates, status and health of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.scale import lookup_join
from newsloom.functions.text import health_label

# Fixed thresholds of the recommendations, and their message formats.
GOOD_PATTERN = 0.7
POOR_RATE = 0.5
MIN_ACCESSES = 5
HEALTHY_RATE = 0.8
MANUAL = (
    "Source '%s' has poor extraction success rate and no good selectors. "
    "Consider adding manual selectors."
)
RETRAIN = "Source '%s' has poor extraction success rate. Consider retraining selectors."


def source_success_rate(attempts: DataFrame) -> DataFrame:
    """`source_id, access_count, error_count, success_rate, last_access` from the attempts."""
    n, bad = F.count(F.lit(1)), F.count_if(~F.col("success"))
    return attempts.groupBy("source_id").agg(
        n.alias("access_count"),
        bad.alias("error_count"),
        ((n - bad) / n).alias("success_rate"),
        F.max("ts").alias("last_access"),
    )


def with_success_rates(sources: DataFrame, attempts: DataFrame) -> DataFrame:
    """Sources with counters computed from all attempts; a source without any has rate 0."""
    rates = source_success_rate(attempts).withColumnRenamed("source_id", "id")
    counters = ["access_count", "error_count", "success_rate", "last_access"]
    zero = {"access_count": 0, "error_count": 0, "success_rate": 0.0}
    return sources.drop(*counters).join(rates, "id", "left").fillna(zero)


def failed_attempts(failed: DataFrame, sources: DataFrame, **limits) -> DataFrame:
    """Attempts for fetches that failed with an error, found by their url; others are dropped."""
    by_url = sources.select("url", F.col("id").alias("source_id"))
    return lookup_join(failed, by_url, ["url"], "inner", spread=["ts"], **limits).select(
        "source_id", "ts", F.lit(False).alias("success")
    )


def source_status(
    sources: DataFrame, patterns: DataFrame, *, source_id: int | None = None, top: int = 6
) -> DataFrame:
    """Every source with its pattern count, its best patterns and its health."""
    if source_id is not None:
        sources = sources.where(F.col("id") == source_id)
        patterns = patterns.where(F.col("source_id") == source_id)
    counts = patterns.groupBy("source_id").agg(F.count("id").alias("pattern_count"))
    best_first = W.partitionBy("source_id").orderBy(F.desc("score"), "id")
    best = (
        patterns.select("source_id", "id", "target_element", "selector", "score")
        .withColumn("rank", F.row_number().over(best_first))
        .where(F.col("rank") <= top)
        .groupBy("source_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("rank", F.col("target_element").alias("target"), "selector", "score"))
            ).alias("top_selectors")
        )
    )
    own = counts.join(best, "source_id", "left").withColumnRenamed("source_id", "id")
    return sources.join(own, "id", "left").select(
        "id", "name", "url", F.col("source_type").alias("type"),
        "success_rate", "access_count", "error_count", "last_access", "rate_limit",
        F.coalesce("pattern_count", F.lit(0)).cast("long").alias("pattern_count"),
        "top_selectors",
        health_label("success_rate").alias("health"),
    )


def health_details(sources: DataFrame) -> DataFrame:
    """Sources with their label, by label and id."""
    return sources.select(
        "id", "name", "url", F.col("source_type").alias("type"),
        "success_rate", "access_count", "error_count",
        health_label("success_rate").alias("health_status"),
    ).orderBy("health_status", "id")


def by_success_rate(sources: DataFrame) -> DataFrame:
    """Sources from the worst success rate to the best."""
    return health_details(sources).orderBy("success_rate", "id")


def health_summary(sources: DataFrame) -> DataFrame:
    """One row: number of sources, healthy ones, percentage (0 without sources)."""
    total = F.count(F.lit(1))
    healthy = F.count_if(F.coalesce("success_rate", F.lit(0.0)) > HEALTHY_RATE)
    return sources.agg(
        total.alias("total_sources"),
        healthy.alias("healthy_sources"),
        F.coalesce(F.try_divide(healthy * 100, total), F.lit(0.0)).alias("health_percentage"),
    )


def health_recommendations(sources: DataFrame, patterns: DataFrame) -> DataFrame:
    """What to do about sources that are often asked and mostly fail."""
    poor = sources.where(
        (F.coalesce("success_rate", F.lit(0.0)) < POOR_RATE) & (F.col("access_count") > MIN_ACCESSES)
    )
    good = (
        patterns.where(F.col("score") > GOOD_PATTERN)
        .groupBy(F.col("source_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("good_patterns"))
    )
    none = F.col("good_patterns").isNull()
    return poor.join(good, "id", "left").select(
        F.col("id").alias("source_id"),
        F.col("name").alias("source_name"),
        F.when(none, "manual_selectors").otherwise("retrain").alias("recommendation"),
        F.when(none, F.format_string(MANUAL, "name")).otherwise(F.format_string(RETRAIN, "name")).alias("message"),
    )


def update_summary(results: DataFrame) -> DataFrame:
    """`total_sources, successful_sources, failed_sources, new_articles` of one update run.

    `results` has one row per source: success, new_articles.
    """
    return results.agg(
        F.count(F.lit(1)).alias("total_sources"),
        F.count_if("success").alias("successful_sources"),
        F.count_if(~F.col("success")).alias("failed_sources"),
        F.coalesce(F.sum("new_articles"), F.lit(0)).cast("long").alias("new_articles"),
    )
