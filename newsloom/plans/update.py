"""One update run: crawled feeds and pages in, new rows for every table out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.scale import cut_lineage, lookup_join
from newsloom.operators.extraction import adaptive_extract, blocks_of, page_nodes
from newsloom.operators.health import update_summary
from newsloom.operators.robots import robots_allowed, robots_rules
from newsloom.operators.tables import new_content
from newsloom.sources.config import dispatch, merge_source_config
from newsloom.sources.feeds import feed_items

BLOCK_SELECTORS = ["article_selector", "title_selector", "content_selector", "link_selector"]


@dataclass
class UpdateRun:
    new_content: DataFrame  # rows to append to content
    attempts: DataFrame  # rows to append to source_attempts
    trials: DataFrame | None  # rows to append to selector_trials
    discovered: DataFrame | None  # selectors for save_new_selectors
    samples: DataFrame | None  # rows for append_training_samples
    summary: DataFrame  # one row


def update_content(
    sources: DataFrame,
    feeds: DataFrame,
    pages: DataFrame,
    patterns: DataFrame,
    content: DataFrame,
    *,
    as_of,
    config: DataFrame | None = None,
    robots: DataFrame | None = None,
    agent: str = "Mozilla",
    adaptive: bool = True,
    fallback: bool = True,
    max_items: int = 10,
    min_content_length: int = 100,
    model: PipelineModel | None = None,
) -> UpdateRun:
    """`feeds` is `source_id, xml`, `pages` is `page_id, source_id, url, html`: what was crawled.

    A source succeeds when it gave at least one article. Pages their robots file forbids
    are left out; sources of unknown type, or without crawled data, fail.
    """
    if config is not None:
        sources = merge_source_config(sources, config)
    rss, web, _ = dispatch(sources)
    stamp = F.lit(as_of).cast("timestamp")

    own_feeds = lookup_join(feeds, rss.select(F.col("id").alias("source_id")), ["source_id"], "left_semi", spread=["xml"])
    from_feeds = feed_items(own_feeds, as_of=as_of, max_items=max_items).drop("position")

    options = [c for c in BLOCK_SELECTORS if c in web.columns]
    about = web.select(F.col("id").alias("source_id"), *options)
    crawled = lookup_join(pages, about, ["source_id"], "inner", spread=["page_id"])
    if robots is not None:
        allowed = robots_allowed(crawled.select(F.col("page_id").alias("id"), "url"), robots_rules(robots), agent=agent)
        crawled = crawled.join(allowed.where("allowed").select(F.col("id").alias("page_id")), "page_id", "left_semi")

    trials = discovered = samples = None
    if adaptive:
        run = adaptive_extract(
            crawled, patterns, as_of=as_of, fallback=fallback, max_items=max_items, min_content_length=min_content_length,
            model=model,
        )
        from_pages, trials, discovered, samples = run.articles, run.trials, run.discovered, run.samples
    else:
        from_pages = blocks_of(page_nodes(crawled), max_items=max_items).drop("position").withColumn("published", stamp)
    if "categories" in sources.columns:
        topics = sources.select(F.col("id").alias("source_id"), "categories")
        from_pages = lookup_join(from_pages, topics, ["source_id"], "left", spread=["url"])

    articles = cut_lineage(from_feeds.unionByName(from_pages.drop("page_id"), allowMissingColumns=True))
    fresh = cut_lineage(new_content(content, articles, as_of=as_of))
    got = articles.groupBy("source_id").agg(F.count(F.lit(1)).alias("articles"))
    added = fresh.groupBy("source_id").agg(F.count(F.lit(1)).alias("new_articles"))
    results = (
        sources.select(F.col("id").alias("source_id"))
        .join(got, "source_id", "left")
        .join(added, "source_id", "left")
        .select(
            "source_id",
            F.col("articles").isNotNull().alias("success"),
            F.coalesce("new_articles", F.lit(0)).alias("new_articles"),
        )
    )
    attempts = results.select("source_id", stamp.alias("ts"), "success")
    return UpdateRun(fresh, attempts, trials, discovered, samples, update_summary(results))
