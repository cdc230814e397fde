"""Source lists from configuration files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.scale import lookup_join

ENTRY = """STRUCT<name: STRING, type: STRING, url: STRING, categories: ARRAY<STRING>,
                  article_selector: STRING, title_selector: STRING, content_selector: STRING,
                  link_selector: STRING>"""
OPTIONS = ["name", "categories", "article_selector", "title_selector", "content_selector", "link_selector"]


def sources_from_config(spark: SparkSession, path: str) -> DataFrame:
    """`position` and the fields of every entry of the `sources` list of JSON files."""
    whole = spark.read.schema(f"sources ARRAY<{ENTRY}>").json(path, multiLine=True)
    return whole.select(F.posexplode("sources").alias("position", "s")).select("position", "s.*")


def merge_source_config(sources: DataFrame, config: DataFrame, **limits) -> DataFrame:
    """Sources with the settings of the first config entry of the same url laid over them."""
    fields = [c for c in OPTIONS if c in config.columns]
    chosen = (
        config.groupBy("url")
        .agg(F.min_by(F.struct("type", *fields), "position").alias("c"))
        .select("url", F.col("c.type").alias("c_type"), *[F.col(f"c.{f}").alias(f"c_{f}") for f in fields])
    )
    joined = lookup_join(sources, chosen, ["url"], "left", spread=["id"], **limits)
    own = lambda c: F.col(c) if c in sources.columns else F.lit(None)
    out = [c for c in sources.columns if c not in (*fields, "source_type")]
    return joined.select(
        *out,
        F.coalesce("c_type", "source_type").alias("source_type"),
        *[F.coalesce(f"c_{f}", own(f)).alias(f) for f in fields],
    )


def dispatch(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feed sources, page sources, and those of an unknown type, which fail."""
    kind = F.coalesce("source_type", F.lit(""))
    return (
        sources.where(kind == "rss"),
        sources.where(kind == "webpage"),
        sources.where(~kind.isin("rss", "webpage")),
    )
