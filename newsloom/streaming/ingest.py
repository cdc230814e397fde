"""Incremental ingest of article batches into the content table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions.scale import cut_lineage
from newsloom.functions.text import content_hash
from newsloom.operators.tables import new_content
from newsloom.sources.tables import Tables


def ingest(articles: DataFrame, tables: Tables, checkpoint: str, *, as_of) -> StreamingQuery:
    """Append the articles with new urls, batch by batch, until the input is used up.

    A batch that is run again after a failure finds its urls in the table and adds nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        # written down first: the table it is compared with is the one it is added to
        fresh = cut_lineage(new_content(tables.read("content"), batch, as_of=as_of))
        tables.append("content", fresh)

    return (
        articles.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drop_repeats(articles: DataFrame, *, within: str = "7 days") -> DataFrame:
    """First article of every fingerprint within the horizon (equals keep-oldest when the
    input is in time order). `published` must be a timestamp with time zone."""
    return (
        articles.withColumn("content_hash", content_hash("content"))
        .withColumn("published", F.col("published").cast("timestamp"))
        .withWatermark("published", within)
        .dropDuplicatesWithinWatermark(["content_hash"])
    )
