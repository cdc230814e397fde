"""Feed documents (RSS and Atom) as article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements that are read. RSS keeps its items in `channel` (RSS 1.0 beside it), Atom in `entry`.
ITEM = """STRUCT<title: STRING, link: STRING, description: STRING, summary: STRING,
                 pubDate: STRING, updated: STRING, category: ARRAY<STRING>,
                 `content:encoded`: STRING, `dc:date`: STRING>"""
ENTRY = """STRUCT<title: STRING, link: ARRAY<STRUCT<_href: STRING, _rel: STRING>>, summary: STRING,
                  content: STRING, published: STRING, updated: STRING, category: ARRAY<STRUCT<_term: STRING>>>"""
BROKEN = "_broken"
FEED = f"channel STRUCT<item: ARRAY<{ITEM}>>, item ARRAY<{ITEM}>, entry ARRAY<{ENTRY}>, {BROKEN} STRING"

# Fixed texts and date patterns. The weekday of an RSS date is dropped before parsing.
NO_TITLE = "No title"
RSS_DATES = ["d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm xx"]


def feed_date(text: Column) -> Column:
    """RSS and ISO dates; anything else is null."""
    day_first = F.trim(F.regexp_replace(text, r"^[A-Za-z]+,\s*", ""))
    return F.coalesce(
        *[F.try_to_timestamp(day_first, F.lit(p)) for p in RSS_DATES], F.try_to_timestamp(text)
    )


def _parsed() -> Column:
    return F.from_xml("xml", FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})


def rejected_feeds(feeds: DataFrame) -> DataFrame:
    """`source_id, xml` of the documents that cannot be read: no text, or not well formed."""
    return feeds.withColumn("_f", _parsed()).where(f"_f IS NULL OR _f.{BROKEN} IS NOT NULL").select("source_id", "xml")


def feed_items(feeds: DataFrame, *, as_of, max_items: int = 10) -> DataFrame:
    """The first `max_items` articles of every feed document.

    `feeds` is `source_id, xml`; the result `source_id, position, title, content, url,
    published, categories`. An article without a date gets `as_of`. Documents that are
    not well formed give no article, see `rejected_feeds`.
    """
    parsed = feeds.select("source_id", _parsed().alias("f"))
    no_items = F.array().cast(f"ARRAY<{ITEM}>")
    rss = F.transform(
        F.concat(F.coalesce("f.channel.item", no_items), F.coalesce("f.item", no_items)),
        lambda i: F.struct(
            i["title"].alias("title"),
            F.coalesce(i["summary"], i["description"], i["content:encoded"]).alias("content"),
            i["link"].alias("url"),
            F.coalesce(i["pubDate"], i["dc:date"], i["updated"]).alias("date"),
            i["category"].alias("categories"),
        ),
    )
    atom = F.transform(
        F.coalesce("f.entry", F.array().cast(f"ARRAY<{ENTRY}>")),
        lambda e: F.struct(
            e["title"].alias("title"),
            F.coalesce(e["summary"], e["content"]).alias("content"),
            F.get(F.filter(e["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"].alias("url"),
            F.coalesce(e["published"], e["updated"]).alias("date"),
            F.transform(e["category"], lambda c: c["_term"]).alias("categories"),
        ),
    )
    items = parsed.select("source_id", F.posexplode(F.slice(F.concat(rss, atom), 1, max_items)).alias("position", "i"))
    return items.select(
        "source_id",
        "position",
        F.coalesce("i.title", F.lit(NO_TITLE)).alias("title"),
        F.coalesce("i.content", F.lit("")).alias("content"),
        F.coalesce("i.url", F.lit("")).alias("url"),
        F.coalesce(feed_date(F.col("i.date")), F.lit(as_of).cast("timestamp")).alias("published"),
        F.coalesce("i.categories", F.array().cast("array<string>")).alias("categories"),
    )
