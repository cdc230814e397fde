"""Exports of article listings: JSON, CSV and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import format_ts
from newsloom.operators.listing import list_content

COLUMNS = [
    "id", "title", "source_name", "url", "published", "categories", "sentiment_label", "sentiment_score",
    "topics", "summary", "content",
]


def export_rows(content: DataFrame, sources: DataFrame, *, limit: int | None = 100, **filters) -> DataFrame:
    """The articles an export holds, newest first."""
    rows = list_content(content, sources, limit=limit, **filters)
    kept = rows.select(*[c for c in COLUMNS if c in rows.columns])
    return kept.withColumn("published", format_ts("published"))


def escape_html(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def html_rows(rows: DataFrame) -> DataFrame:
    """One line of HTML per article."""
    part = lambda c: escape_html(F.coalesce(F.col(c).cast("string"), F.lit("")))
    line = F.concat(
        F.lit('<article><h2><a href="'), part("url"), F.lit('">'), part("title"), F.lit("</a></h2><p>"),
        part("source_name"), F.lit(", "), part("published"), F.lit("</p><div>"),
        F.replace(part("content"), F.lit("\n"), F.lit("<br>")), F.lit("</div></article>"),
    )
    return rows.select(line.alias("value"))


def csv_rows(rows: DataFrame) -> DataFrame:
    """Lists become `a;b`, everything else is text."""
    lists = [f.name for f in rows.schema if f.dataType.typeName() == "array"]
    return rows.select(*[F.array_join(c, ";").alias(c) if c in lists else F.col(c) for c in rows.columns])


def export_content(rows: DataFrame, path: str, *, fmt: str = "json") -> None:
    """Write `export_rows` as a folder of files in the given format."""
    if fmt == "json":
        rows.write.mode("overwrite").json(path)
    elif fmt == "csv":
        csv_rows(rows).write.mode("overwrite").option("header", True).option("escape", '"').option(
            "multiLine", True
        ).csv(path)
    elif fmt == "html":
        html_rows(rows).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {fmt!r}: json, csv or html")
