"""Inputs of the registered queries, derived from the driver's tables.

Every frame has a SQL twin in `CTES`; `ctes("content", ...)` gives the WITH clause
that defines the named ones in dependency order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the derived inputs (see FIXTURES.md).
STOP_WORDS = [
    "the", "and", "of", "to", "in", "is", "on", "with", "by", "for", "this", "that",
    "le", "la", "de", "les", "et", "en", "un", "une", "des", "que",
    "der", "die", "das", "und", "el", "los", "para",
]
KEYWORDS = ["the", "and", "nicht", "para", "que"]
LEXICON = [
    ("the", 0.5), ("and", 1.9), ("of", -1.5), ("nicht", -2.0), ("le", 1.2), ("que", -0.8), ("para", 1.0),
]
ROBOTS = [
    (404, ""),
    (200, "User-agent: *\nDisallow:"),
    (200, "User-agent: *\nDisallow: /en"),
    (200, "User-agent: *\nAllow: /en/1\nDisallow: /en"),
    (200, "User-agent: mozilla\nDisallow: /\n\nUser-agent: *\nAllow: /"),
]


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


TEXT_TABLES = {"documents", "pages"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    # one small file is one task, however many cores are idle; tables of many files stay as they are
    if name in TEXT_TABLES and len(df.inputFiles()) < cores:
        df = df.repartition(cores)
    return df


def content(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("source_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        F.concat(F.lit("http://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"),
        day.cast("timestamp").alias("published"),
        (day.cast("timestamp") + F.expr("interval 1 hour")).alias("added"),
        F.array("lang").alias("categories"),
    )


def sources(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("source").distinct()
    number = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    return d.select(
        number.alias("id"),
        F.col("source").alias("name"),
        F.concat(F.lit("http://"), "source", F.lit(".example.com/feed")).alias("url"),
        F.when(number % 2 == 0, "rss").otherwise("webpage").alias("source_type"),
        F.lit(5).alias("rate_limit"),
    )


def source_attempts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ok = (
        F.when(F.col("user_id") % 3 == 0, F.col("event_type") == "click")
        .when(F.col("user_id") % 3 == 1, ~F.col("event_type").isin("error", "view"))
        .otherwise(~((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)))
    )
    return e.select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp"), ok.alias("success"))


def health_sources(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "events").select("user_id").distinct()
    name = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    return u.select(
        F.col("user_id").alias("id"),
        name.alias("name"),
        F.concat(F.lit("http://"), name, F.lit(".example.com/")).alias("url"),
        F.when(F.col("user_id") % 2 == 0, "rss").otherwise("webpage").alias("source_type"),
        F.lit(5).alias("rate_limit"),
    )


def selector_trials(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("source_id"),
        F.lit("css").alias("selector_type"),
        F.concat(F.lit("."), "event_type").alias("selector"),
        F.when(F.col("user_id") % 2 == 0, "title").otherwise("content").alias("target_element"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % (2 + F.col("user_id") % 4) != 0).alias("success"),
    )


def scrape_patterns(spark: SparkSession, sf: str) -> DataFrame:
    from newsloom.operators.selectors import selector_scores

    # at most one pattern per event type in a source
    place = F.row_number().over(W.partitionBy("source_id").orderBy("target_element", "selector"))
    number = (F.col("source_id") * 1000 + place).cast("long")
    return selector_scores(selector_trials(spark, sf)).select(
        number.alias("id"), "source_id", "selector_type", "selector", "target_element",
        "success_count", "fail_count", "last_used", F.round("score", 9).alias("score"),
        (number % 2 == 1).alias("is_learned"),
    )


def training_data(spark: SparkSession, sf: str) -> DataFrame:
    pair = lambda s: F.struct(F.lit("css").alias("selector_type"), F.lit(s).alias("selector"))
    return content(spark, sf).select(
        "id", "source_id", F.lit("").alias("html_sample"), F.col("content").alias("article_content"),
        F.col("title").alias("article_title"),
        F.struct(pair("h1").alias("title"), pair("article p").alias("content")).alias("successful_selectors"),
        F.col("published").alias("date_collected"),
    )


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return content(spark, sf).withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n\n")))


CTES = {
    "content": (
        [],
        """content AS (
        SELECT doc_id AS id, CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS source_id,
               split_part(text, chr(10), 1) AS title, text AS content,
               'http://' || source || '.example.com/' || doc_id AS url,
               CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS TIMESTAMP) AS published,
               CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS TIMESTAMP) + INTERVAL 1 HOUR AS added,
               lang AS category
        FROM documents)""",
    ),
    "sources": (
        [],
        """sources AS (
        SELECT DISTINCT CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS id, source AS name,
               'http://' || source || '.example.com/feed' AS url,
               CASE WHEN CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) % 2 = 0
                    THEN 'rss' ELSE 'webpage' END AS source_type,
               5 AS rate_limit
        FROM documents)""",
    ),
    "source_attempts": (
        [],
        """source_attempts AS (
        SELECT user_id AS source_id, ts,
               CASE WHEN user_id % 3 = 0 THEN event_type = 'click'
                    WHEN user_id % 3 = 1 THEN event_type NOT IN ('error', 'view')
                    ELSE NOT (event_type = 'error' AND event_id % 2 = 0) END AS success
        FROM events)""",
    ),
    "health_sources": (
        [],
        """health_sources AS (
        SELECT DISTINCT user_id AS id, 's' || user_id AS name,
               'http://s' || user_id || '.example.com/' AS url,
               CASE WHEN user_id % 2 = 0 THEN 'rss' ELSE 'webpage' END AS source_type,
               5 AS rate_limit
        FROM events)""",
    ),
    "selector_trials": (
        [],
        """selector_trials AS (
        SELECT user_id AS source_id, 'css' AS selector_type, '.' || event_type AS selector,
               CASE WHEN user_id % 2 = 0 THEN 'title' ELSE 'content' END AS target_element, ts,
               event_id % (2 + user_id % 4) <> 0 AS success
        FROM events)""",
    ),
    "scores": (
        ["selector_trials"],
        """numbered AS (
        SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY source_id, selector, target_element) AS n,
               sum(CAST(success AS INTEGER)) OVER w AS good
        FROM selector_trials
        WINDOW w AS (PARTITION BY source_id, selector, target_element ORDER BY ts
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        scores AS (
        SELECT source_id, selector_type, selector, target_element,
               CAST(sum(CAST(success AS INTEGER)) AS BIGINT) AS success_count,
               CAST(sum(CAST(NOT success AS INTEGER)) AS BIGINT) AS fail_count,
               max(ts) AS last_used,
               sum(CASE WHEN k = 1 THEN pow(0.2::DOUBLE, n - 1) * (CASE WHEN success THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END)
                        ELSE 0.8::DOUBLE * pow(0.2::DOUBLE, n - k) * good / k END) AS score
        FROM numbered GROUP BY ALL)""",
    ),
    "patterns": (
        ["scores"],
        """patterns AS (
        SELECT source_id * 1000 + row_number() OVER (PARTITION BY source_id ORDER BY target_element, selector) AS id,
               source_id, selector_type, selector, target_element, success_count, fail_count,
               last_used, round(score, 9) AS score,
               (source_id * 1000 + row_number() OVER (PARTITION BY source_id ORDER BY target_element, selector)) % 2 = 1 AS is_learned
        FROM scores)""",
    ),
    "rates": (
        ["source_attempts"],
        """rates AS (
        SELECT source_id, count(*) AS access_count, count(*) FILTER (NOT success) AS error_count,
               count(*) FILTER (success) / count(*) AS success_rate, max(ts) AS last_access
        FROM source_attempts GROUP BY source_id)""",
    ),
    "hashes": (
        ["content"],
        """hashes AS (
        SELECT *, sha256(lower(trim(regexp_replace(content, '\\s+', ' ', 'g')))) AS content_hash
        FROM content)""",
    ),
    "marked": (
        ["hashes"],
        """marked AS (
        SELECT *, count(*) OVER (PARTITION BY content_hash) AS copies,
               first_value(id) OVER (PARTITION BY content_hash ORDER BY published DESC, id DESC) AS survivor_id
        FROM hashes)""",
    ),
    "tokens": (
        ["content"],
        """tokens AS (
        SELECT id, list_filter(string_split_regex(lower(content), '[^\\pL\\pN_]+'), lambda w: w <> '') AS words
        FROM content)""",
    ),
    "page_urls": (
        [],
        """page_urls AS (
        SELECT page_id, url, html, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
               regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS host,
               regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path
        FROM pages)""",
    ),
}


def ctes(*names: str, recursive: bool = False) -> str:
    """WITH clause with the named relations and all they depend on."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in CTES[name][0]:
            need(dep)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(CTES[n][1] for n in order) + "\n"
