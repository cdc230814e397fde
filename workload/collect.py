"""Queries over sources, feeds, pages, selectors and training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.functions import urls
from newsloom.functions.html import xpath_tag
from newsloom.functions.scale import cut_lineage
from newsloom.operators import extraction, health, quality, robots, selectors, tables, training
from newsloom.sources import config, feeds
from workload import inputs
from workload.articles import AS_OF, quality_sql, terms_sql, ts
from workload.catalog import case
from workload.inputs import ctes

# --- health ------------------------------------------------------------------------------------


def rated_sources(spark, sf) -> DataFrame:
    return health.with_success_rates(inputs.health_sources(spark, sf), inputs.source_attempts(spark, sf))


HEALTH = "CASE WHEN coalesce(success_rate, 0) > 0.8 THEN 'good' WHEN coalesce(success_rate, 0) > 0.5 THEN 'fair' ELSE 'poor' END"


@case(
    "source_success_rate",
    ctes("rates") + f"""
    SELECT source_id, access_count, error_count, round(success_rate, 6) AS success_rate,
           strftime(last_access, '%Y-%m-%d %H:%M:%S') AS last_access, round(success_rate * 100, 1) AS percent,
           {HEALTH} AS health FROM rates""",
)
def source_success_rate(spark, sf):
    rates = health.source_success_rate(inputs.source_attempts(spark, sf))
    return rates.select(
        "source_id", "access_count", "error_count", F.round("success_rate", 6).alias("success_rate"),
        ts("last_access"), tx.percent("success_rate").alias("percent"), tx.health_label("success_rate").alias("health"),
    )


@case(
    "selector_scores",
    ctes("scores") + """
    SELECT source_id, selector_type, selector, target_element, success_count, fail_count,
           strftime(last_used, '%Y-%m-%d %H:%M:%S') AS last_used, round(score, 6) AS score FROM scores""",
)
def selector_scores(spark, sf):
    s = selectors.selector_scores(inputs.selector_trials(spark, sf))
    return s.withColumn("last_used", tx.format_ts("last_used")).withColumn("score", F.round("score", 6))


@case(
    "selector_ranking",
    ctes("patterns") + """
    SELECT id, source_id, target_element, selector, round(score, 6) AS score,
           row_number() OVER (PARTITION BY source_id, target_element ORDER BY score DESC, id) AS rank FROM patterns""",
)
def selector_ranking(spark, sf):
    ranked = selectors.selector_ranking(inputs.scrape_patterns(spark, sf))
    return ranked.select(
        "id", "source_id", "target_element", "selector", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")
    )


@case(
    "source_status",
    ctes("rates", "health_sources", "patterns") + f""",
    top AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, id) AS rank,
                   count(*) OVER (PARTITION BY source_id) AS pattern_count FROM patterns)
    SELECT s.id, s.name, s.url, s.source_type AS type, round(coalesce(r.success_rate, 0), 6) AS success_rate,
           coalesce(r.access_count, 0) AS access_count, coalesce(r.error_count, 0) AS error_count,
           strftime(r.last_access, '%Y-%m-%d %H:%M:%S') AS last_access, s.rate_limit,
           coalesce(t.pattern_count, 0) AS pattern_count, {HEALTH} AS health,
           t.rank, t.target_element AS target, t.selector, round(t.score, 6) AS score
    FROM health_sources s LEFT JOIN rates r ON r.source_id = s.id
    LEFT JOIN top t ON t.source_id = s.id AND t.rank <= 6""",
)
def source_status(spark, sf):
    status = health.source_status(rated_sources(spark, sf), inputs.scrape_patterns(spark, sf))
    flat = status.select(*[c for c in status.columns if c != "top_selectors"], F.explode_outer("top_selectors").alias("t"))
    return flat.select(
        "id", "name", "url", "type", F.round("success_rate", 6).alias("success_rate"), "access_count", "error_count",
        ts("last_access"), "rate_limit", "pattern_count", "health",
        F.col("t.rank").cast("long").alias("rank"), "t.target", "t.selector", F.round("t.score", 6).alias("score"),
    )


@case(
    "source_status_one",
    ctes("rates", "health_sources", "patterns") + f"""
    SELECT s.id, s.name, round(r.success_rate, 6) AS success_rate, {HEALTH} AS health,
           (SELECT count(*) FROM patterns p WHERE p.source_id = s.id) AS pattern_count
    FROM health_sources s JOIN rates r ON r.source_id = s.id WHERE s.id = 8""",
)
def source_status_one(spark, sf):
    status = health.source_status(rated_sources(spark, sf), inputs.scrape_patterns(spark, sf), source_id=8)
    return status.select("id", "name", F.round("success_rate", 6).alias("success_rate"), "health", "pattern_count")


@case(
    "source_pattern_counts",
    ctes("sources", "patterns") + """
    SELECT s.id, s.name, count(p.id) AS pattern_count FROM sources s LEFT JOIN patterns p ON p.source_id = s.id
    GROUP BY s.id, s.name""",
)
def source_pattern_counts(spark, sf):
    s = inputs.sources(spark, sf)
    for name in ("success_rate", "access_count", "error_count", "last_access"):
        s = s.withColumn(name, F.lit(None).cast("double"))
    return health.source_status(s, inputs.scrape_patterns(spark, sf)).select("id", "name", "pattern_count")


@case(
    "source_health",
    ctes("rates", "health_sources", "patterns") + f"""
    SELECT s.id AS source_id, s.name AS source_name,
           CASE WHEN g.n IS NULL THEN 'manual_selectors' ELSE 'retrain' END AS recommendation,
           CASE WHEN g.n IS NULL THEN replace('{health.MANUAL.replace("'", "''")}', '%s', s.name)
                ELSE replace('{health.RETRAIN.replace("'", "''")}', '%s', s.name) END AS message
    FROM health_sources s JOIN rates r ON r.source_id = s.id
    LEFT JOIN (SELECT source_id, count(*) AS n FROM patterns WHERE score > 0.7 GROUP BY source_id) g ON g.source_id = s.id
    WHERE r.success_rate < 0.5 AND r.access_count > 5""",
)
def source_health(spark, sf):
    return health.health_recommendations(rated_sources(spark, sf), inputs.scrape_patterns(spark, sf))


@case(
    "source_health_summary",
    ctes("rates", "health_sources") + """
    SELECT count(*) AS total_sources, count(*) FILTER (coalesce(r.success_rate, 0) > 0.8) AS healthy_sources,
           round(100 * count(*) FILTER (coalesce(r.success_rate, 0) > 0.8) / count(*), 6) AS health_percentage
    FROM health_sources s LEFT JOIN rates r ON r.source_id = s.id""",
)
def source_health_summary(spark, sf):
    s = health.health_summary(rated_sources(spark, sf))
    return s.withColumn("health_percentage", F.round("health_percentage", 6))


@case(
    "source_health_details",
    ctes("rates", "health_sources") + f"""
    SELECT s.id, s.name, s.url, s.source_type AS type, round(r.success_rate, 6) AS success_rate,
           r.access_count, r.error_count, {HEALTH} AS health_status
    FROM health_sources s JOIN rates r ON r.source_id = s.id ORDER BY health_status, s.id""",
)
def source_health_details(spark, sf):
    return health.health_details(rated_sources(spark, sf)).withColumn("success_rate", F.round("success_rate", 6))


@case(
    "sources_by_success_rate",
    ctes("rates", "health_sources") + """
    SELECT s.id, round(r.success_rate, 6) AS success_rate FROM health_sources s JOIN rates r ON r.source_id = s.id
    ORDER BY r.success_rate, s.id""",
)
def sources_by_success_rate(spark, sf):
    worst = health.by_success_rate(rated_sources(spark, sf))
    return worst.select("id", F.round("success_rate", 6).alias("success_rate"))


@case(
    "failed_fetch_attempts",
    ctes("health_sources") + """
    SELECT s.id AS source_id, count(*) AS failures FROM events e
    JOIN health_sources s ON s.url = 'http://s' || (e.user_id * 2) || '.example.com/'
    WHERE e.event_type = 'error' GROUP BY s.id""",
)
def failed_fetch_attempts(spark, sf):
    """Failed urls found in the source table; half of them belong to no source."""
    e = inputs.table(spark, sf, "events").where("event_type = 'error'")
    failed = e.select(
        F.concat(F.lit("http://s"), (F.col("user_id") * 2).cast("string"), F.lit(".example.com/")).alias("url"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    rows = health.failed_attempts(failed, inputs.health_sources(spark, sf))
    return rows.groupBy("source_id").agg(F.count_if(~F.col("success")).alias("failures"))


@case(
    "update_summary",
    ctes("rates") + """
    SELECT count(*) AS total_sources, count(*) FILTER (access_count > error_count) AS successful_sources,
           count(*) FILTER (access_count <= error_count) AS failed_sources,
           CAST(sum(access_count - error_count) AS BIGINT) AS new_articles FROM rates""",
)
def update_summary(spark, sf):
    rates = health.source_success_rate(inputs.source_attempts(spark, sf))
    good = F.col("access_count") - F.col("error_count")
    return health.update_summary(rates.select((good > 0).alias("success"), good.alias("new_articles")))


# --- table changes -----------------------------------------------------------------------------


@case(
    "append_new_content",
    ctes("content") + """
    SELECT count(*) AS new_articles, CAST(min(id) AS BIGINT) AS min_old_id, CAST(max(id) AS BIGINT) AS max_old_id
    FROM content WHERE id % 4 = 0""",
)
def append_new_content(spark, sf):
    content = inputs.content(spark, sf)
    stored = content.where("id % 4 <> 0")
    fresh = tables.new_content(stored, content.unionByName(content), as_of=AS_OF)
    old = F.element_at(F.split("url", "/"), -1).cast("long")
    return fresh.agg(
        F.count_distinct("id").alias("new_articles"), F.min(old).alias("min_old_id"), F.max(old).alias("max_old_id")
    )


@case(
    "append_ids",
    ctes("content") + """,
    fresh AS (SELECT url, '{"url":"' || url || '"}' AS k FROM content WHERE id % 4 = 0)
    SELECT url, (SELECT max(id) FROM content WHERE id % 4 <> 0)
           + row_number() OVER (ORDER BY substr(md5(k), 1, 3), k) AS id FROM fresh""",
)
def append_ids(spark, sf):
    content = inputs.content(spark, sf)
    return tables.new_content(content.where("id % 4 <> 0"), content, as_of=AS_OF).select("url", "id")


@case(
    "add_sources",
    ctes("sources", "health_sources") + """,
    old AS (SELECT * FROM sources), batch AS (SELECT name, url, source_type FROM health_sources UNION SELECT name, url, source_type FROM sources)
    SELECT name, url, source_type, 5 AS rate_limit FROM batch""",
)
def add_sources(spark, sf):
    old = inputs.sources(spark, sf)
    batch = inputs.health_sources(spark, sf).drop("rate_limit").unionByName(old.drop("rate_limit"))
    return tables.add_sources(old, batch).select("name", "url", "source_type", "rate_limit")


@case(
    "remove_source",
    ctes("health_sources", "patterns") + """
    SELECT s.id, count(p.id) AS patterns FROM health_sources s FULL JOIN patterns p ON p.source_id = s.id
    WHERE s.id <> 8 GROUP BY s.id""",
)
def remove_source(spark, sf):
    s, p = tables.remove_source(inputs.health_sources(spark, sf), 8, inputs.scrape_patterns(spark, sf))
    counts = p.groupBy(F.col("source_id").alias("id")).agg(F.count("id").alias("patterns"))
    return s.select("id").join(counts, "id", "full").select("id", F.coalesce("patterns", F.lit(0)).cast("long").alias("patterns"))


@case(
    "retrain_source",
    ctes("patterns") + """
    SELECT id, source_id, selector, is_learned FROM patterns WHERE NOT (source_id = 8 AND is_learned)""",
)
def retrain_source(spark, sf):
    s = inputs.health_sources(spark, sf).withColumn("adaptive_config_version", F.lit(1))
    _, patterns, _ = selectors.retrain_source(s, inputs.scrape_patterns(spark, sf), 8)
    return patterns.select("id", "source_id", "selector", "is_learned")


@case(
    "retrain_source_versions",
    ctes("health_sources") + "SELECT id, CASE WHEN id = 8 THEN 2 ELSE 1 END AS version FROM health_sources",
)
def retrain_source_versions(spark, sf):
    s = inputs.health_sources(spark, sf).withColumn("adaptive_config_version", F.lit(1))
    changed, _, _ = selectors.retrain_source(s, inputs.scrape_patterns(spark, sf), 8)
    return changed.select("id", F.col("adaptive_config_version").alias("version"))


@case(
    "upsert_counters",
    ctes("rates") + """
    SELECT source_id, access_count, error_count, strftime(last_access, '%Y-%m-%d %H:%M:%S') AS last_access FROM rates""",
)
def upsert_counters(spark, sf):
    """Counters of the first half of the month, brought up to date with the second half."""
    attempts = inputs.source_attempts(spark, sf)
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    old = health.source_success_rate(attempts.where(early))
    delta = health.source_success_rate(attempts.where(~early))
    rows = tables.upsert_counters(old, delta, ["source_id"], add=["access_count", "error_count"], latest=["last_access"])
    return rows.withColumn("last_access", tx.format_ts("last_access"))


@case(
    "save_new_selectors",
    ctes("patterns") + """,
    found AS (SELECT DISTINCT source_id, '.' || (CASE WHEN id % 2 = 0 THEN 'new' ELSE substr(selector, 2) END) AS selector, target_element FROM patterns)
    SELECT source_id, selector, target_element, round(score, 6) AS score, is_learned FROM patterns
    UNION ALL
    SELECT f.source_id, f.selector, f.target_element, 0.5 AS score, true AS is_learned FROM found f
    WHERE NOT EXISTS (SELECT 1 FROM patterns p WHERE p.source_id = f.source_id AND p.selector = f.selector AND p.target_element = f.target_element)""",
)
def save_new_selectors(spark, sf):
    patterns = inputs.scrape_patterns(spark, sf)
    found = patterns.select(
        "source_id", "selector_type", "target_element",
        F.when(F.col("id") % 2 == 0, F.lit(".new")).otherwise(F.col("selector")).alias("selector"),
    )
    rows = selectors.save_new_selectors(patterns, found, as_of=AS_OF)
    return rows.select("source_id", "selector", "target_element", F.round("score", 6).alias("score"), "is_learned")


# --- training samples ---------------------------------------------------------------------------


@case(
    "training_retention",
    ctes("content") + """
    SELECT id, source_id FROM content
    QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY published DESC, id DESC) <= 20""",
)
def training_retention(spark, sf):
    return training.keep_training(inputs.training_data(spark, sf), per_source=20).select("id", "source_id")


@case("training_sample_counts", ctes("content") + "SELECT source_id, count(*) AS samples FROM content GROUP BY source_id")
def training_sample_counts(spark, sf):
    return training.samples_per_source(inputs.training_data(spark, sf))


def stamped_sources(spark, sf) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") + 10).cast("int"))
    stamp = F.when(F.col("id") % 5 != 0, day.cast("timestamp"))
    return inputs.sources(spark, sf).withColumn("last_updated", stamp)


STAMPED = """,
    stamped AS (SELECT id, CASE WHEN id % 5 <> 0 THEN CAST(DATE '2024-01-01' + CAST(id + 10 AS INTEGER) AS TIMESTAMP) END AS last_updated FROM sources)
"""


@case(
    "retrain_due",
    ctes("content", "sources") + STAMPED + """
    SELECT s.id, (SELECT count(*) FROM content c WHERE s.last_updated IS NULL OR c.published > s.last_updated) >= 100 AS due FROM stamped s""",
)
def retrain_due(spark, sf):
    return training.retrain_due(stamped_sources(spark, sf), inputs.training_data(spark, sf))


@case(
    "samples_since_training",
    ctes("content", "sources") + STAMPED + """
    SELECT count(*) AS new_samples FROM content c, stamped s WHERE s.id = 3 AND (s.last_updated IS NULL OR c.published > s.last_updated)""",
)
def samples_since_training(spark, sf):
    return training.samples_since(stamped_sources(spark, sf), inputs.training_data(spark, sf), 3)


@case(
    "sources_stamped_after_training",
    ctes("content", "sources") + STAMPED + """
    SELECT s.id, strftime(CASE WHEN (SELECT count(*) FROM content c WHERE s.last_updated IS NULL OR c.published > s.last_updated) >= 100
                               THEN TIMESTAMP '2024-02-01 00:00:00' ELSE s.last_updated END, '%Y-%m-%d %H:%M:%S') AS last_updated FROM stamped s""",
)
def sources_stamped(spark, sf):
    s = stamped_sources(spark, sf)
    rows = training.stamp_trained(s, training.retrain_due(s, inputs.training_data(spark, sf)), as_of=AS_OF)
    return rows.select("id", ts("last_updated"))


@case(
    "append_training_samples",
    ctes("content") + """
    SELECT source_id, count(*) AS samples, max(length(html)) AS longest_page
    FROM (SELECT source_id, substr(content || content, 1, 50000) AS html FROM content WHERE content <> '' AND title <> ''
          QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY substr(md5(url), 1, 3) DESC, url DESC) <= 20)
    GROUP BY source_id""",
)
def append_training_samples(spark, sf):
    content = inputs.content(spark, sf)
    none = inputs.training_data(spark, sf).where("false")
    found = content.select(
        "source_id", "url", F.concat("content", "content").alias("html"), F.col("content").alias("article_content"),
        F.col("title").alias("article_title"),
        F.lit(None).cast(inputs.training_data(spark, sf).schema["successful_selectors"].dataType).alias("successful_selectors"),
    )
    rows = training.append_training_samples(none, found, as_of=AS_OF, per_source=20)
    return rows.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("samples"), F.max(F.length("html_sample")).cast("long").alias("longest_page")
    )


@case(
    "training_positives",
    ctes("content") + "SELECT id, 1.0::DOUBLE AS label, CAST(length(content) AS DOUBLE) AS chars FROM content WHERE content <> ''",
)
def training_positives(spark, sf):
    good = quality.training_positives(inputs.training_data(spark, sf))
    return good.select("id", "label", F.length("text").cast("double").alias("chars"))


@case("damaged_negatives")
def damaged_negatives(spark, sf):
    return quality.damaged_negatives(quality.training_positives(inputs.training_data(spark, sf)))


@case("training_split")
def training_split(spark, sf):
    rows = quality.training_set(inputs.training_data(spark, sf))
    return rows.groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("rows"))


@case("quality_model_metrics")
def quality_model_metrics(spark, sf):
    """Accuracy and F1 on the held-out rows, from the evaluator and from the predictions."""
    trained = quality.train_quality_model(inputs.training_data(spark, sf))
    return quality.prediction_metrics(trained.predictions).withColumn(
        "evaluator_accuracy", F.lit(trained.accuracy)
    ).withColumn("evaluator_f1", F.lit(trained.f1))


@case("quality_model_scores")
def quality_model_scores(spark, sf):
    trained = quality.train_quality_model(inputs.training_data(spark, sf))
    return quality.score_quality(inputs.content(spark, sf), trained.model)


@case("topic_vocabulary", ctes("content") + terms_sql("content") + "SELECT count(*) AS terms FROM content_v")
def topic_vocabulary(spark, sf):
    """All terms within the limits are in the model."""
    from newsloom.operators.topics import topic_model

    model = topic_model(inputs.content(spark, sf), stop_words=inputs.STOP_WORDS, iterations=1)
    return spark.createDataFrame([(model.vocabulary_size(),)], "terms bigint")


@case("topic_model_words")
def topic_model_words(spark, sf):
    from newsloom.operators.topics import topic_model

    return topic_model(inputs.content(spark, sf), stop_words=inputs.STOP_WORDS).topics()


@case("article_topics")
def article_topics(spark, sf):
    from newsloom.operators import topics

    content = inputs.content(spark, sf)
    return topics.article_topics(content, topics.topic_model(content, stop_words=inputs.STOP_WORDS))


# --- feeds and configuration ---------------------------------------------------------------------


def feed_documents(spark, sf) -> DataFrame:
    """RSS documents: one per source and run of 200 article ids. Some items lack a date or a title."""
    def escaped(c):
        t = F.col(c)
        for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            t = F.replace(t, F.lit(mark), F.lit(name))
        return t

    element = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    item = F.concat(
        F.lit("<item>"),
        F.when(F.col("id") % 11 == 0, "").otherwise(element("title", escaped("title"))),
        element("link", F.col("url")),
        element("description", escaped("content")),
        F.when(F.col("id") % 7 == 0, "").otherwise(
            element("pubDate", F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss xx"))
        ),
        element("category", F.get("categories", F.lit(0))),
        F.lit("</item>"),
    )
    rows = inputs.content(spark, sf).select(
        "source_id", F.floor(F.col("id") / 200).alias("run"), F.struct("id", item.alias("item")).alias("i")
    )
    # at most 200 items per document
    return rows.groupBy("source_id", "run").agg(F.array_sort(F.collect_list("i")).alias("items")).select(
        "source_id", "run",
        F.concat(
            F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>feed</title>'),
            F.array_join(F.transform("items", lambda i: i["item"]), ""),
            F.lit("</channel></rss>"),
        ).alias("xml"),
    )


@case(
    "feed_items",
    ctes("content") + """,
    placed AS (SELECT *, row_number() OVER (PARTITION BY source_id, id // 200 ORDER BY id) - 1 AS position FROM content)
    SELECT source_id, position, CASE WHEN id % 11 = 0 THEN 'No title' ELSE regexp_replace(title, '^\\s+|\\s+$', '', 'g') END AS title,
           regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content, url,
           CASE WHEN id % 7 = 0 THEN '2024-02-01 00:00:00' ELSE strftime(published, '%Y-%m-%d %H:%M:%S') END AS published,
           category AS categories
    FROM placed WHERE position < 5""",
)
def feed_items(spark, sf):
    items = feeds.feed_items(feed_documents(spark, sf), as_of=AS_OF, max_items=5)
    return items.select(
        "source_id", F.col("position").cast("long").alias("position"), "title", "content", "url", ts("published"),
        F.array_join("categories", ",").alias("categories"),
    )


def atom_documents(spark, sf) -> DataFrame:
    """Atom documents like `feed_documents`; the own address of the feed comes before each article's link."""
    c = inputs.content(spark, sf).select("source_id", "id", "url", F.floor(F.col("id") / 200).alias("run"))
    n = F.col("id").cast("string")
    entry = F.concat(
        F.lit('<entry><link rel="self" href="http://feed.example.com/atom"/><link rel="alternate" href="'), "url", F.lit('"/><title>Entry '), n,
        F.lit("</title>"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("<summary>short "), n, F.lit("</summary>"))).otherwise(""),
        F.when(F.col("id") % 3 < 2, F.concat(F.lit('<content type="text">long '), n, F.lit("</content>"))).otherwise(""),
        F.lit("<updated>2024-01-05T06:07:08Z</updated></entry>"))
    rows = c.groupBy("source_id", "run").agg(F.array_sort(F.collect_list(F.struct("id", entry.alias("entry")))).alias("e"))
    body = F.array_join(F.transform("e", lambda e: e["entry"]), "")
    end = F.when(F.col("source_id") == 3, "<broken").otherwise("</feed>")  # one source's documents end too early
    return rows.select("source_id", F.concat(F.lit("<feed><title>t</title>"), body, end).alias("xml"))


@case(
    "atom_items",
    ctes("content") + """,
    placed AS (SELECT *, row_number() OVER (PARTITION BY source_id, id // 200 ORDER BY id) - 1 AS position FROM content WHERE source_id <> 3)
    SELECT source_id, position, 'Entry ' || id AS title, url, '2024-01-05 06:07:08' AS published,
           CASE id % 3 WHEN 0 THEN 'short ' || id WHEN 1 THEN 'long ' || id ELSE '' END AS content
    FROM placed WHERE position < 5""",
)
def atom_items(spark, sf):
    items = feeds.feed_items(atom_documents(spark, sf), as_of=AS_OF, max_items=5)
    return items.select("source_id", F.col("position").cast("long").alias("position"), "title", "url", ts("published"), "content")


@case(
    "rejected_feeds",
    ctes("content") + "SELECT source_id, count(DISTINCT id // 200) AS documents FROM content WHERE source_id = 3 GROUP BY source_id",
)
def rejected_feeds(spark, sf):
    return feeds.rejected_feeds(atom_documents(spark, sf)).groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"))


@case(
    "merge_source_config",
    ctes("sources") + """
    SELECT id, CASE WHEN id % 3 = 0 THEN 'configured ' || id ELSE name END AS name, url, source_type,
           CASE WHEN id % 3 = 0 THEN 'div.post' END AS article_selector FROM sources""",
)
def merge_source_config(spark, sf):
    s = inputs.sources(spark, sf)
    entry = lambda position, name: s.where("id % 3 = 0").select(
        (F.col("id") * 2 + position).cast("int").alias("position"), F.concat(F.lit(name), F.col("id").cast("string")).alias("name"),
        F.lit(None).cast("string").alias("type"), "url", F.lit("div.post").alias("article_selector"),
    )
    both = entry(0, "configured ").unionByName(entry(1, "second "))
    rows = config.merge_source_config(s, both)
    return rows.select("id", "name", "url", "source_type", "article_selector")


@case(
    "source_dispatch",
    ctes("sources") + """
    SELECT CASE WHEN id % 7 = 0 THEN 'unknown' ELSE source_type END AS branch, count(*) AS sources FROM sources GROUP BY branch""",
)
def source_dispatch(spark, sf):
    s = inputs.sources(spark, sf).withColumn("source_type", F.when(F.col("id") % 7 == 0, "ftp").otherwise(F.col("source_type")))
    rss, web, bad = config.dispatch(s)
    named = [d.select(F.lit(n).alias("branch")) for n, d in (("rss", rss), ("webpage", web), ("unknown", bad))]
    return named[0].unionByName(named[1]).unionByName(named[2]).groupBy("branch").agg(F.count(F.lit(1)).alias("sources"))


# --- urls, robots, pages --------------------------------------------------------------------------


@case(
    "site_bases",
    ctes("page_urls") + "SELECT scheme || '://' || host AS site, count(*) AS pages FROM page_urls GROUP BY site",
)
def site_bases(spark, sf):
    return inputs.table(spark, sf, "pages").groupBy(urls.site_base("url").alias("site")).agg(F.count(F.lit(1)).alias("pages"))


@case(
    "resolve_urls",
    ctes("page_urls") + """,
    links AS (SELECT page_id, url, scheme, host, CASE page_id % 4 WHEN 0 THEN '/a/' || page_id WHEN 1 THEN 'b/' || page_id || '?x=1'
                     WHEN 2 THEN 'https://other.example.org/' || page_id END AS href FROM page_urls)
    SELECT page_id, CASE WHEN href IS NULL THEN url WHEN href LIKE 'https://%' THEN href
                         ELSE scheme || '://' || host || CASE WHEN href LIKE '/%' THEN '' ELSE '/' END || href END AS resolved FROM links""",
)
def resolve_urls(spark, sf):
    p = inputs.table(spark, sf, "pages")
    n = F.col("page_id").cast("string")
    href = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/a/"), n))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("b/"), n, F.lit("?x=1")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://other.example.org/"), n))
    )
    return p.select("page_id", urls.resolve_url(href, "url").alias("resolved"))


@case(
    "xpath_tags",
    ctes("patterns") + "SELECT id, split_part('/html/body/' || substr(selector, 2), '/', -1) AS tag FROM patterns",
)
def xpath_tags(spark, sf):
    p = inputs.scrape_patterns(spark, sf)
    return p.select("id", xpath_tag(F.concat(F.lit("/html/body/"), F.substring("selector", 2, 100))).alias("tag"))


def robots_files(spark, sf) -> DataFrame:
    """One robots file per host of the pages; which one depends on the length of the host."""
    hosts = inputs.table(spark, sf, "pages").select(urls.host("url").alias("host")).distinct()
    files = F.array(*[F.struct(F.lit(s).alias("status"), F.lit(b).alias("body")) for s, b in inputs.ROBOTS])
    return hosts.select("host", F.get(files, F.length("host") % 5).alias("f")).select("host", "f.*")


@case(
    "robots_rules",
    ctes("page_urls") + """,
    rules(kind, group_no, agent, rule_no, allow, path) AS (VALUES
      (1, 1, '*', 1, true, ''), (2, 1, '*', 1, false, '/en'), (3, 1, '*', 1, true, '/en/1'), (3, 1, '*', 2, false, '/en'),
      (4, 1, 'mozilla', 1, false, '/'), (4, 2, '*', 4, true, '/'))
    SELECT h.host, CAST(group_no AS BIGINT) AS group_no, agent, CAST(rule_no AS BIGINT) AS rule_no, allow, path
    FROM (SELECT DISTINCT host FROM page_urls) h JOIN rules r ON r.kind = length(h.host) % 5""",
)
def robots_rules(spark, sf):
    rules = robots.robots_rules(robots_files(spark, sf))
    return rules.withColumn("group_no", F.col("group_no").cast("long")).withColumn("rule_no", F.col("rule_no").cast("long"))


ALLOWED = """CASE length(host) % 5 WHEN 2 THEN NOT starts_with(path, '/en')
                 WHEN 3 THEN starts_with(path, '/en/1') OR NOT starts_with(path, '/en') WHEN 4 THEN false ELSE true END"""


@case(
    "robots_allowed_normalised",
    ctes("page_urls") + """
    SELECT page_id AS id, page_id % 3 <> 0 AS allowed FROM page_urls""",
)
def robots_allowed_normalised(spark, sf):
    """Escapes in either case and hosts in capitals: every third url is under a forbidden folder."""
    pages = inputs.table(spark, sf, "pages")
    escape = F.when(F.col("page_id") % 2 == 0, "%3C").otherwise("%3c")
    shout = lambda c: F.when(F.col("page_id") % 2 == 0, F.upper(c)).otherwise(c)
    asked = pages.select(
        F.col("page_id").alias("id"),
        F.concat(F.lit("http://"), shout(urls.host("url")), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/a"), escape, F.lit("d"))).otherwise("/b")).alias("url"))
    files = pages.select(urls.host("url").alias("host")).distinct().select(
        F.when(F.length("host") % 2 == 0, F.upper("host")).otherwise(F.col("host")).alias("host"), F.lit(200).alias("status"),
        F.when(F.length("host") % 3 == 0, "User-agent: *\nDisallow: /a%3c").otherwise("User-agent: *\nDisallow: /a%3C").alias("body"))
    return robots.robots_allowed(asked, robots.robots_rules(files)).select("id", "allowed")


@case("robots_allowed", ctes("page_urls") + f"SELECT page_id AS id, url, {ALLOWED} AS allowed FROM page_urls")
def robots_allowed(spark, sf):
    pages = inputs.table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url")
    return robots.robots_allowed(pages, robots.robots_rules(robots_files(spark, sf)))


@case(
    "robots_refresh_summary",
    ctes("page_urls") + f"""
    SELECT count(*) FILTER (length(host) % 5 <> 0) AS updated, count(*) FILTER (length(host) % 5 = 0) AS failed,
           count(*) FILTER (NOT {ALLOWED}) AS disallowed FROM page_urls""",
)
def robots_refresh_summary(spark, sf):
    """Here a 404 file stands for a host that did not answer."""
    files = robots_files(spark, sf).withColumn("status", F.when(F.col("status") == 200, F.col("status")))
    pages = inputs.table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url")
    return robots.robots_refresh_summary(pages, files)


def crawled(spark, sf) -> DataFrame:
    return inputs.table(spark, sf, "pages").select("page_id", (F.col("page_id") % 10).alias("source_id"), "url", "html")


PLAIN = "regexp_replace(replace(replace(replace(replace(replace(regexp_replace({h}, '<[^>]+>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&amp;', '&'), '^\\s+|\\s+$', '', 'g')"


@case(
    "page_blocks",
    f"""SELECT page_id, url, {PLAIN.format(h="regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1)")} AS title,
               {PLAIN.format(h="regexp_extract(html, '(?s)</h1>(<p>.*)</article>', 1)")} AS content FROM pages""",
)
def page_blocks(spark, sf):
    """The first paragraph is never closed, so it holds the rest of its article."""
    rows = extraction.extract_blocks(crawled(spark, sf), title="h1")
    return rows.select("page_id", "url", "title", "content")


def page_patterns(spark, sf) -> DataFrame:
    """Patterns of the ten sources the pages are spread over; source 9 knows no content selector."""
    kinds = [
        ("title", "css", ".headline", 0.9), ("title", "css", "article h1", 0.6), ("title", "xpath", "//html/h2", 0.8),
        ("content", "css", ".entry", 0.8), ("content", "css", "article p", 0.5), ("content", "xpath", "/body/article", 0.4),
    ]
    rows = F.array(*[
        F.struct(F.lit(t).alias("target_element"), F.lit(k).alias("selector_type"), F.lit(s).alias("selector"), F.lit(v).alias("score"))
        for t, k, s, v in kinds
    ])
    s = crawled(spark, sf).select("source_id").distinct().select("source_id", F.posexplode(rows).alias("n", "p"))
    return s.select(
        (F.col("source_id") * 10 + F.col("n")).alias("id"), "source_id", "p.*"
    ).where("source_id <> 9 or target_element = 'title'")


@case(
    "extract_with_selectors",
    f"""SELECT page_id, page_id % 10 AS source_id, 'title' AS target_element, 'article h1' AS selector, 'css' AS selector_type,
               {PLAIN.format(h="regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1)")} AS text FROM pages
        WHERE length({PLAIN.format(h="regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1)")}) >= 1""",
)
def extract_titles(spark, sf):
    found = extraction.extract_with_selectors(crawled(spark, sf), page_patterns(spark, sf))
    return found.where("target_element = 'title'").select("page_id", "source_id", "target_element", "selector", "selector_type", "text")


# Fixed: the selectors that the combinator query runs, each with what it finds on the given pages.
COMBINATORS = [
    "h1, h2", "footer, h1", "article > p", "body > article > h1", "div[class]", "div[class=ad]", "div[class^=a]",
    "div[class$=x]", "a[href^='/']", "nav li + li", "ul > li ~ li", "li:first-child",
]


def _links(first: bool) -> str:
    texts = "list_transform(regexp_extract_all(html, '<li><a href=\"/[^\"]*\">([^<]*)</a></li>', 1), lambda x: " + PLAIN.format(h="x") + ")"
    return texts if first else f"list_slice({texts}, 2, 1000000)"


def _found(selector: str, texts: str) -> str:
    return f"""SELECT page_id, '{selector.replace("'", "''")}' AS selector, true AS supported, len(t)::BIGINT AS n_matches,
        CASE WHEN len(t) > 0 THEN t[1] END AS first_text, CASE WHEN len(t) > 0 THEN array_to_string(t, chr(10)) END AS all_text
        FROM (SELECT page_id, {texts} AS t FROM pages)"""


H1 = PLAIN.format(h="regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")
FOOTER = PLAIN.format(h="regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")
FIRST_P = PLAIN.format(h="regexp_extract(html, '(?s)</h1>(<p>.*)</article>', 1)")
AD = PLAIN.format(h="regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)")


@case("selector_matches", "\nUNION ALL\n".join([
    _found("h1, h2", f"[{H1}]"), _found("footer, h1", f"[{H1}, {FOOTER}]"), _found("article > p", f"[{FIRST_P}]"),
    _found("body > article > h1", f"[{H1}]"), _found("div[class]", f"[{AD}]"), _found("div[class=ad]", f"[{AD}]"),
    _found("div[class^=a]", f"[{AD}]"), _found("div[class$=x]", "CAST([] AS VARCHAR[])"),
    _found("a[href^='/']", _links(True)), _found("nav li + li", _links(False)), _found("ul > li ~ li", _links(False)),
    "SELECT page_id, 'li:first-child' AS selector, false AS supported, 0::BIGINT AS n_matches, NULL::VARCHAR AS first_text, "
    "NULL::VARCHAR AS all_text FROM pages",
]))
def selector_matches(spark, sf):
    """Lists, child and sibling combinators and attribute tests over every page; the first paragraph of
    an article is never closed, so it is the article's only child paragraph and holds the rest."""
    return extraction.select_all(extraction.page_nodes(crawled(spark, sf)), COMBINATORS)


@case("adaptive_articles")
def adaptive_articles(spark, sf):
    run = extraction.adaptive_extract(crawled(spark, sf), page_patterns(spark, sf), as_of=AS_OF, title="h1")
    return run.articles


@case(
    "adaptive_attempts",
    "SELECT page_id % 10 AS source_id, count(*) AS attempts, count(*) AS successes FROM pages GROUP BY ALL",
)
def adaptive_attempts(spark, sf):
    run = extraction.adaptive_extract(crawled(spark, sf), page_patterns(spark, sf), as_of=AS_OF, title="h1")
    return run.attempts.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("successes")
    )


@case("selector_trial_log")
def selector_trial_log(spark, sf):
    run = extraction.adaptive_extract(crawled(spark, sf), page_patterns(spark, sf), as_of=AS_OF)
    return run.trials.groupBy("source_id", "target_element", "selector").agg(
        F.count(F.lit(1)).alias("tried"), F.count_if("success").alias("won")
    )


def with_classes(spark, sf) -> DataFrame:
    """The pages with ids and classes put on their articles and titles, so there is something to discover."""
    html = F.replace("html", F.lit("<article><h1>"), F.lit(
        '<article id="main" class="post-body wide"><h1 id="head" class="big page-title">'))
    return crawled(spark, sf).withColumn("html", html)


@case(
    "discovered_selectors",
    """SELECT page_id % 10 AS source_id, target_element, selector, position, count(*) AS pages
       FROM pages, (VALUES ('title', '#head', 0), ('title', '.page-title', 1), ('title', '.post-body h1', 2),
                           ('content', '#main', 0), ('content', '.post-body', 1)) v(target_element, selector, position)
       GROUP BY ALL
       UNION ALL
       SELECT page_id % 10, 'content', '.post-body p', 2, count(*) FROM pages WHERE len(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')) >= 3 GROUP BY ALL""",
)
def discovered_selectors(spark, sf):
    pages = with_classes(spark, sf)
    nodes = extraction.page_nodes(pages)
    winner = lambda t, s: pages.select(
        "page_id", F.lit(t).alias("target_element"), F.lit("css").alias("selector_type"), F.lit(s).alias("selector")
    )
    found = extraction.discover_selectors(nodes, winner("title", "h1").unionByName(winner("content", "article")))
    return found.groupBy("source_id", "target_element", "selector", F.col("position").cast("int").alias("position")).agg(
        F.count(F.lit(1)).alias("pages")
    )


@case(
    "clipped_pages",
    "SELECT page_id, length(substr(html || html || html || html, 1, 50000)) AS chars FROM pages",
)
def clipped_pages(spark, sf):
    p = inputs.table(spark, sf, "pages")
    return p.select("page_id", F.length(tx.clip_html(F.concat("html", "html", "html", "html"))).cast("long").alias("chars"))


@case(
    "export_rows",
    ctes("content", "sources") + """
    SELECT c.id, c.title, s.name AS source_name, c.url, strftime(c.published, '%Y-%m-%d %H:%M:%S') AS published,
           c.category AS categories, c.content
    FROM content c LEFT JOIN sources s ON s.id = c.source_id WHERE c.category = 'de'
    ORDER BY c.published DESC, c.id DESC LIMIT 100""",
)
def export_rows(spark, sf):
    from newsloom.sources.export import csv_rows, export_rows as rows

    return csv_rows(rows(inputs.content(spark, sf), inputs.sources(spark, sf), categories=["de"], include_duplicates=True))
