"""Queries over articles: duplicates, listings, text rules, sentiment, summaries, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.functions.scale import cut_lineage
from newsloom.operators import dedup, groups, listing, similarity, summary, tfidf
from newsloom.operators import sentiment as sent
from workload import inputs
from workload.catalog import case
from workload.inputs import KEYWORDS, LEXICON, STOP_WORDS, ctes, quoted

AS_OF = "2024-02-01 00:00:00"


def ts(column: str):
    return tx.format_ts(column).alias(column)


# --- exact duplicates -------------------------------------------------------------------------

@case(
    "exact_duplicates",
    ctes("marked") + """
    SELECT id, content_hash, copies, survivor_id, id <> survivor_id AS is_duplicate FROM marked""",
)
def exact_duplicates(spark, sf) -> DataFrame:
    return dedup.exact_duplicates(inputs.content(spark, sf))


@case(
    "exact_duplicates_keep_oldest",
    ctes("hashes") + """
    SELECT id, first_value(id) OVER (PARTITION BY content_hash ORDER BY published, id) AS survivor_id,
           id <> first_value(id) OVER (PARTITION BY content_hash ORDER BY published, id) AS is_duplicate
    FROM hashes""",
)
def exact_duplicates_keep_oldest(spark, sf):
    marks = dedup.exact_duplicates(inputs.content(spark, sf), keep_newest=False)
    return marks.select("id", "survivor_id", "is_duplicate")


def marked_content(spark, sf) -> DataFrame:
    content = inputs.content(spark, sf)
    return content.join(dedup.exact_duplicates(content).select("id", "content_hash", "is_duplicate"), "id")


@case(
    "duplicate_report",
    ctes("marked", "sources") + """
    SELECT s.name AS source_name, count(*) AS articles,
           count(*) FILTER (m.id <> m.survivor_id) AS duplicates,
           CAST(coalesce(sum(strlen(m.content)) FILTER (m.id <> m.survivor_id), 0) AS BIGINT) AS duplicate_bytes
    FROM marked m JOIN sources s ON s.id = m.source_id GROUP BY s.name""",
)
def duplicate_report(spark, sf):
    """Duplicates and their size by source."""
    per_source = marked_content(spark, sf).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("articles"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.coalesce(F.sum(F.when(F.col("is_duplicate"), F.octet_length("content"))), F.lit(0))
        .cast("long").alias("duplicate_bytes"),
    )
    names = inputs.sources(spark, sf).select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return per_source.join(names, "source_id").drop("source_id")


@case(
    "space_saved",
    ctes("marked") + """
    SELECT count(*) AS duplicates, round(coalesce(sum(strlen(content)), 0) / 1024, 2) AS kb,
           round(coalesce(sum(strlen(content)), 0) / 1024 / 1024, 2) AS mb
    FROM marked WHERE id <> survivor_id""",
)
def space_saved(spark, sf):
    return dedup.space_saved(marked_content(spark, sf))


@case(
    "recent_duplicates",
    ctes("marked", "sources") + """
    SELECT m.id, m.title, s.name AS source, strftime(m.added, '%Y-%m-%d %H:%M:%S') AS added
    FROM marked m LEFT JOIN sources s ON s.id = m.source_id
    WHERE m.id <> m.survivor_id ORDER BY m.added DESC, m.id DESC LIMIT 5""",
)
def recent_duplicates(spark, sf):
    rows = dedup.recent_duplicates(marked_content(spark, sf), inputs.sources(spark, sf))
    return rows.withColumn("added", tx.format_ts("added"))


# --- listings ----------------------------------------------------------------------------------

VALUES_LEXICON = ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in LEXICON)

# words with their neighbours, valence by the published rules; see the sentiment operator
SCORED = f""",
lexicon(token, valence) AS (VALUES {VALUES_LEXICON}),
bare AS (
  SELECT id, content,
         list_transform(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> ''),
                        lambda w: CASE WHEN length(regexp_replace(w, '^[!-/:-@\\[-`{{-~]+|[!-/:-@\\[-`{{-~]+$', '', 'g')) <= 2
                                  THEN w ELSE regexp_replace(w, '^[!-/:-@\\[-`{{-~]+|[!-/:-@\\[-`{{-~]+$', '', 'g') END) AS w
  FROM content),
sized AS (
  SELECT *, list_transform(w, lambda x: lower(x)) AS lw,
         len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) AS up FROM bare),
worded AS (
  SELECT id, unnest(w) AS word, unnest(lw) AS token, generate_subscripts(lw, 1) AS place, lw,
         coalesce(list_position(lw, 'but'), 0) AS but, up > 0 AND up < len(w) AS mixed FROM sized),
hits AS (
  SELECT d.*, l.valence + CASE WHEN mixed AND word = upper(word) AND word <> lower(word)
                               THEN sign(l.valence) * 0.733::DOUBLE ELSE 0 END AS v0,
         CASE WHEN place > 1 THEN lw[place - 1] END AS p1, CASE WHEN place > 2 THEN lw[place - 2] END AS p2,
         CASE WHEN place > 3 THEN lw[place - 3] END AS p3
  FROM worded d JOIN lexicon l USING (token)),
""" + ",\n".join(
    f"""b{d} AS (
  SELECT *, (v{d - 1} + {w}::DOUBLE * (CASE WHEN v{d - 1} < 0 THEN -1 ELSE 1 END)
             * (CASE WHEN p{d} IN ({quoted(sent.BOOSTERS)}) THEN 0.293::DOUBLE
                     WHEN p{d} IN ({quoted(sent.DAMPENERS)}) THEN -0.293::DOUBLE ELSE 0 END))
            * (CASE WHEN p{d} IN ({quoted([n.replace("'", "''") for n in sent.NEGATIONS])})
                      OR coalesce(contains(p{d}, 'n''t'), false) THEN -0.74::DOUBLE ELSE 1 END) AS v{d}
  FROM {'hits' if d == 1 else f'b{d - 1}'})"""
    for d, w in sent.BOOST_BY_DISTANCE.items()
) + """,
sums AS (
  SELECT id, sum(v3 * CASE WHEN but = 0 OR place = but THEN 1 WHEN place < but THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END) AS s
  FROM b3 GROUP BY id),
marks AS (
  SELECT c.id, c.title, coalesce(s.s, 0) AS s,
         least(length(content) - length(replace(content, '!', '')), 4) * 0.292::DOUBLE
         + CASE WHEN length(content) - length(replace(content, '?', '')) <= 1 THEN 0
                WHEN length(content) - length(replace(content, '?', '')) <= 3
                THEN (length(content) - length(replace(content, '?', ''))) * 0.18::DOUBLE ELSE 0.96::DOUBLE END AS m
  FROM content c LEFT JOIN sums s USING (id)),
scored AS (
  SELECT id, title, round((s + sign(s) * m) / sqrt((s + sign(s) * m) * (s + sign(s) * m) + 15), 4) AS sentiment_score FROM marks),
labelled AS (
  SELECT *, CASE WHEN sentiment_score >= 0.05 THEN 'positive' WHEN sentiment_score <= -0.05 THEN 'negative'
                 ELSE 'neutral' END AS sentiment_label FROM scored)
"""


def lexicon(spark) -> DataFrame:
    return spark.createDataFrame(LEXICON, "token string, valence double")


def scored_content(spark, sf) -> DataFrame:
    content = marked_content(spark, sf)
    return content.join(sent.sentiment(content, lexicon(spark)), "id")


LISTED = """
SELECT m.id, m.title, s.name AS source_name, strftime(m.published, '%Y-%m-%d %H:%M:%S') AS published, m.url,
       replace(substr(m.content, 1, 200), chr(10), ' ') AS preview
FROM marked m LEFT JOIN sources s ON s.id = m.source_id
WHERE """


def listed(df: DataFrame) -> DataFrame:
    return df.select("id", "title", "source_name", ts("published"), "url", tx.preview("content").alias("preview"))


@case(
    "list_content",
    ctes("marked", "sources") + LISTED + """ m.id = m.survivor_id AND m.category IN ('en', 'fr')
      AND (contains(lower(m.title), 'the') OR contains(lower(m.content), 'the')
           OR contains(lower(m.title), 'que') OR contains(lower(m.content), 'que'))
    ORDER BY m.published DESC, m.id DESC LIMIT 20 OFFSET 5""",
)
def list_content(spark, sf):
    return listed(listing.list_content(
        marked_content(spark, sf), inputs.sources(spark, sf),
        limit=20, offset=5, categories=["en", "fr"], keywords=["the", "que"],
    ))


@case(
    "list_by_source_with_duplicates",
    ctes("marked", "sources") + LISTED + " m.source_id = 3 ORDER BY m.published DESC, m.id DESC LIMIT 10",
)
def list_by_source(spark, sf):
    return listed(listing.list_content(
        marked_content(spark, sf), inputs.sources(spark, sf), source_id=3, include_duplicates=True
    ))


@case(
    "list_by_sentiment",
    ctes("content") + SCORED + """
    SELECT id, title, sentiment_label, sentiment_score FROM labelled
    WHERE sentiment_label = 'positive' AND sentiment_score >= 0.2 AND sentiment_score <= 0.95
    ORDER BY id""",
)
def list_by_sentiment(spark, sf):
    content = inputs.content(spark, sf)
    scored = content.join(sent.sentiment(content, lexicon(spark)), "id")
    rows = listing.filter_content(
        scored, sentiment="positive", min_score=0.2, max_score=0.95, include_duplicates=True
    )
    return rows.select("id", "title", "sentiment_label", "sentiment_score")


@case(
    "article_by_id",
    ctes("content", "sources") + """
    SELECT c.id, c.title, s.name AS source_name, strftime(c.published, '%Y-%m-%d %H:%M:%S') AS published, c.content
    FROM content c LEFT JOIN sources s ON s.id = c.source_id WHERE c.id = 7""",
)
def article_by_id(spark, sf):
    row = listing.article_by_id(inputs.content(spark, sf), inputs.sources(spark, sf), 7)
    return row.select("id", "title", "source_name", ts("published"), "content")


@case(
    "keyword_hits",
    ctes("content") + f"""
    SELECT id FROM content WHERE {' OR '.join(f"contains(lower(title), '{k}') OR contains(lower(content), '{k}')" for k in KEYWORDS)}""",
)
def keyword_hits(spark, sf):
    return inputs.content(spark, sf).where(listing.has_keyword(KEYWORDS)).select("id")


@case(
    "keyword_table_hits",
    ctes("content") + f"""
    SELECT id FROM content
    WHERE list_has_any(string_split_regex(lower(title || ' ' || content), '[^\\pL\\pN_]+'), [{quoted(KEYWORDS)}])""",
)
def keyword_table_hits(spark, sf):
    words = spark.createDataFrame([(w,) for w in KEYWORDS], "word string")
    return listing.by_keyword_table(inputs.content(spark, sf), words).select("id")


@case(
    "category_counts",
    ctes("content") + "SELECT category, count(*) AS articles FROM content WHERE category IN ('de', 'es') GROUP BY category",
)
def category_counts(spark, sf):
    rows = inputs.content(spark, sf).where(F.arrays_overlap("categories", tx.comma_list(F.lit("de,es"))))
    return rows.groupBy(F.get("categories", F.lit(0)).alias("category")).agg(F.count(F.lit(1)).alias("articles"))


@case(
    "long_enough_for_nlp",
    ctes("content") + "SELECT id, length(content) AS chars FROM content WHERE content IS NOT NULL AND content <> '' AND length(content) >= 100",
)
def long_enough(spark, sf):
    rows = listing.filter_content(listing.non_empty(inputs.content(spark, sf)), min_length=100, include_duplicates=True)
    return rows.select("id", F.length("content").cast("long").alias("chars"))


@case(
    "unprocessed_articles",
    ctes("hashes") + "SELECT id FROM hashes WHERE id % 3 <> 0 ORDER BY id LIMIT 50",
)
def unprocessed_articles(spark, sf):
    content = listing.with_hash(inputs.content(spark, sf)).withColumn(
        "content_hash", F.when(F.col("id") % 3 == 0, F.col("content_hash"))
    )
    return listing.unprocessed(content, "content_hash", limit=50).select("id")


# --- text rules --------------------------------------------------------------------------------

WORDS = "list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')"
SENTENCES = "list_filter(string_split(regexp_replace(trim({t}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"


def quality_sql(relation: str) -> str:
    return f""",
    m AS (SELECT id, title, content, len({WORDS.format(t='title')}) AS tw, len({WORDS.format(t='content')}) AS cw,
                 len({SENTENCES.format(t='content')}) AS cs,
                 len(regexp_extract_all(content, '<[^>]+>')) AS tags
          FROM {relation}),
    q AS (SELECT id,
      CASE WHEN title IS NULL OR title = '' THEN 0.0::DOUBLE WHEN tw < 3 OR tw > 30 THEN 0.5::DOUBLE
           WHEN title = lower(title) AND title <> upper(title) THEN 0.6::DOUBLE
           WHEN regexp_matches(lower(title), '\\b(lorem|ipsum|dolor)\\b') THEN 0.1::DOUBLE ELSE 0.9::DOUBLE END AS title_quality,
      CASE WHEN content IS NULL OR content = '' THEN 0.0::DOUBLE WHEN cw < 20 THEN 0.3::DOUBLE
           WHEN NOT contains(content, chr(10) || chr(10)) THEN 0.7::DOUBLE
           WHEN regexp_matches(lower(content), '\\b(lorem|ipsum|dolor)\\b') THEN 0.1::DOUBLE
           WHEN tags / length(content) > 0.1 THEN 0.4::DOUBLE
           WHEN cw / cs < 3 OR cw / cs > 40 THEN 0.6::DOUBLE ELSE 0.85::DOUBLE END AS content_quality
      FROM m)
    SELECT *, least(title_quality, content_quality) AS extraction_quality FROM q"""


def quality(content: DataFrame) -> DataFrame:
    return content.select(
        "id",
        tx.element_quality(F.lit("title"), "title").alias("title_quality"),
        tx.element_quality(F.lit("content"), "content").alias("content_quality"),
    ).withColumn("extraction_quality", tx.article_quality("title_quality", "content_quality"))


@case("quality_rules", ctes("content") + quality_sql("content"))
def quality_rules(spark, sf):
    return quality(inputs.content(spark, sf))


@case(
    "quality_rules_paragraphs",
    ctes("content") + ", paragraphs AS (SELECT id, title, replace(content, chr(10), chr(10) || chr(10)) AS content FROM content)"
    + quality_sql("paragraphs"),
)
def quality_rules_paragraphs(spark, sf):
    return quality(inputs.paragraphs(spark, sf))


@case(
    "good_articles",
    ctes("content") + quality_sql("content") + " WHERE least(title_quality, content_quality) >= 0.5",
)
def good_articles(spark, sf):
    return listing.filter_content(quality(inputs.content(spark, sf)), min_quality=0.5, include_duplicates=True)


@case(
    "quality_features",
    ctes("content") + f""", w AS (SELECT id, content, {WORDS.format(t='content')} AS words FROM content)
    SELECT id, CAST(length(content) AS DOUBLE) AS chars, CAST(len(words) AS DOUBLE) AS words,
           CAST(len(string_split(content, chr(10))) AS DOUBLE) AS lines,
           round(len(regexp_extract_all(content, '\\p{{Lu}}')) / length(content), 9) AS upper_ratio,
           round(len(regexp_extract_all(content, '[!-/:-@\\[-`{{-~]')) / length(content), 9) AS punct_ratio,
           round(len(list_distinct(words)) / len(words), 9) AS distinct_ratio
    FROM w""",
)
def quality_features(spark, sf):
    f = inputs.content(spark, sf).select("id", *tx.quality_features("content"))
    return f.select("id", *[F.round(c, 9).alias(c) for c in tx.FEATURES])


@case(
    "token_counts",
    ctes("tokens") + "SELECT token, count(*) AS n FROM (SELECT unnest(words) AS token FROM tokens) GROUP BY token",
)
def token_counts(spark, sf):
    rows = inputs.content(spark, sf).select(F.explode(tx.tokens("content")).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@case(
    "content_words_without_stop_words",
    ctes("tokens") + f"""
    SELECT id, count(*) AS words, count(DISTINCT token) AS distinct_words
    FROM (SELECT id, unnest(words) AS token FROM tokens) WHERE token NOT IN ({quoted(STOP_WORDS)}) GROUP BY id""",
)
def without_stop_words(spark, sf):
    w = inputs.content(spark, sf).select("id", tx.content_tokens("content", STOP_WORDS).alias("w"))
    return w.where(F.size("w") > 0).select(
        "id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("distinct_words")
    )


@case(
    "sentence_counts",
    ctes("content") + f"SELECT id, len(s) AS sentences, CAST(list_sum(list_transform(s, lambda x: length(x))) AS BIGINT) AS chars FROM (SELECT id, {SENTENCES.format(t='content')} AS s FROM content) WHERE len(s) > 0",
)
def sentence_counts(spark, sf):
    s = inputs.content(spark, sf).select("id", F.explode(tx.sentences("content")).alias("s"))
    return s.groupBy("id").agg(
        F.count(F.lit(1)).alias("sentences"), F.sum(F.length("s")).cast("long").alias("chars")
    )


# --- sentiment ---------------------------------------------------------------------------------

@case("sentiment", ctes("content") + SCORED + "SELECT id, sentiment_score, sentiment_label FROM labelled")
def sentiment(spark, sf):
    return sent.sentiment(inputs.content(spark, sf), lexicon(spark))


@case(
    "sentiment_counts",
    ctes("content") + SCORED + "SELECT sentiment_label, count(*) AS articles FROM labelled GROUP BY sentiment_label",
)
def sentiment_counts(spark, sf):
    return sent.sentiment_counts(sent.sentiment(inputs.content(spark, sf), lexicon(spark)))


@case(
    "sentiment_stats",
    ctes("content") + SCORED + """
    SELECT count(*) FILTER (sentiment_label = 'positive') AS positive, count(*) FILTER (sentiment_label = 'neutral') AS neutral,
           count(*) FILTER (sentiment_label = 'negative') AS negative, round(avg(sentiment_score), 6) AS average_score,
           (SELECT id FROM labelled ORDER BY sentiment_score DESC, id LIMIT 1) AS most_positive_id,
           (SELECT title FROM labelled ORDER BY sentiment_score DESC, id LIMIT 1) AS most_positive_title,
           max(sentiment_score) AS most_positive_score,
           (SELECT id FROM labelled ORDER BY sentiment_score, id LIMIT 1) AS most_negative_id,
           (SELECT title FROM labelled ORDER BY sentiment_score, id LIMIT 1) AS most_negative_title,
           min(sentiment_score) AS most_negative_score
    FROM labelled""",
)
def sentiment_stats(spark, sf):
    content = inputs.content(spark, sf).select("id", "title", "content")
    s = sent.sentiment_stats(content.join(sent.sentiment(content, lexicon(spark)), "id"))
    flat = [
        F.col(f"{side}.{f}").alias(f"{side}_{f}")
        for side in ("most_positive", "most_negative") for f in ("id", "title", "score")
    ]
    return s.select("positive", "neutral", "negative", F.round("average_score", 6).alias("average_score"), *flat)


@case(
    "nlp_run_counts",
    ctes("content") + """
    SELECT count(*) AS total, count(*) FILTER (length(content) >= 100) AS processed,
           count(*) FILTER (NOT coalesce(length(content) >= 100, false)) AS errors FROM content""",
)
def nlp_run_counts(spark, sf):
    from newsloom.plans.nlp import process_counts

    return process_counts(inputs.content(spark, sf))


# --- summaries and terms -----------------------------------------------------------------------

SENTENCE_SCORES = f""",
    long AS (SELECT id, content FROM content WHERE length(content) >= 100),
    split AS (SELECT id, {SENTENCES.format(t='content')} AS s FROM long),
    sents AS (SELECT id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM split),
    toks AS (SELECT id, pos, unnest(list_filter(string_split_regex(lower(sentence), '[^\\pL\\pN_]+'), lambda w: w <> '')) AS word FROM sents),
    kept AS (SELECT * FROM toks WHERE word NOT IN ({quoted(STOP_WORDS)})),
    freq AS (SELECT id, word, count(*) AS f FROM kept GROUP BY id, word),
    most AS (SELECT id, max(f) AS m FROM freq GROUP BY id),
    sums AS (SELECT k.id, k.pos, sum(f.f / m.m) AS score
             FROM kept k JOIN freq f USING (id, word) JOIN most m USING (id) GROUP BY k.id, k.pos),
    scores AS (SELECT s.id, s.pos, s.sentence, round(coalesce(u.score, 0), 6) AS score FROM sents s LEFT JOIN sums u USING (id, pos)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS rank FROM scores)
"""


@case(
    "best_sentences",
    ctes("content") + SENTENCE_SCORES + "SELECT id, CAST(pos AS BIGINT) AS pos, score, rank FROM ranked WHERE rank <= 3",
)
def best_sentences(spark, sf):
    docs = inputs.content(spark, sf).where(F.length("content") >= 100)
    best = summary.best_sentences(docs, stop_words=STOP_WORDS)
    return best.select("id", F.col("pos").cast("long").alias("pos"), "score", F.col("rank").cast("long").alias("rank"))


@case(
    "summaries",
    ctes("content") + SENTENCE_SCORES + """, sm AS (
    SELECT id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM ranked WHERE rank <= 3 GROUP BY id)
    SELECT c.id, coalesce(sm.summary, c.content) AS summary FROM content c LEFT JOIN sm USING (id)""",
)
def summaries(spark, sf):
    return summary.summarize(inputs.content(spark, sf), stop_words=STOP_WORDS)


def terms_sql(field: str) -> str:
    """Counted terms of one field, vocabulary and unit weights."""
    f = field
    return f""",
    {f}_t AS (SELECT id, list_filter(string_split_regex(lower({f}), '[^\\pL\\pN_]+'),
                 lambda w: length(w) >= 2 AND w NOT IN ({quoted(STOP_WORDS)})) AS w FROM content),
    {f}_g AS (SELECT id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {f}_t),
    {f}_c AS (SELECT id, term, count(*) AS tf FROM {f}_g GROUP BY id, term),
    {f}_v AS (SELECT term, count(*) AS df FROM {f}_c GROUP BY term
              HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM content)),
    {f}_r AS (SELECT id, term, tf, df, tf * (ln((1 + (SELECT count(*) FROM content)) / (1 + df)) + 1) AS weight
              FROM {f}_c JOIN {f}_v USING (term)),
    {f}_w AS (SELECT id, term, tf, df, weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)) AS weight FROM {f}_r)"""


@case(
    "tfidf_top_terms",
    ctes("content") + terms_sql("content") + """
    SELECT id, term, tf, df, round(weight, 6) AS weight FROM content_w
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(weight, 6) DESC, term) <= 10""",
)
def tfidf_top_terms(spark, sf):
    top = tfidf.top_terms(tfidf.tfidf(inputs.content(spark, sf), stop_words=STOP_WORDS), limit=10)
    return top.select("id", "term", "tf", "df", F.round("weight", 6).alias("weight"))


@case(
    "tfidf_weights",
    ctes("content") + terms_sql("content") + "SELECT id, term, tf, df, round(weight, 6) AS weight FROM content_w",
)
def tfidf_weights(spark, sf):
    weights = tfidf.tfidf(inputs.content(spark, sf), stop_words=STOP_WORDS)
    return weights.select("id", "term", "tf", "df", F.round("weight", 6).alias("weight"))


@case(
    "tfidf_vocabulary",
    ctes("content") + terms_sql("content") + "SELECT term, df, round(ln((1 + (SELECT count(*) FROM content)) / (1 + df)) + 1, 6) AS idf FROM content_v",
)
def tfidf_vocabulary(spark, sf):
    docs = inputs.content(spark, sf).select("id", "content")
    return tfidf.document_frequencies(docs, ["content"], stop_words=STOP_WORDS).select("term", "df", F.round("idf", 6).alias("idf"))


@case(
    "topic_counts",
    ctes("tokens") + """
    SELECT topic, count(*) AS articles FROM (SELECT id, unnest(list_distinct(words[1:3])) AS topic FROM tokens)
    GROUP BY topic ORDER BY articles DESC, topic LIMIT 10""",
)
def topic_counts(spark, sf):
    from newsloom.operators.topics import topic_counts as count_topics

    content = inputs.content(spark, sf).withColumn("topics", F.array_distinct(F.slice(tx.tokens("content"), 1, 3)))
    return count_topics(content, limit=10)


# --- near-duplicates ---------------------------------------------------------------------------

VECTORS = terms_sql("title") + terms_sql("content") + """,
    raw AS (
      SELECT c.id, 'title' AS field, chr(1) || c.title AS term, 1.0::DOUBLE AS weight FROM content c
      WHERE c.id NOT IN (SELECT id FROM title_w)
      UNION ALL
      SELECT c.id, 'content', chr(1) || c.content, 1.0::DOUBLE FROM content c WHERE c.id NOT IN (SELECT id FROM content_w)),
    vectors AS (
      SELECT id, 'title:' || term AS term, sqrt(0.3::DOUBLE) * weight AS w FROM title_w
      UNION ALL SELECT id, 'content:' || term, sqrt(0.7::DOUBLE) * weight FROM content_w
      UNION ALL SELECT id, field || ':' || term, CASE WHEN field = 'title' THEN sqrt(0.3::DOUBLE) ELSE sqrt(0.7::DOUBLE) END FROM raw)
"""
REPS = """,
    keyed AS (
      SELECT c.id, CAST(c.published AS DATE) AS day,
             CASE WHEN len(t.w) = 0 THEN chr(1) || c.title ELSE array_to_string(t.w, ' ') END AS k1,
             CASE WHEN len(b.w) = 0 THEN chr(1) || c.content ELSE array_to_string(b.w, ' ') END AS k2
      FROM content c JOIN title_t t USING (id) JOIN content_t b USING (id)),
    reps AS (SELECT id, day, min(id) OVER (PARTITION BY day, k1, k2) AS rep_id, count(*) OVER (PARTITION BY day, k1, k2) AS copies FROM keyed)
"""
PAIRS = """,
    pairs AS (
      SELECT a.id AS id_a, b.id AS id_b, round(sum(a.w * b.w), 6) AS similarity
      FROM vectors a JOIN vectors b ON a.term = b.term AND a.id < b.id
      WHERE a.id IN (SELECT rep_id FROM reps) AND b.id IN (SELECT rep_id FROM reps)
      GROUP BY a.id, b.id HAVING round(sum(a.w * b.w), 6) >= 0.75),
    near AS (
      SELECT p.* FROM pairs p JOIN reps a ON a.id = p.id_a JOIN reps b ON b.id = p.id_b
      WHERE abs(date_diff('day', a.day, b.day)) <= 7)
"""


@case(
    "similar_to",
    ctes("content") + VECTORS + """
    SELECT b.id, round(sum(a.w * b.w), 6) AS similarity, b.id = 23 AS is_main
    FROM vectors a JOIN vectors b ON a.term = b.term WHERE a.id = 23
    GROUP BY b.id HAVING b.id = 23 OR round(sum(a.w * b.w), 6) >= 0.2""",
)
def similar_to(spark, sf):
    """Looked up in the vector index at rest, built once per input in the shared folder."""
    return similarity.similar_to_indexed(spark, vector_index(spark, sf), 23, threshold=0.2)


def vector_index(spark, sf) -> str:
    import hashlib

    from newsloom.functions.scale import shared_folder

    content = inputs.content(spark, sf)
    key = hashlib.md5(repr((sorted(content.inputFiles()), STOP_WORDS, similarity.INDEX_BUCKETS)).encode()).hexdigest()
    path = f"{shared_folder(spark)}/packed-vector-index-{key}"
    if not similarity.index_ready(spark, path):
        similarity.build_vector_index(content, path, stop_words=STOP_WORDS)
    return path


@case(
    "representatives",
    ctes("content") + terms_sql("title") + terms_sql("content") + REPS + "SELECT id, rep_id, copies FROM reps",
)
def representatives(spark, sf):
    return similarity.representatives(inputs.content(spark, sf), stop_words=STOP_WORDS)


@case(
    "near_duplicate_pairs",
    ctes("content") + VECTORS + REPS + PAIRS + "SELECT id_a, id_b, similarity FROM near",
)
def near_duplicate_pairs(spark, sf):
    return similarity.near_duplicates(inputs.content(spark, sf), use_min_hash=False, stop_words=STOP_WORDS)


UNDATED = "id % 4 = 1"  # articles of the next query that lose their date


@case(
    "near_duplicate_pairs_undated",
    ctes("content") + VECTORS + ",\n    dated AS (SELECT id, CASE WHEN NOT (" + UNDATED + """) THEN published END AS published FROM content)
    SELECT a.id AS id_a, b.id AS id_b, round(sum(a.w * b.w), 6) AS similarity
    FROM vectors a JOIN vectors b ON a.term = b.term AND a.id < b.id
    JOIN dated x ON x.id = a.id JOIN dated y ON y.id = b.id
    WHERE x.published IS NULL AND y.published IS NULL
    GROUP BY a.id, b.id HAVING round(sum(a.w * b.w), 6) >= 0.75""",
)
def near_duplicate_pairs_undated(spark, sf):
    """Links of the articles without a date: representatives' pairs, and members with their representative."""
    rows = inputs.content(spark, sf).withColumn("published", F.when(~F.expr(UNDATED), F.col("published")))
    reps = cut_lineage(similarity.representatives(rows, stop_words=STOP_WORDS).join(
        rows.select("id", F.col("published").isNull().alias("undated")), "id"))
    pairs = similarity.near_duplicates(rows, reps.drop("undated"), stop_words=STOP_WORDS)
    own = reps.where("undated")
    one, two = own.select(F.col("id").alias("x"), F.col("rep_id").alias("id_a")), own.select(F.col("id").alias("y"), F.col("rep_id").alias("id_b"))
    across = pairs.join(one, "id_a").join(two, "id_b").select("x", "y", "similarity")
    same = one.join(two, F.col("id_a") == F.col("id_b")).where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    return across.unionByName(same).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


@case("near_duplicate_pairs_min_hash")
def near_duplicate_pairs_min_hash(spark, sf):
    return similarity.near_duplicates(inputs.content(spark, sf), use_min_hash=True, stop_words=STOP_WORDS)


@case("min_hash_recall")
def min_hash_recall(spark, sf):
    """Share of the exact near-duplicate pairs that weighted min-hash candidates find, at 0.75 and 0.4."""
    content = inputs.content(spark, sf)
    reps = cut_lineage(similarity.representatives(content, stop_words=STOP_WORDS))
    vectors = cut_lineage(similarity.representative_vectors(content, reps, stop_words=STOP_WORDS))  # the same for all four
    out = None
    for threshold in (0.75, 0.4):
        pairs = lambda hashed: similarity.near_duplicates(
            content, reps, threshold=threshold, use_min_hash=hashed, stop_words=STOP_WORDS, vectors=vectors).select("id_a", "id_b")
        exact, found = cut_lineage(pairs(False)), cut_lineage(pairs(True))
        row = exact.join(found.withColumn("hit", F.lit(1)), ["id_a", "id_b"], "left").agg(
            F.count(F.lit(1)).alias("exact_pairs"), F.count("hit").alias("found_pairs"))
        row = row.select(F.lit(threshold).alias("threshold"), "exact_pairs", "found_pairs",
                         F.when(F.col("exact_pairs") > 0, F.col("found_pairs") / F.col("exact_pairs")).otherwise(F.lit(1.0)).alias("recall"))
        out = row if out is None else out.unionByName(row)
    return out


def labels(spark, sf, content: DataFrame) -> DataFrame:
    reps = cut_lineage(similarity.representatives(content, stop_words=STOP_WORDS))
    pairs = similarity.near_duplicates(content, reps, use_min_hash=False, stop_words=STOP_WORDS)
    return groups.similarity_labels(pairs, reps)


LABELS = """,
    links AS (SELECT id_a AS u, id_b AS v FROM near UNION SELECT id_b, id_a FROM near
              UNION SELECT id, rep_id FROM reps WHERE id <> rep_id UNION SELECT rep_id, id FROM reps WHERE id <> rep_id),
    reach(id, root) AS (SELECT u, u FROM links UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.id),
    labels AS (SELECT id, min(root) AS similarity_group FROM reach GROUP BY id)
"""


@case(
    "similarity_groups",
    ctes("content", recursive=True) + VECTORS + REPS + PAIRS + LABELS + "SELECT id, similarity_group FROM labels",
)
def similarity_groups(spark, sf):
    return labels(spark, sf, inputs.content(spark, sf))


GROUPS = LABELS + """,
    groups AS (
      SELECT l.similarity_group AS id, arg_max(c.id, (c.published, c.id)) AS main_article_id, count(*) AS article_count
      FROM labels l JOIN content c USING (id) GROUP BY l.similarity_group)
"""


@case(
    "similarity_group_table",
    ctes("content", recursive=True) + VECTORS + REPS + PAIRS + GROUPS
    + "SELECT id, '2024-02-01 00:00:00' AS created, '2024-02-01 00:00:00' AS updated, main_article_id, article_count FROM groups",
)
def similarity_group_table(spark, sf):
    content = inputs.content(spark, sf)
    table = groups.group_table(labels(spark, sf, content), content, as_of=AS_OF)
    return table.withColumn("created", tx.format_ts("created")).withColumn("updated", tx.format_ts("updated"))


@case(
    "duplicate_stats",
    ctes("marked", "sources", recursive=True) + VECTORS + REPS + PAIRS + GROUPS + """,
    big AS (SELECT * FROM groups ORDER BY article_count DESC, id LIMIT 1)
    SELECT (SELECT count(*) FROM marked WHERE id <> survivor_id) AS exact_duplicates,
           (SELECT count(*) FROM groups) AS similarity_groups,
           (SELECT CAST(sum(article_count) AS BIGINT) FROM groups) AS articles_in_similarity_groups,
           b.id AS largest_group_id, b.article_count AS largest_group_count, b.main_article_id AS largest_main_id,
           m.title AS largest_title, s.name AS largest_source,
           (SELECT round(sum(strlen(content)) / 1024, 2) FROM marked WHERE id <> survivor_id) AS space_saved_kb,
           (SELECT round(sum(strlen(content)) / 1024 / 1024, 2) FROM marked WHERE id <> survivor_id) AS space_saved_mb
    FROM big b JOIN marked m ON m.id = b.main_article_id JOIN sources s ON s.id = m.source_id""",
)
def duplicate_stats(spark, sf):
    content = marked_content(spark, sf)
    table = groups.group_table(labels(spark, sf, inputs.content(spark, sf)), content, as_of=AS_OF)
    return dedup.duplicate_stats(content, table, inputs.sources(spark, sf))


@case(
    "dedup_run_counts",
    ctes("marked", recursive=True) + VECTORS + REPS + PAIRS + GROUPS + """
    SELECT (SELECT count(*) FROM marked WHERE id <> survivor_id) AS exact_duplicates_found,
           (SELECT count(*) FROM groups) AS similarity_groups_created,
           (SELECT count(*) FROM labels) AS similar_articles_found, (SELECT count(*) FROM content) AS total_processed""",
)
def dedup_run_counts(spark, sf):
    from newsloom.plans.dedup import deduplicate

    run = deduplicate(inputs.content(spark, sf), as_of=AS_OF, use_min_hash=False, stop_words=STOP_WORDS)
    return run.counts


@case(
    "dedup_exact_only_counts",
    ctes("marked") + """
    SELECT count(*) FILTER (id <> survivor_id) AS exact_duplicates_found, CAST(0 AS BIGINT) AS similarity_groups_created,
           CAST(0 AS BIGINT) AS similar_articles_found, count(*) AS total_processed FROM marked""",
)
def dedup_exact_only_counts(spark, sf):
    from newsloom.plans.dedup import deduplicate

    return deduplicate(inputs.content(spark, sf), as_of=AS_OF, exact_only=True).counts
