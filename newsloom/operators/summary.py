"""Extractive summaries: the sentences with the most frequent words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import counting
from newsloom.functions.scale import split_repeated
from newsloom.functions.text import content_tokens, content_tokens_sql, sentences
from newsloom.operators.tfidf import default_stop_words


def _scored(docs: DataFrame, stop_words: list[str]) -> DataFrame:
    """`docs` with `scores`: summed word frequency of each sentence, relative to the most frequent word.

    Works inside each row; nothing is shuffled. A null text has no sentences."""
    split = docs.withColumn("_sentences", sentences("content"))
    words = split.withColumn("_words", F.expr(f"transform(_sentences, s -> {content_tokens_sql('s', stop_words)})"))
    scores = F.transform(counting.sentence_scores("_words"), lambda x: F.round(x, 6))
    return words.withColumn("scores", scores).drop("_sentences", "_words")


def sentence_scores(docs: DataFrame, *, stop_words: list[str] | None = None) -> DataFrame:
    """`id, pos, score`: summed word frequency of a sentence, relative to the most frequent word.

    Texts that share their id count as one text, sentence by sentence; only those are shuffled."""
    stop = default_stop_words() if stop_words is None else stop_words
    lone, repeated = split_repeated(docs.select("id", "content"))
    scores = _scored(lone, stop).select("id", F.posexplode("scores").alias("pos", "score"))
    return scores if repeated is None else scores.unionByName(_scores_by_id(repeated, stop))


def _scores_by_id(docs: DataFrame, stop_words: list[str]) -> DataFrame:
    """`id, pos, score` of texts that share their id: they count as one text."""
    sents = docs.repartition("id").select("id", F.posexplode(sentences("content")).alias("pos", "sentence"))
    words = sents.select("id", "pos", F.explode_outer(content_tokens("sentence", stop_words)).alias("word"))
    counted = words.groupBy("id", "pos", "word").agg(F.count("word").alias("n"))
    in_doc = F.sum("n").over(W.partitionBy("id", "word"))
    most = F.max("f").over(W.partitionBy("id"))
    relative = F.coalesce(F.try_divide(F.col("n") * F.col("f"), most), F.lit(0.0))
    return (
        counted.withColumn("f", in_doc)
        .withColumn("part", relative)
        .groupBy("id", "pos")
        .agg(F.round(F.sum("part"), 6).alias("score"))
    )


def _best_of(scores: str, kept: int) -> Column:
    """Places and scores of the `kept` highest scores, ties to the earlier one."""
    ordered = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("down"), i.alias("pos"))))
    return F.transform(F.slice(ordered, 1, kept), lambda b: F.struct(b["pos"].alias("pos"), (-b["down"]).alias("score")))


def _best_by_id(docs: DataFrame, kept: int, stop_words: list[str]) -> DataFrame:
    order = W.partitionBy("id").orderBy(F.desc("score"), "pos")
    ranked = _scores_by_id(docs, stop_words).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= kept)


def best_sentences(docs: DataFrame, *, sentences_kept: int = 3, stop_words: list[str] | None = None) -> DataFrame:
    """`id, pos, score, rank` of the best sentences, ties to the earlier one.

    A text is scored and ranked in its row; only texts that share their id are shuffled."""
    stop = default_stop_words() if stop_words is None else stop_words
    lone, repeated = split_repeated(docs.select("id", "content"))
    ranked = _scored(lone, stop).select("id", F.posexplode(_best_of("scores", sentences_kept)).alias("place", "b"))
    best = ranked.select("id", "b.pos", "b.score", (F.col("place") + 1).alias("rank"))
    return best if repeated is None else best.unionByName(_best_by_id(repeated, sentences_kept, stop))


def summarize(
    content: DataFrame,
    *,
    sentences_kept: int = 3,
    min_length: int = 100,
    stop_words: list[str] | None = None,
) -> DataFrame:
    """`id, summary`: best sentences in text order; texts below `min_length` stay as they are."""
    stop = default_stop_words() if stop_words is None else stop_words
    lone, repeated = split_repeated(content.select("id", "content"))
    picked = F.array_sort(F.transform(_best_of("scores", sentences_kept), lambda b: b["pos"]))
    rows = _scored(lone, stop).select("id", "content", picked.alias("picked"))
    long_text = F.col("id").isNotNull() & (F.length("content") >= min_length) & (F.size("picked") > 0)
    if repeated is not None:
        long_rows = repeated.where(F.length("content") >= min_length)
        best = _best_by_id(long_rows, sentences_kept, stop).groupBy("id").agg(
            F.array_sort(F.collect_list("pos")).alias("picked"))
        rows = rows.withColumn("picked", F.when(long_text, F.col("picked")))
        rows = rows.unionByName(repeated.join(best, "id", "left").select("id", "content", "picked"))
        long_text = F.col("picked").isNotNull()
    parts = sentences("content")
    text = F.array_join(F.transform("picked", lambda p: F.get(parts, p)), " ")
    return rows.select("id", F.when(long_text, text).otherwise(F.col("content")).alias("summary"))
