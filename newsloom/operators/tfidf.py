"""Term weights of documents as a long table `(id, field, term, tf, df, weight)`."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.counting import gram_batches, shared_grams
from newsloom.functions.scale import cut_lineage, is_small, salted_join, split_repeated
from newsloom.functions.text import content_tokens


MAX_BROADCAST_TERMS = 1_000_000  # some 50 MB


def default_stop_words() -> list[str]:
    """Spark's English stop words (needs a running session)."""
    return list(StopWordsRemover.loadDefaultStopWords("english"))


def ngrams(words: str, low: int, high: int) -> Column:
    """All n-grams of `low` to `high` words of an array column, joined by a blank."""
    grams = []
    for n in range(low, high + 1):
        parts = "".join(f", get({words}, place + {k})" for k in range(1, n))
        starts = f"slice({words}, 1, greatest(size({words}) - {n - 1}, 0))"
        grams.append(words if n == 1 else f"transform({starts}, (first, place) -> concat_ws(' ', first{parts}))")
    return F.expr(f"concat({', '.join(grams)})")


def _in_field(name: str):
    return lambda term: F.struct(F.lit(name).alias("field"), term.alias("term"))


def _token_arrays(docs: DataFrame, fields: list[str], keep: list[str], stop_words: list[str] | None) -> DataFrame:
    stop = default_stop_words() if stop_words is None else stop_words
    return docs.select("id", *keep, *[content_tokens(f, stop, min_chars=2).alias(f) for f in fields])


def _counts_by_id(arrays: DataFrame, fields: list[str], keep: list[str], gram_range: tuple[int, int]) -> DataFrame:
    """Term counts of rows that share their `id` and `keep` columns: they count as one document."""
    terms = arrays.select(
        "id",
        *keep,
        F.explode(
            F.concat(
                *[
                    F.transform(ngrams(f, *gram_range), _in_field(f))
                    for f in fields
                ]
            )
        ).alias("t"),
    )
    return terms.groupBy("id", *keep, "t.field", "t.term").agg(F.count(F.lit(1)).alias("tf"))


def term_counts(
    docs: DataFrame,
    fields: list[str],
    *,
    stop_words: list[str] | None = None,
    gram_range: tuple[int, int] = (1, 2),
    keep: list[str] = (),
) -> DataFrame:
    """`id, field, term, tf` and the `keep` columns for every distinct term of every field.

    Tokens of one character and stop words go first, n-grams are built from what
    is left. A document is counted where it is: only those that share their id are shuffled.
    """
    keep, (low, high) = list(keep), gram_range
    lone, repeated = split_repeated(docs.select("id", *keep, *fields))
    arrays = _token_arrays(lone, fields, keep, stop_words)
    kinds = T.StructType([arrays.schema[c] for c in ["id", *keep]])
    kinds = kinds.add("field", T.StringType()).add("term", T.StringType()).add("tf", T.LongType())
    counts = arrays.mapInArrow(lambda b: gram_batches(b, fields, ["id", *keep], low, high), kinds)
    if repeated is None:
        return counts
    again = _counts_by_id(_token_arrays(repeated, fields, keep, stop_words), fields, keep, gram_range)
    return counts.unionByName(again)


def document_frequencies(
    docs: DataFrame,
    fields: list[str],
    *,
    stop_words: list[str] | None = None,
    gram_range: tuple[int, int] = (1, 2),
    min_df: int = 2,
    max_df: float = 0.95,
) -> DataFrame:
    """`vocabulary` straight from the texts: terms leave a task summed over many documents, and the
    documents' own counts are not made."""
    low, high = gram_range
    keep = ["copies"] if "copies" in docs.columns else []
    lone, repeated = split_repeated(docs.select("id", *keep, *fields))
    weight = keep[0] if keep else None
    partial = _token_arrays(lone, fields, keep, stop_words).drop("id").mapInArrow(
        lambda b: shared_grams(b, fields, low, high, weight), "field string, term string, df bigint, n bigint")
    if repeated is not None:
        again = _counts_by_id(_token_arrays(repeated, fields, keep, stop_words), fields, keep, gram_range)
        partial = partial.unionByName(again.select(
            "field", "term", F.col(weight).alias("df") if weight else F.lit(1).cast("long").alias("df"),
            F.lit(1).cast("long").alias("n")))
    sums = partial.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    return _limited(sums, docs, min_df, max_df)


def vocabulary(
    counts: DataFrame, docs: DataFrame, *, min_df: int = 2, max_df: float = 0.95
) -> DataFrame:
    """`field, term, df, idf, n` of the terms in at least `min_df` documents and at
    most the share `max_df` of them. With a `copies` column a row stands for that many
    equal documents; `n` is the number of rows."""
    weight = F.col("copies") if "copies" in docs.columns else F.lit(1)
    sums = counts.groupBy("field", "term").agg(F.sum(weight).alias("df"), F.count(F.lit(1)).alias("n"))
    return _limited(sums, docs, min_df, max_df)


def _limited(sums: DataFrame, docs: DataFrame, min_df: int, max_df: float) -> DataFrame:
    n_docs = docs.agg(F.sum("copies" if "copies" in docs.columns else F.lit(1))).scalar()
    df = F.col("df")
    return sums.where((df >= min_df) & (df <= max_df * n_docs)).withColumn("idf", F.log((1 + n_docs) / (1 + df)) + 1)


def raw_weights(counts: DataFrame, vocab: DataFrame, **skew) -> DataFrame:
    """tf * idf before normalisation.

    A vocabulary of counted size goes to the documents; a larger one meets them in a
    join that spreads the rows of frequent terms over tasks.
    """
    key, values = ["field", "term"], vocab.select("field", "term", "df", "idf")
    if not skew and is_small(values, MAX_BROADCAST_TERMS):
        joined = counts.join(F.broadcast(values), key)
    else:
        joined = salted_join(counts, values, key, spread=["id"], counts=vocab.select(*key, "n"), **skew)
    return joined.withColumn("weight", F.col("tf") * F.col("idf"))


def tfidf(
    docs: DataFrame,
    *,
    text: str = "content",
    stop_words: list[str] | None = None,
    gram_range: tuple[int, int] = (1, 2),
    min_df: int = 2,
    max_df: float = 0.95,
    **skew,
) -> DataFrame:
    """`id, term, tf, df, weight`: tf * (ln((1+n)/(1+df)) + 1), unit length per document."""
    docs = docs.select("id", text)
    grams = {"stop_words": stop_words, "gram_range": gram_range}
    vocab = cut_lineage(document_frequencies(docs, [text], min_df=min_df, max_df=max_df, **grams))
    counts = term_counts(docs, [text], **grams)  # made again from the texts: no table of all terms is written
    per_doc = W.partitionBy("id")
    weighted = raw_weights(counts, vocab, **skew)
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(per_doc))
    return weighted.select("id", "term", "tf", "df", (F.col("weight") / norm).alias("weight"))


def top_terms(weights: DataFrame, *, limit: int = 10) -> DataFrame:
    """The heaviest terms of every document, rounded weight first, then the term."""
    order = W.partitionBy("id").orderBy(F.desc(F.round("weight", 6)), "term")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
