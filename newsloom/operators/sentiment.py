"""Lexicon sentiment of articles, after Hutto & Gilbert (2014).

Every word of the lexicon adds its valence, changed by capitals, by up to three
words before it (boosters, negations), by a later or earlier "but", and by
exclamation and question marks. The sum s becomes s / sqrt(s * s + 15).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.scale import lookup_join
from newsloom.functions.text import sentiment_label, sql_list, words

# Fixed values published with the method.
ALPHA = 15
BOOST = 0.293
CAPITALS = 0.733
NEGATED = -0.74
BOOST_BY_DISTANCE = {1: 1.0, 2: 0.95, 3: 0.9}
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MAX_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS = 0.18, 0.96
NEGATIONS = """
aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt
neither neednt never none nope nor not nothing nowhere oughtnt shant shouldnt uhuh wasnt werent
without wont wouldnt rarely seldom despite
ain't aren't can't couldn't daren't didn't doesn't don't hadn't hasn't haven't isn't mightn't
mustn't needn't oughtn't shan't shouldn't uh-uh wasn't weren't won't wouldn't
""".split()
BOOSTERS = """
absolutely amazingly awfully completely considerably decidedly deeply effing enormously entirely
especially exceptionally extremely fabulously flipping flippin fricking frickin frigging friggin
fully fucking greatly hella highly hugely incredibly intensely majorly more most particularly purely
quite really remarkably so substantially thoroughly totally tremendously uber unbelievably unusually
utterly very
""".split()
DAMPENERS = """
almost barely hardly kinda kindof kind-of less little marginally occasionally partly scarcely
slightly somewhat sorta sortof sort-of
""".split()

# a word with capitals and without small letters
LOUD_WORD = r"(?U)(?<!\S)[^\s\p{Ll}]*\p{Lu}[^\s\p{Ll}]*(?!\S)"


def _bare(word: str) -> str:
    """SQL: the word without punctuation around it; very short ones (smileys) stay whole."""
    stripped = f"btrim({word}, {sql_list([string.punctuation])})"
    return f"CASE WHEN length({stripped}) <= 2 THEN {word} ELSE {stripped} END"


def _with_valence(hits: DataFrame) -> DataFrame:
    """Valence of each word of the lexicon after the words around it, in column `v`."""
    v = F.col("valence")
    hits = hits.withColumn("v", v + F.when(F.col("loud"), F.signum(v) * CAPITALS).otherwise(0.0))
    for d, weight in BOOST_BY_DISTANCE.items():
        step = f"CASE WHEN p{d} IN ({sql_list(BOOSTERS)}) THEN 1 WHEN p{d} IN ({sql_list(DAMPENERS)}) THEN -1 ELSE 0 END"
        negated = f"p{d} IN ({sql_list(NEGATIONS)}) OR coalesce(contains(p{d}, 'n\\'t'), false)"
        boosted = f"v + CASE WHEN v < 0 THEN -1 ELSE 1 END * {step} * {BOOST}D * {weight}D"
        hits = hits.withColumn("v", F.expr(f"({boosted}) * CASE WHEN {negated} THEN {NEGATED}D ELSE 1D END"))
    but = F.col("but")
    turn = F.when(but == 0, 1.0).when(F.col("at") < but, BEFORE_BUT).when(F.col("at") > but, AFTER_BUT).otherwise(1.0)
    return hits.withColumn("v", F.col("v") * turn)


def sentiment(content: DataFrame, lexicon: DataFrame, *, text: str = "content", **limits) -> DataFrame:
    """`id, sentiment_score, sentiment_label`; `lexicon` is `token, valence`, tokens in lower case."""
    t = F.coalesce(text, F.lit(""))
    asked = F.regexp_count(t, F.lit(r"\?"))
    marks = (
        F.least(F.regexp_count(t, F.lit("!")), F.lit(MAX_EXCLAMATIONS)) * EXCLAMATION
        + F.when(asked <= 1, 0.0).when(asked <= 3, asked * QUESTION).otherwise(MANY_QUESTIONS)
    )
    docs = content.select("id", marks.alias("marks"), words(t).alias("w"), F.regexp_count(t, F.lit(LOUD_WORD)).alias("upper"), t.alias("t"))
    docs = docs.withColumn("mixed", F.expr("upper > 0 AND upper < size(w)")).withColumn(
        "but",  # its place is only looked for where the word occurs
        F.expr(f"CASE WHEN contains(lower(t), 'but') THEN array_position(transform(w, x -> lower({_bare('x')})), 'but') ELSE 0 END"),
    )
    raw = docs.select(
        "id", "mixed", "but",
        F.expr("explode(transform(w, (x, i) -> struct(i + 1 AS at, x AS word, get(w, i - 1) AS w1, get(w, i - 2) AS w2, get(w, i - 3) AS w3)))").alias("r"),
    ).select("id", "mixed", "but", "r.*").withColumn("word", F.expr(_bare("word")))
    rows = raw.withColumn("token", F.lower("word"))
    hits = lookup_join(rows, lexicon.select("token", "valence"), ["token"], "inner", spread=["id", "at"], **limits)
    hits = hits.withColumn("loud", F.expr("mixed AND word = upper(word) AND word <> token"))
    for d in BOOST_BY_DISTANCE:
        hits = hits.withColumn(f"p{d}", F.expr(f"lower({_bare(f'w{d}')})"))
    # articles without any word of the lexicon stay in, with a sum of 0
    scored = _with_valence(hits).select("id", "v", F.lit(0.0).alias("marks")).unionByName(
        content.select("id", F.lit(0.0).alias("v"), marks.alias("marks"))
    )
    s = F.col("s") + F.signum("s") * F.col("marks")
    return (
        scored.groupBy("id")
        .agg(F.sum("v").alias("s"), F.max("marks").alias("marks"))
        .select("id", s.alias("s"))
        .select("id", F.round(F.col("s") / F.sqrt(F.col("s") * F.col("s") + ALPHA), 4).alias("sentiment_score"))
        .withColumn("sentiment_label", sentiment_label("sentiment_score"))
    )


def sentiment_counts(content: DataFrame) -> DataFrame:
    return (
        content.where("sentiment_label is not null")
        .groupBy("sentiment_label")
        .agg(F.count(F.lit(1)).alias("articles"))
    )


def sentiment_stats(content: DataFrame) -> DataFrame:
    """One row: mean score, most positive and most negative article (ties: smallest id)."""
    s = F.col("sentiment_score")
    high = F.max_by(F.struct("id", "title", s.alias("score")), F.struct(s, -F.col("id")))
    low = F.min_by(F.struct("id", "title", s.alias("score")), F.struct(s, F.col("id")))
    return content.where(s.isNotNull()).agg(
        F.count_if(F.col("sentiment_label") == "positive").alias("positive"),
        F.count_if(F.col("sentiment_label") == "neutral").alias("neutral"),
        F.count_if(F.col("sentiment_label") == "negative").alias("negative"),
        F.avg(s).alias("average_score"),
        high.alias("most_positive"),
        low.alias("most_negative"),
    )
