"""Text expressions: words, sentences, fingerprints, quality rules, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the quality rules.
PLACEHOLDER_WORDS = r"(?U)\b(lorem|ipsum|dolor)\b"
TAG = r"<[^>]+>"
PUNCTUATION = r"[!-/:-@\[-`{-~]"  # the ASCII punctuation characters
TITLE_SCORES = {"empty": 0.0, "length": 0.5, "lower_case": 0.6, "placeholder": 0.1, "good": 0.9}
CONTENT_SCORES = {
    "empty": 0.0,
    "short": 0.3,
    "one_paragraph": 0.7,
    "placeholder": 0.1,
    "markup": 0.4,
    "sentence_length": 0.6,
    "good": 0.85,
}
OTHER_SCORE = 0.7


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Runs of non-blank characters."""
    return F.filter(F.split(col(text), r"(?U)\s+"), lambda w: w != "")


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def sql_list(values: list[str]) -> str:
    """Quoted SQL literals; long word lists go to Spark as one text."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def content_tokens_sql(text: str, stop_words: list[str], min_chars: int = 1) -> str:
    known = f"AND w NOT IN ({sql_list(stop_words)})" if stop_words else ""
    return rf"filter(split(lower(coalesce({text}, '')), r'[^\p{{L}}\p{{N}}_]+'), w -> length(w) >= {max(min_chars, 1)} {known})"


def content_tokens(text: str, stop_words: list[str], min_chars: int = 1) -> Column:
    """Tokens of a column without stop words and without tokens shorter than `min_chars`."""
    return F.expr(content_tokens_sql(text, stop_words, min_chars))


def sentences(text: Column | str) -> Column:
    """Split after `.`, `!` or `?` followed by white space; the marks stay with the sentence."""
    marked = F.regexp_replace(F.trim(col(text)), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


def content_hash(text: Column | str) -> Column:
    """Fingerprint that ignores case and the amount of white space."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(col(text), r"\s+", " "))), 256)


def preview(text: Column | str, chars: int = 200) -> Column:
    return F.translate(F.substring(col(text), 1, chars), "\n", " ")


def clip_html(html: Column | str, chars: int = 50_000) -> Column:
    return F.substring(col(html), 1, chars)


def strip(text: Column | str) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def join_texts(parts: Column | str) -> Column:
    """Strip every piece and put the pieces on lines of their own."""
    return F.array_join(F.transform(col(parts), strip), "\n")


def comma_list(text: Column | str) -> Column:
    """`"a,b"` to `["a", "b"]`; null and empty give null (no filter)."""
    return F.when(col(text) != "", F.split(col(text), ","))


def format_ts(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")


def percent(rate: Column | str) -> Column:
    return F.round(F.coalesce(col(rate), F.lit(0.0)) * 100, 1)


def health_label(rate: Column | str) -> Column:
    """Above 0.8 good, above 0.5 fair, otherwise (also without a rate) poor."""
    r = F.coalesce(col(rate), F.lit(0.0))
    return F.when(r > 0.8, "good").when(r > 0.5, "fair").otherwise("poor")


def sentiment_label(score: Column | str) -> Column:
    """Cut-offs at +0.05 and -0.05, as published with the lexicon method."""
    s = col(score)
    return F.when(s >= 0.05, "positive").when(s <= -0.05, "negative").when(s.isNotNull(), "neutral")


def _is_blank(t: Column) -> Column:
    return t.isNull() | (t == "")


def title_quality(text: Column | str) -> Column:
    t = col(text)
    n = F.size(words(t))
    score = {k: F.lit(v) for k, v in TITLE_SCORES.items()}
    return (
        F.when(_is_blank(t), score["empty"])
        .when((n < 3) | (n > 30), score["length"])
        .when((t == F.lower(t)) & (t != F.upper(t)), score["lower_case"])
        .when(F.lower(t).rlike(PLACEHOLDER_WORDS), score["placeholder"])
        .otherwise(score["good"])
    )


def content_quality(text: Column | str) -> Column:
    """Rules in a fixed order; the first that applies decides."""
    t = col(text)
    n = F.size(words(t))
    per_sentence = F.try_divide(n, F.size(sentences(t)))  # sentences partition the words
    score = {k: F.lit(v) for k, v in CONTENT_SCORES.items()}
    return (
        F.when(_is_blank(t), score["empty"])
        .when(n < 20, score["short"])
        .when(~F.contains(t, F.lit("\n\n")), score["one_paragraph"])
        .when(F.lower(t).rlike(PLACEHOLDER_WORDS), score["placeholder"])
        .when(F.try_divide(F.regexp_count(t, F.lit(TAG)), F.length(t)) > 0.1, score["markup"])
        .when((per_sentence < 3) | (per_sentence > 40), score["sentence_length"])
        .otherwise(score["good"])
    )


def element_quality(element: Column | str, text: Column | str) -> Column:
    """Quality of a text by the page element it came from."""
    e = col(element)
    return (
        F.when(_is_blank(col(text)), F.lit(0.0))
        .when(e == "title", title_quality(text))
        .when(e == "content", content_quality(text))
        .otherwise(F.lit(OTHER_SCORE))
    )


def article_quality(title_q: Column | str, content_q: Column | str) -> Column:
    return F.least(col(title_q), col(content_q))


FEATURES = ["chars", "words", "lines", "upper_ratio", "punct_ratio", "distinct_ratio"]


def quality_features(text: Column | str) -> list[Column]:
    """Six numbers about a text, in the order of `FEATURES`."""
    t = col(text)
    w = words(t)
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    return [
        F.length(t).cast("double").alias("chars"),
        F.size(w).cast("double").alias("words"),
        F.size(F.split(t, "\n")).cast("double").alias("lines"),
        share(F.regexp_count(t, F.lit(r"\p{Lu}")), F.length(t)).alias("upper_ratio"),
        share(F.regexp_count(t, F.lit(PUNCTUATION)), F.length(t)).alias("punct_ratio"),
        share(F.size(F.array_distinct(w)), F.size(w)).alias("distinct_ratio"),
    ]
