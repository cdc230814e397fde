"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets a rate between 0 and `most`: among all rates that give each source its target of
words, those closest (in relative entropy) to taking everything once. They are
`min(most, exp(l * size / scale))` with one multiplier `l` per source, the solution of a convex dual that
Newton steps solve for all sources at once. Rates depend on source and size only, so every step runs over
the counts by source and size. Sums are decimal, hence the same in any order, and reruns agree.

Rates become copies by going through a source in order of size and rounding the running sum of the rates:
the words of a source differ from its target by less than its longest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.work import SPACE, checked_join, saved, whole_text

TOLERANCE = 1e-9  # of the target
MAX_STEPS = 100  # bisection alone needs about 60


def word_count(column: str = "text") -> Column:
    return F.regexp_count(whole_text(column), F.lit(SPACE)).cast("bigint")


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """`source, source_size, target` from `source, source_size`, one row per source.

    Sources by code point, null last, weigh `weights`, repeating; they share `share` times all sizes. A target
    stops at `most` times its source's size and the excess is shared by weight again: filled in order of size
    by weight, all others get the same level. One row per source goes through one task.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    fill = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    everywhere = W.partitionBy()
    return (
        sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", (total - before) / left)
        .withColumn("full", F.col("ratio") <= F.col("level"))
        .withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(everywhere))
        .select("source", "source_size",
                F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("level")).alias("target"))
    )


def _rate(most: float) -> Column:
    """The tilted rate; a source whose target is all it can give has rate `most` throughout."""
    tilt = F.exp(F.least(F.col("l") * F.col("size") / F.col("scale"), F.lit(700.0)))
    return F.when(F.col("all"), F.lit(most)).otherwise(F.least(F.lit(most), tilt))


def _exact(x: Column) -> Column:
    return F.sum(x.cast("decimal(38,9)"))


def _solved(hist: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """`source, source_size, target, scale, all, l`: the multipliers, by safeguarded Newton steps."""
    size, n = F.col("size").cast("double"), F.col("n")
    scales = hist.where("size > 0").groupBy("source").agg(
        (_exact(n * size * size).cast("double") / _exact(n * size).cast("double")).alias("scale"),
        F.min("size").alias("least"))
    t, s = F.col("target"), F.col("source_size")
    tightest = F.col("scale") / F.col("least")  # 1 / smallest exponent factor
    state = saved(
        targets.join(scales, targets["source"].eqNullSafe(scales["source"]), "left").drop(scales["source"])
        .withColumn("all", t >= s * most)
        .withColumn("low", F.when(t >= s, F.lit(0.0)).otherwise(F.ln(t / s) * tightest))
        .withColumn("high", F.when(t >= s, F.log(F.lit(most)) * tightest).otherwise(F.lit(0.0)))
        .withColumn("l", F.lit(0.0)).withColumn("done", F.col("all") | F.col("scale").isNull() | (t == s)))
    tilt = F.exp(F.least(F.col("l") * size / F.col("scale"), F.lit(700.0)))
    inside = tilt < most
    for _ in range(MAX_STEPS):
        open_ = state.where("not done").select("source", "l", "scale")
        if open_.isEmpty():
            break
        at = checked_join(hist.where("size > 0"), open_.withColumnRenamed("source", "key"), F.col("source").eqNullSafe(F.col("key")))
        sums = at.groupBy("key").agg(
            _exact(n * size * F.least(F.lit(most), tilt)).cast("double").alias("f"),
            _exact(F.when(inside, n * size * size / F.col("scale") * tilt).otherwise(0.0)).cast("double").alias("slope"))
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("key")), "left").drop("key")
        step = F.col("l") - (F.col("f") - t) / F.col("slope")
        moved = (
            joined.withColumn("low", F.when(F.col("f") < t, F.col("l")).otherwise(F.col("low")))
            .withColumn("high", F.when(F.col("f") >= t, F.col("l")).otherwise(F.col("high")))
            .withColumn("hit", F.coalesce(F.abs(F.col("f") - t) <= t * TOLERANCE, F.lit(False)))
            .withColumn("next", F.when((F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high")), step)
                        .otherwise((F.col("low") + F.col("high")) / 2)))
        settled = F.col("done") | F.col("hit") | (F.col("next") == F.col("l"))
        state = saved(moved.withColumn("done", settled).withColumn("l", F.when(F.col("done"), F.col("l")).otherwise(F.col("next")))
                      .select(*state.columns))
    return state.select("source", "source_size", "target", "scale", "all", "l")


def mixed(documents: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """`doc_id, source, size, source_size, target, rate, copies, taken`, one row for each row of `documents`.

    `size` is the number of words (ASCII white space between; null: 0). `taken` is `copies * size`, with
    `copies` from 0 to `most`. Null sources are one source, the last. Documents without words have rate 1
    unless their source is taken whole. Documents of one source and size are told apart by the md5 of their
    doc_id; rows that repeat a doc_id are rounded one after the other. An empty table gives no rows.
    """
    name = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    base = saved(
        documents.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"),
                         F.substring(name, 1, 2).alias("bucket")))
    hist = saved(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    solved = _solved(hist, source_targets(sizes, weights=weights, share=share, most=most), most).withColumnRenamed("source", "key")
    rates = checked_join(hist, solved, F.col("source").eqNullSafe(F.col("key")))
    # at most sqrt(2 * words) different sizes in a source
    upto = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    rates = rates.withColumn("rate", F.when(F.col("scale").isNotNull(), _rate(most)).otherwise(F.lit(1.0))).withColumn(
        "start", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(upto), F.lit(0.0)))
    rates = rates.select("source", "size", "source_size", "target", "rate", "start")
    # a source and size may hold a third of all documents: 256 buckets, numbered one after the other
    parts = base.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("m"))
    inside = W.partitionBy("source", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("m").over(inside), F.lit(0))).drop("m")
    known = rates.alias("r").join(
        parts.alias("p"), (F.col("r.size") == F.col("p.size")) & F.col("r.source").eqNullSafe(F.col("p.source"))
    ).select(F.col("p.source").alias("k_source"), F.col("p.size").alias("k_size"), F.col("bucket").alias("k_bucket"),
             "source_size", "target", "rate", "start", "before")
    rows = base.join(
        known, F.col("source").eqNullSafe(F.col("k_source")) & (F.col("size") == F.col("k_size"))
        & (F.col("bucket") == F.col("k_bucket")))
    place = F.row_number().over(W.partitionBy("source", "size", "bucket").orderBy(name, "doc_id")) + F.col("before")
    up = lambda j: F.floor(F.col("start") + j * F.col("rate") + 0.5)
    copies = F.greatest(F.floor("rate"), F.least(F.ceil("rate"), up(place) - up(place - 1)))
    return rows.withColumn("copies", copies.cast("int")).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def mixture(documents: DataFrame, **settings) -> DataFrame:
    """The mix itself: rows of `documents` as often as they are taken, with `copy` (or the first free name of
    copy_1, copy_2, ...) counting from 1.

    Settings as in `mixed`. Rows are found again by doc_id, source and text size; of rows that are equal in
    these each is taken as often as the first of them.
    """
    taken = saved(mixed(documents, **settings).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")))
    keys = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies"))
    rows = documents.withColumn("_words", word_count())
    same = (F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
            & (F.col("_words") == F.col("_size")))
    names = ["copy", *(f"copy_{i}" for i in range(1, len(documents.columns) + 1))]
    free = next(n for n in names if n not in documents.columns)
    return rows.join(keys, same).select(
        *[F.col(c) for c in documents.columns], F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias(free))
