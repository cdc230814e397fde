"""Selector scores, rankings and the table of patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.scale import MAX_BROADCAST_ROWS, is_small

KEY = ["source_id", "selector_type", "selector", "target_element"]

# Fixed values of the score: score = 0.8 * (successes / trials) + 0.2 * previous score.
ALPHA = 0.8
FIRST_SUCCESS = 0.7
FIRST_FAILURE = 0.3
LEARNED_SCORE = 0.5
# Fixed message formats.
RETRAINED = "Retrained source '%s'. New selectors will be learned during the next update."

# A trial weighs 0.2 times as much with every later one; after 512 of them its weight is
# below the smallest double, so the last 512 trials and the totals decide the score exactly.
TAIL = 512


def selector_scores(trials: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """`KEY, success_count, fail_count, last_used, score` from the log of trials.

    Trials are folded in time order. `seed` (KEY, score) holds patterns that already
    have a score but no trials, such as learned ones. However many trials a selector
    has, a task sees only its last `TAIL`: the group limit is applied before the shuffle.
    """
    totals = trials.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("success").alias("success_count"),
        F.max("ts").alias("last_used"),
    )
    newest = W.partitionBy(*KEY).orderBy(F.desc("ts"), F.asc("success"))
    tail = (
        trials.select(*KEY, "ts", "success")
        .withColumn("back", F.row_number().over(newest))
        .where(F.col("back") <= TAIL)
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), F.col("success").alias("ok")))).alias("tail"))
    )
    folded = totals.join(tail, KEY)
    if seed is not None:
        folded = folded.join(seed.select(*KEY, F.col("score").alias("seed")), KEY, "left")
    else:
        folded = folded.withColumn("seed", F.lit(None).cast("double"))
    in_tail = F.size(F.filter("tail", lambda t: t["ok"]))
    state = F.struct(
        (F.col("n") - F.size("tail")).alias("k"),
        (F.col("success_count") - in_tail).cast("long").alias("good"),
        # beyond the tail the previous score no longer matters, any value will do
        F.coalesce("seed", F.when(F.col("n") > F.size("tail"), F.lit(0.0))).alias("score"),
    )

    def step(s, t):
        k = s["k"] + 1
        good = s["good"] + t["ok"].cast("long")
        first = F.when(t["ok"], F.lit(FIRST_SUCCESS)).otherwise(F.lit(FIRST_FAILURE))
        smoothed = F.lit(ALPHA) * (good / k) + F.lit(1 - ALPHA) * s["score"]
        return F.struct(
            k.alias("k"), good.alias("good"),
            F.when(s["score"].isNull(), first).otherwise(smoothed).alias("score"),
        )

    return folded.select(
        *KEY,
        "success_count",
        (F.col("n") - F.col("success_count")).alias("fail_count"),
        "last_used",
        F.aggregate("tail", state, step, lambda s: s["score"]).alias("score"),
    )


def selector_ranking(
    patterns: DataFrame, *, limit: int | None = None, max_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Patterns with their `rank` in source and target, best score first, ties by id.

    With `limit` the groups are cut before the shuffle. A table of more than `max_rows`
    patterns is ranked in pieces, so that a source with very many of them is not one task.
    """
    order = W.partitionBy("source_id", "target_element").orderBy(F.desc("score"), "id")
    if limit is not None:
        return patterns.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    if is_small(patterns.select("id"), max_rows):
        return patterns.withColumn("rank", F.row_number().over(order))
    return _ranking_in_pieces(patterns)


def _ranking_in_pieces(patterns: DataFrame) -> DataFrame:
    """Rank = patterns in better bands + in better pieces of the band + place in the piece.

    Bands are thousandths of the score; a piece is one score and a run of 65,536 ids.
    """
    group, piece = ["source_id", "target_element"], ["_band", "_score", "_chunk"]
    score = F.coalesce("score", F.lit(-1.0))  # without a score: last
    rows = patterns.withColumn("_score", score).withColumn("_band", F.floor(-score * 1000)).withColumn(
        "_chunk", F.floor(F.col("id") / 65536)
    )
    sizes = rows.groupBy(*group, *piece).agg(F.count(F.lit(1)).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    in_band = W.partitionBy(*group, "_band").orderBy(F.desc("_score"), "_chunk")
    pieces = sizes.select(*group, *piece, before(in_band).alias("_in_band"))
    bands = sizes.groupBy(*group, "_band").agg(F.sum("n").alias("n")).select(
        *group, "_band", before(W.partitionBy(*group).orderBy("_band")).alias("_in_group")
    )

    def same(left, right, columns):
        right = right.withColumnsRenamed({c: f"r_{c}" for c in columns})
        test = reduce(lambda x, y: x & y, [left[c].eqNullSafe(right[f"r_{c}"]) for c in columns])
        return left.join(right, test).drop(*[f"r_{c}" for c in columns])

    place = F.row_number().over(W.partitionBy(*group, *piece).orderBy("id"))
    placed = same(rows.withColumn("_place", place), same(pieces, bands, [*group, "_band"]), [*group, *piece])
    rank = (F.col("_in_group") + F.col("_in_band") + F.col("_place")).cast("int")
    return placed.select(*patterns.columns, rank.alias("rank"))


def save_new_selectors(patterns: DataFrame, found: DataFrame, *, as_of) -> DataFrame:
    """Add discovered selectors as learned patterns with score 0.5; known ones stay as they are."""
    from newsloom.operators.tables import append_with_ids

    fresh = found.select(*KEY).distinct().select(
        *KEY,
        F.lit(0).cast("long").alias("success_count"),
        F.lit(0).cast("long").alias("fail_count"),
        F.lit(as_of).cast("timestamp").alias("last_used"),
        F.lit(LEARNED_SCORE).alias("score"),
        F.lit(True).alias("is_learned"),
    )
    return append_with_ids(patterns, fresh, KEY)


def retrain_source(sources: DataFrame, patterns: DataFrame, source_id: int):
    """`(sources, patterns, result)`: learned patterns of the source dropped, version one up.

    `result` is one row (status, message); an unknown source leaves both tables as they are.
    """
    is_it = F.col("id") == source_id
    version = F.col("adaptive_config_version")
    new_sources = sources.withColumn("adaptive_config_version", F.when(is_it, version + 1).otherwise(version))
    known = sources.where(is_it).agg(F.max("name")).scalar()
    dropped = (F.col("source_id") == source_id) & F.col("is_learned")
    new_patterns = patterns.where(~F.coalesce(dropped, F.lit(False)) | F.isnull(known))
    result = sources.where(is_it).agg(F.max("name").alias("name")).select(
        F.when(F.col("name").isNull(), "error").otherwise("success").alias("status"),
        F.when(F.col("name").isNull(), F.lit(f"Source ID {source_id} not found"))
        .otherwise(F.format_string(RETRAINED, "name"))
        .alias("message"),
    )
    return new_sources, new_patterns, result
