"""Similarity groups: connected components of the pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.scale import MIN_HOT_ROWS, cut_lineage, salted_join


def _to_smallest(pairs: DataFrame, salted: bool, **skew) -> DataFrame:
    """Adds `m` to every `(u, v)`: the smallest of u and its neighbours."""
    best = pairs.groupBy("u").agg(
        F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")
    )
    if not salted:
        return pairs.join(best.select("u", "m"), "u")
    return salted_join(
        pairs, best.select("u", "m"), ["u"], spread=["v"], counts=best.select("u", "n"), **skew
    )


def _large_star(edges: DataFrame, salted: bool, **skew) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _to_smallest(both, salted, **skew).where("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, salted: bool, **skew) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _to_smallest(down, salted, **skew)
    moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    selves = linked.select("u", F.col("m").alias("v"))
    return moved.unionByName(selves).where("u <> v").distinct()


def connected_components(
    pairs: DataFrame, *, max_rounds: int = 60, min_rows: int = MIN_HOT_ROWS, **skew
) -> DataFrame:
    """`id, group` for every id in `pairs (id_a, id_b)`; the group is its smallest id.

    Alternating stars (Kiveris et al. 2014): the number of rounds grows with the
    logarithm of the component size, and no step gathers a neighbourhood in one task.
    The edges of each round are written down; only a count and a checksum come to the
    driver. Vertices are salted once there are enough edges for one to be hot.
    """
    edges = cut_lineage(
        pairs.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")).where("u <> v").distinct()
    )
    mark = None
    for _ in range(max_rounds):
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("sum")).first()
        if seen == mark:
            break
        mark = seen
        salted = 2 * seen["n"] > min_rows
        large = _large_star(edges, salted, min_rows=min_rows, **skew)
        if salted:
            large = cut_lineage(large)  # counted and joined below
        edges = cut_lineage(_small_star(large, salted, min_rows=min_rows, **skew))
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("group"))
    heads = edges.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct()
    return members.unionByName(heads)


def similarity_labels(pairs: DataFrame, reps: DataFrame, **skew) -> DataFrame:
    """`id, similarity_group` of all articles in a group of at least two."""
    labels = connected_components(pairs, **skew).select(F.col("id").alias("rep_id"), "group")
    counts = reps.where("copies > 1 and id = rep_id").select("rep_id", F.col("copies").alias("n"))
    joined = salted_join(reps, labels, ["rep_id"], "left", spread=["id"], counts=counts, **skew)
    alone = F.when(F.col("copies") > 1, F.col("rep_id"))
    return joined.select("id", F.coalesce("group", alone).alias("similarity_group")).where(
        "similarity_group is not null"
    )


def group_table(labels: DataFrame, content: DataFrame, *, as_of, keep_newest: bool = True) -> DataFrame:
    """`id, created, updated, main_article_id, article_count`, one row per group.

    The main article is the newest (or oldest) member, ties by id.
    """
    pick = F.max if keep_newest else F.min
    stamp = F.lit(as_of).cast("timestamp")
    return (
        labels.join(content.select("id", "published"), "id")
        .groupBy(F.col("similarity_group"))
        .agg(pick(F.struct("published", "id")).alias("main"), F.count(F.lit(1)).alias("article_count"))
        .select(
            F.col("similarity_group").alias("id"),
            stamp.alias("created"),
            stamp.alias("updated"),
            F.col("main.id").alias("main_article_id"),
            "article_count",
        )
    )
