"""Joins that keep working when one key holds a large share of the rows.

A dimension whose row count has been checked is broadcast. Everything else goes
through `salted_join`, which spreads the rows of hot keys over several tasks.
The list of hot keys is itself broadcast: a key is hot when it holds more than
1/`slots` of all rows, so there can never be more than `slots` of them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOTS = 1000  # a hot key is one with more than 1/SLOTS of the rows
MIN_HOT_ROWS = 100_000  # below this a key fits in one task whatever its share
MAX_BROADCAST_ROWS = 100_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True when `df` has at most `max_rows` rows; reads no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def hot_keys(counts: DataFrame, slots: int = SLOTS, min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Keys with more than 1/`slots` of the rows and the number of salts each one gets.

    `counts` has the key columns and `n`, the rows per key.
    """
    total = counts.agg(F.sum("n")).scalar()
    return (
        counts.where((F.col("n") > min_rows) & (F.col("n") * slots > total))
        .withColumn("_salts", F.ceil(F.col("n") * slots / total).cast("int"))
        .drop("n")
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    *,
    spread: list[str],
    counts: DataFrame | None = None,
    hot_on: list[str] | None = None,
    slots: int = SLOTS,
    min_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Equi join in which the left rows of a hot key are split over many tasks.

    `spread` names left columns that tell the rows of one key apart. `hot_on` are the
    key columns in which heat is measured (all of `on` by default), `counts`
    (`hot_on` + `n`) saves the counting pass when the caller already has it. `how` is
    any join type that keeps left rows or matches (inner, left, left_semi, left_anti).
    The hot keys, at most `slots` of them, are looked up first; without any this is a
    plain join.
    """
    hot_on = hot_on or on
    if counts is None:
        counts = left.groupBy(*hot_on).agg(F.count(F.lit(1)).alias("n"))
    found = hot_keys(counts.select(*hot_on, "n"), slots, min_rows)
    rows = found.collect()  # fewer than `slots`, see above
    if not rows:
        return left.join(right, on, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(rows, found.schema))
    bits = F.xxhash64(*[F.col(c) for c in spread])
    no_key = F.lit(False)
    for c in on:
        no_key = no_key | F.col(c).isNull()
    # rows without a key match nothing, but a left join keeps them: spread them as well
    salt = (
        F.when(no_key, F.pmod(bits, F.lit(slots)))
        .when(F.col("_salts").isNotNull(), F.pmod(bits, F.col("_salts")))
        .otherwise(F.lit(0))
    )
    l = left.join(hot, hot_on, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    r = (
        right.join(hot, hot_on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    return l.join(r, [*on, "_salt"], how).drop("_salt")


def lookup_join(
    left: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "left",
    *,
    spread: list[str],
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join with a dimension: broadcast after a size check, salted beyond it."""
    if is_small(dim, max_rows):
        return left.join(F.broadcast(dim), on, how)
    return salted_join(left, dim, on, how, spread=spread)


def few_join(few: DataFrame, big: DataFrame, on: str) -> DataFrame:
    """Left join of a frame known to be a few rows long (a top-n, one row) with a table
    whose `on` is unique. The table is first reduced to the rows that are asked for."""
    asked = F.broadcast(few.select(on).distinct())
    return few.join(F.broadcast(big.join(asked, on, "left_semi")), on, "left")


def split_repeated(rows: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame | None]:
    """Rows whose `key` stands in one row only, and the others (None when there are none).

    Only the keys are counted; null is a key like any other. The lone rows can be handled where
    they are, without a shuffle."""
    again = cut_lineage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_key")))
    if again.isEmpty():
        return rows, None
    same = rows[key].eqNullSafe(again["_key"])
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def shared_folder(spark) -> str:
    """The folder that `spark.checkpoint.dir` names; only in local mode, when unset, a new one."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="newsloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def shuffles_deleted(spark) -> Iterator[None]:
    """What a query inside shuffles is deleted when the query ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once, under the folder that `spark.checkpoint.dir` names, and read it back.

    For results that several later steps read. The files survive lost executors. What was shuffled for `df` is
    deleted as soon as it is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    with shuffles_deleted(spark):
        # a plan of its own: a plan that runs again would look for its deleted shuffle files
        df.select("*").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dense_ids(rows: DataFrame, key: str, start: int | DataFrame = 0) -> DataFrame:
    """Add `id`: consecutive numbers from `start` + 1, decided by the unique column `key` alone.

    Rows fall into 4096 buckets by the md5 of the key and are numbered inside
    their bucket; only the 4096 bucket sizes are put in one sequence. `start` may
    be a one-row frame, read as a scalar subquery.
    """
    base = start.scalar() if isinstance(start, DataFrame) else F.lit(start)
    # 4096 buckets: the first three hexadecimal digits of the md5
    tagged = rows.withColumn("_bucket", F.substring(F.md5(F.col(key)), 1, 3))
    sizes = tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select(
        "_bucket",
        (
            F.sum("_size").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
        ).alias("_before"),
    )
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(key))
    return (
        tagged.join(F.broadcast(before), "_bucket")
        .withColumn("id", base + F.coalesce("_before", F.lit(0)) + inside)
        .drop("_bucket", "_before")
    )
