"""Changes to tables, as joins that give the new rows or the new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.scale import dense_ids, is_small


def first_per_key(batch: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the first in `order`; copies are dropped before the shuffle."""
    rest = [c for c in batch.columns if c not in key]
    if not rest:
        return batch.distinct()
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return batch.groupBy(*key).agg(row).select(*key, *[f"_row.{c}" for c in rest]).select(*batch.columns)


def new_rows(existing: DataFrame, batch: DataFrame, key: list[str], *, small_batch: bool | None = None) -> DataFrame:
    """Rows of `batch` whose key is not in `existing`; `batch` has each key once.

    A batch that passes the size check is sent to the table, so the table itself is
    only filtered; a larger one meets the table in a shuffle join.
    """
    known = existing.select(*key)
    if small_batch is None:
        small_batch = is_small(batch.select(*key))
    if small_batch:
        known = known.join(F.broadcast(batch.select(*key)), key, "left_semi").distinct()
    return batch.join(known, key, "left_anti")


def rows_to_append(
    existing: DataFrame, batch: DataFrame, key: list[str], *, small_batch: bool | None = None
) -> DataFrame:
    """`new_rows` with ids that continue those of `existing`, in the columns of `existing`."""
    fresh = new_rows(existing, batch.drop("id"), key, small_batch=small_batch)
    start = existing.agg(F.coalesce(F.max("id"), F.lit(0)))
    numbered = dense_ids(fresh.withColumn("_key", F.to_json(F.struct(*key))), "_key", start).drop("_key")
    for field in existing.schema:
        if field.name not in numbered.columns:
            numbered = numbered.withColumn(field.name, F.lit(None).cast(field.dataType))
    return numbered.select(*existing.columns)


def append_with_ids(existing: DataFrame, batch: DataFrame, key: list[str], **options) -> DataFrame:
    """Snapshot of `existing` with the new rows of `batch`."""
    return existing.unionByName(rows_to_append(existing, batch, key, **options))


def new_content(content: DataFrame, batch: DataFrame, *, as_of, **options) -> DataFrame:
    """Articles of `batch` whose url is new, with id and `added`; of one url the newest stays."""
    newest = first_per_key(
        batch, ["url"], [F.coalesce(-F.unix_micros("published"), F.lit(2**62)), F.col("title"), F.col("content")]
    )
    stamped = newest.withColumn("added", F.lit(as_of).cast("timestamp")).withColumn(
        "is_duplicate", F.lit(False)
    )
    return rows_to_append(content, stamped, ["url"], **options)


def add_sources(sources: DataFrame, batch: DataFrame) -> DataFrame:
    """Add the sources whose url is new: default name "Unknown", type webpage, 5 requests a minute."""
    defaults = {
        "name": F.lit("Unknown"),
        "source_type": F.lit("webpage"),
        "rate_limit": F.lit(5),
        "access_count": F.lit(0).cast("long"),
        "error_count": F.lit(0).cast("long"),
        "success_rate": F.lit(0.0),
        "adaptive_config_version": F.lit(1),
    }
    filled = batch
    for name, value in defaults.items():
        if name in sources.columns:
            given = F.coalesce(F.col(name), value) if name in batch.columns else value
            filled = filled.withColumn(name, given)
    order = [F.col(c) for c in ("name", "source_type") if c in filled.columns]
    return append_with_ids(sources, first_per_key(filled, ["url"], order or [F.col("url")]), ["url"])


def remove_source(sources: DataFrame, source_id: int, *dependents: DataFrame) -> tuple[DataFrame, ...]:
    """The source goes, and its rows in the dependent tables; articles are kept by the caller."""
    keep = lambda df, c: df.where(~F.col(c).eqNullSafe(F.lit(source_id)))
    return (keep(sources, "id"), *[keep(d, "source_id") for d in dependents])


def upsert_counters(old: DataFrame, delta: DataFrame, key: list[str], *, add: list[str], latest: list[str]) -> DataFrame:
    """Update-or-insert: `add` columns are summed, `latest` columns keep the greater value."""
    joined = old.select(*key, *[F.col(c).alias(f"o_{c}") for c in add + latest]).join(
        delta.select(*key, *[F.col(c).alias(f"d_{c}") for c in add + latest]), key, "full"
    )
    zero = F.lit(0).cast("long")
    return joined.select(
        *key,
        *[(F.coalesce(f"o_{c}", zero) + F.coalesce(f"d_{c}", zero)).alias(c) for c in add],
        *[F.greatest(f"o_{c}", f"d_{c}").alias(c) for c in latest],
    )
