"""Threshold-scaled fingerprints (FracMinHash) in DataFrame operations only.

A text's sketch is every hash of its word runs below a fixed fraction of all hashes, so that sketches of
texts of any length can be merged (union) and compared: |A & B| / |A| estimates how much of A lies in B however
long B is. Hashes are the first 16 hexadecimal digits of a run's md5; a fraction of 1/8 keeps those below `2`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.work import SPACE, checked_join, saved, whole_text

WORDS = 5
BELOW = "2"  # of 16 leading digits: an eighth
RANGES, CELL = 256, 1000  # documents are dealt to ranges of ids of about CELL documents


def _with(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def run_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all runs of `words` words; of a shorter text, of all its words."""
    first16 = lambda s: F.substring(F.md5(s), 1, 16)
    return _with(F.regexp_extract_all(text, F.lit(SPACE), F.lit(0)), lambda w: F.when(
        F.size(w) >= words, F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)), lambda i: first16(
            F.concat_ws(" ", *[F.get(w, i + (j - 1)) for j in range(words)])))).when(
        F.size(w) > 0, F.array(first16(F.array_join(w, " ")))).otherwise(F.array().cast("array<string>")))


def sketch_of(hashes: Column, below: str = BELOW) -> Column:
    """The sketch as a sorted array. If no hash is low enough the lowest one stands for the text, so that only a text
    without words has an empty sketch."""
    return _with(hashes, lambda all_: _with(F.sort_array(F.array_distinct(F.filter(all_, lambda h: h < below))), lambda low: F.when(
        (F.size(low) == 0) & (F.size(all_) > 0), F.array(F.array_min(all_))).otherwise(low)))


def merged(sketches: Column) -> Column:
    """Aggregate: the sketch of several texts together."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(sketches))))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's runs that b has; of an empty sketch, 1 if b is empty as well."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise((F.size(b) == 0).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance (Jaccard) of two sketches; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(1.0))


def as_text(sketch: Column) -> Column:
    return F.array_join(sketch, "")


def _bucketed(documents: DataFrame) -> DataFrame:
    """`doc_id, text, bucket, ghost`: ranges of ids, each followed by the first document of the next one.

    Quantiles of the ids give RANGES ranges, each cut into cells of equal width with about CELL documents. The first
    document of every cell is also dealt to the cell before, as a ghost; the very first one to the last cell.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    ids = texts.select("doc_id")
    steps = [i / RANGES for i in range(1, RANGES)]
    row = ids.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
                  F.percentile_approx("doc_id", steps, 10_000).alias("q")).first()
    if row["lo"] is None:
        cell = F.struct(F.lit(-1).alias("r"), F.lit(0).cast("bigint").alias("c"))
    else:
        bounds = sorted({row["lo"], *row["q"]})
        cells = max(1, row["n"] // (RANGES * CELL))
        ends = [*bounds[1:], row["hi"] + 1]
        widths = [max(1, -(-(z - a) // cells)) for a, z in zip(bounds, ends, strict=True)]
        at, width = F.array(*[F.lit(b) for b in bounds]), F.array(*[F.lit(w) for w in widths])
        r = F.size(F.filter(at, lambda b: b <= F.col("doc_id")))
        c = F.floor((F.col("doc_id") - F.element_at(at, r)) / F.element_at(width, r))
        cell = F.when(F.col("doc_id").isNull(), F.struct(F.lit(-1).alias("r"), F.lit(0).cast("bigint").alias("c"))).otherwise(
            F.struct(r.alias("r"), c.cast("bigint").alias("c")))
    # one row a cell: its first id, and the cell before it (before the first comes the last)
    firsts = ids.withColumn("cell", cell).groupBy("cell").agg(F.min("doc_id").alias("first"))
    order = W.orderBy("cell")
    ends = firsts.select("cell", "first", F.lag("cell").over(order).alias("before"),
                         F.max("cell").over(W.partitionBy()).alias("last"))
    starts = saved(ends.select(F.col("cell").alias("_cell"), "first", F.coalesce("before", "last").alias("before"),
                               F.col("before").isNull().alias("wraps")))
    placed = texts.withColumn("cell", cell)
    heads = checked_join(placed, starts, F.col("cell") == F.col("_cell")).where(
        F.col("doc_id").eqNullSafe(F.col("first"))).select(
        "doc_id", "text", F.col("before").alias("cell"), F.when(F.col("wraps"), 2).otherwise(1).alias("ghost"))
    return placed.select("doc_id", "text", "cell", F.lit(0).alias("ghost")).unionByName(heads)


def fingerprints(documents: DataFrame) -> DataFrame:
    """`doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`.

    The edited text: the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document in order of doc_id; after the last comes the first. Null texts are empty. Rows without doc_id come
    first, rows that repeat one follow each other in order of their texts, and a single document is its own next
    one. The texts are shuffled once.
    """
    rows = _bucketed(documents).repartition("cell").withColumn("sketch", sketch_of(run_hashes(F.col("text"))))
    order = W.partitionBy("cell").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    # a cell's ghost follows its documents; a document without one is the last and only document of the table
    with_next = rows.withColumn("next", F.lead(F.struct("text", "sketch")).over(order)).where("ghost = 0")
    following = F.coalesce("next.text", "text")
    edited = with_next.select(
        "doc_id", n.cast("bigint").alias("n_chars"), "sketch", F.coalesce("next.sketch", "sketch").alias("next_sketch"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(following, F.lit(1), cut)).alias("edited"))
    both = edited.withColumn("edited_sketch", sketch_of(run_hashes(F.col("edited"))))
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
