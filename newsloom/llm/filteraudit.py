"""Filter interaction audit: how five document filters overlap, in every order they could be applied.

Method: each document's pass/fail outcome of the five filters is a 5-bit cell. Counts of documents per
(part, cell) — and of those labelled good or toxic — are summed by Spark with map-side partial
aggregation; a part then has at most 32 cells. Inside one task per part the counts are reshaped to a
2x2x2x2x2 tensor and contracted with `numpy.einsum`: along each axis a selector picks `pass`, `fail`
or `all`, which gives kept, removed, redundant and unique counts for every step of all 120 orders.

Filters (a failure removes the document):
    A  under 200 words                      (words: maximal runs of `[^\\x20\\x09-\\x0D]`, case-sensitive)
    B  100 * distinct words < 50 * words
    C  100 * count of `[A-Z]` > 3 * code points
    D  holds any of `# $ % & * |`
    E  identical to the text of any smaller doc_id in the whole table, removed or not

Defined cases: a null text is empty (fails A, passes B C D). A null `lang` is the part "". Rows repeated
with the same doc_id and text are counted each; none of them is "smaller" than another, so all of them
pass E unless a smaller doc_id holds the text. A null doc_id is larger than every id (it fails E when any
row with an id holds its text; null-id rows among themselves count as equal). Labels: a document is good
(toxic) when any of its label rows has quality = 1 (toxic = 1); without a label it is neither, and label rows
without doc_id label nothing (a null id is never equal to another). An empty
table gives no rows. Extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.work import SPACE

# Fixed: filter letters, their order on the tensor's axes, and the thresholds of the contract.
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3
SYMBOLS = r"[#$%&*|]"

ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])

AUDIT_SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def failures(text: Column) -> list[Column]:
    """Fail flags of the filters A to D for a (non-null) text column; all stay inside the JVM."""
    words = F.regexp_extract_all(text, F.lit(SPACE), 0)
    n = F.size(words)
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n,
        100 * upper > MAX_UPPER_PERCENT * F.length(text),
        text.rlike(SYMBOLS),
    ]


def cell_counts(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(part, cell, n, good, toxic): documents per part and 5-bit failure cell (bit 4 - i is filter i)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    a, b, c, d = failures(text)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.sha2(text, 256).alias("digest"),
        (a.cast("int") * 16 + b.cast("int") * 8 + c.cast("int") * 4 + d.cast("int") * 2).alias("cell4"),
    )
    if labels is not None:
        marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
        )
        rows = rows.join(marks, "id", "left")  # the left side is narrow: no text crosses this shuffle
    else:
        rows = rows.withColumn("good", F.lit(None).cast("int")).withColumn("toxic", F.lit(None).cast("int"))
    rows = rows.fillna(0, ["good", "toxic"])
    # One row per (text, id, part, labels): repeated rows collapse, the key spreads a hot text.
    per_id = rows.groupBy("digest", "id", "part", "good", "toxic", "cell4").agg(F.count(F.lit(1)).alias("n"))
    # A hot text now has one row per id; partial aggregation folds them before this shuffle.
    # (is null, id) orders null ids after all others, and equal to each other.
    order_key = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    groups = per_id.groupBy("digest", "part", "good", "toxic", "cell4").agg(
        F.sum("n").alias("n"),
        F.min_by("n", order_key).alias("n_first"),
        F.min(order_key).alias("low"),
    )
    # Few rows per text remain (parts x label pairs), so a window over the digest is small.
    lowest = F.min("low").over(Window.partitionBy("digest"))
    passing = F.when(F.col("low").eqNullSafe(lowest), F.col("n_first")).otherwise(F.lit(0))
    split = groups.select(
        "part", "good", "toxic", "cell4", passing.alias("pass_e"), (F.col("n") - passing).alias("fail_e")
    )
    cells = split.select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("cell4").alias("cell"), F.col("pass_e").alias("n")),
            F.struct((F.col("cell4") + 1).alias("cell"), F.col("fail_e").alias("n")),
        )).alias("c"),
    ).where(F.col("c.n") > 0)
    return cells.groupBy("part", F.col("c.cell").alias("cell")).agg(
        F.sum("c.n").alias("n"),
        F.sum(F.col("c.n") * F.col("good")).alias("good"),
        F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"),
    )


def contract(tensor: np.ndarray, selectors: list[np.ndarray]) -> int:
    """Sum of the 2x2x2x2x2 tensor with one selector per axis."""
    return int(np.einsum("abcde,a,b,c,d,e->", tensor, *selectors))


def audit_part(part: str, cells: pd.DataFrame) -> pd.DataFrame:
    """All 600 rows (120 orders x 5 steps) of one part from its cell counts."""
    tensors = {}
    for name in ("n", "good", "toxic"):
        flat = np.zeros(32, dtype=np.int64)
        np.add.at(flat, cells["cell"].to_numpy(dtype=np.int64), cells[name].to_numpy(dtype=np.int64))
        tensors[name] = flat.reshape(2, 2, 2, 2, 2)
    t = tensors["n"]

    def pick(passing: str, failing: str) -> list[np.ndarray]:
        return [PASS if f in passing else FAIL if f in failing else ALL for f in FILTERS]

    unique = {f: contract(t, pick(FILTERS.replace(f, ""), f)) for f in FILTERS}
    fails = {f: contract(t, pick("", f)) for f in FILTERS}
    removed_at = {}
    for order in ORDERS:
        for k, f in enumerate(order):
            sel = pick(order[:k], f)
            removed_at[order, k] = (contract(t, sel), contract(tensors["good"], sel), contract(tensors["toxic"], sel))
    shapley = {f: sum(removed_at[o, o.index(f)][0] for o in ORDERS) for f in FILTERS}
    out = []
    for order in ORDERS:
        for k, f in enumerate(order):
            removed, good, toxic = removed_at[order, k]
            out.append((part, order, k + 1, contract(t, pick(order[: k + 1], "")), removed,
                        fails[f] - removed, unique[f], good, toxic, shapley[f]))
    return pd.DataFrame(out, columns=[c.split()[0] for c in AUDIT_SCHEMA.split(", ")])


def filter_audit(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per part, order of the five filters and step; see the module text for the columns."""
    cells = cell_counts(docs, labels)

    def per_part(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return audit_part(key[0], pdf)

    return cells.groupBy("part").applyInPandas(per_part, AUDIT_SCHEMA)
