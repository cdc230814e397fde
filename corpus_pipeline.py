"""A corpus from raw documents: language, repeated lines, near-duplicates, benchmark leaks, mixture.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept and returns a DataFrame;
all but the last return the columns of `documents`. Null and empty texts, repeated rows and empty tables
are handled as the operators' docstrings say; further columns of `documents` pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.decontaminate import leaks
from newsloom.llm.langid import UNKNOWN, predict, train
from newsloom.llm.linededup import repeated_lines
from newsloom.llm.mixing import mixture
from newsloom.llm.neardup import near_duplicates
from newsloom.llm.work import checked_join, crc_part, saved, shared_folder

MIN_LANGUAGE_SCORE = 0.3  # a guess among the languages of `documents` would have 0.25


def _set_apart(docs: DataFrame) -> DataFrame:
    """All columns but doc_id and text under names that no operator uses."""
    return docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"_column_{i}") for i, c in _others(docs)])


def _back(docs: DataFrame, *put: tuple[str, Column]) -> list[Column]:
    """The columns of `docs` again, those named in `put` with new values."""
    new = dict(put)
    names = {c: f"_column_{i}" for i, c in _others(docs)}
    return [new.get(c, F.col(names.get(c, c))).alias(c) for c in docs.columns]


def _others(docs: DataFrame) -> list[tuple[int, str]]:
    return [(i, c) for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without letters, or that no language fits, go."""
    model = train(docs.where(crc_part(5) != 0))
    rows = _set_apart(docs)
    judged = predict(rows, model, rows.columns)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*_back(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines, n_chars to match. A document that loses every line stays, empty."""
    rows = _set_apart(docs)
    kept = repeated_lines(rows, keep=[c for c in rows.columns if c != "text"])
    put = [("text", F.col("kept"))]
    if "n_chars" in docs.columns:
        put.append(("n_chars", F.char_length("kept").cast(dict(docs.dtypes)["n_chars"])))
    return kept.select(*_back(docs, *put))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    gone = saved(near_duplicates(docs).where("not kept").select("doc_id").distinct())
    return checked_join(docs, gone, "doc_id", "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = saved(found.select(F.col("doc_id").alias("_leak")).distinct())
    return checked_join(docs, bad, F.col("doc_id").eqNullSafe(F.col("_leak")), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them, with `copy`."""
    return mixture(docs)


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("decontaminate", decontaminate), ("mix", mix),
]
ORACLE_SQL = None  # a trained model decides in the first stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    name, stage = STAGES[-1]
    stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")
