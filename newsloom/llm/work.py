"""Shared steps: results written to the shared folder, joins behind a size check, document keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000  # narrow rows (some 100 bytes at most), so 50 MB
SPACE = r"[^\x20\x09-\x0D]+"  # fixed: what a word is
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. Unset and local (tests): a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="newsloom-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back; survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when `df` has at most `max_rows` rows; reads one row beyond at most."""
    return df.limit(max_rows + 1).count() <= max_rows


def checked_join(big: DataFrame, few: DataFrame, on, how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a saved frame of narrow rows: sent to all tasks when it has few rows, shuffled otherwise."""
    return big.join(F.broadcast(few) if is_small(few, max_rows) else few, on, how)


def whole_text(column: str = "text") -> Column:
    """Null texts are empty ones."""
    return F.coalesce(F.col(column), F.lit(""))


def crc_part(n: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, mod n."""
    return F.crc32(F.col(key).cast("string")) % n


def at_least_tasks(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores is dealt to all of them; larger ones stay as they are read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if len(df.inputFiles()) < n and df.rdd.getNumPartitions() < n else df
