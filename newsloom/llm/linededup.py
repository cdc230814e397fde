"""Removal of repeated lines with levelled sorted runs of line hashes.

A run is a Parquet table sorted by the 128-bit hash of a line's key, with the number of
documents that hold the key and the largest of their ids. A batch of documents makes a run of
level 0; when a level has `fanout` runs they are merged into one run of the next level, so
that after n batches there are about log(n) runs, and a batch is merged at most log(n) times.
Runs are written in the shared folder and never changed.

The two uses: `LineRuns.fresh` merge-anti-joins a batch with all runs (lines never seen before);
`repeated_lines` reads the merged runs once all batches are in.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bytewise as B
from newsloom.llm.work import checked_join, saved, shared_folder

NEWLINE = 10
FOLD = np.arange(256, dtype=np.uint8)  # A-Z as a-z; white space at the ends is cut off before
FOLD[65:91] += 32


def key_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, block: int = 1 << 14) -> list[np.ndarray]:
    """128-bit XXH3 of each key's bytes, A-Z folded, as two int64 arrays: a real hash, so that keys
    that differ do not meet. Keys are taken `block` at a time, so only their bytes are copied at once."""
    out = np.empty((len(begin), 2), dtype="<u8")
    for i in range(0, len(begin), block):
        a, z = begin[i:i + block], end[i:i + block]
        lo = int(a.min()) if len(a) else 0
        folded = FOLD[data[lo:int(z.max()) if len(z) else lo]].tobytes()
        raw = b"".join(xxhash.xxh3_128_digest(folded[x - lo:y - lo]) for x, y in zip(a.tolist(), z.tolist()))
        out[i:i + len(a)] = np.frombuffer(raw, dtype="<u8").reshape(-1, 2)
    return [out[:, 0].view(np.int64).copy(), out[:, 1].view(np.int64).copy()]


class Lines:
    """Lines of a chunk of texts: begin and end in bytes, row, hashes and code points of their keys."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        breaks = np.flatnonzero(data == NEWLINE)
        n = np.diff(np.searchsorted(breaks, at)) + 1  # lines of each row
        self.first = np.concatenate([[0], np.cumsum(n)])
        row = np.repeat(np.arange(len(n)), n)
        begin = np.empty(len(row), np.int64)
        end = np.empty(len(row), np.int64)
        lead = np.zeros(len(row), bool)
        lead[self.first[:-1]] = True
        begin[lead], begin[~lead] = at[:-1], breaks + 1
        last = np.zeros(len(row), bool)
        last[self.first[1:] - 1] = True
        end[last], end[~last] = at[1:], breaks
        self.row, self.begin, self.end = row, begin, end
        solid = np.flatnonzero(~B.IS_SPACE[data])
        a = np.searchsorted(solid, begin)
        z = np.searchsorted(solid, end)
        self.blank = a == z
        some = ~self.blank
        key_begin, key_end = begin.copy(), begin.copy()
        key_begin[some], key_end[some] = solid[a[some]], solid[z[some] - 1] + 1
        points = np.concatenate([[0], np.cumsum(B.IS_START[data])])
        self.points = points[key_end] - points[key_begin]
        self.hashes = key_hashes(data, key_begin, key_end)


LINE_KEYS = "doc_id bigint, h1 bigint, h2 bigint"


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in B.chunks(batch.column("text")):
                lines = Lines(data, at)
                use = np.flatnonzero(lines.points >= min_chars)
                key = np.stack([lines.row[use], *[h[use] for h in lines.hashes]], axis=1)
                order = np.lexsort(key.T[::-1])
                key = key[order]
                key = key[np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])] if len(key) else key
                ids = batch.column("doc_id").slice(first, end - first).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(key[:, 0])), pa.array(key[:, 1]), pa.array(key[:, 2])],
                    names=["doc_id", "h1", "h2"])
    return run


def line_keys(documents: DataFrame, min_chars: int) -> DataFrame:
    """`doc_id, h1, h2`: hashes of a document's keys of at least `min_chars` code points, each once a row."""
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_keys(min_chars), LINE_KEYS)


class LineRuns:
    """Levelled sorted runs `h1, h2, docs, last` of line keys."""

    def __init__(self, spark: SparkSession, *, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.folder}/{level}-{uuid.uuid4().hex}"
        # the grouping deals rows by hash; sorted inside each file, a later merge reads runs in order
        run.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            paths, self.levels[level] = self.levels[level], []
            self._write(self._merged([self._read(p) for p in paths]), level + 1)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("h1 bigint, h2 bigint, docs bigint, last bigint").parquet(path)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("h1", "h2").agg(
            F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def runs(self) -> list[DataFrame]:
        return [self._read(p) for level in self.levels for p in level]

    def add(self, keys: DataFrame) -> None:
        """Adds a batch of `doc_id, h1, h2`. All rows of a document belong to one batch."""
        once = keys.where("doc_id is not null").distinct()
        self._write(once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last")), 0)

    def fresh(self, keys: DataFrame) -> DataFrame:
        """Rows of the batch whose key is in no run."""
        for run in self.runs():
            keys = keys.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        return keys

    def repeated(self, min_docs: int) -> DataFrame:
        """`h1, h2, last` of keys that at least `min_docs` documents hold."""
        runs = self.runs()
        merged = runs[0] if len(runs) == 1 else self._merged(runs)
        return merged.where(F.col("docs") >= min_docs).select("h1", "h2", "last")


KEPT = "kept string, n_lines bigint, n_dropped bigint, kept_sha256 string"


def _strip(columns: list[str]):
    """Drops a document's lines whose key is in `drop` (h1, h2, h1, h2, ...)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            dropping = batch.column("drop")
            for first, end, data, at in B.chunks(batch.column("text")):
                n = end - first
                own = dropping.slice(first, n)
                total = np.diff(np.searchsorted(np.flatnonzero(data == NEWLINE), at)) + 1
                gone = np.zeros(n, np.int64)
                raw = data.tobytes()
                kept = [raw[at[i] : at[i + 1]] for i in range(n)]
                if own.null_count < n:
                    lines = Lines(data, at)
                    for i in np.flatnonzero(~np.asarray(own.is_null())):
                        keys = own[int(i)].values.to_numpy()
                        keys = set(zip(keys[::2].tolist(), keys[1::2].tolist(), strict=True))
                        a, z = lines.first[i], lines.first[i + 1]
                        pairs = zip(lines.hashes[0][a:z].tolist(), lines.hashes[1][a:z].tolist(), strict=True)
                        stay = [j for j, pair in enumerate(pairs, a) if pair not in keys]
                        gone[i] = z - a - len(stay)
                        kept[i] = b"\n".join(raw[lines.begin[j] : lines.end[j]] for j in stay)
                sha = [hashlib.sha256(x).hexdigest() for x in kept]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(names.index(c)).slice(first, n) for c in columns]
                    + [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total), pa.array(gone), pa.array(sha)],
                    names=[*columns, "kept", "n_lines", "n_dropped", "kept_sha256"])
    return run


def repeated_lines(
    documents: DataFrame, *, min_docs: int = 3, min_chars: int = 20, batches: int = 4, keep: list[str] | None = None
) -> DataFrame:
    """Each document with the lines that stay: `keep` columns, `kept, n_lines, n_dropped, kept_sha256`.

    A text is split at newlines (null or empty: one empty line). A line's key is the line without white
    space at its ends, A-Z lower-cased. Keys of at least `min_chars` code points in at least `min_docs`
    documents lose all their lines except in the document with the largest id that holds them. The
    documents go through the runs in `batches` batches dealt by a hash of the id. Rows that repeat a
    doc_id count as one document and are all returned. Rows without doc_id count for no key and keep
    their lines. A document may lose all lines: its text is empty then. `keep` defaults to doc_id.
    """
    keep = keep or ["doc_id"]
    runs = LineRuns(documents.sparkSession)
    keys = saved(line_keys(documents, min_chars))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    for i in range(batches):
        runs.add(keys.where(part == i))
    repeated = saved(runs.repeated(min_docs))
    hits = checked_join(keys.where("doc_id is not null"), repeated, ["h1", "h2"]).where("doc_id <> last")
    drop = saved(hits.groupBy("doc_id").agg(F.flatten(F.collect_set(F.array("h1", "h2"))).alias("drop")))
    joined = checked_join(documents.select(*keep, *({"doc_id", "text"} - set(keep))), drop, "doc_id", "left", 200_000)
    types = dict(documents.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return joined.mapInArrow(_strip(keep), f"{schema}, {KEPT}")
