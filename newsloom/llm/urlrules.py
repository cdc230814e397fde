"""Allow and block rules for urls in a memory-mapped sorted array of digests.

A rule is a host and a path prefix, written `host/path`. The rules' 64-bit xxhash keys form a sorted array,
which every Python worker maps into memory once; the strings lie in the order of the keys. For a url, the
strings a fitting rule could have (its host and the hosts above it, with as much of the path as there are
rule lengths) are hashed and looked up by one vectorised binary search a batch; a hit is confirmed on the
stored string, so that a collision of keys decides nothing.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.work import LOWER

BLOCK = 1_000_000  # rules of one array: 8 MB of keys and their strings; more rules are more arrays
_mapped: dict[str, np.ndarray] = {}


@dataclass
class Digests:
    """A sorted array of rule keys as bytes, their strings, verdicts and the lengths of rule paths."""

    name: str
    keys: bytes
    strings: list[str] = field(repr=False, default_factory=list)
    allow: list[bool] = field(repr=False, default_factory=list)
    path_lengths: list[int] = field(default_factory=list)

    def mapped(self) -> np.ndarray:
        """The keys, mapped from a file without a name: it goes with the process."""
        if self.name not in _mapped:
            if not self.keys:
                return np.zeros(0, np.uint64)
            with tempfile.NamedTemporaryFile() as f:
                f.write(self.keys)
                f.flush()
                _mapped[self.name] = np.memmap(f.name, np.uint64, "r")
        return _mapped[self.name]


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def digests(rules: list[tuple[str, bool]]) -> Digests:
    """The array of `(host/path, allow)`. Of a rule given twice with both verdicts, block wins."""
    merged: dict[str, bool] = {}
    for text, allow in rules:
        host, slash, path = text.partition("/")
        text = host.translate(str.maketrans(*LOWER)) + slash + path
        merged[text] = merged.get(text, True) and allow
    order = sorted(merged, key=lambda t: (digest(t), t))
    keys = np.array([digest(t) for t in order], np.uint64).tobytes()
    lengths = sorted({len(t) - len(t.partition("/")[0]) for t in order})
    return Digests(xxhash.xxh64_hexdigest(keys + "\n".join(order).encode("utf-8", "surrogatepass")) + f"-{os.getpid()}",
                   keys, order, [merged[t] for t in order], lengths)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) behind the first `://`, and the path up to `?` or `#`; without `://` both empty."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return rest[:end].translate(str.maketrans(*LOWER)), path[:stop]


def _looked_up(found: list[tuple[str, str]], table: Digests) -> list[tuple[str, bool] | None]:
    """The longest fitting rule of each (host, path); at equal length the one with the longer host."""
    keys = table.mapped()
    owner, candidates = [], []
    for i, (host, path) in enumerate(found):
        if not host:
            continue
        above = [host]
        while "." in above[-1]:
            above.append(above[-1].partition(".")[2])
        for h in above:
            for n in table.path_lengths:
                if n <= len(path):
                    owner.append(i)
                    candidates.append(h + path[:n])
    best: list[tuple[str, bool] | None] = [None] * len(found)
    if not candidates or not len(keys):
        return best
    probe = np.fromiter((digest(c) for c in candidates), np.uint64, len(candidates))
    low, high = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
    rank = lambda t: (len(t), len(t.partition("/")[0]))
    for j in np.flatnonzero(high > low):
        for k in range(low[j], high[j]):  # more than one: a collision
            if table.strings[k] == candidates[j]:
                old = best[owner[j]]
                if old is None or rank(table.strings[k]) > rank(old[0]):
                    best[owner[j]] = (table.strings[k], table.allow[k])
    return best


OUT = "host string, path string, rule string, verdict string"


def judge(urls: DataFrame, rules: list[tuple[str, bool]] | DataFrame, *, keep: list[str], default: str = "allow") -> DataFrame:
    """`keep` columns with `host, path, rule, verdict` of column `url`.

    `rules`: pairs `(host/path, allow)` or a frame `rule string, allow boolean`, which is taken in blocks of about
    `BLOCK` rules; a url goes through all of them in one pass and the longest fitting rule wins. A rule fits its
    host and all hosts below it when the url's path begins with the rule's. Without one, `default` is the verdict
    (no digest of the array fits). Null urls and those without `://` have empty host and path and fit none.
    """
    types = dict(urls.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    spark = urls.sparkSession

    def blocks() -> Iterator[list[tuple[str, bool]]]:
        if not isinstance(rules, DataFrame):
            yield [*rules]
            return
        parts = max(1, -(-rules.count() // BLOCK))
        for i in range(parts):  # a block of rules at a time passes the driver
            part = rules.where(F.pmod(F.xxhash64("rule"), F.lit(parts)) == i).select("rule", "allow").collect()
            yield [(r["rule"], r["allow"]) for r in part if r["rule"] is not None]

    rows = urls.select(*keep, F.col("url").cast("string").alias("_url"), F.lit(None).cast("string").alias("_rule"),
                       F.lit(None).cast("boolean").alias("_allow"))
    for block in blocks():
        table = digests(block)
        sent = spark.sparkContext.broadcast((table.name, table.keys, table.strings, table.allow, table.path_lengths))

        def probe(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            table = Digests(*sent.value)
            for batch in batches:
                at = len(keep)
                found = [host_and_path(u) for u in batch.column(at).to_pylist()]
                rule, allow = batch.column(at + 1).to_pylist(), batch.column(at + 2).to_pylist()
                for i, hit in enumerate(_looked_up(found, table)):
                    if hit and (rule[i] is None or (len(hit[0]), len(hit[0].partition("/")[0])) > (
                            len(rule[i]), len(rule[i].partition("/")[0]))):
                        rule[i], allow[i] = hit
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: at + 1], pa.array(rule, pa.string()), pa.array(allow, pa.bool_())],
                    names=[*keep, "_url", "_rule", "_allow"])

        rows = rows.mapInArrow(probe, f"{schema}, _url string, _rule string, _allow boolean")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = len(keep)
            found = [host_and_path(u) for u in batch.column(at).to_pylist()]
            allow = batch.column(at + 2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array([h for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.string()),
                 batch.column(at + 1),
                 pa.array([default if a is None else "allow" if a else "block" for a in allow], pa.string())],
                names=[*keep, "host", "path", "rule", "verdict"])

    return rows.mapInArrow(named, f"{schema}, {OUT}")
