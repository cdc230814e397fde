"""Quality scores by histogram gradient-boosted trees over statistics of whole texts.

The statistics are counted on the texts' bytes, without Python strings. Trees of `DEPTH` levels are grown on
binned statistics (`BINS` quantile bins) of a bounded sample of labelled rows and flattened into arrays:
node i has the children 2i + 1 and 2i + 2, so that scoring is DEPTH vectorised steps a tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import bytewise as B

TREES, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 60, 4, 64, 0.15, 1.0, 2.0

_b = np.arange(256)
_letter = ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122)) | (_b >= 0xC0)
_classes = {
    "letters": _letter, "capitals": (_b >= 65) & (_b <= 90), "digits": (_b >= 48) & (_b <= 57),
    "spaces": B.IS_SPACE, "lines": _b == 10, "stops": np.isin(_b, [46, 33, 63]), "commas": np.isin(_b, [44, 59, 58]),
    "shouts": _b == 33, "pipes": np.isin(_b, [124, 92, 47]), "brackets": np.isin(_b, list(b"()[]{}<>")),
    "symbols": np.isin(_b, list(b"#$%&*+=@^_~`")), "beyond": _b >= 0xC0,
}
STATISTICS = [
    "log_chars", "log_words", "mean_word", "longest_word", "distinct_share", "top_word_share", "wordless_share",
    "short_share", "capital_words", "stop_words_share", "mean_line", "repeated_lines", "entropy",
    *[f"{c}_share" for c in _classes],
]


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a chunk; an empty text has zeros."""
    n = len(at) - 1
    out = np.zeros((n, len(STATISTICS)))
    count = {c: np.diff(np.concatenate([[0], np.cumsum(m[data])])[at]) for c, m in _classes.items()}
    chars = B.lengths(data, at)
    size = np.maximum(chars, 1)
    starts, first = B.word_starts(data, at)
    words = np.diff(first)
    w = np.maximum(words, 1)
    column = {name: i for i, name in enumerate(STATISTICS)}
    out[:, 0], out[:, 1] = np.log1p(chars), np.log1p(words)
    out[:, 2] = (chars - count["spaces"]) / w
    for c in _classes:
        out[:, column[f"{c}_share"]] = count[c] / size
    out[:, column["mean_line"]] = np.log1p(chars / (count["lines"] + 1))
    if len(starts):
        hashes = B.word_hashes(data, starts)
        solid = np.concatenate([[0], np.cumsum(~B.IS_SPACE[data])])
        letters = np.concatenate([[0], np.cumsum(_letter[data])])
        ends = np.append(starts[1:], len(data))
        long_, has = solid[ends] - solid[starts], letters[ends] - letters[starts]
        lead = data[starts]
        for name, flag in (("wordless_share", has * 2 < long_), ("short_share", long_ <= 2),
                           ("capital_words", _classes["capitals"][lead])):
            out[:, column[name]] = np.diff(np.concatenate([[0], np.cumsum(flag)])[first]) / w
        last = data[np.maximum.accumulate(np.where(~B.IS_SPACE[data], np.arange(len(data)), 0))[ends - 1]]
        out[:, column["stop_words_share"]] = np.diff(np.concatenate([[0], np.cumsum(_classes["stops"][last])])[first]) / w
        for i in np.flatnonzero(words):
            own = hashes[first[i] : first[i + 1]]
            _, c = np.unique(own, return_counts=True)
            p = c / len(own)
            out[i, 3] = long_[first[i] : first[i + 1]].max()
            out[i, 4], out[i, 5] = len(c) / len(own), p.max()
            out[i, column["entropy"]] = -(p * np.log(p)).sum()
    breaks = np.flatnonzero(data == 10)
    if len(breaks):
        up, down = B.powers(len(data))
        bounds = np.unique(np.concatenate([at[:-1][at[:-1] < len(data)], breaks + 1]))
        bounds = bounds[bounds < len(data)]
        line = B.mixed(np.add.reduceat(B.FOLDED[data] * up, bounds) * down[bounds])
        place = np.searchsorted(bounds, at)
        for i in np.flatnonzero(count["lines"]):
            own = line[place[i] : place[i + 1]]
            out[i, column["repeated_lines"]] = 1 - len(np.unique(own)) / max(len(own), 1)
    return out


@dataclass
class Trees:
    """Flat trees: statistic and threshold of inner nodes, values of leaves, and the value all start from."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the log loss. Without rows, or with one class, a constant."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    rate = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), start if len(y) else 0.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    features = x.shape[1]
    raw = np.full(len(y), start)
    all_f, all_t, all_v = [], [], []
    offset = np.arange(features) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            base, width = 2**depth - 1, 2**depth
            cell = ((node - base)[:, None] * (features * BINS) + offset + binned).ravel()
            size = width * features * BINS
            hist_g = np.bincount(cell, np.repeat(g, features), size).reshape(width, features, BINS)
            hist_h = np.bincount(cell, np.repeat(h, features), size).reshape(width, features, BINS)
            left_g, left_h = hist_g.cumsum(2), hist_h.cumsum(2)
            sum_g, sum_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = (left_g**2 / (left_h + RIDGE) + (sum_g - left_g) ** 2 / (sum_h - left_h + RIDGE) - sum_g**2 / (sum_h + RIDGE))
            gain[(left_h < LEAST_WEIGHT) | (sum_h - left_h < LEAST_WEIGHT)] = -1
            best = gain.reshape(width, -1).argmax(1)
            for i, b in enumerate(best):
                j, cut = divmod(int(b), BINS)
                if gain[i, j, cut] > 1e-6 and cut < len(edges[j]):
                    feature[base + i], threshold[base + i] = j, edges[j][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        raw += value[leaf]
        all_f.append(feature)
        all_t.append(threshold)
        all_v.append(value)
    return Trees(np.array(all_f), np.array(all_t), np.array(all_v), start)


def train(documents: DataFrame, labels: DataFrame, *, max_labels: int = 12_000) -> Trees:
    """Trees for `labels (doc_id, quality)`, fitted on about `max_labels` labelled rows drawn by a hash of doc_id.

    Labels other than 0 and 1, and labels of unknown documents, are left out. A document with several labels
    is used with each of them. The sample's statistics (a few MB) are fitted on the driver.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    n = usable.count()
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.lit(1_000_003)) < max_labels / max(n, 1) * 1_000_003
    rows = documents.select("doc_id", "text").join(F.broadcast(usable.where(drawn)), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in B.chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first).cast(pa.int64()),
                     batch.column("quality").slice(first, end - first).cast(pa.int32()),
                     pa.array(list(statistics(data, at)), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    got = rows.mapInArrow(run, "doc_id bigint, quality int, x array<double>").toPandas().sort_values(
        ["doc_id", "quality"], kind="stable")
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(STATISTICS)))
    return grow(x, got["quality"].to_numpy(float))


def score(documents: DataFrame, trees: Trees, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (doc_id by default), `score` (0 to 1) and `predicted` of every whole text; null is empty."""
    keep = keep or ["doc_id"]
    types = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in B.chunks(batch.column(len(keep))):
                s = trees.score(statistics(data, at))
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(first, end - first) for c in batch.columns[: len(keep)]], pa.array(s),
                     pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return documents.select(*keep, F.col("text").alias("_text")).mapInArrow(run, f"{schema}, score double, predicted int")
