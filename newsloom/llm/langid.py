"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters is one space. Runs of 1 to 3 characters are hashed into
`2**BITS` features; a text's vector is tf * idf with unit length. Document frequencies come from all
training texts. The weights are fitted by follow-the-regularised-leader (per-coordinate steps, elastic
net: the L1 part keeps most weights at zero) on a bounded sample of `per_class` texts of each language:
each of `SHARDS` tasks fits its share of the sample, starting from the mean of the last round. The
temperature is set on a part of the sample that no task learns from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.work import saved

BITS, SHARDS, ROUNDS = 16, 4, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
UNKNOWN = "und"
LAST_LETTER = 0x33479  # of Unicode 17; behind it are marks, tags and private use
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Which code points are letters; made once per process."""
    if "letters" not in _tables:
        _tables["letters"] = np.array([chr(c).isalpha() for c in range(LAST_LETTER + 1)] + [False])
    return _tables["letters"]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Feature numbers and how often they occur; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(points, LAST_LETTER + 1)]
    if not letter.any():
        return None
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space behind each word
    points = points[keep]
    points = np.concatenate([[np.uint32(32)], points, [np.uint32(32)]]).astype(np.uint32)
    one = points * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + one[2:]
    runs = np.concatenate([one * np.uint32(0x27D4EB2F), two * np.uint32(0x165667B1), three * np.uint32(0xD3A2646D)])
    runs = (runs ^ (runs >> np.uint32(16))) * np.uint32(0x7FEB352D) >> np.uint32(32 - BITS)
    if len(runs) > 1 << (BITS - 2):
        counts = np.bincount(runs, minlength=1 << BITS)
        where = np.flatnonzero(counts)
        return where, counts[where].astype(np.float64)
    where, counts = np.unique(runs, return_counts=True)
    return where.astype(np.int64), counts.astype(np.float64)


def _vector(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    where, counts = found
    x = counts * idf[where]
    return where, x / max(np.sqrt(x @ x), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for text in batch.column("text"):
            found = features(text.as_py())
            if found:
                total[found[0]] += 1
    where = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(total[where])], names=["feature", "df"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The FTRL-proximal minimiser of the linearised loss with L1 and L2."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x classes
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str | None) -> np.ndarray | None:
        found = features(text)
        if found is None or not self.classes:
            return None
        where, x = _vector(found, self.idf)
        return x @ self.weights[where] + self.bias


def _fit_shard(idf: np.ndarray, classes: list[str], state: tuple[np.ndarray, np.ndarray], seed: int):
    number = {c: i for i, c in enumerate(classes)}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        z, n = state[0].copy(), state[1].copy()  # the last row is the bias
        rows = rows.sort_values("order")
        order = np.random.default_rng(seed).permutation(len(rows))
        texts, langs = rows["text"].to_numpy(), rows["lang"].to_numpy()
        for i in order:
            found = features(texts[i])
            if found is None:
                continue
            where, x = _vector(found, idf)
            where, x = np.append(where, 1 << BITS), np.append(x, 1.0)
            zi, ni = z[where], n[where]
            w = _weights(zi, ni)
            p = _softmax(x @ w)
            p[number[langs[i]]] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[where] = zi + g - sigma * w
            n[where] = ni + g * g
        at, c = np.nonzero(n)
        return pd.DataFrame({"feature": at, "c": c, "z": z[at, c], "n": n[at, c]})

    return run


def train(labelled: DataFrame, *, per_class: int = 1000) -> Model:
    """A model of the languages in `doc_id, text, lang`; rows without lang are left out.

    Every text counts for the document frequencies. The weights are fitted on about `per_class` texts of
    each language, drawn by a hash of the doc_id. Without any labelled text the model knows no language.
    """
    rows = labelled.where("lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted(counts)
    idf = np.zeros(1 << BITS)
    if not classes:
        return Model([], idf, np.zeros((1 << BITS, 0)), np.zeros(0))
    df = rows.select("text").mapInArrow(_frequencies, "feature bigint, df bigint").groupBy("feature").agg(
        F.sum("df").alias("df")).toPandas()  # 2**BITS rows at most
    idf[:] = np.log(1.0 + sum(counts.values()))
    idf[df["feature"].to_numpy()] = np.log((1.0 + sum(counts.values())) / (1.0 + df["df"].to_numpy())) + 1.0
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(7))
    share = F.pmod(order, F.lit(1_000_003)) / F.lit(1_000_003)
    rate = F.element_at(
        F.create_map(*[F.lit(x) for c in classes for x in (c, min(1.0, per_class / counts[c]))]), F.col("lang"))
    sample = saved(rows.withColumn("order", order).where(share < rate).withColumn(
        "shard", F.pmod(F.shiftright("order", 20), F.lit(SHARDS + 1)).cast("int")))
    shape = ((1 << BITS) + 1, len(classes))
    z, n = np.zeros(shape), np.zeros(shape)
    learn = sample.where(F.col("shard") < SHARDS)
    for r in range(ROUNDS):
        got = learn.groupBy("shard").applyInPandas(
            _fit_shard(idf, classes, (z, n), r), "feature bigint, c int, z double, n double"
        ).groupBy("feature", "c").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toPandas()  # one model's size
        at, c = got["feature"].to_numpy(), got["c"].to_numpy()
        z, n = np.zeros(shape), np.zeros(shape)
        z[at, c], n[at, c] = got["z"] / SHARDS, got["n"] / SHARDS
    w = _weights(z, n)
    model = Model(classes, idf, w[:-1], w[-1])
    held = _logits_of(sample.where(F.col("shard") == SHARDS), model).toPandas()  # some per_class / 5 rows a class
    held = held[held["logits"].notna()]
    if len(held):
        model.temperature = _temperature(
            np.stack(held["logits"].to_list()), np.searchsorted(classes, held["lang"].to_numpy().astype(str)))
    return model


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least mean log loss, by a search on its logarithm."""
    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]))

    low, high = np.log(0.02), np.log(20.0)
    for _ in range(60):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _logits_of(rows: DataFrame, model: Model) -> DataFrame:
    parts = (model.classes, model.idf, model.weights, model.bias, model.temperature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*parts)
        for batch in batches:
            out = [model.logits(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(out, pa.list_(pa.float64()))], names=["lang", "logits"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, logits array<double>")


def predict(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (doc_id by default), `lang_pred` and `score` of every row.

    The whole text is read; nothing else is an input. A null text, or one without a letter, is `und` with
    score 0; so is every text if the model knows no language. `score` is the calibrated probability.
    """
    keep = keep or ["doc_id"]
    types = dict(documents.dtypes)
    parts = (model.classes, model.idf, model.weights, model.bias, model.temperature)
    sent = documents.sparkSession.sparkContext.broadcast(parts)  # 2**BITS x (classes + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*sent.value)
        for batch in batches:
            lang, score = [], []
            for text in batch.column(len(keep)):
                z = known.logits(text.as_py())
                if z is None:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                else:
                    p = _softmax(z / known.temperature)
                    best = int(p.argmax())
                    lang.append(known.classes[best])
                    score.append(float(p[best]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    rows = documents.select(*keep, F.col("text").alias("_text"))
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
