"""Counts over the token arrays of many rows at once, in Arrow batches.

Everything stays inside the row's task: a batch is taken in runs of a bounded number of tokens, so a
worker holds one run, whatever the number or the length of the texts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The functions travel with the tasks: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUN_TOKENS = 500_000


def runs(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of at most `most` tokens each, or one row."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, stop
        at = stop


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def count_grams(tokens: pa.Array, low: int, high: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row number, n-gram (tokens joined by a blank) and count of every distinct n-gram of every row."""
    words, names = _codes(tokens.flatten())
    row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    base = max(len(names), 1)
    places, grams, strings = np.arange(len(words)), words, names  # where the grams of n tokens begin
    rows, terms, counts = [], [], []
    for n in range(1, high + 1):
        if n > 1:  # a longer gram is a gram and the token after it, in the same row
            nexts = places + n - 1
            fits = nexts < len(words)
            fits[fits] = row[nexts[fits]] == row[places[fits]]
            places, nexts = places[fits], nexts[fits]
            found, grams = np.unique(grams[fits] * base + words[nexts], return_inverse=True)
            strings = pc.binary_join_element_wise(strings.take(pa.array(found // base)), names.take(pa.array(found % base)), " ")
        if n >= low:
            size = max(len(strings), 1)
            key, times = np.unique(row[places] * size + grams, return_counts=True)
            rows.append(key // size)
            terms.append(strings.take(pa.array(key % size)))
            counts.append(times)
    return np.concatenate(rows), pa.concat_arrays(terms), np.concatenate(counts)


def sentence_sums(texts: pa.Array) -> pa.Array:
    """Scores of the sentences of every text, given as lists of tokens: summed frequency within the
    text of a sentence's tokens, relative to the most frequent one. A null text has no sentences."""
    sizes = pc.list_value_length(texts.flatten()).fill_null(0).to_numpy(zero_copy_only=False)
    per_text = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.cumsum(per_text)
    tokens = before[ends] - before[ends - per_text]
    parts = [_sums_of(texts.slice(at, stop - at)) for at, stop in runs(tokens, RUN_TOKENS)]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0), *parts])))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def sentence_scores(texts: pa.Array) -> pa.Array:
    return sentence_sums(texts)


def _sums_of(texts: pa.Array) -> np.ndarray:
    sentences = texts.flatten()
    text_of = np.repeat(np.arange(len(texts)), texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    sizes = sentences.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    words, names = _codes(sentences.flatten())
    sentence = np.repeat(np.arange(len(sentences)), sizes)
    base = max(len(names), 1)
    found, place, times = np.unique(text_of[sentence] * base + words, return_inverse=True, return_counts=True)
    most = np.zeros(len(texts))
    np.maximum.at(most, found // base, times)
    sums = np.bincount(sentence, weights=times[place], minlength=len(sentences))
    highest = most[text_of]
    return np.divide(sums, highest, out=np.zeros(len(sentences)), where=highest > 0)


def gram_batches(
    batches: Iterator[pa.RecordBatch], fields: list[str], kept: list[str], low: int, high: int
) -> Iterator[pa.RecordBatch]:
    """`kept, field, term, tf` of every distinct n-gram of every row, a bounded run of rows at a time."""
    for batch in batches:
        for name in fields:
            tokens = batch.column(name)
            sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for at, stop in runs(sizes, RUN_TOKENS):
                row, term, tf = count_grams(tokens.slice(at, stop - at), low, high)
                place = pa.array(row + at)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(place) for c in kept], pa.array([name] * len(row), pa.string()),
                     term, pa.array(tf, pa.int64())],
                    [*kept, "field", "term", "tf"])


def shared_grams(
    batches: Iterator[pa.RecordBatch], fields: list[str], low: int, high: int, weight: str | None
) -> Iterator[pa.RecordBatch]:
    """`field, term, df, n`: how many rows hold an n-gram, by their `weight` and counted, summed over a run."""
    for batch in batches:
        for name in fields:
            tokens = batch.column(name)
            sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for at, stop in runs(sizes, 4 * RUN_TOKENS):
                row, term, _ = count_grams(tokens.slice(at, stop - at), low, high)
                codes, names = _codes(term)
                n = np.bincount(codes, minlength=len(names))
                df = n if weight is None else np.rint(np.bincount(
                    codes, weights=batch.column(weight).to_numpy(zero_copy_only=False)[row + at], minlength=len(names)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(names), pa.string()), names, pa.array(df.astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["field", "term", "df", "n"])
