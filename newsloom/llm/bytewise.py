"""Words and hashes of whole Arrow string columns, computed on their UTF-8 bytes with numpy.

No Python string is made. Texts are taken in chunks of about `CHUNK` bytes, so that the
arrays of one step stay small; a longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
IS_START = np.ones(256, bool)  # first byte of a code point
IS_START[0x80:0xC0] = False
BASE = np.uint64(0x9E3779B97F4A7C15 & ~7 | 5)  # 5 mod 8: powers stay apart
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_random = np.random.default_rng(20240229)
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = BYTE.copy()  # A-Z as a-z, white space as nothing
FOLDED[65:91] = BYTE[97:123]
FOLDED[IS_SPACE] = 0
PLACE = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i (mod 2**64) for i below n."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]))
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(column, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about `size` bytes."""
    data, at = buffers(column)
    first, n = 0, len(at) - 1
    while first < n:
        end = int(np.searchsorted(at, at[first] + size, "right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def word_starts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which words begin, and for each row the index of its first word (rows + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = IS_SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    begin = at[:-1]
    before[begin[begin < len(data)]] = True
    starts = np.flatnonzero(~space & before)
    return starts, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, table: np.ndarray = FOLDED) -> np.ndarray:
    """64-bit hashes of the words; `table` gives white space the value 0."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    return mixed(np.add.reduceat(table[data] * up, starts) * down[starts])


def sequence_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a row, and for each row the index of its first one (rows + 1).

    A row of fewer than k words, but at least one, has one run: all of them.
    """
    n = np.diff(first)
    full = np.maximum(n - k + 1, 0)
    out_first = np.concatenate([[0], np.cumsum(np.where(n > 0, np.maximum(full, 1), 0))]).astype(np.int64)
    out = np.zeros(int(out_first[-1]), np.uint64)
    size = max(len(words) - k + 1, 0)
    if size:
        total = words[:size] * PLACE[0]
        for j in range(1, k):
            total += words[j : size + j] * PLACE[j]
        inside = np.repeat(full > 0, np.where(n > 0, np.maximum(full, 1), 0))
        wide = np.zeros(len(words) + 1, np.int32)  # +1 where a row's runs begin, -1 where they end
        np.add.at(wide, first[:-1][full > 0], 1)
        np.add.at(wide, (first[:-1] + full)[full > 0], -1)
        out[inside] = mixed(total[np.flatnonzero(np.cumsum(wide[:size]))])
    for i in np.flatnonzero((n > 0) & (full == 0)):
        w = words[first[i] : first[i + 1]]
        out[out_first[i]] = mixed((w * PLACE[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))[0]
    return out, out_first


def lengths(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of each row."""
    return np.diff(np.concatenate([[0], np.cumsum(IS_START[data])])[at])
