"""Packing documents into fixed-length training sequences with little padding, in document order.

Method: order-preserving dynamic programming. Documents are range-partitioned by (doc_id, reading order)
and sorted inside each partition, so every task sees a contiguous run of the corpus. A task tokenizes its
documents (Arrow batches through `mapInPandas`), appends the end id to each, and cuts the token stream
into windows of at most `seq_len` ids. Cut positions are candidates with a penalty: a document boundary
costs 0, a sentence end inside a document `SENTENCE_COST`, any other position `TRUNCATION_COST`; each
window costs its padding, `seq_len - length`, except that a window whose length is a power of two needs
none. Besides the boundaries, the positions one full window after a boundary (and, inside runs longer
than a window, every full window from either end) are candidates, so full windows are always possible.
The cheapest cut sequence is found by a left-to-right recurrence over candidates: the best previous cut
within one window is the minimum of f(c') + c' over a sliding range, kept in a monotone queue (O(1)
amortised per candidate); the power-of-two lengths are 13 extra look-ups. Streams are solved in blocks
of `block_tokens` ids ending at a document boundary, which bounds a task's memory by the block (or by
the one document that is longer than a block).

A piece is a maximal run of one document's ids inside one window. Output per piece: doc_id, start (ids of
its document before it), length, ids_crc32 (CRC-32 of the ids as little-endian unsigned 32-bit integers),
doc_tokens (all ids of the document, with its end id), sequence_id (numbered from 0 in document order over
the whole table) and offset (inside its sequence, gapless from 0).

Defined cases: a null text is empty and gives the one piece of its end id; very long texts are cut into
as many windows as needed. Repeated rows (equal doc_id) are separate documents, kept in reading order.
Rows without doc_id come first (nulls sort first) and keep a null doc_id. An empty table gives no rows.
Only doc_id and text are read, so other columns of any name are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.work import saved

SEQ_LEN = 4096
END_ID = 2  # fixed: the id that closes every document
SENTENCE_COST = 16  # cutting at a sentence end inside a document, in padding ids
TRUNCATION_COST = 256  # cutting anywhere else inside a document
BLOCK_TOKENS = 1 << 20  # ids solved at once by one task (a block ends at a document boundary)
ENCODE_CHARS = 1 << 21  # code points encoded at once
KNOWN_WORDS = 500_000  # distinct words a worker remembers the ids of, the first ones (some 100 MB)
KNOWN_CHARS = 32  # longer words are not remembered
SPECIAL = b"<|"  # how every special token begins
BLANK, WORD, SIGN, OTHER = range(4)  # kinds of bytes: ASCII white space, letters and digits, signs; the rest
KINDS = np.array([BLANK if c in b" \t\n\v\f\r" else OTHER if c < 33 or c > 126 else WORD if chr(c).isalnum() else SIGN
                  for c in range(256)], dtype=np.uint8)
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch  # NFC keeps them, each has one small form
# How a tokenizer reads a text whose ids are those of its words one after the other: no step sees beyond
# ASCII white space (it is no part of a token, composes with nothing, and letters change case one by one).
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None, "padding": None,
}

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, part int")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    vocab = tok.get_vocab()
    ends = set()
    for text, i in vocab.items():
        core = text.removesuffix("</w>")
        if core and not any(ch.isalnum() for ch in core) and core[-1] in ".!?":
            ends.add(i)
    return tok, np.array(sorted(ends), dtype=np.int64)


@lru_cache(maxsize=4)
def reads_by_word(path: str) -> bool:
    """True when the ids of a text are those of its words (divided by ASCII white space) in order."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    plain = all(t["content"].startswith(SPECIAL.decode()) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]))
                for t in said.get("added_tokens") or [])
    return plain and all(said.get(k) == v for k, v in BY_WORD.items())


@lru_cache(maxsize=4)
def _known(path: str) -> dict[str, bytes]:
    """The ids of words met by this worker, over all of its tasks (at most KNOWN_WORDS)."""
    return {}


@lru_cache(maxsize=4)
def _word_ends(path: str) -> np.ndarray | None:
    """For each id whether it ends a run of letters; None when the tokenizer does not mark that."""
    with open(path, encoding="utf-8") as f:
        if json.load(f)["model"].get("end_of_word_suffix") != "</w>":
            return None
    vocab = _tokenizer(path)[0].get_vocab(with_added_tokens=False)
    ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
    ends[[i for text, i in vocab.items() if text.endswith("</w>")]] = True
    return ends


def _encode_words(tok, words: list[str], ends: np.ndarray | None) -> Iterator[bytes]:
    """The ids of each word. Runs of Latin letters are one token run each: they are encoded as one text and
    divided where an id ends a run; the other words one by one."""
    runs = {w for w in words if LETTERS(w)} if ends is not None else set()
    plain = [w for w in words if w in runs]
    single = iter(tok.encode_batch_fast([w for w in words if w not in runs], add_special_tokens=False))
    parts: Iterator[bytes] = iter(())
    if plain:
        flat = np.array(tok.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, dtype=np.int32)
        cuts = [0, *((np.flatnonzero(ends[flat]) + 1) * 4).tolist()]
        if len(cuts) != len(plain) + 1:
            raise ValueError("the tokenizer divides runs of letters")
        data = flat.tobytes()
        parts = (data[a:b] for a, b in zip(cuts, cuts[1:]))
    for w in words:
        yield next(parts) if w in runs else np.array(next(single).ids, dtype=np.int32).tobytes()


def _divided(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts and how many each text has, alike ones made equal where the ids allow it: closing
    ASCII punctuation after an ASCII letter or digit is a word of its own, and A-Z before an ASCII character (it
    composes with nothing) is small. Texts that may hold a special token stay as they are."""
    data = ("\n".join(texts) + "\n").encode()
    low = data.lower()
    raw = np.frombuffer(data, dtype=np.uint8)
    stops = np.cumsum(pc.binary_length(pa.array(texts, pa.large_string())).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    if SPECIAL not in low:
        raw = np.where(np.append(raw[1:], 0) < 128, np.frombuffer(low, dtype=np.uint8), raw)
        kinds = KINDS[raw]
        runs = np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1])
        k = kinds[runs]
        closing = np.flatnonzero((k[1:-1] == SIGN) & (k[:-2] == WORD) & (k[2:] == BLANK)) + 1
        at = runs[closing]
        raw = np.insert(raw, at, 32)
        stops = stops + np.searchsorted(at, stops)
    offsets = np.concatenate([[0], stops])
    rows = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw.tobytes()))
    words = pc.ascii_split_whitespace(rows)
    return words.flatten(), words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def encoded(tok, texts: list[str], by_word: bool, known: dict[str, bytes], ends: np.ndarray | None = None) -> list[np.ndarray]:
    """The ids of every text. With `by_word` each distinct word is encoded once; `known` remembers short ones."""
    if not by_word:
        return [np.asarray(e.ids, dtype=np.int32) for e in tok.encode_batch(texts, add_special_tokens=False)]
    if not texts:
        return []
    flat, counts = _divided(texts)
    coded = flat.dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    found: list = list(map(known.get, names))
    new = [i for i, x in enumerate(found) if x is None]
    for i, x in zip(new, _encode_words(tok, [names[i] for i in new], ends)):
        found[i] = x
        if len(known) < KNOWN_WORDS and len(names[i]) <= KNOWN_CHARS:
            known[names[i]] = x
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
    store = np.frombuffer(b"".join(found), dtype=np.int32)
    n = sizes[codes]  # ids of every word, which lie in the store from `starts`
    ends_at = np.cumsum(n)
    starts = (np.cumsum(sizes) - sizes)[codes]
    ids = store[np.arange(ends_at[-1] if len(ends_at) else 0) + np.repeat(starts - (ends_at - n), n)]
    until = np.concatenate([[0], ends_at])[np.cumsum(counts)]
    return np.split(ids, until[:-1])


def plan_cuts(costs: dict[int, int], total: int, seq_len: int = SEQ_LEN) -> list[int]:
    """Cut positions (0 and `total` included) minimising cut costs plus padding.

    `costs` maps candidate positions in (0, total) to their cut cost; 0 and `total` cost nothing.
    """
    cands = np.array(sorted({0, total, *(p for p in costs if 0 < p < total)}), dtype=np.int64)
    # Earlier candidates exactly a power of two before each one: few, found by vectorised search. One a whole
    # window before needs no look-up: the queue gives it without padding.
    later, earlier = [], []
    p = 1
    while p <= seq_len:
        if p < seq_len:
            i = np.searchsorted(cands, cands - p)
            hit = np.flatnonzero(cands[i] == cands - p)  # i is in range: cands - p is below the last one
            later.append(hit)
            earlier.append(i[hit])
        p <<= 1
    to = np.concatenate(later) if later else np.zeros(0, dtype=np.int64)
    order = np.argsort(to, kind="stable")
    exact = np.concatenate(earlier)[order].tolist() if later else []
    until = np.searchsorted(to[order], np.arange(len(cands)), side="right").tolist()
    # The first candidate at most one window back, for every candidate.
    first = np.searchsorted(cands, cands - seq_len).tolist()
    pos = cands.tolist()
    here = [costs.get(c, TRUNCATION_COST) for c in pos]
    here[-1] = 0
    inf = float("inf")
    best, back = [inf] * len(pos), [-1] * len(pos)
    best[0] = 0
    # Candidate indexes from `head` to `tail` with increasing best + position, which orders them.
    queue, keys, head, tail = [0] * len(pos), [0] * len(pos), 0, 0
    at = 0
    for j, (lo, c, cost, end) in enumerate(zip(first, pos, here, until)):
        if j == 0:
            continue
        while head <= tail and queue[head] < lo:
            head += 1
        b, k = inf, -1
        if head <= tail:
            k = queue[head]
            b = keys[head] + seq_len - c + cost
        for i in exact[at:end]:  # lengths that are a power of two carry no padding
            v = best[i] + cost
            if v < b:
                b, k = v, i
        at = end
        best[j], back[j] = b, k
        if b < inf:
            b += c
            while tail >= head and keys[tail] >= b:
                tail -= 1
            tail += 1
            queue[tail], keys[tail] = j, b
    cuts, j = [], len(pos) - 1
    while j > 0:
        cuts.append(pos[j])
        j = back[j]
    return [0, *reversed(cuts)]


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, seq_len: int = SEQ_LEN) -> dict[int, int]:
    """Candidate cuts with their costs: boundaries, one window after each, full windows in long runs."""
    costs = {int(p): SENTENCE_COST for p in sentence_ends}
    costs.update({int(p): 0 for p in doc_ends})
    marks = sorted({0, total, *costs})
    extra = {}
    for a, b in zip(marks, marks[1:]):
        if a + seq_len < b:
            extra.update({p: TRUNCATION_COST for p in range(a + seq_len, b, seq_len)})
            extra.update({p: TRUNCATION_COST for p in range(b - seq_len, a, -seq_len)})
    for a in marks:
        if a + seq_len < total and a + seq_len not in costs:
            extra[a + seq_len] = TRUNCATION_COST
    return {**extra, **costs}


def pack_block(ids: list[np.ndarray], keys: list, sentence_ids: np.ndarray, seq_len: int = SEQ_LEN):
    """Pieces of one block: (key, start, length, crc, doc_tokens, local sequence, offset)."""
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    stream = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
    total = int(bounds[-1])
    sentence = np.flatnonzero(np.isin(stream, sentence_ids)) + 1  # cut after a sentence end
    cuts = plan_cuts(candidates(bounds[1:-1], sentence, total, seq_len), total, seq_len)
    out = []
    for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
        d = int(np.searchsorted(bounds, a, side="right") - 1)
        pos = a
        while pos < b:
            end = min(b, int(bounds[d + 1]))
            piece = stream[pos:end].astype("<u4")
            out.append((keys[d], pos - int(bounds[d]), end - pos, zlib.crc32(piece.tobytes()), int(lengths[d]), s, pos - a))
            pos = end
            d += 1
    return out, len(cuts) - 1


def _slices(texts: list[str], chars: int = ENCODE_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `chars` code points together (a longer text is a run of its own)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > chars:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _pack_partition(batches: Iterator[pd.DataFrame], path: str, seq_len: int, block_tokens: int) -> Iterator[pd.DataFrame]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
    tok, sentence_ids = _tokenizer(path)
    by_word, known, ends = reads_by_word(path), _known(path), _word_ends(path)
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    ids, keys, size, done = [], [], 0, 0

    def flush():
        nonlocal ids, keys, size, done
        rows, n = pack_block(ids, keys, sentence_ids, seq_len)
        frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        frame["sequence_id"] += done
        frame["part"] = part
        ids, keys, size, done = [], [], 0, done + n
        return frame

    for batch in batches:
        texts = batch["text"].fillna("").tolist()
        doc_keys = batch["doc_id"].tolist()
        for lo, hi in _slices(texts):  # encodings hold offsets and token strings: a bounded number at once
            for key, found in zip(doc_keys[lo:hi], encoded(tok, texts[lo:hi], by_word, known, ends)):
                one = np.append(found, np.int32(END_ID))
                ids.append(one)
                keys.append(None if key is None or key != key else int(key))
                size += len(one)
                if size >= block_tokens:
                    yield flush()
    if ids:
        yield flush()


def pack(docs: DataFrame, path: str | None = None, seq_len: int = SEQ_LEN, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of all documents packed into sequences of at most `seq_len` ids; see the module text."""
    path = path or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.monotonically_increasing_id().alias("seen"))
    # The reading order breaks ties, so one doc_id repeated very often still spreads over partitions.
    ordered = rows.repartitionByRange("doc_id", "seen").sortWithinPartitions("doc_id", "seen").drop("seen")
    pieces = saved(ordered.mapInPandas(lambda it: _pack_partition(it, path, seq_len, block_tokens), PIECES))
    # One row per partition: where its sequence numbers start.
    firsts = pieces.groupBy("part").agg((F.max("sequence_id") + 1).alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("first"))
    return pieces.join(F.broadcast(firsts), "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence_id") + F.coalesce(F.col("first"), F.lit(0))).alias("sequence_id"), "offset")
