"""Benchmark decontamination on templates.

Texts become sequences of canonical tokens: lower case, without punctuation, with numbers, names and
units replaced by typed placeholders whose original values are kept aside as slots. Windows of `width`
tokens of the documents are hash-joined with those of the benchmark. A re-parameterised question has
the same templates with other values; it counts only if its slots are consistent, that is if within
the window every value of the benchmark stands for one value of the document and the other way round.
Windows without slots, or with the item's own values, always are.

Such templates need plain words around the values. Beside them, all windows of an item are also joined as
plain case-folded tokens without placeholders, so that a copy is found whatever it consists of.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import bytewise as B
from newsloom.llm.work import checked_join, saved

# Numbers in words and units; ambiguous short units count only behind a number.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "mm cm m km meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet ft yard yards "
    "mile miles mg g kg gram grams kilogram kilograms ounce ounces oz pound pounds lb lbs ton tons tonne tonnes ml l "
    "liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week "
    "weeks month months year years dollar dollars cent cents euro euros usd eur percent degree degrees mph kmh kph "
    "watt watts kw volt volts amp amps joule joules hz khz mhz ghz kb mb gb tb"
).split()
NUM, UNIT, NAME = (np.uint64(x) for x in (0x11, 0x22, 0x33))  # the placeholders' hashes
WINDOW_BLOCK = 2_000_000  # hashes of benchmark windows sent to the tasks at once (16 MB)

_byte = np.arange(256)
_digit = (_byte >= 48) & (_byte <= 57)
_upper = (_byte >= 65) & (_byte <= 90)
_lower = (_byte >= 97) & (_byte <= 122)
_kept = _digit | _upper | _lower | (_byte >= 128) | B.IS_SPACE
_stop = np.isin(_byte, [ord(c) for c in ".!?:;|\n"])


def _hash_of(words: list[str]) -> np.ndarray:
    data, at = B.buffers(pa.array([" ".join(words)]))
    return np.sort(B.word_hashes(data, B.word_starts(data, at)[0]))


_NUMBERS, _UNITS = _hash_of(NUMBER_WORDS), _hash_of(UNITS)


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def templates(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical tokens, their own values (0 where they are no slot), and each row's first token (rows + 1).

    A token of digits, one that begins with a digit, or a number word is a number; a unit word behind a number
    is a unit; a capitalised word that does not begin a sentence or line is a name.
    """
    kept = _kept[data]
    small = data[kept]
    where = np.flatnonzero(kept)
    bounds = np.concatenate([[0], np.cumsum(kept)])[at]
    starts, first = B.word_starts(small, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), first
    words = B.word_hashes(small, starts)
    lead = small[starts]
    number = _digit[lead] | _in(words, _NUMBERS)
    after = np.zeros(len(words), bool)
    after[1:] = number[:-1]
    after[first[:-1][first[:-1] < len(after)]] = False
    unit = after & ~number & _in(words, _UNITS)
    second = small[np.minimum(starts + 1, len(small) - 1)]
    # À to Þ in UTF-8: C3 80 to C3 9E
    capital = (_upper[lead] & (_lower[second] | (second >= 128))) | ((lead == 0xC3) & (second < 0x9F))
    stops = np.concatenate([[0], np.cumsum(_stop[data])])
    last_byte = np.zeros(len(starts), np.int64)  # of the word before, in the whole text
    last_byte[1:] = where[np.maximum(starts[1:] - 1, 0)]
    begins = np.zeros(len(starts), bool)
    begins[first[:-1][first[:-1] < len(begins)]] = True
    # stops between the last word byte before and this word
    space_run = np.flatnonzero(~B.IS_SPACE[small])
    before = np.searchsorted(space_run, starts) - 1
    last_byte[1:] = where[space_run[np.maximum(before[1:], 0)]]
    begins |= stops[where[starts]] - stops[last_byte + 1] > 0
    name = capital & ~begins & ~number & ~unit
    tokens = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, words)))
    slots = np.where(number | unit | name, words | np.uint64(1), np.uint64(0))
    return tokens, slots, first


def _literal(tokens: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The tokens themselves, case-folded, without placeholders."""
    return np.where(slots != 0, slots, tokens) | np.uint64(1)


def _benchmark(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id")
            for row, _, data, at in B.chunks(batch.column("text"), 1):  # a row at a time
                tokens, slots, first = templates(data, at)
                k = max(1, min(width, len(tokens)))  # a shorter item is one window
                hashes, _ = B.sequence_hashes(tokens, first, k)
                n = len(hashes)
                plain = [int((slots[i : i + k] == 0).sum()) for i in range(n)]
                exact, _ = B.sequence_hashes(_literal(tokens, slots), first, k)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, 1).take(pa.array(np.zeros(2 * n, np.int64))).cast(pa.int64()), pa.array(np.tile(np.arange(n), 2)),
                     pa.array(np.concatenate([hashes, exact]).view(np.int64)), pa.array(np.full(2 * n, k)), pa.array(plain * 2, pa.int64()),
                     pa.array([slots[i : i + k].view(np.int64) for i in range(n)] + [[]] * n, pa.list_(pa.int64())),
                     pa.array(np.repeat([False, True], n))],
                    names=["item_id", "item_at", "w", "tokens", "plain", "item_slots", "exact"])
    return run


def _matches(width: int, known: np.ndarray):
    short = np.unique(known["tokens"][known["tokens"] < width])
    tables = {exact: np.sort(known["w"][known["exact"] == exact]) for exact in (False, True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for row, end, data, at in B.chunks(batch.column("text")):
                tokens, slots, first = templates(data, at)
                for k, exact in [(k, e) for k in [width, *short.tolist()] for e in tables]:  # items shorter than a window are looked for whole
                    runs, begin = B.sequence_hashes(_literal(tokens, slots) if exact else tokens, first, k)
                    hit = np.flatnonzero(_in(runs, tables[exact]))
                    if not len(hit):
                        continue
                    doc = np.searchsorted(begin, hit, "right") - 1
                    place = hit - begin[doc]
                    full = first[doc + 1] - first[doc] >= k
                    hit, doc, place = hit[full], doc[full], place[full]
                    if exact:  # once for each document
                        once = np.unique(np.stack([doc.astype(np.uint64), runs[hit]]), axis=1, return_index=True)[1]
                        hit, doc = hit[once], doc[once]
                    own = [[]] * len(hit) if exact else [slots[a : a + k].view(np.int64) for a in first[doc] + place]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(row, end - row).take(pa.array(doc)).cast(pa.int64()),
                         pa.array(runs[hit].view(np.int64)), pa.array(own, pa.list_(pa.int64())), pa.array(np.full(len(hit), exact))],
                        names=["doc_id", "w", "doc_slots", "exact"])
    return run


def benchmark_windows(benchmark: DataFrame, *, width: int = 8, min_plain: int = 5) -> DataFrame:
    """`item_id, item_at, w, tokens, plain, item_slots, exact`: windows of the items, as templates and (`exact`) as they are.

    Templates of fewer than `min_plain` words that are no placeholders say too little and are left out; the
    exact windows are all there. An item shorter than `width` is one window.
    """
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(
        _benchmark(width),
        "item_id bigint, item_at bigint, w bigint, tokens bigint, plain bigint, item_slots array<bigint>, exact boolean")
    return rows.where(F.col("exact") | (F.col("plain") >= min_plain))


def leaks(documents: DataFrame, benchmark: DataFrame, *, width: int = 8, min_plain: int = 5) -> DataFrame:
    """`doc_id, item_id, n_windows, item_windows, n_exact, item_exact`: documents that hold passages of benchmark items.

    One row per document and item with at least one template window whose slots are consistent, or one window
    copied but for case and punctuation. `n_windows` counts the item's template windows found, `item_windows` all
    it has; `n_exact` and `item_exact` count the windows as they are. Repeated doc_ids count as one document, a null doc_id is
    one document of its own; null and empty texts hold nothing. Benchmark windows go to the tasks in blocks of
    `WINDOW_BLOCK` hashes, each read against all documents.
    """
    spark = documents.sparkSession
    windows = saved(benchmark_windows(benchmark, width=width, min_plain=min_plain))
    total = windows.count()
    texts = documents.select("doc_id", "text")
    found = None
    for i in range(max(1, -(-total // WINDOW_BLOCK))):
        block = windows.where(F.pmod(F.xxhash64("w"), F.lit(-(-total // WINDOW_BLOCK) or 1)) == i)
        rows = block.select("w", "tokens", "exact").distinct().toPandas()  # at most about WINDOW_BLOCK rows
        known = np.zeros(len(rows), [("w", np.uint64), ("tokens", np.int64), ("exact", bool)])
        known["w"], known["tokens"] = rows["w"].to_numpy(np.int64).view(np.uint64), rows["tokens"]
        known["exact"] = rows["exact"].to_numpy(bool)
        part = texts.mapInArrow(_matches(width, known), "doc_id bigint, w bigint, doc_slots array<bigint>, exact boolean")
        found = part if found is None else found.unionByName(part)
    joined = checked_join(found, windows, ["w", "exact"], max_rows=200_000)
    values = F.array_distinct(F.filter(
        F.arrays_zip("item_slots", "doc_slots"), lambda p: (p["item_slots"] != 0) | (p["doc_slots"] != 0)))
    one_way = F.size(F.array_distinct(F.transform("values", lambda p: p["item_slots"])))
    other_way = F.size(F.array_distinct(F.transform("values", lambda p: p["doc_slots"])))
    n = F.size("values")
    consistent = joined.withColumn("values", values).where((one_way == n) & (other_way == n))
    places = lambda exact: F.countDistinct(F.when(F.col("exact") == exact, F.col("item_at")))
    sizes = windows.groupBy("item_id").agg(places(False).alias("item_windows"), places(True).alias("item_exact"))
    hits = consistent.groupBy("doc_id", "item_id").agg(places(False).alias("n_windows"), places(True).alias("n_exact"))
    return checked_join(hits, saved(sizes), "item_id").select(
        "doc_id", "item_id", "n_windows", "item_windows", "n_exact", "item_exact")
