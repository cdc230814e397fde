"""Ranked lexical search: the top documents of each query by an integer BM25-like score.

Method: hybrid term-at-a-time / document-at-a-time over an inverted index.
1. The queries are taken in runs of at most `run_terms` distinct (query, term) pairs and `run_queries`
   queries, which are sent to all tasks. One pass over the texts writes the forward postings of a run: one
   row per document with its number of terms and its distinct query terms with their frequencies (terms no
   query holds are dropped in that pass). Statistics of the collection come from these rows.
2. A task reads the postings block of documents by block, inverts each block and scores it. A query term is
   *short* when at most `short_fraction` of the documents hold it, *long* otherwise. Short lists are read
   term at a time into accumulators, one per (query, document of the block).
3. The threshold of a query is the k-th best exact score its task has found so far (1 without one, as only
   scores above 0 count). Long terms of a query, sorted by the highest impact they have in the block: those
   whose sum stays below the threshold are not essential. The lists of essential terms are read into the
   accumulators; a document that holds no short and no essential term cannot reach the threshold.
4. Document at a time: an accumulator that reaches the threshold together with all the non-essential terms
   is completed from its document's own postings and so gets its exact score; the others are dropped. Every
   task hands on its k best documents of each query, and the k best of these are the result. Nothing is
   sampled or capped, and nothing but those few rows is shuffled.

Score (all integer but the weight): terms are maximal runs of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]`
after lower-casing A-Z only; N documents have a term, L terms in all, n in one document, df documents
hold a term, tf times in one. w = floor(1000 ln((2N + 2) / (2df + 1))); m = 25 + (75 n N) div L;
score = sum over the query's terms, repeats included, of w * ((10^9 tf) div (1000 tf + 8 m)).

Defined cases: a null text has no terms (it counts in no statistic). Rows without doc_id count in the
statistics but are never returned. Repeated rows are separate documents: each counts in N, L and df and
each may be returned; equal scores rank by ascending doc_id, then by reading order. A query with a null or
termless text returns nothing; repeated query rows each get their result. Only scores above 0 are
returned, so a query may get fewer than k rows. Empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.work import LOWER, checked_join, saved

# Fixed: what a term is and the constants of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10

SHORT_FRACTION = 0.001  # a term held by at most this share of the documents is read term at a time
RUN_TERMS = 500_000  # (query, term) pairs of a run of queries
RUN_QUERIES = 5_000  # queries of a run
BLOCK_CELLS = 1 << 21  # accumulators of a block: queries x documents
BLOCK_DOCS = 4096  # documents of a block at most
TEXT_BYTES = 1 << 22  # bytes of text read at once (a longer text is read alone)

# What each byte of a text is read as: A-Z as a-z, other bytes of terms as they are, the rest as blanks.
BYTES = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], dtype=np.uint8)


def terms(text: Column) -> Column:
    """All terms of a text column, in order, repeats kept; null gives an empty array."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), *LOWER), F.lit(TERM), 0)


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `most` together; a larger row is a run of its own."""
    lo = 0
    ends = np.cumsum(sizes)
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def _postings(batch: pa.RecordBatch, wanted: pa.Array) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, n, codes, tfs) of the documents of a batch; codes are places in `wanted`."""
    whole = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    for lo, hi in _runs(pc.binary_length(whole).to_numpy(zero_copy_only=False).astype(np.int64), TEXT_BYTES):
        texts = pa.concat_arrays([whole.slice(lo, hi - lo)])
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
        first = int(np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + 1)[texts.offset])
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[first:first + ends[-1]]
        plain = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(ends), pa.py_buffer(BYTES[data].tobytes()))
        words = pc.ascii_split_whitespace(plain)
        flat = words.flatten()
        real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # blanks at an end of a text leave an empty one
        doc = np.repeat(np.arange(hi - lo), words.value_lengths().to_numpy(zero_copy_only=False))
        n = np.bincount(doc[real], minlength=hi - lo)
        code = pc.fill_null(pc.index_in(flat, value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        held = real & (code >= 0)
        cells, tf = np.unique(doc[held] * max(len(wanted), 1) + code[held], return_counts=True)
        d, c = np.divmod(cells, max(len(wanted), 1))
        starts = pa.array(np.searchsorted(d, np.arange(hi - lo + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()),
             pa.ListArray.from_arrays(starts, pa.array(c, pa.int32())), pa.ListArray.from_arrays(starts, pa.array(tf, pa.int64()))],
            names=["row", "doc_id", "n", "codes", "tfs"])


def build_index(docs: DataFrame, wanted: list[str]) -> tuple[DataFrame, int, int]:
    """Forward postings (row, doc_id, n, codes, tfs) of the `wanted` terms, one row per document, written to
    the shared folder, with N and L."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(wanted, pa.large_string())
        for batch in batches:
            yield from _postings(batch, known)

    postings = saved(rows.mapInArrow(read, "row long, doc_id long, n long, codes array<int>, tfs array<long>"))
    stats = postings.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    return postings, int(stats["N"]), int(stats["L"])


def query_terms(queries: DataFrame, key: str) -> DataFrame:
    """(qrow, key, term, q): each distinct term of each query row, q its repeats."""
    rows = queries.select(
        F.monotonically_increasing_id().alias("qrow"), F.col(key).alias("qkey"), terms(F.col("text")).alias("t"))
    return rows.select("qrow", "qkey", F.explode("t").alias("term")).groupBy("qrow", "qkey", "term").agg(
        F.count(F.lit(1)).alias("q"))


class _Scorer:
    """Scores the blocks of one task and keeps its k best documents of each query."""

    def __init__(self, q: np.ndarray, t: np.ndarray, times: np.ndarray, weights: np.ndarray, short: np.ndarray,
                 n_queries: int, n_docs: int, n_terms: int, k: int):
        order = np.argsort(t, kind="stable")  # the pairs of a term lie together
        self.q, self.t, self.times = q[order], t[order], times[order]
        self.weights, self.long = weights, ~short[self.t]
        self.n_queries, self.n_docs, self.n_terms, self.k = n_queries, n_docs, n_terms, k
        self.of_term = np.searchsorted(self.t, np.arange(len(weights) + 1))
        self.least = np.ones(n_queries, dtype=np.int64)  # the thresholds
        none = np.zeros(0, dtype=np.int64)
        self.top = (none, none, none, none)  # query, score, doc_id, row

    def block(self, row: np.ndarray, doc_id: np.ndarray, n: np.ndarray, starts: np.ndarray, code: np.ndarray, tf: np.ndarray) -> None:
        doc = np.repeat(np.arange(len(row)), np.diff(starts))
        m = 25 + (75 * n * self.n_docs) // max(self.n_terms, 1)
        impact = self.weights[code] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        inverted = np.argsort(code, kind="stable")
        lists = np.searchsorted(code[inverted], np.arange(len(self.weights) + 1))
        peak = np.zeros(len(self.weights), dtype=np.int64)
        np.maximum.at(peak, code, impact)
        # Long terms of each query in rising order of the most they add in this block.
        most = np.where(self.long, self.times * peak[self.t], 0)
        rising = np.lexsort((most, self.q))
        upto = np.cumsum(most[rising])
        heads = np.searchsorted(self.q[rising], np.arange(self.n_queries))
        before = np.concatenate([[0], upto])[heads]
        sums = np.empty_like(upto)
        sums[rising] = upto - before[self.q[rising]]
        essential = ~self.long | (sums >= self.least[self.q])
        spare = np.zeros(self.n_queries, dtype=np.int64)
        np.maximum.at(spare, self.q[~essential], sums[~essential])
        # Term at a time: the short lists and those of the essential terms.
        acc = np.zeros((self.n_queries, len(row)), dtype=np.int64)
        for term in np.unique(self.t[essential & (peak[self.t] > 0)]):
            a, b = self.of_term[term], self.of_term[term + 1]
            asked = np.flatnonzero(essential[a:b]) + a
            held = inverted[lists[term]:lists[term + 1]]
            acc[self.q[asked][:, None], doc[held]] += self.times[asked][:, None] * impact[held]
        # Document at a time: what can reach the threshold is completed.
        found_q, found_d = np.nonzero(acc + spare[:, None] >= self.least[:, None])
        score = acc[found_q, found_d]
        part = np.searchsorted(found_q, np.arange(self.n_queries + 1))
        rest = np.flatnonzero(~essential)
        rest = rest[np.argsort(self.q[rest], kind="stable")]
        cuts = np.searchsorted(self.q[rest], np.arange(self.n_queries + 1))
        times = np.zeros(len(self.weights), dtype=np.int64)
        for i in np.flatnonzero((np.diff(part) > 0) & (np.diff(cuts) > 0)):
            here, docs = rest[cuts[i]:cuts[i + 1]], found_d[part[i]:part[i + 1]]
            times[self.t[here]] = self.times[here]
            size = starts[docs + 1] - starts[docs]  # at least 1: a document without postings reaches nothing
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(starts[docs] - (ends - size), size)
            score[part[i]:part[i + 1]] += np.add.reduceat(impact[at] * times[code[at]], ends - size)
            times[self.t[here]] = 0
        good = score >= self.least[found_q]
        fresh = (found_q[good], score[good], doc_id[found_d[good]], row[found_d[good]])
        q, s, d, r = (np.concatenate(x) for x in zip(self.top, fresh))
        order = np.lexsort((r, d, -s, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = order[rank < self.k]
        self.top = (q[rank < self.k], s[kept], d[kept], r[kept])
        last = rank == self.k - 1
        self.least[q[last]] = np.maximum(s[order[last]], 1)


def _score(batches: Iterator[pa.RecordBatch], scorer: _Scorer) -> Iterator[pa.RecordBatch]:
    most = int(min(BLOCK_DOCS, max(64, BLOCK_CELLS // max(scorer.n_queries, 1))))
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            some = batch.slice(lo, most)
            row, doc_id, n = (some.column(c).to_numpy(zero_copy_only=False) for c in ("row", "doc_id", "n"))
            codes, tfs = some.column("codes"), some.column("tfs")
            starts = np.concatenate([[0], np.cumsum(codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
            scorer.block(row, doc_id, n, starts, codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                         tfs.flatten().to_numpy(zero_copy_only=False))
    q, s, d, r = scorer.top
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, d, r, s)], names=["query", "doc_id", "row", "score"])


def _search_run(docs: DataFrame, asked: DataFrame, k: int, short_fraction: float) -> DataFrame:
    """(qrow, doc_id, row, score): the k best documents of each task for each query of a run."""
    spark = docs.sparkSession
    table = asked.select("qrow", "term", "q").toArrow()  # a run, bounded
    names = pc.unique(table["term"])
    wanted, t = names.to_pylist(), pc.index_in(table["term"], value_set=names).to_numpy().astype(np.int64)
    numbers, q = np.unique(table["qrow"].to_numpy(), return_inverse=True)
    times = table["q"].to_numpy().astype(np.int64)
    postings, n_docs, n_terms = build_index(docs, wanted)
    df = postings.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    w = F.floor(F.lit(1000.0) * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    found = df.select("code", "df", w.alias("w")).toArrow()  # a row a term of the run
    weights, short = np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    weights[found["code"].to_numpy()] = found["w"].to_numpy()
    short[found["code"].to_numpy()] = found["df"].to_numpy() <= max(1.0, short_fraction * n_docs)
    with_terms = postings.where(F.col("doc_id").isNotNull() & (F.size("codes") > 0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _score(batches, _Scorer(q, t, times, weights, short, len(numbers), n_docs, n_terms, k))

    best = saved(with_terms.mapInArrow(score, "query long, doc_id long, row long, score long"))
    ids = spark.createDataFrame(pa.table({"query": np.arange(len(numbers)), "qrow": numbers}))
    return best.join(F.broadcast(ids), "query").select("qrow", "doc_id", "row", "score")


def search(docs: DataFrame, queries: DataFrame, key: str = "item_id", k: int = TOP, short_fraction: float = SHORT_FRACTION,
           run_terms: int = RUN_TERMS, run_queries: int = RUN_QUERIES) -> DataFrame:
    """(key, rank, doc_id, score): the k best documents of every query row; see the module text."""
    qt = saved(query_terms(queries, key))
    total = qt.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("qrow").alias("queries")).first()
    empty = qt.select(F.col("qkey").alias(key), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                      F.lit(0).cast("long").alias("score")).limit(0)
    if total["pairs"] == 0:
        return empty
    n_runs = max(-(-total["pairs"] // run_terms), -(-total["queries"] // run_queries))
    run = F.pmod(F.xxhash64("qrow"), F.lit(n_runs))
    found = [_search_run(docs, qt.where(run == i), k, short_fraction) for i in range(n_runs)]
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    top = every.withColumn("rank", F.row_number().over(
        Window.partitionBy("qrow").orderBy(F.desc("score"), "doc_id", "row"))).where(F.col("rank") <= k)
    keys = saved(qt.select("qrow", "qkey").distinct())
    return checked_join(top, keys, "qrow").select(F.col("qkey").alias(key), F.col("rank").cast("int"), "doc_id", "score")
