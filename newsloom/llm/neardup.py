"""Near-duplicates by a MinHash LSH forest, confirmed on the full shingle sets.

1. One pass over the texts gives each document its number of shingles, a 128-bit digest of
   its set, `TREES` signatures of `DEPTH` minima, and 128 one-bit minima. Documents of equal
   sets become one representative (their smallest id) from here on.
2. Forest: in each of the `TREES` signature orders, documents that share the first `ROOT`
   minima form a region, sorted by the following ones. The neighbours in that order are those
   with the longest common prefix, so the depth adapts to how crowded the region is. A candidate
   whose one-bit minima rule it out is skipped (at 0.8 one misses by chance with probability
   below 1e-9).
3. Direct neighbours are confirmed on the full sets; their links give components.
4. Then come neighbours up to `REACH` places apart that still lie in different components, and in
   regions wider than `REACH` every member outside the component of the region's hub, the
   document with the most direct neighbours, with that hub.
5. Regions wider than `REACH` that even then hold several components go through a prefix filter on
   their rarest shingles, which loses no link between these components.

A pair at the threshold of 0.8 shares no region of any tree with probability
(1 - 0.8**3)**24 = 3e-8. Copies are one row, and near copies are tied together by the neighbours and
hubs of 24 orders before anything is enumerated. What step 5 looks at grows with the square of a family
of different texts that lie just below the threshold; such pairs can only be told by looking at them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import bytewise as B
from newsloom.llm.work import checked_join, saved
from newsloom.operators.groups import connected_components

TREES, ROOT, DEPTH, REACH = 24, 3, 6, 6
BITS = 128
BLOCK = 1000  # documents of one shingle that meet in one step; those of more are dealt to blocks
MAX_DIFFERENT = 38  # of BITS one-bit minima; at a likeness of 0.8 the mean is 12.8, the deviation 3.4
_random = np.random.default_rng(17)
ODD = _random.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
TURN = _random.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def _runs(batch_texts, k: int):
    for first, end, data, at in B.chunks(batch_texts):
        starts, words = B.word_starts(data, at)
        yield first, end, *B.sequence_hashes(B.word_hashes(data, starts), words, k)


def _signatures(runs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Region keys and sort keys (rows x TREES), one-bit minima (rows x 2) of rows that all have runs."""
    x = (runs >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((len(at) - 1, TREES * DEPTH), np.uint32)
    for j in range(TREES * DEPTH):
        minima[:, j] = np.minimum.reduceat((x * ODD[j]) ^ TURN[j], at[:-1])
    trees = minima.reshape(-1, TREES, DEPTH).astype(np.uint64)
    region = np.zeros(trees.shape[:2], np.uint64) + np.arange(1, TREES + 1, dtype=np.uint64)
    for d in range(ROOT):
        region = B.mixed(region + trees[:, :, d] * B.PLACE[d])
    order = np.zeros_like(region)
    for d in range(ROOT, DEPTH):
        order = (order << np.uint64(21)) | (B.mixed(trees[:, :, d]) >> np.uint64(43))
    bit = (B.mixed(minima[:, :BITS].astype(np.uint64)) & np.uint64(1)).reshape(-1, BITS // 64, 64)
    bits = (bit << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    return region.view(np.int64), order.view(np.int64), bits.view(np.int64)


SIGNED = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, b1 bigint, b2 bigint, region binary, place binary"


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, end, runs, at in _runs(batch.column("text"), k):
                n = np.diff(at)
                size = np.zeros(end - first, np.int64)
                digest = np.zeros((end - first, 2), np.int64)
                for i in np.flatnonzero(n):
                    own = np.unique(runs[at[i] : at[i + 1]])
                    size[i] = len(own)
                    digest[i] = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                some = np.flatnonzero(n)
                bits = np.zeros((end - first, 2), np.int64)
                region = [None] * (end - first)
                place = [None] * (end - first)
                if len(some):
                    keys, order, b = _signatures(runs, np.append(at[some], len(runs)))
                    bits[some] = b
                    for row, i in enumerate(some):
                        region[i], place[i] = keys[row].tobytes(), order[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first).cast(pa.int64()), pa.array(size), pa.array(digest[:, 0]),
                     pa.array(digest[:, 1]), pa.array(bits[:, 0]), pa.array(bits[:, 1]),
                     pa.array(region, pa.binary()), pa.array(place, pa.binary())],
                    names=["doc_id", "n_shingles", "d1", "d2", "b1", "b2", "region", "place"])
    return run


TREE_ROWS = "region bigint, place bigint, id bigint, n bigint, b1 bigint, b2 bigint"


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and tree; a column `group` is handed on."""
    for batch in batches:
        for first in range(0, batch.num_rows, 2000):
            part = batch.slice(first, 2000)
            keys = b"".join(part.column("region").to_pylist())
            order = b"".join(part.column("place").to_pylist())
            again = lambda c: pa.array(np.repeat(part.column(c).to_numpy(zero_copy_only=False), TREES))
            own = ["doc_id", "n_shingles", "b1", "b2", *(["group"] if "group" in part.schema.names else [])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(order, np.int64)), *map(again, own)],
                names=["region", "place", "id", "n", *own[2:]])


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, runs, at in _runs(batch.column("text"), k):
                own = [np.unique(runs[a:b]).view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first).cast(pa.int64()),
                     pa.array(own, pa.list_(pa.int64()))], names=["id", "shingles"])
    return run


def _alike(a: str, b: str) -> Column:
    """False where the one-bit minima rule out that two documents are alike."""
    differ = F.bit_count(F.col(f"{a}.b1").bitwiseXOR(F.col(f"{b}.b1"))) + F.bit_count(
        F.col(f"{a}.b2").bitwiseXOR(F.col(f"{b}.b2")))
    return differ <= MAX_DIFFERENT


def _neighbours(percent: int, gaps: range):
    """Pairs `gaps` rows apart in one region; the rows come in order of region and place.

    With a column `group`, pairs of one group are left out.
    """
    reach = gaps[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the rows before this batch
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            begin = 0
            if last is not None:
                begin = last.shape[1]
                rows = np.concatenate([last, rows], axis=1)
            out = []
            for gap in gaps:
                y = np.arange(max(begin, gap), rows.shape[1])
                y = y[rows[0, y] == rows[0, y - gap]]
                x = y - gap
                small, large = np.minimum(rows[2, x], rows[2, y]), np.maximum(rows[2, x], rows[2, y])
                bits = np.bitwise_count((rows[3:5, x] ^ rows[3:5, y]).view(np.uint64))
                use = (small * 100 >= large * percent) & (bits[0].astype(np.int64) + bits[1] <= MAX_DIFFERENT) & (rows[1, x] != rows[1, y])
                if len(rows) > 5:
                    use &= rows[5, x] != rows[5, y]
                x, y = x[use], y[use]
                out.append([np.minimum(rows[1, x], rows[1, y]), np.maximum(rows[1, x], rows[1, y])])
            last = rows[:, -reach:]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def _candidates(rows: DataFrame, percent: int, gaps: range) -> DataFrame:
    """`a, b` of neighbours in the signature orders, each pair once.

    One sort by ranges over all orders, so that a region of any size is spread over tasks. Where a range ends inside a
    region, the pairs across that place are not seen in this order; the other orders have them.
    """
    ordered = rows.repartitionByRange("region", "place", "id").sortWithinPartitions("region", "place", "id")
    return ordered.drop("place").mapInArrow(_neighbours(percent, gaps), "a bigint, b bigint").distinct()


def _with_hubs(rows: DataFrame, pairs: DataFrame, reach: int) -> DataFrame:
    """`a, b`: the members of crowded regions with the one of them that has the most direct neighbours in all orders.

    `rows` has the group of each document; a region of a single group needs no hub.
    """
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    known = checked_join(
        rows.select("region", "group", F.struct("id", "n", "b1", "b2").alias("x")), saved(degree), F.col("x.id") == F.col("id"), "left"
    ).withColumn("degree", F.coalesce("degree", F.lit(0)))
    hubs = saved(
        known.groupBy("region").agg(
            F.count(F.lit(1)).alias("m"), F.min("group").alias("lo"), F.max("group").alias("hi"),
            F.max(F.struct("degree", "x", "group")).alias("hub"))
        .where((F.col("m") > reach) & (F.col("lo") != F.col("hi")))
        .select("region", F.col("hub.x").alias("y"), F.col("hub.group").alias("hub_group")))
    return checked_join(known, hubs, "region").where((F.col("group") != F.col("hub_group")) & _alike("x", "y")).select(
        F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _sets_of(texts: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """`id, shingles` of the documents in the pairs."""
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    return saved(
        checked_join(texts, ids, "doc_id", "left_semi").mapInArrow(_sets(words), "id bigint, shingles array<bigint>"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs `a, b` whose sets really are that alike."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.select("a", "b").join(one, "a").join(two, "b")
        .where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent)
        .select("a", "b")
    )


def _renamed(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs `a, b` with the components `ga, gb` of both sides, where these differ."""
    one = labels.select(F.col("id").alias("a"), F.col("group").alias("ga"))
    two = labels.select(F.col("id").alias("b"), F.col("group").alias("gb"))
    joined = pairs.join(one, "a", "left").join(two, "b", "left")
    return joined.select("a", "b", F.coalesce("ga", "a").alias("ga"), F.coalesce("gb", "b").alias("gb")).where("ga <> gb")


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links.select(F.col("a").alias("id_a"), F.col("b").alias("id_b")))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`id, group` after further links; these join few components, so the large graph isn't walked again."""
    over = saved(_renamed(links, labels))
    if over.isEmpty():
        return labels
    joined = connected_components(over.select(F.col("ga").alias("id_a"), F.col("gb").alias("id_b"))).select(
        F.col("id").alias("group"), F.col("group").alias("to"))
    ends = over.select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.col("ga").alias("group")),
        F.struct(F.col("b").alias("id"), F.col("gb").alias("group")))).alias("x")).select("x.*")
    known = labels.unionByName(ends).distinct()
    return saved(known.join(joined, "group", "left").select("id", F.coalesce("to", "group").alias("group")))


POSTING = "s bigint, p int, q int, block int, id bigint, at bigint, n bigint, b1 bigint, b2 bigint, group bigint"


def _met(percent: int):
    """Pairs of documents that meet in one shingle and pair of blocks; the rows (`POSTING`) come in order of these.

    `at` is the shingle's place among the document's, rarest first. Of the shingles that two documents share, the first
    has all others behind it in both; where too few are behind it, the pair isn't alike or meets in an earlier one.
    """

    def pairs(rows: np.ndarray) -> pa.RecordBatch:
        new = np.append(True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0))
        begin = np.flatnonzero(new)
        inside = np.arange(rows.shape[1]) - begin[np.cumsum(new) - 1]
        _, p, q, block, ids, at, n, b1, b2, group = rows
        out = [np.zeros((2, 0), np.int64)]
        y = np.flatnonzero(inside >= 1)
        gap = 1
        while len(y):
            x = y - gap
            need = (percent * (n[x] + n[y]) + 99 + percent) // (100 + percent)
            use = (np.minimum(n[x] - at[x], n[y] - at[y]) >= need) & (group[x] != group[y]) & ((p[x] == q[x]) | (block[x] != block[y]))
            u, v = x[use], y[use]
            differ = np.bitwise_count((b1[u] ^ b1[v]).view(np.uint64)).astype(np.int64) + np.bitwise_count((b2[u] ^ b2[v]).view(np.uint64))
            u, v = ids[u[differ <= MAX_DIFFERENT]], ids[v[differ <= MAX_DIFFERENT]]
            out.append(np.stack([np.minimum(u, v), np.maximum(u, v)]))
            gap += 1
            y = y[inside[y] >= gap]
        found = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((10, 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
            end = np.flatnonzero((rows[:3] != rows[:3, -1:]).any(axis=0))
            end = int(end[-1]) + 1 if len(end) else 0  # the last group may go on in the next batch
            if end:
                yield pairs(rows[:, :end])
            rest = rows[:, end:]
        if rest.shape[1]:
            yield pairs(rest)

    return run


def _rest(texts: DataFrame, rows: DataFrame, words: int, percent: int, reach: int) -> DataFrame | None:
    """Links between different groups inside regions wider than `reach`: all of them, by a prefix filter.

    Only documents of such regions that hold several groups take part. A shingle all of whose holders are in one group
    can't link two; such shingles come first in a document's order, then the rarest.
    """
    crowded = saved(
        rows.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.min("group").alias("lo"), F.max("group").alias("hi"))
        .where((F.col("m") > reach) & (F.col("lo") != F.col("hi"))).select("region"))
    docs = saved(
        checked_join(rows, crowded, "region", "left_semi").groupBy("id")
        .agg(*[F.first(c).alias(c) for c in ("n", "b1", "b2", "group")]))
    if docs.isEmpty():
        return None
    ids = saved(docs.select(F.col("id").alias("doc_id")))
    sets = saved(
        checked_join(texts, ids, "doc_id", "left_semi").mapInArrow(_sets(words), "id bigint, shingles array<bigint>")
        .dropDuplicates(["id"]))
    each = saved(sets.join(docs.select("id", "group"), "id").select("id", "group", F.explode("shingles").alias("s")))
    counts = each.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("group").alias("lo"), F.max("group").alias("hi")).where(
        "lo <> hi").select("s", "df")
    ranked = each.select("id", "s").join(counts, "s", "left").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s"))).alias("all"))
    size = F.size("all")
    prefix = ranked.select("id", F.posexplode(F.slice("all", F.lit(1), (size - F.floor((size * percent + 99) / 100) + 1).cast("int"))))
    postings = prefix.where("col.df > 1").select("id", F.col("pos").cast("bigint").alias("at"), "col.s", "col.df").join(docs, "id")
    blocks = F.ceil(F.col("df") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = postings.withColumn("blocks", blocks).withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    names = [c.split()[0] for c in POSTING.split(", ")]
    met = dealt.select(*names).repartition("s", "p", "q").sortWithinPartitions("s", "p", "q").mapInArrow(
        _met(percent), "a bigint, b bigint")
    return _confirmed(saved(met.distinct()), sets, percent)


def near_duplicates(
    documents: DataFrame, *, words: int = 5, percent: int = 80, reach: int = REACH
) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept` of every document.

    A document's set: its distinct runs of `words` words (A-Z lower-cased, split at ASCII white space);
    with fewer words the whole sequence; null texts and texts without words have none and link with
    nothing. Documents are linked when 100 * |intersection| >= percent * |union|; a component is named
    by its smallest doc_id, which is the one kept. Rows that repeat a doc_id are one document: each
    row is returned, with the component of that id. A row without doc_id has no component (null) and
    is kept. Other columns are ignored.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = saved(texts.mapInArrow(_sign(words), SIGNED))
    whole = F.struct("doc_id", "n_shingles", "b1", "b2", "region", "place")
    same = saved(
        signed.where("doc_id is not null and n_shingles > 0").groupBy("d1", "d2").agg(F.min(whole).alias("rep")))
    rows = same.select("rep.*").mapInArrow(_trees, TREE_ROWS)
    close = saved(_candidates(rows, percent, range(1, 2)))
    sets = _sets_of(texts, close, words)
    labels = saved(_components(_confirmed(close, sets, percent)))
    # whatever still lies in different components: neighbours further apart, and hubs
    grouped = same.select("rep.*").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn(
        "group", F.coalesce("group", "doc_id"))
    rows = grouped.mapInArrow(_trees, f"{TREE_ROWS}, group bigint")
    further = _candidates(rows, percent, range(2, reach + 1)).unionByName(_with_hubs(rows, close, reach))
    further = saved(further.distinct().join(close, ["a", "b"], "left_anti"))
    if not further.isEmpty():
        labels = _merged(labels, _confirmed(further, _sets_of(texts, further, words), percent))
    # what crowded regions still hold in different components
    grouped = same.select("rep.*").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn(
        "group", F.coalesce("group", "doc_id"))
    rest = _rest(texts, grouped.mapInArrow(_trees, f"{TREE_ROWS}, group bigint"), words, percent, reach)
    labels = labels if rest is None else _merged(labels, rest)
    labels = labels.select(F.col("id").alias("rep"), "group")
    named = same.select("d1", "d2", F.col("rep.doc_id").alias("rep")).join(labels, "rep", "left").select(
        "d1", "d2", F.coalesce("group", "rep").alias("group"))
    found = signed.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
