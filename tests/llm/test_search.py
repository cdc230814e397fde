"""op12: the hybrid search against a plain scoring loop, with every split of short and long lists."""

import math
import re
from collections import Counter

import pytest

from newsloom.llm.lexsearch import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(t):
    return TERM.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items, k):
    tfs = [Counter(words(t)) for _, t in docs]
    n = [sum(c.values()) for c in tfs]
    N = sum(1 for x in n if x)
    L = sum(n)
    df = Counter(t for c in tfs for t in c)
    out = []
    for item_id, q in items:
        scores = []
        for r, ((doc_id, _), c) in enumerate(zip(docs, tfs)):
            m = 25 + (75 * n[r] * N) // max(L, 1)
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in words(q) if c[t])
            if s > 0 and doc_id is not None:
                scores.append((-s, doc_id, r))
        for rank, (s, d, _) in enumerate(sorted(scores)[:k], 1):
            out.append((item_id, rank, d, -s))
    return sorted(out)


DOCS = [
    (1, "the cat sat on the mat"), (2, "The Cat, the dog; the BIRD."), (3, "dog dog dog ÄBC äbc"),
    (4, None), (5, ""), (None, "cat cat cat cat"), (6, "the the the the the the the"), (6, "the the the the the the the"),
    (7, "a mat of cats and dogs"), (8, "bird 42 x42 42x"), (9, "zebra " * 50), (10, "cat mat bird dog zebra the"),
]
ITEMS = [(100, "cat mat"), (101, "the dog the"), (102, None), (103, "42 ÄBC zebra"), (104, "nothing here"), (100, "bird")]


@pytest.mark.parametrize("fraction", [0.0, 0.2, 1.0])
@pytest.mark.parametrize("k", [1, 3, 10])
def test_search_equals_a_loop(spark, fraction, k):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(tuple(r) for r in search(docs, items, k=k, short_fraction=fraction).collect())
    assert got == brute(DOCS, ITEMS, k)


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "cat")], "item_id long, text string")
    assert search(none, items).count() == 0
    docs = spark.createDataFrame([(1, "cat", 9, 9)], "doc_id long, text string, row long, term long")
    clash = spark.createDataFrame([(1, "cat", 3)], "item_id long, text string, qrow long")
    assert [tuple(r) for r in search(docs, clash).collect()] == [(1, 1, 1, brute([(1, "cat")], [(1, "cat")], 10)[0][3])]


@pytest.mark.parametrize("fraction", [0.02, 0.1])
def test_search_equals_a_loop_on_a_skewed_vocabulary(spark, fraction):
    import random

    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rnd.choices(vocab, weights, k=rnd.randint(0, 80)))) for i in range(300)]
    items = [(j, " ".join(rnd.choices(vocab, weights, k=rnd.randint(1, 12)))) for j in range(25)]
    got = sorted(tuple(r) for r in search(spark.createDataFrame(docs, "doc_id long, text string"),
                                          spark.createDataFrame(items, "item_id long, text string"),
                                          k=5, short_fraction=fraction).collect())
    assert got == brute(docs, items, 5)


def test_runs_of_queries_give_the_same(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(DOCS, ITEMS, 3)
    assert sorted(tuple(r) for r in search(docs, items, k=3, run_terms=2).collect()) == want
    assert sorted(tuple(r) for r in search(docs, items, k=3, run_queries=2, short_fraction=0.0).collect()) == want


@pytest.mark.parametrize("short", [0, 5, 40])
@pytest.mark.parametrize("per_block", [1, 7, 100])
def test_blocks_with_thresholds_equal_a_loop(short, per_block):
    import random

    import numpy as np
    import pyarrow as pa

    from newsloom.llm.lexsearch import _postings, _score, _Scorer

    rnd = random.Random(per_block + short)
    vocab = [f"W{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    docs = [(i // 2, " ".join(rnd.choices(vocab, weights, k=rnd.randint(0, 60)))) for i in range(300)]
    items = [(j, " ".join(rnd.choices(vocab, weights, k=rnd.randint(1, 15)))) for j in range(20)]
    tfs = [Counter(words(t)) for _, t in docs]
    df = Counter(t for c in tfs for t in c)
    n_docs, n_terms = sum(1 for c in tfs if c), sum(sum(c.values()) for c in tfs)
    names = sorted({t for _, q in items for t in words(q)} & set(df))
    pairs = [(j, names.index(t), x) for j, q in items for t, x in Counter(words(q)).items() if t in df]
    q, t, x = (np.array(c, dtype=np.int64) for c in zip(*pairs))
    w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[a] + 1))) for a in names])
    scorer = _Scorer(q, t, x, w, np.array([df[a] <= short for a in names]), len(items), n_docs, n_terms, 4)
    table = pa.record_batch({"row": pa.array(range(len(docs))), "doc_id": pa.array([d for d, _ in docs], pa.int64()),
                             "text": pa.array([x for _, x in docs])})
    found = [p.slice(i, per_block) for p in _postings(table, pa.array(names, pa.large_string())) for i in range(0, p.num_rows, per_block)]
    (best,) = _score(iter(found), scorer)
    got, rank = [], Counter()
    for r in best.to_pylist():
        rank[r["query"]] += 1
        got.append((r["query"], rank[r["query"]], r["doc_id"], r["score"]))
    assert got == brute(docs, items, 4)


def test_only_the_best_documents_of_a_task_are_handed_on(spark):
    """The look-ups of the lists used to shuffle a row for each candidate and term."""
    import random

    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rnd.choices(vocab, k=60))) for i in range(400)]
    items = [(j, " ".join(rnd.sample(vocab, 30))) for j in range(8)]
    got = search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") <= 2 and "Aggregate" not in plan  # the tasks' best rows and the queries' keys
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, items, 5)
