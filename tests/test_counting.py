"""Counts over arrays of tokens, without a session."""

from collections import Counter

import pyarrow as pa

from newsloom.functions import counting


def test_grams_of_rows_equal_a_loop(monkeypatch):
    monkeypatch.setattr(counting, "RUN_TOKENS", 3)
    rows = [["a", "b", "a", "b"], [], None, ["a"], ["b", "a", "b", "c", "a", "b"], ["c", "a"]]
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4, None, 6], "text": pa.array(rows, pa.list_(pa.string()))})
    want = Counter()
    for i, words in zip(batch.column("id").to_pylist(), rows):
        for n in (1, 2, 3):
            want.update((i, " ".join(words[k:k + n])) for k in range(len(words or []) - n + 1))
    got = [r for run in counting.gram_batches(iter([batch]), ["text"], ["id"], 1, 3) for r in run.to_pylist()]
    assert {(r["id"], r["term"]): r["tf"] for r in got} == dict(want) and len(got) == len(want)
    shared = Counter()
    for run in counting.shared_grams(iter([batch]), ["text"], 1, 3, None):
        shared.update({r["term"]: r["df"] for r in run.to_pylist()})
    assert shared == Counter(term for _, term in want)
