"""The pipeline's stages, each against brute force on its own input, and the SQL of the registered queries."""

import importlib.util
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline as P
from newsloom.llm.mixing import mixed
from newsloom.llm.queries import QUERIES, SQL

_spec = importlib.util.spec_from_file_location("llm_duplicates", Path(__file__).parent / "test_duplicates.py")
D = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(D)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_give_the_rows_of_their_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())


def test_stages_on_the_small_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in P.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns + ["copy"] * (name == "mix")
        seen.append(docs.collect())
    raw, spoken, lined, single, clean, mix = seen
    assert {r["doc_id"] for r in spoken} == {r["doc_id"] for r in raw if any(c.isalpha() for c in r["text"])}
    want = {i: sha for i, _, _, sha in D.brute_lines([(r["doc_id"], r["text"]) for r in spoken])}
    assert {r["doc_id"]: D.hashlib.sha256(r["text"].encode()).hexdigest() for r in lined} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lined)
    groups = D.brute([(r["doc_id"], r["text"]) for r in lined], 5)
    assert {r["doc_id"] for r in single} == {i for i, v in groups.items() if v[2]}
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    runs = {tuple(w[i : i + 9]) for w in items for i in range(len(w) - 8)}
    for r in single:
        w = r["text"].lower().split()
        leak = any(tuple(w[i : i + 9]) in runs for i in range(len(w) - 8))
        assert not (leak and r["doc_id"] in {x["doc_id"] for x in clean})
    assert {r["doc_id"] for r in clean} <= {r["doc_id"] for r in single} and len(clean) > 0.9 * len(single)
    copies = {r["doc_id"]: r["copies"] for r in mixed(spark.read.parquet(str(tmp_path / "decontaminate"))).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in mix) == copies


def test_stages_on_odd_rows(spark, sf):
    """Nulls, repeated rows, further columns, an empty table."""
    odd = spark.createDataFrame(
        [(1, None, None, None, None, "e", 1), (2, "", "en", "s", 0, "e", 2), (2, "", "en", "s", 0, "e", 2), (None, "some words here", "en", None, 15, None, 3),
         (4, "12 34", "en", "s", 5, "e", 4), (5, "a word " * 20_000, "en", "s", 140_000, "e", 5), (5, "a word " * 20_000, "en", "s", 140_000, "e", 5)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, copies string, kept int")
    for docs in (odd, odd.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns + ["copy"] * (name == "mix")
            assert (out.count() > 0) == (docs is odd)


def test_run_is_the_last_stage(spark, sf):
    out = P.run(spark, sf)
    assert out.count() > 0 and out.columns[-1] == "copy"
