"""Duplicates, near-duplicates, groups and the joins under them, on small hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.functions.scale import dense_ids, hot_keys, salted_join
from newsloom.operators import dedup, groups, similarity
from newsloom.plans.dedup import apply_marks, deduplicate

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "id long, title string, content string, published timestamp"


def rows(spark, items):
    """(id, title, content, day)"""
    return spark.createDataFrame([(i, t, c, DAY + dt.timedelta(days=d)) for i, t, c, d in items], SCHEMA)


def test_exact_duplicates_ignore_case_and_blanks(spark):
    df = rows(spark, [(1, "a", "Some  text", 0), (2, "b", "some text ", 3), (3, "c", "other", 1)])
    got = {r.id: (r.survivor_id, r.is_duplicate, r.copies) for r in dedup.exact_duplicates(df).collect()}
    assert got == {1: (2, True, 2), 2: (2, False, 2), 3: (3, False, 1)}
    oldest = {r.id: r.is_duplicate for r in dedup.exact_duplicates(df, keep_newest=False).collect()}
    assert oldest == {1: False, 2: True, 3: False}


def test_exact_duplicates_with_a_hot_fingerprint(spark):
    df = spark.range(3000).select(
        "id", F.lit("t").alias("title"),
        F.when(F.col("id") % 3 == 0, "copied").otherwise(F.col("id").cast("string")).alias("content"),
        F.lit(DAY).alias("published"),
    )
    got = dedup.exact_duplicates(df, min_rows=10, slots=50)
    assert got.where("is_duplicate").count() == 999
    assert {r.survivor_id for r in got.where("copies > 1").select("survivor_id").distinct().collect()} == {2997}


def test_salted_join_equals_plain_join(spark):
    left = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 20).alias("k"), "id"
    )
    right = spark.range(15).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.join(right, "k", how)
        salted = salted_join(left, right, ["k"], how, spread=["id"], slots=10, min_rows=0)
        assert sorted(map(tuple, salted.select(*plain.columns).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_there_are_fewer_hot_keys_than_slots(spark):
    counts = spark.range(100).select(F.col("id").alias("k"), F.lit(5).alias("n"))
    assert hot_keys(counts, slots=100, min_rows=0).count() == 0  # none has more than 1/100
    assert hot_keys(counts, slots=101, min_rows=0).count() <= 101


def test_dense_ids_are_consecutive_and_repeatable(spark):
    df = spark.range(500).select(F.concat(F.lit("u"), "id").alias("url"))
    one = {r.url: r.id for r in dense_ids(df, "url", 10).collect()}
    two = {r.url: r.id for r in dense_ids(df.repartition(13), "url", 10).collect()}
    assert one == two and sorted(one.values()) == list(range(11, 511))


WORDS = [f"word{i}x" for i in range(40)]


def text(*numbers):
    return " ".join(WORDS[n] for n in numbers)


def near_rows(spark):
    base = list(range(0, 20))
    return rows(spark, [
        (1, "alpha beta gamma", text(*base), 0),
        (2, "alpha beta gamma", text(*base[:-1], 30), 1),  # almost the same
        (3, "alpha beta gamma", text(*base), 9),  # same words, 9 and 8 days away
        (4, "delta epsilon", text(*range(20, 36)), 0),
        (5, "delta epsilon", text(*range(20, 36)), 7),  # same words, exactly 7 days later
        (6, "", "", 2),
        (7, "zeta", text(1, 22, 5), 2),
        (8, "Delta, Epsilon!", text(*range(20, 36)), 0),  # same words as 4 on the same day
    ])


def brute_force(df, threshold, within, **w):
    """All pairs from full vectors, compared one by one in Python."""
    reps = similarity.representatives(df, stop_words=[])
    heads = reps.where("id = rep_id").select("id", "copies")
    docs = df.select("id", "title", "content", F.to_date("published").alias("day")).join(heads, "id")
    vectors = {}
    for r in similarity.article_vectors(docs, stop_words=[], **w).collect():
        vectors.setdefault((r.id, r.day), {})[r.term] = r.w
    found = set()
    for (a, da), va in vectors.items():
        for (b, db), vb in vectors.items():
            if a < b and abs((da - db).days) <= within:
                s = round(sum(x * vb.get(t, 0.0) for t, x in va.items()), 6)
                if s >= threshold:
                    found.add((a, b, s))
    return found


@pytest.mark.parametrize("use_min_hash", [False, True])
def test_near_duplicates_equal_brute_force(spark, use_min_hash):
    df = near_rows(spark)
    want = brute_force(df, 0.75, 7)
    got = {tuple(r) for r in similarity.near_duplicates(df, use_min_hash=use_min_hash, stop_words=[]).collect()}
    assert got == want and any({a, b} == {1, 2} for a, b, _ in got) and any({a, b} == {4, 5} for a, b, _ in got)
    assert not any({a, b} == {1, 3} for a, b, _ in got)


def test_near_duplicates_with_hot_terms_and_crowded_buckets(spark):
    """Forced salting changes nothing; min-hash finds the exact candidates here with its default
    bucket size, and with buckets that all count as crowded it still runs and splits them."""
    df = near_rows(spark)
    want = {tuple(r) for r in similarity.near_duplicates(df, use_min_hash=False, stop_words=[]).collect()}
    hot = similarity.near_duplicates(df, use_min_hash=False, stop_words=[], min_rows=0, slots=20)
    assert {tuple(r) for r in hot.collect()} == want
    reps = similarity.representatives(df, stop_words=[])
    docs = df.select("id", "title", "content", F.to_date("published").alias("day")).join(
        reps.where("id = rep_id").select("id", "copies"), "id")
    vectors = similarity.article_vectors(docs, stop_words=[])
    found = similarity.minhash_candidates(vectors, threshold=0.75, within_days=7)
    exact = similarity.exact_candidates(vectors, threshold=0.75, within_days=7)
    assert {tuple(r) for r in found.collect()} >= {tuple(r) for r in exact.collect()}
    crowded = similarity.minhash_candidates(vectors, threshold=0.75, within_days=7, max_bucket=1)
    assert {tuple(r) for r in crowded.collect()} <= {tuple(r) for r in found.collect()} | {tuple(r) for r in exact.collect()}


def test_crowded_buckets_lose_no_pair(spark):
    """A bucket beyond `max_bucket` used to be dealt at random into parts, and partners in other parts were lost."""
    same = text(*range(30))
    df = rows(spark, [(i, f"alpha beta {i % 3}", f"{same} only{i} only{i}x", i % 2) for i in range(40)]
              + [(100 + i, f"other {i}", f"apart{i} far{i}", 20) for i in range(10)])
    vectors = similarity.representative_vectors(df, stop_words=[]).localCheckpoint()
    limits = {"threshold": 0.75, "within_days": 7}
    found = {tuple(r) for r in similarity.minhash_candidates(vectors, **limits, max_bucket=3).collect()}
    want = {tuple(r) for r in similarity.near_duplicates(df, stop_words=[]).collect()}
    assert len([p for p in want if max(p[:2]) < 40]) == 40 * 39 / 2 and {(min(p), max(p)) for p in found} >= {(a, b) for a, b, _ in want}
    hashed = similarity.near_duplicates(df, stop_words=[], use_min_hash=True, vectors=vectors)
    assert {tuple(r) for r in hashed.collect()} == want


def test_samples_are_shared_by_similarity():
    import numpy as np

    from newsloom.functions.vectors import mixed, sampled

    key = mixed(np.arange(1, 41, dtype=np.uint64)).view(np.int64)
    w = np.linspace(0.5, 2, 40).astype(np.float32)
    two = np.concatenate([key[:30], key[10:]]), np.concatenate([w[:30], w[10:]])
    begins = np.array([0, 30])
    hits = np.mean([np.unique(sampled(*two, begins, i)).size == 1 for i in range(4000)])
    a, b = (np.where(np.arange(40) < 30, w, 0), np.where(np.arange(40) >= 10, w, 0))
    both = [i for i in range(40) if a[i] and b[i]]
    with np.errstate(divide="ignore"):
        want = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in both)
    assert abs(hits - want) < 0.03


def test_packed_vectors_hold_the_vectors_of_all_articles(spark):
    """One row per article, with the weights of the long form; the vocabulary sent to the tasks or joined."""
    df = near_rows(spark).unionByName(rows(spark, [(4, "delta epsilon", text(*range(20, 36)), 0), (9, "", "", 2), (9, "", "", 2)]))
    docs = df.select("id", "title", "content", F.to_date("published").alias("day"), F.lit(1).alias("copies"))
    want = {}
    for r in similarity.article_vectors(docs, stop_words=[]).collect():
        want.setdefault(r.id, []).append((r.df, round(r.w, 9)))
    for options in ({}, {"max_sent": 0}, {"min_rows": 0, "slots": 20}):
        got = similarity.packed_vectors(docs, stop_words=[], **options).collect()
        assert len(got) == docs.select("id").distinct().count()
        assert {r.id: sorted(zip(r.dfs, [round(w, 9) for w in r.ws])) for r in got} == {k: sorted(v) for k, v in want.items()}
    short = similarity.packed_vectors(docs.dropDuplicates(["id"]), stop_words=[], min_df=1, drop_lone=True).collect()
    assert all(d != 1 for r in short for d in r.dfs)


def test_a_large_vocabulary_is_mapped_in_slices(spark):
    """Terms beyond the size that is sent whole used to be shuffled, a row each."""
    import numpy as np

    from newsloom.functions.vectors import looked_up, slices_held
    from newsloom.operators.similarity import _sent_slices

    key = np.random.default_rng(1).integers(-2**63, 2**63, 500)
    vocab = spark.createDataFrame([(int(k), 2 + i, 1 + i % 2) for i, k in enumerate(key)], "key long, df long, n long")
    held = slices_held(_sent_slices(vocab, most=100))
    assert len(held) == 8 and sum(len(names) for names, _ in held) == 500
    asked = np.concatenate([key[::-1], key + 1])
    hit, df, n = looked_up(asked, held)
    assert hit.tolist() == [True] * 500 + [False] * 500 and df.tolist() == [*range(501, 1, -1)] and n.tolist() == [2, 1] * 250
    docs = near_rows(spark).select("id", "title", "content", F.to_date("published").alias("day"), F.lit(1).alias("copies"))
    plan = similarity.packed_vectors(docs, stop_words=[], max_sent=0)._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_packed_candidates_and_pairs_equal_the_long_form(spark):
    df = near_rows(spark).unionByName(rows(spark, [(9, "", "", 2), (10, "Zeta!", text(1, 22, 5), 4)]))
    docs = df.select("id", "title", "content", F.when(F.col("id") != 5, F.to_date("published")).alias("day"), F.lit(1).alias("copies"))
    long_, packed = (f(docs, stop_words=[]) for f in (similarity.article_vectors, similarity.packed_vectors))
    for days in (7, None):
        limits = {"threshold": 0.6, "within_days": days}
        old, new = similarity.exact_candidates(long_, **limits), similarity.packed_candidates(packed, **limits)
        pairs = {tuple(r) for r in similarity.verify(old, long_, threshold=0.6).collect()}
        assert {tuple(r) for r in similarity.packed_verify(new, packed, threshold=0.6).collect()} == pairs and len(pairs) > 2
    assert {tuple(r) for r in similarity.packed_verify(new, packed, threshold=0.6, most_together=1, min_rows=0, slots=20).collect()} == pairs


def test_title_only_weight_still_finds_candidates(spark):
    df = rows(spark, [(1, "alpha beta gamma", "one two", 0), (2, "alpha beta gamma", "three four", 0), (3, "x", "y", 0), (4, "other words", "five six", 0)])
    got = similarity.near_duplicates(df, title_weight=0.8, content_weight=0.2, threshold=0.75, use_min_hash=False, stop_words=[])
    assert [(r.id_a, r.id_b) for r in got.collect()] == [(1, 2)]


def test_empty_vocabulary(spark):
    df = rows(spark, [(1, "a b", "one two", 0), (2, "c d", "three four", 0)])
    assert similarity.near_duplicates(df, stop_words=[]).count() == 0


def test_components_of_a_chain_a_star_and_pairs(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(201, 200)]
    df = spark.createDataFrame(edges, "id_a long, id_b long")
    for options in ({}, {"min_rows": 0, "slots": 30}):
        got = {r.id: r.group for r in groups.connected_components(df, **options).collect()}
        assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_components_without_edges(spark):
    assert groups.connected_components(spark.createDataFrame([], "id_a long, id_b long")).count() == 0


def test_dedup_run_marks_and_groups(spark):
    df = near_rows(spark).withColumn("content_hash", F.lit(None).cast("string")).drop("content_hash")
    run = deduplicate(df, as_of="2024-02-01", stop_words=[], use_min_hash=False)
    group = {r.id: r.similarity_group for r in run.marks.collect()}
    assert group[1] == group[2] == 1 and group[4] == group[5] == group[8] == 4
    assert group[6] is None and group[7] is None
    table = {r.id: (r.main_article_id, r.article_count) for r in run.groups.collect()}
    assert table[4] == (5, 3)
    counts = run.counts.first()
    assert counts.total_processed == 8 and counts.similarity_groups_created == len(table)
    stored = df.withColumn("similarity_group", F.lit(None).cast("long")).withColumn("is_duplicate", F.lit(False))
    assert apply_marks(stored, run.marks).where("similarity_group = 4").count() == 3
