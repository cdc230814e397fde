"""Near-duplicates, repeated lines, fingerprints: against brute force on small tables."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import bytewise as B
from newsloom.llm import neardup
from newsloom.llm.linededup import LineRuns, line_keys, repeated_lines
from newsloom.llm.neardup import near_duplicates
from newsloom.llm.sketches import containment, fingerprints, merged, run_hashes, sketch_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = sorted((root(a), root(b)))
                up[b_] = a_
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


def changed(r, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def family_rows(seed):
    """Originals with exact, near and far copies, a chain, shared passages, short and empty texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 6)))
    rows, shared = [], " ".join(word() for _ in range(30))
    for _ in range(25):
        base = " ".join(word() for _ in range(r.choice([8, 40, 90, 200])))
        if r.random() < 0.5:
            base += " " + shared
        rows += [base] * r.randint(1, 3) + [changed(r, base, n) for n in r.choices([1, 2, 3, 5, 9], k=r.randint(0, 6))]
        step = base
        for _ in range(r.choice([0, 0, 4])):
            step = changed(r, step, 3)
            rows.append(step)
    rows += ["", "  \n ", "one", "One", "one two three", "ONE two\tthree", None]
    r.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "k"), [(1, 4), (2, 5)])
def test_near_duplicates_as_by_brute_force(docs_of, seed, k):
    rows = family_rows(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs_of(rows), words=k).collect()}
    assert got == brute(rows, k)


def test_crowded_region_loses_no_link(docs_of):
    """Very many near copies, and among them pairs whose only partner is one of them."""
    r = random.Random(5)
    base = " ".join(f"w{r.randrange(400)}" for _ in range(120))
    rows = [(i, changed(r, base, r.choice([1, 1, 2, 4, 6]))) for i in range(150)]
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(docs_of(rows), words=4, reach=2).collect()}
    assert got == {i: v[1] for i, v in brute(rows, 4).items()}


def family_below(r, n, pairs):
    """Texts of one family at a likeness of 0.76 to 0.79, and `pairs` further ones of 0.83 to one of them."""
    base, family = [f"w{i}" for i in range(360)], []

    while len(family) < n + pairs:
        same = family[len(family) - n][1] if len(family) >= n else {}
        edits = dict(list(same.items())[:2])
        edits |= {k: f"e{len(family)}_{k}" for k in r.sample([k for k in range(4, 356, 4) if k not in same], 6 - len(edits))}
        if all(len(e.keys() & edits.keys()) <= 2 for _, e in family):
            family.append((len(family), edits))
    return [(i, " ".join(e.get(k, w) for k, w in enumerate(base))) for i, e in family]


def test_family_just_below_the_threshold_keeps_its_links(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 150, raising=False)
    rows = family_below(random.Random(11), 500, 15)
    want = {i: v[1] for i, v in brute(rows, 4).items()}
    assert [(i, w) for i, w in want.items() if i != w] == [(500 + j, j) for j in range(15)]
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(docs_of(rows), words=4).collect()}
    assert got == want


def test_near_duplicates_edge_cases(docs_of, spark):
    text = "a b c d e f g h"
    rows = [(5, text), (5, text), (None, text), (2, "A B c d e f g h"), (9, None), (10, ""), (11, "word " * 30_000)]
    got = near_duplicates(docs_of([(*x, "en", "s") for x in rows]).selectExpr("*", "1 AS id", "2 AS region", "3 AS n_shingles")).collect()
    by = defaultdict(list)
    for x in got:
        by[x["doc_id"]].append((x["component_id"], x["kept"]))
    assert by == {5: [(2, False)] * 2, None: [(None, True)], 2: [(2, True)], 9: [(9, True)], 10: [(10, True)], 11: [(11, True)]}
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_word_hashes_follow_words():
    texts = ["Foo bar", "foo\tBAR ", " foo", None, "é É", ""]
    data, at = B.buffers(pa.array(texts))
    starts, first = B.word_starts(data, at)
    h = B.word_hashes(data, starts)
    assert first.tolist() == [0, 2, 4, 5, 5, 7, 7]
    assert h[0] == h[2] == h[4] and h[1] == h[3] and h[5] != h[6] and h[0] != h[1]
    runs, begin = B.sequence_hashes(h, first, 2)
    assert np.diff(begin).tolist() == [1, 1, 1, 0, 1, 0] and runs[0] == runs[1] != runs[2]


def brute_lines(rows, min_docs=3, min_chars=20):
    key = lambda line: line.strip(SPACES).translate(FOLD)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (i is not None and len(holders.get(key(x), ())) >= min_docs and max(holders[key(x)]) != i)]
        kept = "\n".join(stay)
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_lines_as_by_brute_force(docs_of):
    r = random.Random(3)
    pool = [" ".join(r.choices(["alpha", "Beta", "gämma", "delta", "ö"], k=r.randint(1, 9))) for _ in range(40)]
    line = lambda: r.choice(pool) if r.random() < 0.6 else f"line {r.random()} of its own"
    rows = [(i * 7 % 311, "\n".join(r.choice(["", " ", "\t"]) + (x.upper() if r.random() < 0.1 else x) + r.choice(["", " \r"])
                                    for x in (line() for _ in range(r.randint(0, 12))))) for i in range(150)]
    rows += [(400, None), (401, ""), (None, pool[0]), (3, pool[3]), (3, pool[3]), (402, "\n\n"), (403, (pool[5] + "\n") * 5000)]
    got = repeated_lines(docs_of(rows)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute_lines(rows)


def test_repeated_lines_with_clashing_columns(docs_of, spark):
    rows = [(i, "the same long line in all of them\nown %d" % i, "en", "s") for i in range(3)]
    docs = docs_of(rows).selectExpr("*", "1 AS drop", "2 AS h1", "3 AS last")
    got = {x["doc_id"]: x["kept"] for x in repeated_lines(docs, keep=["doc_id", "lang", "h1"]).collect()}
    assert got == {0: "own 0", 1: "own 1", 2: "the same long line in all of them\nown 2"}
    assert repeated_lines(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_runs_are_levelled_and_anti_joined(docs_of, spark):
    runs = LineRuns(spark, fanout=2)
    batch = lambda *ids: line_keys(docs_of([(i, f"a line that only document {i // 2} has") for i in ids]), 10)
    runs.add(batch(0, 1))
    assert runs.fresh(batch(1, 2)).count() == 1
    for i in range(2, 8, 2):
        runs.add(batch(i, i + 1))
    assert [len(x) for x in runs.levels] == [0, 0, 1]  # four batches: two merges, then one of the next level
    assert runs.fresh(batch(0, 3, 7, 8)).count() == 1
    assert runs.repeated(2).count() == 4 and runs.repeated(3).count() == 0


def frac(text, k=5):
    w = WORD.findall(text)
    runs = [" ".join(w)] if 0 < len(w) < k else [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
    h = [hashlib.md5(x.encode()).hexdigest()[:16] for x in runs] if w else []
    low = sorted({x for x in h if x < "2"})
    return low or ([min(h)] if h else [])


def test_fingerprints_as_by_brute_force(docs_of):
    r = random.Random(8)
    rows = [(i * 1000 if i % 3 else i, " ".join(f"é{r.randrange(50)}" for _ in range(r.choice([0, 2, 6, 50, 300])))) for i in range(120)]
    rows += [(77_777_777_777, None), (5, "  "), (None, "no id at all")]
    order = sorted(((i if i is not None else -1, t or "") for i, t in rows))
    want = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b, c = frac(t), frac(edited), frac(nxt)
        like = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1.0
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), like(a, b), like(a, c))
    got = {x[0] if x[0] is not None else -1: tuple(x[1:]) for x in fingerprints(docs_of(rows)).collect()}
    assert got == want


def test_fingerprints_edge_cases(docs_of, spark):
    assert fingerprints(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    one = fingerprints(docs_of([(1, "abcdefgh")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0
    same = fingerprints(docs_of([(1, "a b"), (1, "a b"), (2, "a b")]).selectExpr("*", "1 AS cell", "2 AS bucket")).collect()
    assert len(same) == 3 and len({x["fingerprint"] for x in same}) == 1


def test_sketches_merge_and_contain(docs_of):
    words = [f"w{i}" for i in range(4000)]
    d = docs_of([(1, " ".join(words)), (2, " ".join(words[1000:1500])), (3, " ".join(words[3990:] + words[:100]))])
    s = d.select("doc_id", sketch_of(run_hashes(d["text"])).alias("s"))
    a, b = (s.where(f"doc_id = {i}").select(s["s"].alias(f"s{i}")) for i in (1, 2))
    both = a.join(b).select(containment(b["s2"], a["s1"]).alias("in_"), containment(a["s1"], b["s2"]).alias("of")).first()
    assert both["in_"] == 1.0 and abs(both["of"] - 496 / 3996) < 0.05
    assert s.where("doc_id < 3").agg(merged(s["s"]).alias("m")).first()["m"] == a.first()[0]


def test_line_keys_that_collide_in_a_polynomial_hash_stay_apart(spark, docs_of):
    """Thue-Morse order of a and b and its complement: equal under polynomials modulo 2**64."""
    from newsloom.llm.linededup import repeated_lines

    word = "a"
    while len(word) < 1024:
        word = word + word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word), (3, word), (4, other), (5, other), (6, other)]
    got = {r.doc_id: r.n_dropped for r in repeated_lines(docs_of(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 1, 5: 1, 6: 0}
