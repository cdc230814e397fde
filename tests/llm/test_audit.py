"""op11: the filter audit against a plain loop over documents and orders."""

import itertools
import re

from newsloom.llm.filteraudit import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    rows = []
    for doc_id, text, lang in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": any((o or "") == t and (doc_id is None and o_id is not None or doc_id is not None and o_id is not None and o_id < doc_id)
                     for o_id, o, _ in docs),
        }
        rows.append((lang or "", doc_id, fails))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_of = {}
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                removed_of[order, k] = [r for r in mine if r[2][f] and not any(r[2][g] for g in order[:k])]
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = removed_of[order, k]
                out[part, "".join(order), k + 1] = (
                    sum(1 for r in mine if not any(r[2][g] for g in order[: k + 1])),
                    len(gone),
                    sum(1 for r in mine if r[2][f]) - len(gone),
                    sum(1 for r in mine if r[2][f] and sum(r[2].values()) == 1),
                    sum(1 for r in gone if r[1] in good),
                    sum(1 for r in gone if r[1] in toxic),
                    sum(len(removed_of[o, o.index(f)]) for o in itertools.permutations("ABCDE")),
                )
    return out


def test_audit_matches_a_loop(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, long, "en"), (2, long, "en"), (3, long.upper(), "en"), (4, "short # text", None),
        (5, None, "de"), (None, long, "de"), (6, "a " * 300, "de"), (6, "a " * 300, "de"), (7, "", "en"),
        (8, long + " $", "fr"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, 0, 1), (None, 1, 1), (8, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in filter_audit(df, lab).collect()}
    want = brute(docs, labels)
    assert len(got) == 4 * 600
    assert got == want


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit(empty).count() == 0
    clash = spark.createDataFrame([(1, "x", "en", 5, "p")], "doc_id long, text string, lang string, cell int, part string")
    rows = filter_audit(clash).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {"en"}
