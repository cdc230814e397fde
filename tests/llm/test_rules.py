"""Urls, licences, benchmark leaks and mixtures: by hand, by brute force and by properties."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import bytewise as B
from newsloom.llm import decontaminate, urlrules
from newsloom.llm.decontaminate import leaks, templates
from newsloom.llm.licences import MIT, known, licence_hits
from newsloom.llm.mixing import mixed, mixture, source_targets

RULES = [("org/", True), ("example.org/es/", False), ("example.org/en/1", False), ("com/fr/", True), ("com/de/", False)]


def judged(spark, urls, rules=RULES):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").selectExpr("*", "1 AS host", "2 AS rule")
    return [tuple(x)[1:] for x in urlrules.judge(rows, rules, keep=["page_id"]).collect()]


def test_url_rules_by_hand(spark):
    urls = ["http://A.example.ORG/es/x?y#z", "https://example.org/en/19", "https://xexample.org/en/19", "http://org", "http://org?/a", None, "no scheme/",
            "ftp://b.com/fr/://c", "http://m.com/de/", "http://com/de", "://", "http://example.org/en/1#f", "http://example.org/en/1", "http://com/FR/"]
    assert judged(spark, urls) == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/19", "example.org/en/1", "block"),
        ("xexample.org", "/en/19", "org/", "allow"), ("org", "", None, "allow"), ("org", "", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("b.com", "/fr/://c", "com/fr/", "allow"), ("m.com", "/de/", "com/de/", "block"), ("com", "/de", None, "allow"),
        ("", "", None, "allow"), ("example.org", "/en/1", "example.org/en/1", "block"), ("example.org", "/en/1", "example.org/en/1", "block"),
        ("com", "/FR/", None, "allow")]
    assert judged(spark, []) == []


def test_rules_in_blocks_and_collisions(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "BLOCK", 2)
    frame = spark.createDataFrame(RULES, "rule string, allow boolean")
    urls = [f"http://{h}/{p}" for h in ("a.org", "example.org", "x.com") for p in ("es/1", "en/1", "fr/", "de/")]
    assert judged(spark, urls, frame) == judged(spark, urls)
    monkeypatch.setattr(urlrules, "digest", lambda t: 7)  # all keys collide: the strings decide
    table = urlrules.digests(RULES)
    assert urlrules._looked_up([("example.org", "/en/12"), ("a.net", "/")], table) == [("example.org/en/1", False), None]


def test_licences(docs_of, spark):
    changed = MIT.replace("Copyright (c) <year> <copyright holders>", "  COPYRIGHT 2020 Some One").replace("sublicense", "sub-licence").upper()
    rows = [(1, MIT), (2, changed), (3, "some text\nReleased under the MIT licence\nmore\n\nreleased UNDER the MIT License!"), (3, "CC BY-NC 4.0"),
            (4, "Licensed under Creative Commons BY-NC 4.0."), (5, None), (6, ""), (None, "SPDX-License-Identifier: MIT"), (7, MIT[:-10]),
            (8, "x\n\n" + "Licensed under the Apache License, Version 2.0.\n" * 3), (9, "word " * 100_000)]
    got = [tuple(x) for x in licence_hits(docs_of(rows).selectExpr("*", "1 AS scope", "2 AS digest"), known(spark)).collect()]
    by = {(x[0], x[1]): x[2:] for x in got}
    assert by[1, "MIT"][0] == by[2, "MIT"][0] == "text" and by[3, "MIT"] == ("paragraph", 3) and by[4, "CC-BY-NC-4.0"] == ("text", 1)
    assert by[8, "Apache-2.0"] == ("line", 3) and by[None, "MIT"] == ("text", 1) and not any(k[0] in (5, 6, 7, 9) and v[0] == "text" for k, v in by.items())
    assert licence_hits(docs_of([]), known(spark)).collect() == []


def test_licence_heads_leave_out_no_hit(docs_of, spark):
    """Only units that begin like a known text are brought to canonical form, whatever stands before their first word."""
    notice = "licensed under the MIT License"
    texts = ["SUB-LICENCE of x", "sub license of x", "sublicense of x", "v v 3", "Ver. v 3", "Creative Commons BY 4.0", "\n\n (C) me\n -- " + notice, notice,
             "\u00a9 2020\n" + notice, "x\u2028copyright\n" + notice, "\u0085" + notice, "copyrighted by me\n\n" + notice, "c", "c " + notice, "\x01" + notice + "\x00",
             "non infringement x", "Noncommercial x", "NON Commercial x", "\u00c9t\u00e9 " + notice, "x " + notice, "", "---", "Copyright", None]
    table = known(spark, [("a", "sub-licence of x"), ("b", "version v 3"), ("c", "CC BY 4.0"), ("d", notice), ("e", "non commercial x"), ("f", "noninfringement x"),
                          ("g", "(c) x\n" + notice), ("h", "\u00a9 y"), ("i", "c " + notice), ("j", "x\u2028")])
    docs = docs_of([*enumerate(texts), *[(100 + i, f"{a}\n{b}\n\n{c}") for i, (a, b, c) in enumerate(zip(texts[:-1], texts[5:-1], texts[11:-1]))]])
    rows = lambda frame: sorted(map(tuple, licence_hits(docs, frame).collect()))
    assert rows(table) == rows(table.drop("head")) and len(rows(table)) > 30
    assert {r.head for r in known(spark, [("a", "Sub-Licence x"), ("b", "The text")]).collect()} == {"sublicense", "the"}


ITEM = "Yesterday Alice bought 12 apples at the little shop near the river and gave Bob 5 of them before walking 3 km home"


def tokens_of(text):
    t, s, _ = templates(*B.buffers(pa.array([text])))
    return t, s


def test_templates_replace_numbers_names_and_units():
    t, s = tokens_of("The shop. In it Alice has 5 kg, three apples; m is no unit. ÉLAN Émile")
    kinds = ["-" if x == 0 else "n" if y == decontaminate.NUM else "u" if y == decontaminate.UNIT else "N" for y, x in zip(t, s, strict=True)]
    assert "".join(kinds) == "----N-nun------N"  # ÉLAN begins a sentence
    assert (tokens_of("a (b) 'c'")[0] == tokens_of("A b, c!")[0]).all()


def test_leaks_find_copies_and_other_parameters(docs_of, spark):
    benchmark = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, "seven plain words make one short item"), (5, ITEM.lower())],
                                      "item_id bigint, text string")
    other = ITEM.replace("Alice", "Carol").replace("12", "40").replace("Bob", "Dave").replace("5", "7").replace("3 km", "9 miles")
    rows = [(1, f"Before. {ITEM.upper()} after"), (2, f"Some words. {other}, and so on"), (3, "nothing of it " * 50), (4, None), (5, ""),
            (6, "Well, seven plain words make one short item."), (7, "7 plain words make one short thing"), (None, ITEM), (8, "x. " * 60_000 + ITEM), (8, ITEM)]
    got = {(x["doc_id"], x["item_id"]): (x["n_windows"], x["item_windows"]) for x in leaks(docs_of(rows).selectExpr("*", "1 AS w"), benchmark).collect()}
    n = len(ITEM.split()) - 8  # one window has too few plain words
    assert got[2, 1] == got[8, 1] == got[None, 1] == (n, n) and got[6, 4] == (1, 1)
    assert {k[0] for k in got} == {1, 2, 6, 8, None}
    assert leaks(docs_of([]), benchmark).collect() == [] and leaks(docs_of(rows), benchmark.limit(0)).collect() == []


def test_inconsistent_slots_are_no_leak(docs_of, spark):
    item = "if Ann has 4 boxes and Ann opens 4 of them how many closed boxes has Ann left at the end of the day"
    good = item.replace("Ann", "Joe").replace("4", "9")
    bad = good.replace("Joe opens", "Ben opens").replace("boxes has Joe", "boxes has Sue")
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {x["doc_id"] for x in leaks(docs_of([(1, good), (2, bad), (3, item)]), benchmark, width=18).collect()}
    assert got == {1, 3}


def test_one_changed_value_loses_only_its_windows(docs_of, spark):
    words = ("a box of red stones was given to Alice when the long summer had come to its end and nobody at home "
             "asked about it until in the winter the neighbour saw Alice with 7 of them near the well")
    places = [i for i, w in enumerate(words.split()) if w == "Alice"]
    other = " ".join("Bob" if i == places[1] else w for i, w in enumerate(words.split()))
    got = {x["doc_id"]: (x["n_windows"], x["item_windows"]) for x in leaks(
        docs_of([(1, other), (2, words)]), spark.createDataFrame([(1, words)], "item_id bigint, text string")).collect()}
    n = len(words.split()) - 7
    assert got == {1: (n, n), 2: (n, n)}  # no window of 8 holds both


def test_copies_without_plain_words_are_found(docs_of, spark):
    sums, title, names = "What is 12 + 7 - 3 x 5 + 40 - 8?", "Who wrote War and Peace?", "then Ann Ben Cid Dora Eve Finn Gus Hal Ida left"
    bench = spark.createDataFrame([(1, sums), (2, title), (3, names)], "item_id bigint, text string")
    rows = [(1, f"Well. {sums} So"), (2, f"they ask: {title.lower()}"), (3, names.upper()), (4, names.lower()), (5, sums.replace("12", "13").replace("40", "41")), (6, title)]
    got = {(x["doc_id"], x["item_id"]): (x["n_exact"], x["item_exact"]) for x in leaks(docs_of(rows), bench).collect()}
    assert got == {(1, 1): (2, 2), (2, 2): (1, 1), (3, 3): (4, 4), (4, 3): (4, 4), (6, 2): (1, 1)}


def test_leaks_as_by_brute_force(docs_of, spark, monkeypatch):
    """Plain words only: a leak is a common run of 8 words; the benchmark in several blocks."""
    monkeypatch.setattr(decontaminate, "WINDOW_BLOCK", 40)
    r = random.Random(6)
    text = lambda n: [f"w{'abcdefgh'[r.randrange(8)]}{'xyz'[r.randrange(3)]}" for _ in range(n)]
    items = {i: text(r.randint(10, 30)) for i in range(12)}
    docs = {i: text(r.randint(0, 60)) for i in range(60)}
    for i in range(0, 60, 3):
        it = items[r.randrange(12)]
        at = r.randrange(len(docs[i]) + 1)
        docs[i][at:at] = it[r.randrange(3):][: r.randint(6, 20)]
    runs = lambda w: {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    want = {(d, i): len([j for j in range(len(x) - 7) if tuple(x[j : j + 8]) in runs(w)]) for d, w in docs.items() for i, x in items.items() if runs(w) & runs(x)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]): x["n_windows"] for x in leaks(docs_of([(i, " ".join(w)) for i, w in docs.items()]), bench).collect()}
    assert got == want


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by the words of the contract: cut off, share the excess, again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        part = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > most * sizes[s]}
        if not over:
            return target | part
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_as_by_the_iteration(spark, seed):
    r = random.Random(seed)
    sizes = {None if i == 3 else f"s{i}é": r.choice([0, 1, 10, 500, 10_000]) * r.randint(1, 9) for i in range(9)}
    got = {x["source"]: x["target"] for x in source_targets(spark.createDataFrame([*sizes.items()], "source string, source_size bigint")).collect()}
    want = filled(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def mix_rows(seed=1):
    r = random.Random(seed)
    rows = []
    for s, n in ((None, 60), ("a", 400), ("b", 90), ("c", 5), ("d", 1)):
        rows += [(None, "w " * r.choice([0, 1, 7, 7, 7, 40, r.randint(1, 900)]), "en", s) for _ in range(n)]
    r.shuffle(rows)
    return [(i, *x[1:]) for i, x in enumerate(rows)] + [(10_000, None, "en", "a"), (None, "no id", "en", "b"), (3, "again here", "en", "c"), (3, "again here", "en", "c")]


def test_mixture_meets_targets_and_agrees_with_itself(docs_of):
    docs = docs_of(mix_rows()).selectExpr("*", "1 AS bucket", "2 AS rate")
    got = mixed(docs).toPandas()
    assert len(got) == docs.count() and (got["taken"] <= 2 * got["size"]).all() and (got["taken"] == got["copies"] * got["size"]).all()
    for _, part in got.groupby("source", dropna=False):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max() + 1e-6
        # the rates solve the dual: log rate is proportional to size below the bound
        free = part[(part["rate"] < 2) & (part["size"] > 0) & (part["rate"] != 1)]
        slope = np.log(free["rate"]) / free["size"]
        assert free.empty or slope.max() - slope.min() < 1e-9
        expected = (part["rate"] * part["size"]).sum()
        assert abs(expected - part["target"].iloc[0]) <= 1e-6 * max(expected, 1)
    again = mixed(docs.repartition(7)).toPandas()
    key = ["doc_id", "source", "size", "copies", "rate", "target"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_mixture_rows(docs_of, spark):
    docs = docs_of(mix_rows(2))
    taken = defaultdict(int)
    for x in mixed(docs).where("doc_id <> 3").collect():
        taken[x["doc_id"]] += x["copies"]
    rows = mixture(docs).where("doc_id <> 3").collect()
    seen = defaultdict(int)
    for x in rows:
        seen[x["doc_id"]] += 1
    assert seen == {k: v for k, v in taken.items() if v}
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert mixed(empty).collect() == [] and mixture(empty).collect() == []
    silent = mixed(docs_of([(1, None, "en", "a"), (2, "", "en", None)])).collect()
    assert [(x["size"], x["taken"], x["target"]) for x in silent] == [(0, 0, 0.0)] * 2
