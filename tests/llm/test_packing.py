"""op13: packed pieces cover every id once, sequences fit, and the recurrence equals a plain search."""

import zlib

import numpy as np
import pytest

from newsloom.llm.packing import END_ID, TRUNCATION_COST, _tokenizer, _word_ends, candidates, encoded, pack, plan_cuts, reads_by_word, tokenizer_path


def cost_of(cuts, costs, total, L):
    c = 0
    for a, b in zip(cuts, cuts[1:]):
        n = b - a
        assert 0 < n <= L
        c += (0 if n & (n - 1) == 0 else L - n) + (0 if b == total else costs.get(b, TRUNCATION_COST))
    return c


def best_plain(costs, total, L):
    cands = sorted({0, total, *costs})
    best = {0: 0}
    for c in cands[1:]:
        here = 0 if c == total else costs[c]
        opts = [best[p] + (0 if (c - p) & (c - p - 1) == 0 else L - (c - p)) + here for p in best if 0 < c - p <= L]
        if opts:
            best[c] = min(opts)
    return best[total]


@pytest.mark.parametrize("seed", range(12))
def test_recurrence_equals_plain_search(seed):
    rng = np.random.default_rng(seed)
    L = int(rng.choice([8, 16, 64]))
    lengths = rng.integers(1, 3 * L, size=int(rng.integers(1, 12)))
    ends = np.cumsum(lengths)
    total = int(ends[-1])
    sentence = rng.choice(np.arange(1, total), size=min(total - 1, int(rng.integers(0, 10))), replace=False) if total > 1 else []
    costs = candidates(ends[:-1], np.asarray(sentence), total, L)
    cuts = plan_cuts(costs, total, L)
    assert cuts[0] == 0 and cuts[-1] == total
    assert cost_of(cuts, costs, total, L) == best_plain(costs, total, L)


def test_pieces_cover_every_id(spark):
    long = "One sentence here. " * 3000
    rows = [(3, "Hello world. Second sentence!"), (1, None), (2, ""), (5, long), (4, "short"), (4, "short"),
            (None, "no id"), (6, "x " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack(df, seq_len=512, block_tokens=2000).toPandas()
    tok, _ = _tokenizer(tokenizer_path())
    # every document: pieces in order cover its ids once, with the right checksums
    for key, text in rows:
        ids = np.append(np.asarray(tok.encode(text or "", add_special_tokens=False).ids, dtype=np.int64), END_ID)
        mine = got[got.doc_id.isna()] if key is None else got[got.doc_id == key]
        copies = sum(1 for k, _ in rows if k == key)
        assert (mine.doc_tokens == len(ids)).all()
        assert mine.length.sum() == copies * len(ids)
        for _, p in mine.iterrows():
            a, n = int(p.start), int(p.length)
            assert zlib.crc32(ids[a:a + n].astype("<u4").tobytes()) == int(p.ids_crc32)
    # sequences: at most 512 ids, offsets gapless from 0, numbered from 0 without gaps
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.length.sum() <= 512
        assert list(seq.offset) == list(np.concatenate([[0], np.cumsum(seq.length)[:-1]]))
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))


def test_empty_and_clashing_names(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c", 7, 8)], "doc_id long, text string, part int, seen long")
    got = pack(df).collect()
    assert len(got) == 1 and got[0].offset == 0 and got[0].sequence_id == 0 and got[0].start == 0


def test_words_encoded_once_give_the_ids_of_whole_texts():
    tok, _ = _tokenizer(tokenizer_path())
    assert reads_by_word(tokenizer_path())
    parts = ["Caf\u00e9", "cafe\u0301", "\u0301", "\u00a0x\u00a0", "\u2003", "don't", "'S", "12\u00bd", "<|endoftext|>", "a<|startoftext|>b", "\u0130I", "\u03a3\u03a3",
             "stra\u00dfe", "\u1e9e", "\U0001f600!?", "\u200d", "\x1c", "\x85", "\ud55c\uae00", "\u1112\u1161", "...", "\x00", "w" * 40, "the"]
    spaces = [" ", "\n", "\t", "  \n", "\x0b", "\x0c", "\r\n", " \u00a0 ", ""]
    rng = np.random.default_rng(0)
    texts = ["", " ", "\n\n", *parts, *["".join(p + s for p, s in zip(rng.choice(parts, 30), rng.choice(spaces, 30))) for _ in range(200)], ""]
    whole = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    calls = []

    class Counting:
        def encode_batch_fast(self, rows, **options):
            calls.extend(rows)
            return tok.encode_batch_fast(rows, **options)

    known = {}
    for _ in range(2):
        assert [x.tolist() for x in encoded(Counting(), texts, True, known)] == whole
    assert calls.count("the") == 1
    assert [x.tolist() for x in encoded(tok, texts, False, {})] == whole
    assert encoded(tok, [], True, {}) == []


def test_words_that_differ_in_case_or_closing_signs_are_encoded_once():
    path = tokenizer_path()
    tok, _ = _tokenizer(path)
    calls = []

    class Counting:
        def encode_batch_fast(self, rows, **options):
            calls.extend(rows)
            return tok.encode_batch_fast(rows, **options)

    texts = ["Word word, WORD. word!*** (word) word's, Th\u00e9, th\u00e9", "J\u030c j\u030c T\u0308, E\u0301", "", "word\x1c,", "12, 1,2. a.b.", "z,"]
    texts += ["<|ENDOFTEXT|>, Word", "a<|endoftext|>, b"]
    whole = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [encoded(Counting(), [t], True, {}, _word_ends(path))[0].tolist() for t in texts] == whole
    calls.clear()
    got = encoded(Counting(), texts[:6], True, {}, _word_ends(path))
    assert [x.tolist() for x in got] == whole[:6]
    assert sum(w == "word" for row in calls for w in row.split(" ")) == 1
    assert not any(row.startswith("word,") or row.startswith("WORD") for row in calls)
