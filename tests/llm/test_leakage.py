import random

import numpy as np

from barloom.llm import leakage as L

WORDS = [f"w{i}" for i in range(400)]


def passage(seed, n=80):
    rng = random.Random(seed)
    return [rng.choice(WORDS) for _ in range(n)]


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame(items, "item_id bigint, passage string")
    return {(r.item_id, r.doc_id): r for r in L.leaks(d, e, doc_id="doc_id", text="text", item_id="item_id", passage="passage", **kw).collect()}


def brute_lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(0, 25))]
        b = [rng.randrange(7) for _ in range(rng.randrange(0, 40))]
        pairs = L.lcs_pairs(a, b)
        assert len(pairs) == brute_lcs(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_words_ignore_case_punctuation_markup_and_spacing():
    assert L.words("The <b>Cat</b>, sat\n\non&nbsp;the-mat!") == ["the", "cat", "sat", "on", "the", "mat"]
    assert L.words("ＡＢＣ ﬁne so­ft") == ["abc", "fine", "soft"]
    assert L.words(None) == L.words("") == L.words("...") == []


def test_whole_partial_split_changed_and_unrelated(spark):
    p = passage(1)
    filler = lambda s, n: passage(1000 + s, n)
    changed = list(p)
    for i in range(3, 80, 11):
        changed[i] = "zzz"
    docs = [
        (1, " ".join(filler(1, 50) + p + filler(2, 50))),
        (2, " ".join(filler(3, 20) + p[:48] + filler(4, 30))),  # more than half
        (3, " ".join(filler(5, 20) + p[:24] + filler(6, 90) + p[40:68] + filler(7, 10))),  # two places
        (4, "<p>" + ",  ".join(w.upper() for w in changed) + "</p>"),
        (5, " ".join(filler(8, 200))),
        (6, " ".join(filler(9, 60) + p[:14] + filler(10, 60))),  # a brief quotation
        (7, " ".join(reversed(p))),  # not in its order
        (8, None),
        (9, ""),
        (10, "w1"),
        (11, " ".join(filler(12, 60_000) + p)),  # very long
    ]
    got = run(spark, docs, [(1, " ".join(p)), (2, " ".join(passage(2))), (3, None), (4, ""), (5, "w1 w2")])
    assert set(got) == {(1, 1), (1, 2), (1, 3), (1, 4), (1, 11)}
    assert got[(1, 1)].words_matched == got[(1, 1)].words_total == 80
    assert got[(1, 1)].at_word <= 50


def test_more_passages_change_nothing(spark):
    items = [(i, " ".join(passage(i))) for i in range(7)]
    docs = [(i, " ".join(passage(500 + i, 40) + passage(i % 9))) for i in range(18)]
    want = {(i % 9, i) for i in range(18) if i % 9 < 7}
    more = [(100 + i, " ".join(passage(9000 + i, 30))) for i in range(300)]
    assert set(run(spark, docs, items)) == set(run(spark, docs, items + more)) == set(run(spark, docs, items, salts=1, least_hits=1)) == want


def test_short_passages_and_exactly_half(spark):
    six, twelve = passage(21, 6), passage(22, 12)
    filler = lambda s: passage(3000 + s, 40)
    docs = [(1, " ".join(filler(1) + six + filler(2))), (2, " ".join(filler(3) + twelve[:6] + filler(4))), (3, " ".join(filler(5) + twelve[6:] + filler(6))), (4, " ".join(filler(7) + twelve[:5] + filler(8)))]
    assert set(run(spark, docs, [(6, " ".join(six)), (12, " ".join(twelve))])) == {(6, 1), (12, 2), (12, 3)}


def test_half_of_passages_of_every_length(spark):
    docs, items, want = [], [], set()
    for n in range(12, 201, 4):
        p = passage(7000 + n, n)
        rng = random.Random(n)
        at = rng.randrange(0, n - -(-n // 2) + 1)
        half = p[at : at + -(-n // 2)]
        for k, part in enumerate((half, p[: n // 5])):  # a fifth is a quotation
            docs.append((2 * n + k, " ".join(passage(100 + n, 60) + part + passage(9 + n, 60))))
        items.append((n, " ".join(p)))
        want.add((n, 2 * n))
    assert set(run(spark, docs, items)) == want


def test_recall_falls_off_where_words_change(spark):
    """Whole copies with a growing share of changed words: a few do not matter."""
    docs, items = [], []
    for i in range(60):
        p = passage(40_000 + i, 90)
        rng = random.Random(i)
        changed = (0.0, 0.05, 0.1, 0.15)[i % 4]
        items.append((i, " ".join(p)))
        docs.append((i, " ".join(passage(i, 30) + [w if rng.random() >= changed else f"y{rng.random()}" for w in p] + passage(i + 1, 30))))
    assert len(run(spark, docs, items)) >= 58


def test_a_sentence_in_every_document_and_passage(spark):
    stock = passage(77, 14)
    items = [(i, " ".join(passage(600 + i, 70) + stock)) for i in range(30)]
    docs = [(i, " ".join(passage(800 + i, 60) + stock + passage(300 + i, 20))) for i in range(300)]
    docs[5] = (5, " ".join(passage(1, 20) + passage(603, 70)[:60]))
    assert set(run(spark, docs, items)) == {(3, 5)}


def test_what_the_first_rule_leaves_out_is_found_all_the_same():
    """Any pair with enough agreeing places has some at the places that are kept."""
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(5, 60)
        need = L.need(n, 0.12)
        places = n - len(L.MASKS[0]) + 1
        t = min(4, need)
        kept = set(rng.sample(range(places), places - need + t)) if need <= places else set()
        agree = set(rng.sample(range(places), need))
        assert len(agree & kept) >= t


def test_copies_and_empty_tables(spark):
    p = " ".join(passage(4))
    d = spark.createDataFrame([(1, p), (1, p), (2, p)], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, p)], "item_id bigint, passage string")
    assert L.leaks(d, e, doc_id="doc_id", text="text", item_id="item_id", passage="passage").count() == 3
    assert run(spark, [], [(1, p)]) == {}
    assert run(spark, [(1, p)], []) == {}
    assert run(spark, [(None, p)], [(1, p), (None, p)]) == {}
