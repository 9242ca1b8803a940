import random

import pytest

from barloom.llm import truncation as T

NOUNS = "ledger panel market seller buyer window hash gate clock record signal margin funding reader spread anchor".split()
VERBS = "moves holds reads turns raises lowers carries leaves closes opens".split()


def sentence(rng):
    return f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} {rng.choice(VERBS)} every {rng.choice(NOUNS)} after {rng.randrange(90)} days."


def text(rng):
    body = " ".join(sentence(rng) for _ in range(rng.randrange(2, 7)))
    end = rng.random()
    if end < 0.1:
        body += "\n\n- Close the window\n- Read the record"
    elif end < 0.2:
        body += f"\nStatus: {rng.choice(['open', 'closed'])}"
    elif end < 0.25:
        body += f"\nrun_id: {rng.getrandbits(48):012x}"
    return body


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    docs, cut = [], set()
    for i in range(1500):
        src = "limited" if i % 3 == 0 else "free"
        t = text(rng)
        if src == "limited" and len(t) > 250:
            t = t[:250]
            if t.rstrip()[-1] not in ".":
                cut.add(i)
        elif i % 25 == 1:
            p = T.cut_points(t, __import__("numpy").random.default_rng(i))
            if p:
                t = t[:p]
                cut.add(i)
        docs.append((i, src, t))
    return docs, cut


def test_held_out_accuracy(spark, corpus):
    docs, cut = corpus
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    got = {r.doc_id: r.score for r in T.truncation_scores(df, id_col="doc_id", source="source", text="text").collect()}
    found = {i for i, s in got.items() if s >= 0.5}
    assert len(got) == len(docs)
    assert len(found & cut) / len(cut) > 0.95
    assert len(found & cut) / len(found) > 0.95


def test_limits_are_measured(spark, corpus):
    df = spark.createDataFrame(corpus[0], "doc_id bigint, source string, text string")
    lim = {r.source: (r.chars, r.bytes) for r in T.source_limits(df, source="source", text="text").collect()}
    assert lim["limited"][0] == 250 and lim["free"] == (None, None)


def test_byte_limits(spark):
    rows = [(i, "b", "가" * (20 + i % 3) if i < 50 else "가" * 33) for i in range(100)]
    lim = T.source_limits(spark.createDataFrame(rows, "doc_id int, source string, text string"), source="source", text="text").first()
    assert lim.chars == 33 or lim.bytes == 99


def test_odd_rows(spark, corpus):
    docs = [(i, s, t) for i, s, t in corpus[0][:400]] + [(9001, None, "No source here."), (9002, "free", None), (9003, "free", ""), (9004, "free", "  \n"), (9005, "free", "x"), (9006, "free", "long " * 300_000 + "end.")]
    docs += [(9007, "free", docs[0][2])] * 3
    df = spark.createDataFrame([(*d, "y") for d in docs], "doc_id bigint, source string, text string, score string")
    got = [r.doc_id for r in T.truncation_scores(df, id_col="doc_id", source="source", text="text").collect()]
    assert {9002, 9003, 9004}.isdisjoint(got) and {9001, 9005, 9006} <= set(got) and got.count(9007) == 3


def test_empty_and_small_tables(spark):
    e = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert T.truncation_scores(e, id_col="doc_id", source="source", text="text").collect() == []
    few = spark.createDataFrame([(1, "a", "One sentence."), (2, "a", "It was cut in the middle of a sen"), (3, "a", "- a list item\n- another one")], "doc_id bigint, source string, text string")
    assert {r.doc_id: r.score >= 0.5 for r in T.truncation_scores(few, id_col="doc_id", source="source", text="text").collect()} == {1: False, 2: True, 3: False}


def test_the_order_of_rows_changes_no_score(spark, corpus):
    def of(docs, parts):
        df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").repartition(parts)
        return {r.doc_id: r.score for r in T.truncation_scores(df, id_col="doc_id", source="source", text="text", sample_rows=300).collect()}

    docs = corpus[0][:500]
    assert of(docs, 1) == of(docs[::-1], 5)


def test_more_sources_than_are_sent_to_all(spark, corpus, monkeypatch):
    df = spark.createDataFrame(corpus[0][:300], "doc_id bigint, source string, text string")
    want = {r.doc_id: r.score for r in T.truncation_scores(df, id_col="doc_id", source="source", text="text").collect()}
    monkeypatch.setattr(T, "SENT_SOURCES", 0)
    assert {r.doc_id: r.score for r in T.truncation_scores(df, id_col="doc_id", source="source", text="text").collect()} == want


def test_a_sentence_is_seen_from_its_beginning():
    long = "One ends. This (which opens a bracket " + "and goes on " * 400 + "to here"
    assert T.last_sentence(long).lstrip().startswith("This (which")
    assert T.last_sentence("no end " * 5000).startswith("no end") and T.last_sentence("") == ""
    assert any(f.startswith("unclosed=['(']") for f in T.ending_features(long, "none"))


def test_cuts_are_inside_words_or_sentences():
    import numpy as np

    rng = np.random.default_rng(0)
    t = "A first sentence stands here. A second one follows it.\nrun_id: 0123456789ab"
    for _ in range(200):
        p = T.cut_points(t, rng)
        assert p is None or (t[:p].rstrip()[-1] not in ".!?" and p <= t.index("\nrun_id"))
