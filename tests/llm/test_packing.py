import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import packing as P


def brute_nnls(a, b, steps=60_000):
    x = np.zeros(a.shape[1])
    rate = 1.0 / np.linalg.eigvalsh(a.T @ a)[-1]
    for _ in range(steps):
        x = np.maximum(x - rate * (a.T @ (a @ x - b)), 0.0)
    return x


@pytest.mark.parametrize("seed", range(5))
def test_nnls_agrees_with_projected_gradient(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.random((8, 12)), rng.random(8)
    x, y = P.nnls(a, b), brute_nnls(a, b)
    assert (x >= 0).all()
    assert np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-6


def test_patterns_fill_the_container():
    have = np.zeros(33, bool)
    have[[1, 3, 7, 16, 20]] = True
    cols = P.patterns(32, have)
    assert cols.shape[1] > 0
    assert (np.arange(33) @ cols == 32).all()
    assert not cols[~have].any()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=0, max_size=300))
def test_every_text_has_a_container_that_holds_it(lengths):
    l = np.array(lengths, dtype=np.int64)
    h = np.bincount(P.length_class(l, 64, 16), minlength=17).astype(float) if len(l) else np.zeros(17)
    h[0] = 0
    box = P.pack_lengths(l, 64, *P.fit_patterns(h, 16), 16)
    assert (box >= 0).all()
    if len(l):
        level = np.bincount(box, weights=l)
        assert level.max() <= 64
        assert (level > 0).all()


def test_little_room_is_left():
    rng = np.random.default_rng(3)
    l = np.clip(np.exp(rng.normal(5.2, 0.9, 20_000)), 5, 1000).astype(int)
    h = np.bincount(P.length_class(l, 1024, P.UNITS), minlength=P.UNITS + 1).astype(float)
    h[0] = 0
    box = P.pack_lengths(l, 1024, *P.fit_patterns(h), P.UNITS)
    assert l.sum() / ((box.max() + 1) * 1024) > 0.98


def frames(spark, sizes, caps):
    s = spark.createDataFrame(sizes, "doc bigint, tokens bigint, container string, at string")
    return s, spark.createDataFrame(caps, "pack bigint, cap bigint, doc string")


def run(spark, sizes, caps, **kw):
    s, c = frames(spark, [(i, n, "x", "y") for i, n in sizes], [(i, n, "z") for i, n in caps])
    return P.pack(s, c, id_col="doc", size="tokens", pack_id="pack", capacity="cap", **kw).collect()


def check(rows, sizes, caps):
    want = {i: n for i, n in sizes if n is not None and n >= 1}
    for pack, cap in caps:
        own = [r for r in rows if r.pack == pack]
        boxes = {}
        for r in own:
            boxes.setdefault(r.container, []).append(r)
        for rs in boxes.values():
            rs.sort(key=lambda r: r.at)
            assert sum(r.n_tokens for r in rs) <= cap
            at = 0
            for r in rs:
                assert r.at == at
                at += r.n_tokens
        seen = {}
        for r in own:
            seen.setdefault(r.doc, []).append(r)
        assert set(seen) == set(want)
        for d, rs in seen.items():
            rs.sort(key=lambda r: r.first_token)
            assert len(rs) == -(-want[d] // cap)  # whole unless over the capacity
            assert [r.piece for r in rs] == list(range(len(rs)))
            assert sum(r.n_tokens for r in rs) == want[d]
            assert [r.first_token for r in rs] == [k * cap for k in range(len(rs))]


def test_whole_texts_and_pieces(spark):
    sizes = [(i, (i * 37) % 90 + 1) for i in range(300)] + [(900, 1000), (901, 64), (902, 128), (903, None), (904, 0), (905, -4)]
    caps = [(1, 64), (2, 200)]
    check(run(spark, sizes, caps), sizes, caps)
    check(run(spark, sizes, caps, shard_rows=40), sizes, caps)


def test_the_result_depends_on_the_rows_only(spark):
    sizes = [(i, (i * 31) % 50 + 1) for i in range(200)]
    a = sorted(map(tuple, run(spark, sizes, [(1, 64)], shard_rows=50)))
    b = sorted(map(tuple, run(spark, sizes[::-1], [(1, 64)], shard_rows=50)))
    assert a == b


def test_empty_tables_and_bad_capacities(spark):
    assert run(spark, [], [(1, 64)]) == []
    assert run(spark, [(1, 5)], []) == []
    assert run(spark, [(1, 5)], [(1, None), (2, 0)]) == []
    assert len(run(spark, [(1, 5)], [(k, 10 + k) for k in range(70)])) == 70


def test_repeated_ids_are_all_packed(spark):
    rows = run(spark, [(1, 30), (1, 30), (1, 30)], [(1, 64)])
    assert len(rows) == 3 and sum(r.n_tokens for r in rows) == 90


def test_token_counts_of_odd_texts(spark):
    long = "word " * 200_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, long), (5, "안녕하세요 \x00 🙂"), (None, "lost")], "doc bigint, text string")
    got = {r.doc: r.tokens for r in P.token_counts(df, id_col="doc", text="text").collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] >= 200_000 and got[5] > 0 and None not in got


def test_patterns_never_cost_a_container():
    rng = np.random.default_rng(2)
    for capacity in (64, 500, 3000):
        lengths = np.sort(np.minimum(np.exp(rng.normal(4.0, 1.2, 2000)).astype(np.int64) + 1, capacity))[::-1]
        h = np.bincount(P.length_class(lengths, capacity, P.UNITS), minlength=P.UNITS + 1).astype(float)
        h[0] = 0
        cols, rate = P.fit_patterns(h)
        alone, box = P.pack_lengths(lengths, capacity, cols, rate * 0), P.pack_patterns(lengths, capacity, cols, rate)
        assert box.max() <= alone.max() and np.bincount(box, weights=lengths).max() <= capacity and (box >= 0).all()


def test_many_capacities_are_packed_in_turns(spark):
    sizes = spark.createDataFrame([(i, 1 + i % 37) for i in range(200)], "id bigint, n bigint")
    caps = spark.createDataFrame([(k, 40 + k) for k in range(9)], "k bigint, cap bigint")
    of = lambda at_once: {tuple(r) for r in P.pack(sizes, caps, id_col="id", size="n", pack_id="k", capacity="cap", capacities_at_once=at_once).collect()}
    assert of(64) == of(4) and len(of(4)) == 9 * 200
