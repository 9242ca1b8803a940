import collections
import math
import random

import pytest

from barloom.functions.columns import table
from barloom.operators import profile as P
from barloom.plans import prep

SCHEMA = "load_id bigint, symbol string, n bigint, x double, flag boolean, stamp string, column_name string, num string"


def rows(seed, loads=8, size=120):
    rng = random.Random(seed)
    base = [(f"S{i}", int(math.exp(rng.gauss(8, 1))), rng.gauss(0, 1)) for i in range(size)]
    return [
        (ld, s, n + 24 * ld, x if rng.random() > 0.02 else None, rng.random() < 0.9, f"2024-{1 + i % 12:02d}-{1 + ld:02d} 10:00:00", "c", "z")
        for ld in range(1, loads + 1)
        for i, (s, n, x) in enumerate(base)
        if rng.random() > 0.1
    ]


def test_counts_are_those_of_a_counter(spark):
    data = rows(1) + [(None, None, None, float("nan"), None, None, None, None), (1, "", 2**60 + 1, -0.0, True, "a", "b", "c"), (1, "", 2**60 + 2, 0.0, True, "a", "b", "c")]
    df = spark.createDataFrame(data, SCHEMA)
    got = collections.defaultdict(dict)
    for r in P.value_counts(df).collect():
        got[r.column_name][(r.num, r.txt)] = r.n
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    assert set(got) == set(names)
    for k, name in enumerate(names):
        assert sum(got[name].values()) == len(data)
    assert got["x"][(None, None)] == sum(r[3] is None or r[3] != r[3] for r in data)
    assert got["x"][(0.0, None)] == 2
    assert sum(n for (v, t), n in got["n"].items() if t is not None) == 2  # exact digits keep big integers apart


def test_deltas_add_up_and_cancel(spark):
    a, b = spark.createDataFrame(rows(1), SCHEMA), spark.createDataFrame(rows(2), SCHEMA)
    da, db = P.value_counts(a), P.value_counts(b)
    both = P.apply_delta(P.apply_delta(None, da), db)
    direct = P.value_counts(a.unionByName(b))
    key = lambda d: {tuple(r) for r in d.select("column_name", "num", "txt", "n").collect()}
    assert key(both) == key(direct)
    assert key(P.apply_delta(both, db, -1)) == key(da)
    assert P.apply_delta(da, da, -1).count() == 0
    with pytest.raises(ValueError):
        P.apply_delta(da, db, 2)


def test_profile_metrics(spark):
    df = spark.createDataFrame([(1, "Ab1", 5.0), (2, "Cd22", None), (3, None, 5.0), (4, "x", 7.0)], "id bigint, s string, x double")
    p = {r.column_name: r for r in P.profile(P.value_counts(df)).collect()}
    assert p["s"].null_share == 0.25 and p["s"].distinct_values == 3 and p["s"].top_form == "Aa9" and p["s"].top_form_share == pytest.approx(2 / 3)
    assert p["x"].min_num == 5.0 and p["x"].max_num == 7.0 and p["x"].distinct_values == 2
    assert p["x"].entropy_bits == pytest.approx(-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3))
    assert p["id"].entropy_bits == pytest.approx(2.0)
    empty = P.profile(P.value_counts(df.where("id < 0")))
    assert empty.count() == 0


def key(d):
    return {tuple(r) for r in d.select("column_name", "num", "txt", "n").collect()}


def test_store_keeps_signed_deltas_and_refuses_repeats(spark, tmp_path):
    store = P.CountStore(spark, f"file://{tmp_path}/counts")
    assert store.counts() is None and store.loads() == set()
    one, two = (P.value_counts(spark.createDataFrame(rows(s), SCHEMA)) for s in (1, 2))
    store.add("one", one)
    files = len(list((tmp_path / "counts").glob("d-*")))
    store.add("two", two)
    # A load adds its own files and rewrites no others.
    assert files == 1 and len(list((tmp_path / "counts").glob("d-*"))) == 2
    assert store.loads() == {"one", "two"}
    assert key(store.counts()) == key(P.apply_delta(one, two))
    with pytest.raises(ValueError):
        store.add("one", one)
    taken = store.withdraw("two")
    assert key(taken) == key(two)
    assert key(store.counts()) == key(one) and store.loads() == {"one"}
    with pytest.raises(ValueError):
        store.withdraw("two")
    store.add("two", taken)
    before = key(store.counts())
    store.compact()
    assert key(store.counts()) == before == key(P.apply_delta(one, two)) and store.loads() == {"one", "two"}
    store.sweep()
    assert len(list((tmp_path / "counts").glob("d-*"))) == 1 and key(store.counts()) == before
    store.withdraw("one")
    assert key(P.CountStore(spark, f"file://{tmp_path}/counts").counts()) == key(two)


def test_of_two_writers_none_is_lost(spark, tmp_path, monkeypatch):
    a, b = (P.CountStore(spark, f"file://{tmp_path}/counts") for _ in range(2))
    one, two = (P.value_counts(spark.createDataFrame(rows(s), SCHEMA)) for s in (1, 2))
    real, late = a._commit, []

    def commit(*args):
        if not late:  # another writer is faster
            late.append(1)
            b.add("two", two)
        return real(*args)

    monkeypatch.setattr(a, "_commit", commit)
    a.add("one", one)
    assert a.loads() == {"one", "two"} and key(a.counts()) == key(P.apply_delta(one, two))


def test_many_loads_in_one_write(spark, tmp_path):
    df = spark.createDataFrame(rows(7) + [(None, "x", 1, 1.0, True, "s", "c", "z")], SCHEMA)
    store = P.CountStore(spark, f"file://{tmp_path}/counts")
    assert store.add_loads(P.value_counts(df, ["symbol", "n", "x"], by=["load_id"]), "load_id") == list(range(1, 9))
    store.withdraw(8)
    want = P.value_counts(df.where("load_id < 8"), ["symbol", "n", "x"])
    assert key(store.counts()) == key(want)
    assert store.by_load().select("load").distinct().count() == 7


COLS = ("symbol", "n", "x", "flag", "stamp")


def changed(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    return {(r.load_id, r.column_name) for r in P.changed_columns(P.value_counts(df, COLS, by=["load_id"]), load="load_id").collect()}


def test_slow_growth_scattered_values_and_missing_symbols_are_no_changes(spark):
    data = rows(3, loads=12)
    data = [r if i % 97 else (*r[:2], -5, *r[3:]) for i, r in enumerate(data)]
    data = [r for r in data if not (r[0] == 5 and r[1] < "S3")]
    assert changed(spark, data) == set()


def test_departures_come_out(spark):
    def bend(r):
        ld, s, n, x, f, t, a, b = r
        if ld == 3:
            n = n * 60
        if ld == 4:
            x = None if hash(s) % 2 else x
        if ld == 6:
            t = "1704103200000"
        if ld == 7:
            s = s.lower()
        if ld == 9:
            f = not f
        if ld == 10:
            t = t.replace("2024", "2051")
        return (ld, s, n, x, f, t, a, b)

    data = [bend(r) for r in rows(4, loads=12)]
    data = [(r[0], r[1], r[2], None if r[0] == 4 and i % 2 else r[3], *r[4:]) for i, r in enumerate(data)]
    assert changed(spark, data) == {(3, "n"), (4, "x"), (6, "stamp"), (7, "symbol"), (9, "flag"), (10, "stamp")}


def test_texts_that_collapse_to_few_values_come_out(spark):
    def bend(r):
        ld, s = r[0], r[1]
        if ld == 4:
            s = "S7"
        if ld == 8:
            s = f"S{int(s[1:]) % 4 + 20}"
        return (ld, s, *r[2:])

    plain = [(r[0], f"S{i % 120 + 100}", *r[2:]) for i, r in enumerate(rows(5, loads=12))]
    assert changed(spark, plain) == set()
    assert changed(spark, [bend(r) for r in plain]) == {(4, "symbol"), (8, "symbol")}


def test_a_long_run_of_bad_loads_comes_out(spark):
    data = [(*r[:5], r[5] if not 20 <= r[0] < 32 else r[5].replace("-", "/"), *r[6:]) for r in rows(6, loads=90, size=60)]
    assert changed(spark, data) == {(i, "stamp") for i in range(20, 32)}


def test_ranges_of_loads_are_judged_alike(spark, monkeypatch):
    data = [(*r[:2], r[2] * (50 if r[0] in (3, 9, 17) else 1), *r[3:]) for r in rows(8, loads=20, size=60)]
    want = {(3, "n"), (9, "n"), (17, "n")}
    assert changed(spark, data) == want
    monkeypatch.setattr(P, "LOADS_PER_TASK", 4)
    assert changed(spark, data) == want


def test_a_new_form_hides_in_no_old_one(spark, monkeypatch):
    monkeypatch.setattr(P, "FORM_BUCKETS", 1)  # every form collides with every other
    data = [(*r[:2], *r[2:5], r[5] if r[0] != 5 else "1704103200000", *r[6:]) for r in rows(9, loads=12)]
    assert changed(spark, data) == {(5, "stamp")}


@pytest.mark.parametrize("seed", [31, 32])
def test_graded_changes(spark, seed):
    """Nulls in a growing share of a load's rows: from a quarter on they come out, a twentieth is no change."""
    shares = {4: 0.05, 8: 0.25, 12: 0.4, 16: 0.8}
    rng = random.Random(seed)
    data = [(*r[:3], None if rng.random() < shares.get(r[0], 0.0) else 1.5 + r[2] % 3, *r[4:]) for r in rows(seed, loads=20, size=200)]
    assert changed(spark, data) == {(8, "x"), (12, "x"), (16, "x")}


def test_stamps_in_any_spelling(spark):
    texts = ["2024-03-01 10:00:00", "2024-03-01T10:00:00Z", "2024/03/01 10:00", "01.03.2024 10:00", "2024-03-01", "1709287200000", "1709287200", "2024", "12", "x", "", None, "2024-13-01"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(P.stamp_days(P.F.rtrim(P.F.col("t"), P.F.lit(" Z")))).collect()]
    assert [None if g is None else round(g) for g in got] == [19783] * 7 + [None] * 6


def test_few_loads_and_empty_tables(spark):
    assert changed(spark, rows(1, loads=2)) == set()
    assert changed(spark, []) == set()
    assert changed(spark, [(None, "a", 1, 1.0, True, "x", "", "")] * 5) == set()


def test_every_column_of_the_large_tables_is_profiled(spark):
    names = (*prep.PROFILED, *prep.PROFILED_TEXTS)
    assert set(names) == {"raw_1m", "panel_1h", "positioning", "funding", "symbol_qa", "trials", "documents"}
    sf = "/root/testdata/sf0.001"
    got = {(r[0], r[1]) for r in prep.p3_profile(spark, sf).union(prep.p3_profile_texts(spark, sf)).select("table_name", "column_name").collect()}
    assert got == {(n, c) for n in names for c in table(spark, sf, n).columns}


def test_queries_over_empty_tables(spark, tmp_path):
    for name in (*prep.PROFILED, *prep.PROFILED_TEXTS):
        table(spark, "/root/testdata/sf0.001", name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for q in (prep.p3_found, prep.p3_profile, prep.p3_profile_texts, prep.p3_withdrawn, prep.p1_found, prep.p4_found, prep.p5_found):
        assert q(spark, f"file://{tmp_path}").collect() == []
