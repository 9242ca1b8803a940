import datetime as dt
import random

import pytest

from barloom.llm.nearest import nearest_match

T0 = dt.datetime(2024, 1, 1)
LEFT = "lid bigint, sym string, ts timestamp_ntz, gap_us string"
RIGHT = "rid bigint, sym string, ts timestamp_ntz, oi double, lid string"


def run(spark, left, right, tol=600, present="oi", **kw):
    l = spark.createDataFrame([(i, s, t, "x") for i, s, t in left], LEFT)
    r = spark.createDataFrame([(i, s, t, v, "x") for i, s, t, v in right], RIGHT)
    out = nearest_match(l, r, left_key="sym", right_key="sym", left_ts="ts", right_ts="ts", left_id="lid", right_id="rid", tolerance_s=tol, right_present=present, **kw)
    return sorted((x.lid, x.rid) for x in out.collect())


def brute(left, right, tol=600):
    key = lambda s: None if s is None else s.strip().upper()
    first = {}
    for i, s, t in left:
        if s is not None and t is not None:
            k = (key(s), t)
            first[k] = min(first.get(k, i), i)
    out = []
    for (s, t), i in first.items():
        best = min(((abs((u - t).total_seconds()), u, j) for j, z, u, v in right if key(z) == s and u is not None and v is not None and v == v and abs((u - t).total_seconds()) <= tol), default=None)
        if best:
            out.append((i, best[2]))
    return sorted(out)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("seed", range(4))
def test_agrees_with_brute_force(spark, seed):
    rng = random.Random(seed)
    syms = ["AAA", "aaa ", " Bbb", "BBB", "CC", None]
    left = [(i, rng.choice(syms), at(rng.randrange(0, 40_000))) for i in range(150)]
    right = [(i, rng.choice(syms), at(rng.choice([rng.randrange(0, 40_000), rng.randrange(0, 40) * 1000])), rng.choice([1.0, None, float("nan"), 2.0])) for i in range(400)]
    assert run(spark, left, right) == brute(left, right)
    assert run(spark, left, right, tol=60) == brute(left, right, 60)
    # The size of the buckets never changes the result.
    assert run(spark, left, right, bucket_tolerances=1) == brute(left, right)


def test_tolerance_is_inclusive_and_ties_go_to_the_earlier_then_the_smaller(spark):
    assert run(spark, [(1, "A", at(1000))], [(5, "A", at(400), 1.0), (6, "A", at(1600), 1.0)]) == [(1, 5)]
    assert run(spark, [(1, "A", at(1000))], [(6, "A", at(1600), 1.0)]) == [(1, 6)]
    assert run(spark, [(1, "A", at(1000))], [(6, "A", at(1601), 1.0)]) == []
    assert run(spark, [(1, "A", at(1000))], [(9, "A", at(900), 1.0), (7, "A", at(900), 1.0), (8, "A", at(1100), 1.0)]) == [(1, 7)]


def test_repeats_count_once_under_the_smallest_id(spark):
    left = [(4, "A", at(10)), (2, "a", at(10)), (3, " A ", at(10))]
    assert run(spark, left, [(1, "A", at(12), 1.0)] * 3) == [(2, 1)]


def test_nulls_and_empty_tables(spark):
    assert run(spark, [], [(1, "A", at(0), 1.0)]) == []
    assert run(spark, [(1, "A", at(0))], []) == []
    assert run(spark, [(1, None, at(0)), (2, "A", None)], [(1, None, at(0), 1.0), (2, "A", None, 1.0)]) == []


def test_readings_without_a_value_do_not_exist(spark):
    right = [(1, "A", at(10), None), (2, "A", at(11), float("nan")), (3, "A", at(50), 5.0)]
    assert run(spark, [(1, "A", at(10))], right) == [(1, 3)]


def test_hot_entity_spreads_over_buckets(spark):
    left = [(i, "HOT", at(i * 300)) for i in range(500)]
    right = [(i, "HOT", at(i * 300 + 7), 1.0) for i in range(500)]
    assert run(spark, left, right) == [(i, i) for i in range(500)]
