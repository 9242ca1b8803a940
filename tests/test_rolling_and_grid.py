import datetime as dt
import random

import numpy as np
import pytest

from barloom.operators import regrid as G
from barloom.operators import rolling as R

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "bar_id bigint, symbol string, ts timestamp_ntz, close double, funding_rate double, funding_settled boolean, ingested_at timestamp, day string, value string, status string"


def rows(seed, n=300, span_h=24 * 50):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = T0 + dt.timedelta(hours=rng.randrange(span_h), seconds=rng.choice([0, 0, 31]))
        if 24 * 15 < (t - T0).total_seconds() / 3600 < 24 * 27:
            continue  # an outage
        out.append((i, rng.choice(["A", "A", "B"]), t, rng.choice([None, float("nan"), 10 + rng.random(), 11.0, 12.0]), rng.choice([None, 0.0, 1e-4]), rng.choice([None, False, False, True]), T0 + dt.timedelta(hours=i), "d", "v", "s"))
    return out


def latest_per_hour(data):
    h = {}
    for r in data:
        if r[1] is not None and r[2] is not None:
            k = (r[1], r[2].replace(minute=0, second=0))
            h.setdefault(k, []).append(r)
    return {k: (max(v, key=lambda r: (r[6], r[0])), any(r[5] for r in v)) for k, v in h.items()}


def brute(data, periods):
    h = latest_per_hour(data)
    out = {}
    for s in {k[0] for k in h}:
        days = [k[1].date() for k in h if k[0] == s]
        d = min(days)
        while d <= max(days):
            for p in periods:
                win = [v for k, v in h.items() if k[0] == s and d - dt.timedelta(days=p - 1) <= k[1].date() <= d]
                c = [v[0][3] for v in win if v[0][3] is not None and v[0][3] == v[0][3]]
                f = [v[0][4] for v in win if v[0][4] is not None]
                out[(s, d, p)] = (sum(f), sum(c) / len(c) if c else None, sum(v[1] for v in win))
            d += dt.timedelta(days=1)
    return out


def run(spark, data, periods):
    df = spark.createDataFrame(data, SCHEMA)
    out = R.trailing_totals(df, entity="symbol", ts="ts", sums=["funding_rate"], averages=["close"], flags=["funding_settled"], periods=periods, order=["ingested_at", "bar_id"])
    return {(r.symbol, r.day, r.days): (r.total_funding_rate, r.avg_close, r.n_funding_settled) for r in out.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_trailing_totals_agree_with_brute_force(spark, seed):
    data = rows(seed)
    data += data[:20]  # repeats
    got, want = run(spark, data, [1, 7, 30]), brute(data, [1, 7, 30])
    assert set(got) == set(want)
    for k, (f, c, n) in want.items():
        assert got[k][0] == pytest.approx(f, abs=1e-12) and got[k][2] == n
        assert (got[k][1] is None) == (c is None) and (c is None or got[k][1] == pytest.approx(c, rel=1e-9))


def test_trailing_of_empty_and_null_rows(spark):
    assert run(spark, [], [7]) == {}
    assert run(spark, [(1, None, T0, 1.0, 0.0, True, T0, "", "", ""), (2, "A", None, 1.0, 0.0, True, T0, "", "", "")], [7]) == {}
    assert run(spark, [(1, "A", T0, None, None, None, None, "", "", "")], [7]) == {("A", T0.date(), 7): (0.0, None, 0)}
    with pytest.raises(ValueError):
        run(spark, rows(0, 3), [0])


def test_gates_name_days(spark):
    gates = ["none", "dip:0.10:7", "DIP:.2:30", "sma:90", " SMA:5 ", "sma:0", "dip:x:9", None, "sma:99999"]
    df = spark.createDataFrame([(None if g is None else f'{{"gate": "{g}"}}',) for g in gates] + [("broken",), (None,)], "config_json string")
    assert R.gate_days(df) == [5, 7, 30, 90, 99999]  # a long gate is a period like any other


# Regular grid


def grid(spark, data, **kw):
    df = spark.createDataFrame(data, SCHEMA)
    return {(r.symbol, r.slot_start): (r.value, r.status) for r in G.regrid(df, source="symbol", ts="ts", value="close", tie="bar_id", **kw).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_every_slot_once_and_readings_unchanged(spark, seed):
    data = rows(seed)
    last = {}
    for r in data:
        if r[3] is not None and r[3] == r[3]:
            k = (r[1], r[2].replace(minute=0, second=0))
            last[k] = max(last.get(k, (dt.datetime.min, -1, 0)), (r[2], r[0], r[3]))
    got = grid(spark, data)
    for s in {k[0] for k in last}:
        hours = [k[1] for k in last if k[0] == s]
        n = int((max(hours) - min(hours)).total_seconds() // 3600) + 1
        assert {k[1] for k in got if k[0] == s} == {min(hours) + dt.timedelta(hours=i) for i in range(n)}
    for k, (v, st) in got.items():
        assert (st == G.STATUS_READ) == (k in last)
        if k in last:
            assert v == last[k][2]
        assert (v is None) == (st == G.STATUS_MARKED)


def test_blocks_do_not_change_what_is_read(spark):
    data = rows(5)
    a, b = grid(spark, data), grid(spark, data, block=48, margin=24, window=6)
    assert set(a) == set(b)
    assert {k for k, v in a.items() if v[1] == "read"} == {k for k, v in b.items() if v[1] == "read"}


def test_imputation_recovers_a_seasonal_series():
    rng = np.random.default_rng(0)
    t = np.arange(600)
    x = 100 + 0.01 * t + 5 * np.sin(2 * np.pi * t / 24) + 2 * np.cos(2 * np.pi * t / 12)
    y = x + rng.normal(0, 0.05, 600)
    gap = rng.choice(np.arange(30, 570), 90, replace=False)
    y[gap] = np.nan
    y[200:208] = np.nan
    got = G.ssa_fill(y, window=48, rank=6)
    miss = np.isnan(y)
    line = np.interp(t[miss], t[~miss], y[~miss])
    assert np.sqrt(np.mean((got[miss] - x[miss]) ** 2)) < 0.5 * np.sqrt(np.mean((line - x[miss]) ** 2))
    assert (got[~miss] == y[~miss]).all()


def walk_with_gaps(seed=5):
    rng = np.random.default_rng(seed)
    x = 100 * np.exp(np.cumsum(rng.normal(scale=0.005, size=400)))
    x[60:75] = np.nan
    x[150:190] = np.nan
    x[rng.choice(np.arange(200, 390), 30, replace=False)] = np.nan
    return x


def test_imputation_goes_on_until_the_missing_entries_stand_still():
    x = walk_with_gaps()
    gap = np.isnan(x)
    y = G.ssa_fill(x)
    # One more plain pass, written out, changes nothing beyond the tolerance.
    m, k = np.mean(x[~gap]), len(x) - 23
    h = np.array([y[i : i + k] - m for i in range(24)])
    u, s, v = np.linalg.svd(h, full_matrices=False)
    low = (u[:, :8] * s[:8]) @ v[:8]
    again = np.array([np.mean([low[i, t - i] for i in range(24) if 0 <= t - i < k]) for t in range(len(x))]) + m
    assert np.abs(again - y)[gap].max() <= 1.5e-5 * np.std(x[~gap])


def test_slots_of_a_block_that_does_not_stand_still_are_marked(spark):
    x = walk_with_gaps()
    data = [("A", T0 + dt.timedelta(hours=i), float(v), i) for i, v in enumerate(x) if np.isfinite(v)]
    d = spark.createDataFrame(data, "symbol string, ts timestamp_ntz, close double, bar_id bigint")
    f = lambda n: G.regrid(d, source="symbol", ts="ts", value="close", tie="bar_id", block=10_000, max_iter=n).groupBy("status").count().collect()
    gaps = int(np.isnan(x).sum())
    assert {r.status: r["count"] for r in f(3)} == {"read": 400 - gaps, "marked": gaps}
    assert {r.status: r["count"] for r in f(2000)} == {"read": 400 - gaps, "filled": gaps}


def test_imputation_of_degenerate_series():
    nan = float("nan")
    assert np.isnan(G.ssa_fill(np.array([nan, nan]))).all()
    assert G.ssa_fill(np.array([1.0, 2.0])).tolist() == [1.0, 2.0]
    assert G.ssa_fill(np.array([1.0, nan, 3.0])).tolist() == [1.0, 2.0, 3.0]
    assert G.ssa_fill(np.array([5.0] * 50 + [nan] + [5.0] * 50)).tolist() == [5.0] * 101


def test_grid_of_empty_single_and_null_rows(spark):
    assert grid(spark, []) == {}
    one = (1, "A", T0, 4.0, None, None, None, "", "", "")
    assert grid(spark, [one]) == {("A", T0): (4.0, "read")}
    assert grid(spark, [(1, None, T0, 4.0, None, None, None, "", "", ""), (2, "A", None, 4.0, None, None, None, "", "", ""), (3, "A", T0, None, None, None, None, "", "", "")]) == {}
    # An outage of years is marked, not invented.
    far = grid(spark, [one, (2, "A", T0 + dt.timedelta(days=400), 5.0, None, None, None, "", "", "")])
    assert len(far) == 9601 and sum(v[1] == "marked" for v in far.values()) == 9599
