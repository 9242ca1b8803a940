import datetime as dt

import numpy as np
import pandas as pd
import pytest
from barloom.operators import spikes as S

T0 = dt.datetime(2024, 1, 1)
SCHEMA = (
    "row_id bigint, symbol string, ts string, open double, high double, low double, close double, volume double, taker_buy_base double, ingested_at timestamp, kind string, minute string"
)


def walk(n=2000, seed=0, symbol="AAA", price=100.0):
    rng = np.random.default_rng(seed)
    c = price * np.exp(np.cumsum(rng.normal(0, 0.0005, n)))
    o = np.concatenate([[price], c[:-1]])
    h, l = np.maximum(o, c) * (1 + rng.random(n) * 0.0005), np.minimum(o, c) * (1 - rng.random(n) * 0.0005)
    v = np.exp(rng.normal(5, 0.5, n))
    return [dict(row_id=i, symbol=symbol, ts=(T0 + dt.timedelta(minutes=i)).strftime("%Y-%m-%d %H:%M:%S"), open=o[i], high=h[i], low=l[i], close=c[i], volume=v[i], taker_buy_base=v[i] / 2, ingested_at=T0 + dt.timedelta(minutes=i, seconds=5), kind="k", minute="m") for i in range(n)]


def frame(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(float(r[n]) if isinstance(r[n], float) else r[n] for n in names) for r in rows], SCHEMA)


def found(spark, rows, **kw):
    return {r.row_id: r.kind for r in S.implausible_bars(frame(spark, rows), **kw).collect()}


def test_a_clean_walk_has_nothing(spark):
    assert found(spark, walk()) == {}


def test_impossible_rows(spark):
    rows = walk(100)
    rows[5]["low"] = 0.0
    rows[6]["high"] = rows[6]["close"] * 0.9
    rows[7]["volume"], rows[7]["taker_buy_base"] = -5.0, None
    rows[8]["taker_buy_base"] = rows[8]["volume"] * 2
    rows[9]["ts"], rows[9]["close"] = "n/a", -1.0
    rows[10]["symbol"], rows[10]["open"] = None, -1.0
    rows[11]["open"] = float("nan")
    rows[12]["close"] = None
    got = found(spark, rows)
    assert {k for k, v in got.items() if v == "impossible"} == {5, 6, 7, 8, 9, 10}
    assert 11 not in got and 12 not in got


def test_stuck_prices_and_volumes(spark):
    rows = walk(300)
    for i in range(50, 56):  # six
        for c in S.PRICES:
            rows[i][c] = rows[50][c]
    for i in range(100, 105):  # five are not enough
        for c in S.PRICES:
            rows[i][c] = rows[100][c]
    for i in range(200, 207):
        rows[i]["volume"], rows[i]["taker_buy_base"] = 77.0, 1.0
    for i in range(250, 260):  # a quiet market trades nothing
        rows[i]["volume"], rows[i]["taker_buy_base"] = 0.0, 0.0
    got = found(spark, rows)
    assert {k for k, v in got.items() if v == "stuck"} == set(range(50, 56)) | set(range(200, 207))


def test_stuck_across_a_block_edge_and_with_repeats(spark):
    first = 1440
    rows = walk(first + 200)
    for i in range(first - 3, first + 4):
        for c in S.PRICES:
            rows[i][c] = rows[first - 3][c]
    again = dict(rows[first - 1], row_id=900_000, ingested_at=T0 + dt.timedelta(days=30))
    got = found(spark, rows + [again], block_bars=1440)
    assert {k for k, v in got.items() if v == "stuck"} == set(range(first - 3, first + 4)) | {900_000}


def test_spikes_but_not_moves_or_wide_stretches(spark):
    rows = walk(3000, seed=3)
    rows[700]["low"] *= 0.93  # a wick
    for c in S.PRICES:  # a whole bar, ten times
        rows[1200][c] *= 10
    rows[1500]["volume"] *= 1000
    for i in range(2000, 3000):  # a move that stays
        for c in S.PRICES:
            rows[i][c] *= 1.2
    rng = np.random.default_rng(9)
    for i in range(400, 460):  # all bars are wide
        rows[i]["high"] *= 1 + 0.01 * rng.random()
        rows[i]["low"] *= 1 - 0.01 * rng.random()
    got = found(spark, rows)
    assert {k for k, v in got.items() if v == "spike"} == {700, 1200, 1500}


def test_a_spike_of_three_bars(spark):
    rows = walk(800, seed=5)
    for i, cs in ((300, ("low", "close")), (301, S.PRICES), (302, ("open", "low"))):
        for c in cs:
            rows[i][c] *= 0.95
    assert {300, 301, 302} == set(found(spark, rows))


def test_spellings_of_one_minute_and_corrected_deliveries(spark):
    rows = walk(400, seed=2)
    t = T0 + dt.timedelta(minutes=200)
    rows[200]["low"] *= 0.9
    for k, ts in enumerate([t.strftime("%Y-%m-%dT%H:%M:%SZ"), t.strftime("%Y/%m/%d %H:%M"), str(int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)), f"  {t:%Y-%m-%d %H:%M:%S} "]):
        rows.append(dict(rows[200], row_id=5000 + k, ts=ts, volume=rows[200]["volume"] * 1.01, ingested_at=T0 + dt.timedelta(days=1, seconds=k)))
    # A later delivery that differs is judged by its own values.
    rows.append(dict(rows[210], row_id=6000, high=rows[210]["high"] * 1.2, ingested_at=T0 + dt.timedelta(days=2)))
    assert set(found(spark, rows)) == {200, 5000, 5001, 5002, 5003, 6000}


def test_empty_single_and_null_rows(spark):
    assert found(spark, []) == {}
    assert found(spark, walk(1)) == {}
    blank = {n.split()[0]: None for n in SCHEMA.split(", ")}
    assert found(spark, [dict(blank, row_id=1), dict(blank, row_id=2, symbol="A", ts="2024-01-01 00:00:00")]) == {}


def test_deliveries_that_differ_in_what_is_null(spark):
    rows = walk(300, seed=4)
    x = rows[150]["high"] * 1.3
    rows.append(dict(rows[150], row_id=7000, open=None, high=None, low=None, close=x, ingested_at=T0 + dt.timedelta(days=1)))
    rows.append(dict(rows[150], row_id=7001, open=x, high=None, low=None, close=None, ingested_at=T0 + dt.timedelta(days=2)))
    assert set(found(spark, rows)) == {7000, 7001}


def test_blocks_of_other_lengths_agree(spark):
    rows = walk(6000, seed=8)
    for i in (100, 1440, 2879, 2880, 4000):
        rows[i]["high"] *= 1.1
    want = {100, 1440, 2879, 2880, 4000}
    assert set(found(spark, rows)) == set(found(spark, rows, block_bars=1440)) == set(found(spark, rows, block_bars=777)) == want


def test_principal_components_separate_sparse_from_low_rank():
    rng = np.random.default_rng(0)
    low = rng.normal(size=(80, 2)) @ rng.normal(size=(2, 200))
    sparse = np.zeros((80, 200))
    at = rng.choice(80 * 200, 400, replace=False)
    sparse.flat[at] = rng.choice([-30.0, 30.0], 400)
    l, s = S.rpca(low + sparse, tol=1e-7, max_iter=200)
    assert np.linalg.norm(l - low) / np.linalg.norm(low) < 1e-2
    assert set(np.flatnonzero(np.abs(s) > 5)) == set(at)
    assert not S.rpca(np.zeros((3, 4)))[1].any()


def outage(rows, at, hours):
    """The bars from `at` on come so many hours later."""
    for r in rows[at:]:
        t = dt.datetime.strptime(r["ts"], "%Y-%m-%d %H:%M:%S") + dt.timedelta(hours=hours)
        r["ts"] = t.strftime("%Y-%m-%d %H:%M:%S")
    return rows


@pytest.mark.parametrize("block", [1000, 960, 100_000])
def test_margins_count_bars_so_outages_hide_nothing(spark, block):
    rows = walk(2000, seed=6)
    for i in range(957, 963):  # a stuck run of six bars around the outage
        for c in S.PRICES:
            rows[i][c] = rows[957][c]
    rows[1003]["low"] *= 0.95  # a spike three bars after another
    rows = outage(outage(rows, 960, 13), 1000, 50)
    assert set(found(spark, rows, block_bars=block)) == {*range(957, 963), 1003}


def regimes(days=6, seed=1):
    """Whole days that are twelve times as restless as the others, as days go by turns."""
    rng = np.random.default_rng(seed)
    n = days * 1440
    sd = np.where(np.arange(n) // 1440 % 2 == 0, 0.0002, 0.0024)
    rows = walk(n, seed=seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 1, n) * sd))
    o = np.concatenate([[100.0], c[:-1]])
    h, l = np.maximum(o, c) * (1 + rng.random(n) * sd), np.minimum(o, c) * (1 - rng.random(n) * sd)
    for r, *v in zip(rows, o, h, l, c):
        r.update(zip(("open", "high", "low", "close"), map(float, v)))
    return rows, sd


def test_the_components_decide(spark, monkeypatch):
    rows, sd = regimes()
    want = set()
    for i in range(400, len(rows), 1440):  # twelve times the restlessness of its day
        rows[i]["low"] *= 1 - 20 * sd[i]
        want.add(i)
    assert set(found(spark, rows)) == want
    pdf = pd.DataFrame([{**{c: r[c] for c in (*S.PRICES, "volume")}, "minute": i, "own_block": 0, "differ": False} for i, r in enumerate(rows)])
    assert want <= set(S._context(pdf, 0, S.PARAMETERS)["minute"])
    monkeypatch.setattr(S, "rpca", lambda m, **_: (np.zeros_like(m), m))
    # Without the low-rank part the quiet days' spikes are lost, and restless days' bars come up in numbers.
    got = set(S._context(pdf, 0, S.PARAMETERS)["minute"])
    assert not want <= got
    monkeypatch.setattr(S, "rpca", lambda m, **_: (m, np.zeros_like(m)))
    assert len(S._context(pdf, 0, S.PARAMETERS)) == 0


def test_what_recurs_every_day_is_normal(spark):
    rows = walk(20 * 1440, seed=12)
    for i in range(600, len(rows), 1440):  # every day at ten
        rows[i]["high"] *= 1.012
    rows[9 * 1440 + 900]["high"] *= 1.02
    assert set(found(spark, rows)) == {9 * 1440 + 900}


@pytest.mark.parametrize("seed", [101, 202])
def test_graded_plants(spark, seed):
    """Spikes of every strength in sources of other restlessness: found from some ten times the usual range on, none below five."""
    rng = np.random.default_rng(seed)
    rows, strength = [], {}
    for s in range(4):
        part = walk(4000, seed=seed + s, symbol=f"S{s}", price=10.0 ** (s - 1))
        for i in range(60, 3940, 40):
            k = float(rng.choice([2.0, 3.0, 14.0, 20.0, 40.0]))
            width = np.median([np.log(r["high"] / r["low"]) for r in part[i - 30 : i + 30]])
            if rng.random() < 0.5:
                part[i]["low"] = min(part[i]["low"], part[i]["close"] * np.exp(-k * width))
            else:
                for c in S.PRICES:
                    part[i][c] *= np.exp(k * width)
            strength[len(rows) + i] = k
        rows += part
    for i, r in enumerate(rows):
        r["row_id"] = i
    got = found(spark, rows)
    far = {i for i, k in strength.items() if k >= 14}
    assert len(far & set(got)) >= 0.9 * len(far)
    assert len([i for i in got if i not in far]) <= 0.1 * len(got)
