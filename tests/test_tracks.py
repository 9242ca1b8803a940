"""Evaluators against independent bar-by-bar versions, and the properties that results must have."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom import constants as K
from barloom.operators import analytic as A
from barloom.operators import metrics, rules, signal, simulate, tiers
from barloom.operators import timeseries as W
from barloom.operators.analytic import Plan
from barloom.operators.rules import Rule
from barloom.operators.signal import Account
from barloom.operators.simulate import PathPlan
from barloom.operators.tiers import Tiers

T0 = dt.datetime(2024, 1, 1)


def market(n, seed=0, sigma=0.004, funding=True):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.standard_t(3, n) * sigma))
    return dict(
        close=c, low=c * (1 - np.abs(rng.normal(0, sigma / 2, n))), high=c * (1 + np.abs(rng.normal(0, sigma / 2, n))),
        funding_rate=np.where(np.arange(n) % 8 == 0, rng.normal(1e-4, 2e-4, n), 0.0) if funding else np.zeros(n), funding_settled=np.arange(n) % 8 == 0, open_interest=1000 * np.exp(np.cumsum(rng.normal(0, 0.01, n))),
    )


def panel(spark, **sources):
    rows = [
        (s, T0 + dt.timedelta(hours=i), i, *(float(m[c][i]) for c in ("close", "high", "low", "close")), 1.0, float(m["funding_rate"][i]), bool(m["funding_settled"][i]), float(m["open_interest"][i]))
        for s, m in sources.items() for i in range(len(m["close"]))
    ]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, bar_idx bigint, open double, high double, low double, close double, volume double, funding_rate double, funding_settled boolean, open_interest double")


PLANS = [Plan(stride=5, n=7, hold=11), Plan(stride=1, n=4, hold=0), Plan(stride=24, n=3, hold=50)]


def slow_dca(m, plan, funding):
    n, h, out = len(m["close"]), plan.horizon, {}
    paid = plan.amount / (1 + plan.c_in)
    for s in range(n - h):
        units = sum(paid / m["close"][s + j * plan.stride] for j in range(plan.n))
        bill = 0.0
        if funding:
            for j in range(plan.n):
                at = s + j * plan.stride
                bill += paid / m["close"][at] * sum(m["close"][t] * m["funding_rate"][t] for t in range(at, s + h + 1))
        out[s] = units * m["close"][s + h] * (1 - plan.c_out) - bill
    return out


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("funding", [False, True])
def test_closed_form_is_the_loop(spark, plan, funding):
    m = market(220, seed=plan.stride)
    got = {r.start_idx: r.terminal_value for r in A.evaluate(panel(spark, S=m), plan, funding).collect()}
    assert got == pytest.approx(slow_dca(m, plan, funding), rel=1e-10)


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("funding", [False, True])
def test_closed_form_is_the_simulator(plan, funding):
    m = market(300, seed=9)
    starts = np.arange(300 - plan.horizon)
    out = simulate.simulate(m["close"], m["low"], starts, PathPlan(plan, funding=funding), Tiers("BTCUSDT"), m["funding_rate"])
    want = slow_dca(m, plan, funding)
    # Without leverage the wallet holds the deposits, and the position's cost basis cancels them.
    assert out["terminal_equity"].to_numpy() == pytest.approx(np.array([want[s] for s in starts]), rel=1e-9)


def test_chunks_do_not_change_the_simulation(spark):
    m = {"S": market(400, 1), "T": market(90, 2), "U": market(10, 3)}
    p = PathPlan(Plan(stride=6, n=8, hold=5), leverage=4.0, take_profit=0.2, stop_loss=0.4)
    whole = {(r.symbol, r.start_idx): r.terminal_equity for r in simulate.simulate_panel(panel(spark, **m), p).collect()}
    parts = {(r.symbol, r.start_idx): r.terminal_equity for r in simulate.simulate_panel(panel(spark, **m), p, chunk=13).collect()}
    assert whole == parts
    assert {s for s, _ in whole} == {"S", "T"}
    direct = simulate.simulate(m["S"]["close"], m["S"]["low"], np.arange(400 - p.plan.horizon - 1), p, Tiers("S"), m["S"]["funding_rate"])
    assert [whole[("S", i)] for i in direct["start_idx"]] == pytest.approx(direct["terminal_equity"].tolist())


def slow_path(m, s, p, tiers_):
    """One start, one bar at a time, in plain floats."""
    plan, wallet, qty, basis, put, idle, peak, dd, paid, done = p.plan, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0
    for e in range(plan.horizon + 1):
        t = s + e
        price, low = m["close"][t], m["low"][t]
        if qty > 0:
            ep = basis / qty
            dd = max(dd, peak - (wallet + qty * (low - ep) - put))
            r, c = tiers_.at(np.array([qty * low]))
            if wallet + qty * (low - ep) <= qty * low * r[0] - c[0]:
                return 0.0, 1, e, max(dd, peak + put)
        if e % plan.stride == 0 and done < plan.n:
            wallet, put, idle, done = wallet + plan.amount, put + plan.amount, idle + plan.amount, done + 1
        if idle > 0:
            qty += idle * p.leverage / (price * (1 + plan.c_in))
            basis += idle * p.leverage
            idle = 0.0
        wallet -= qty * price * m["funding_rate"][t]
        ep = basis / qty
        pnl = wallet + qty * (price - ep) - put
        peak, dd = max(peak, pnl), max(dd, max(peak, pnl) - pnl)
        why = 2 if p.take_profit is not None and pnl / put >= p.take_profit else 3 if p.stop_loss is not None and pnl / put <= -p.stop_loss else 0 if e == plan.horizon else None
        if why is not None:
            return wallet + qty * (price * (1 - plan.c_out) - ep), why, e, dd


@pytest.mark.parametrize("lev,tp,sl,sigma", [(1.0, None, None, 0.01), (5.0, None, None, 0.02), (3.0, 0.3, 0.3, 0.01), (10.0, 0.5, None, 0.01)])
def test_simulator_agrees_with_one_start_at_a_time(lev, tp, sl, sigma):
    m = market(160, seed=int(lev), sigma=sigma)
    p = PathPlan(Plan(stride=7, n=6, hold=20), leverage=lev, take_profit=tp, stop_loss=sl)
    out = simulate.simulate(m["close"], m["low"], np.arange(100), p, Tiers("X"), m["funding_rate"])
    for s in range(100):
        v, why, e, dd = slow_path(m, s, p, Tiers("X"))
        r = out.iloc[s]
        assert (r.exit_reason, r.exit_bar) == (why, e)
        assert r.terminal_equity == pytest.approx(v, rel=1e-9, abs=1e-9) and r.max_dd_abs == pytest.approx(dd, rel=1e-9, abs=1e-9)


def test_simulator_refusals_and_gates():
    m = market(60)
    with pytest.raises(ValueError):
        simulate.simulate(m["close"], m["low"], np.array([50]), PathPlan(Plan(stride=5, n=4)), Tiers("X"))
    with pytest.raises(ValueError):
        simulate.simulate(m["close"], m["low"], np.array([0]), PathPlan(Plan(stride=5, n=4)), Tiers("X"), np.full(60, np.nan))
    with pytest.raises(ValueError):
        PathPlan(leverage=-1.0)
    with pytest.raises(ValueError):
        Plan(hold=-1)
    shut = simulate.simulate(m["close"], m["low"], np.array([0]), PathPlan(Plan(stride=5, n=4)), Tiers("X"), gate=np.zeros(60, bool)).iloc[0]
    assert shut.terminal_equity == shut.invested and shut.units == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(1, 1e5), min_size=30, max_size=80), st.floats(0, 0.2))
def test_a_wick_never_shrinks_a_drawdown_and_costs_never_help(prices, wick):
    c = np.array(prices)
    p = Plan(stride=3, n=4, hold=5)
    run = lambda low, plan: simulate.simulate(c, low, np.array([0]), PathPlan(plan), Tiers("X")).iloc[0]
    assert run(c * (1 - wick), p).max_dd_abs >= run(c, p).max_dd_abs - 1e-9
    dear = Plan(stride=3, n=4, hold=5, fee_bps=50.0, exit_fee_bps=50.0)
    assert run(c, dear).terminal_equity <= run(c, p).terminal_equity + 1e-9


# Money-weighted rates


def test_rate_solvers_agree():
    for v in (50.0, 500.0, 900.0):
        r = float(A.mwrr(np.array([v]), 100.0, 5, 0.25, 1.5)[0])
        flows, years = np.array([-100.0] * 5 + [v]), np.array([0, 0.25, 0.5, 0.75, 1.0, 1.5])
        assert r == pytest.approx(A.mwrr_irregular(flows, years), abs=1e-6)
    edge = A.mwrr(np.array([0.0, 1e-13, 1e-9, 1e9, np.nan]), 100.0, 5, 0.1, 0.4)
    assert edge[0] == edge[1] == -1.0 and edge[2] == A.LOW and edge[3] == A.HIGH and math.isnan(edge[4])
    assert math.isnan(A.mwrr_irregular(np.array([1.0, 1.0]), np.array([0.0, 1.0])))


# Profiles


def test_profile_of_non_finite_and_single_values(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", None), ("A", float("nan")), ("A", float("inf")), ("A", 3.0), ("B", 2.0), ("C", None)], "symbol string, v double")
    p = {r.symbol: r for r in A.start_profile(df, "v", "v").collect()}
    assert (p["A"].v_n, p["A"].v_n_non_finite, p["A"].v_q50, p["A"].v_mean) == (2, 3, 2.0, 2.0)
    assert p["B"].v_std == 0.0 and p["C"].v_n == 0 and p["C"].v_q50 is None
    x = np.random.default_rng(0).normal(size=101)
    q = A.start_profile(spark.createDataFrame([("A", float(v)) for v in x], "symbol string, v double"), "v", "v").first()
    assert [q[f"v_q{round(100 * a):02d}"] for a in K.QUANTILES] == pytest.approx(np.quantile(x, K.QUANTILES).tolist())


# Liquidation


def test_levels_of_columns_and_arrays_agree(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(s, w, q) for s in ("BTCUSDT", "ETHUSDT", "ZZZ") for w in (10.0, 500.0, 1e5) for q in (0.1, 30.0, 4e4)], "symbol string, w double, q double")
    d = df.withColumn("tier", tiers.tier_name(F.col("symbol")))
    for side in (1, -1):
        got = d.withColumn("l", tiers.liquidation_level(side, F.col("w"), F.col("q"), F.lit(100.0), F.col("tier"))).collect()
        for r in got:
            assert r.l == pytest.approx(float(Tiers(r.symbol).level(side, np.array(r.w), r.q, 100.0)))


def test_ten_times_is_gone_at_about_ten_percent():
    level = float(Tiers("BTCUSDT").level(1, np.array(1000.0), 100.0, 100.0))
    assert 89.5 < level < 91.0


# Signals


def slow_signals(m, entry, exit_, a, t):
    """Independent account, one bar at a time: state, not index arithmetic."""
    p, n, cash, out, pos, wait = m["close"], len(m["close"]), a.capital, [], None, 0
    for i in range(n):
        if pos is None:
            if i > 0 and wait <= i - 1 and entry[i - 1] != 0 and i <= n - 2 and cash > 0:
                side = int(entry[i - 1])
                fill = p[i] * (1 + side * a.cost)
                pos = dict(side=side, at=i, fill=fill, qty=cash * a.leverage / fill, acc=0.0, leave=bool(exit_[i]))
            continue
        side, q, fill = pos["side"], pos["qty"], pos["fill"]
        before = pos["acc"]
        after = before - side * q * p[i] * m["funding_rate"][i]
        level = float(t.level(side, np.array(cash + min(before, after)), q, fill))
        bad, good = (m["low"][i], m["high"][i]) if side > 0 else (m["high"][i], m["low"][i])
        margin = cash / q
        ends = []
        if side * (bad - level) <= 0:
            ends.append((0, "liquidation", level))
        if a.stop_loss is not None and side * (bad - (fill - side * a.stop_loss * margin)) <= 0:
            ends.append((1, "stop_loss", fill - side * a.stop_loss * margin))
        if a.take_profit is not None and side * (good - (fill + side * a.take_profit * margin)) >= 0:
            ends.append((2, "take_profit", fill + side * a.take_profit * margin))
        if a.max_hold is not None and i - pos["at"] >= a.max_hold:
            ends.append((3, "max_hold", p[i]))
        if pos["leave"] or i == n - 1:
            ends.append((4, "signal", p[i]))
        pos["acc"], pos["leave"] = after, bool(exit_[i])
        if ends:
            _, why, price = min(ends)
            if why == "liquidation":
                pnl = -cash
            else:
                pnl = side * q * (price * (1 - side * a.cost) - fill) + after
            cash += pnl
            out.append((pos["at"], i, side, why, pnl))
            pos, wait = None, i + 1
            if cash <= 0:
                break
    return out, cash


@pytest.mark.parametrize("seed", range(60))
def test_trade_scan_agrees_with_the_slow_account(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(20, 400))
    m = market(n, seed, sigma=float(rng.choice([0.002, 0.01, 0.05])), funding=bool(rng.random() < 0.7))
    entry, exit_ = rng.choice([-1, 1, 0], n, p=[0.15, 0.15, 0.7]), rng.random(n) < rng.choice([0.02, 0.1, 0.3])
    pick = lambda *v: v[int(rng.integers(len(v)))]
    a = Account(leverage=pick(1.0, 2.0, 5.0), stop_loss=pick(0.05, 0.25, None), take_profit=pick(0.05, 0.5, None), max_hold=pick(int(rng.integers(2, 50)), None))
    got, eq = signal.run(m, entry, exit_, a, Tiers("ZZZ"))
    want, cash = slow_signals(m, entry, exit_, a, Tiers("ZZZ"))
    assert [(t["entry_bar"], t["exit_bar"], t["side"], t["reason"]) for t in got] == [w[:4] for w in want]
    assert [t["pnl"] for t in got] == pytest.approx([w[4] for w in want], rel=1e-7, abs=1e-6)
    assert eq[-1] == pytest.approx(cash, rel=1e-7, abs=1e-6) and len(eq) == n and (eq >= 0).all()
    assert all(t["exit_bar"] > t["entry_bar"] for t in got)
    for t in got:
        assert t["gross"] + t["funding"] == pytest.approx(t["pnl"], rel=1e-9, abs=1e-6)


def test_short_is_paid_what_long_pays():
    m = market(60, 1)
    m["close"], m["high"], m["low"] = (np.full(60, 100.0) for _ in range(3))
    e, x = np.zeros(60, int), np.zeros(60, bool)
    e[3], x[50] = 1, True
    a = Account(fee_bps=0.0, slip_bps=0.0)
    long_, short = signal.run(m, e, x, a, Tiers("X"))[0][0], signal.run(m, -e, x, a, Tiers("X"))[0][0]
    assert long_["funding"] == pytest.approx(-short["funding"]) and long_["gross"] == short["gross"] == 0.0


def test_refusals():
    m = market(30)
    with pytest.raises(ValueError):
        signal.run(m, np.zeros(30, int), np.zeros(30, bool), Account(leverage=60.0), Tiers("ZZZ"))
    m["funding_rate"][3] = np.nan
    with pytest.raises(ValueError):
        signal.run(m, np.zeros(30, int), np.zeros(30, bool), Account(), Tiers("ZZZ"))


def test_grouped_scan_and_summary(spark):
    p = panel(spark, A=market(300, 4), B=market(300, 5))
    s = rules.signals(p, Rule("cci_reversion", lookback_days=1))
    t = signal.trades(s, Account())
    eq = {(r.symbol, r.bar_idx): r.equity for r in signal.equity(s, Account()).collect()}
    for r in t.groupBy("symbol").agg({"pnl": "sum"}).collect():
        assert eq[(r.symbol, 299)] == pytest.approx(10_000 + r[1])
    h = {(r.symbol, r.reason): r.n for r in signal.exit_histogram(t).collect()}
    assert sum(h.values()) == t.count() == sum(r.n_trades for r in signal.trade_summary(t).collect())
    assert signal.trades(s.where("false"), Account()).count() == 0


# Rules


def test_rules_are_causal(spark):
    a, b = market(400, 6), market(400, 7)
    for c in a:
        b[c][:300] = a[c][:300]
    for r in (Rule("cci_mtf", lookback_days=1, filter_hours=4, filter_level=50.0), Rule("cci_breakout", lookback_days=2, timeframe_hours=4), Rule("carry_funding", lookback_days=2), Rule("oi_confirmed_reversion", lookback_days=1, oi_drop=0.01)):
        d = rules.signals(panel(spark, A=a, B=b), r).where("bar_idx < 300").select("symbol", "bar_idx", "entry", "exit").collect()
        of = lambda s: sorted((x.bar_idx, x.entry, x.exit) for x in d if x.symbol == s)
        assert of("A") == of("B") and len(of("A")) == 300


def test_missing_readings_exit_channel_rules_but_not_carry(spark):
    flat = market(100, 1)
    for c in ("close", "high", "low"):
        flat[c][:] = 50.0
    flat["funding_settled"][:] = False
    p = panel(spark, A=flat)
    assert all(r.exit and r.entry == 0 for r in rules.signals(p, Rule("cci_reversion", lookback_days=1)).collect())
    assert not any(r.exit or r.entry for r in rules.signals(p, Rule("carry_funding", lookback_days=1)).collect())


def test_rule_registry(spark):
    with pytest.raises(ValueError):
        rules.signals(panel(spark, A=market(5)), Rule("nothing"))
    with pytest.raises(ValueError):
        rules.register_rule("cci_mtf", rules.cci_mtf)
    for bad in (Rule("carry_funding", enter=0.0, exit=1.0), Rule("cci_reversion", enter_level=1.0, exit_level=2.0), Rule("oi_confirmed_reversion")):
        with pytest.raises(ValueError):
            rules.signals(panel(spark, A=market(5)), bad)
    assert rules.period(0.5, 1) == 12 and rules.period(2.5 / 24, 1) == 2  # half to even


# Windows and metrics


def test_gates_look_back_only(spark):
    m = market(120, 3, sigma=0.02)
    p = W.gate_sma(W.gate_dip(W.gate_dip(panel(spark, A=m), 0.05, 10, "d"), 0.05, 0, "e"), 10, "s")
    assert not any(r.d or r.s for r in W.gate_sma(W.gate_dip(panel(spark, A=m), 0.05, 120, "d"), 120, "s").collect())
    d = p.select("bar_idx", "d", "e", "s").orderBy("bar_idx").collect()
    c = m["close"]
    for i, r in enumerate(d):
        assert r.d == (i >= 9 and c[i] <= max(c[max(0, i - 10):i]) * 0.95)
        assert r.e == (i > 0 and c[i] <= max(c[:i]) * 0.95)
        assert r.s == (i >= 10 and bool(c[i] <= np.mean(c[i - 10:i])))


def test_suffix_sums_over_blocks(spark):
    from pyspark.sql import functions as F

    m = market(50)
    got = [r.w for r in W.suffix_sum(panel(spark, A=m), F.col("close"), "w", block=7).orderBy("bar_idx").collect()]
    assert got == pytest.approx(np.cumsum(m["close"][::-1])[::-1].tolist())


def test_curve_metrics(spark):
    def of(values, bpy=4.0):
        df = spark.createDataFrame([("A", i, None if v is None else float(v)) for i, v in enumerate(values)], "symbol string, bar_idx bigint, equity double")
        return metrics.summary(df, bars_per_year=bpy).first()

    r = of([100, 120, 90, 150, 200])
    assert r.cagr == pytest.approx(1.0) and r.max_drawdown == pytest.approx(0.25) and r.calmar == pytest.approx(4.0) and r.total_return == pytest.approx(1.0)
    x = np.diff(np.log([100, 120, 90, 150, 200]))
    assert r.sharpe == pytest.approx(x.mean() / x.std(ddof=1) * 2)
    assert of([100, 120]).cagr is None  # under a year
    assert of([100, 120, 90, 0, 0]).cagr == -1.0 and of([100, 120, 90, 0, 0]).sharpe is None
    for bad in ([100, None, 90, 150, 200], [100, float("nan"), 90, 150, 200]):
        b = of(bad)
        assert b.cagr is b.max_drawdown is b.calmar is b.sharpe is None
    assert of([100, 101, 102, 103, 104]).calmar is None


@pytest.mark.parametrize("funding", [False, True])
def test_a_grid_in_one_pass_is_its_plans(spark, funding):
    p = panel(spark, A=market(150, 1), B=market(40, 2))
    plans = [Plan(stride=k, n=n, hold=h) for k in (3, 7) for n in (2, 5) for h in (0, 6)] + [Plan(stride=200, n=3)]
    got = {(r.symbol, r.cell, r.start_idx): r.terminal_value for r in A.evaluate_many(p, plans, funding).collect()}
    want = {(r.symbol, i, r.start_idx): r.terminal_value for i, q in enumerate(plans) for r in A.evaluate(p, q, funding).collect()}
    assert got == pytest.approx(want)
