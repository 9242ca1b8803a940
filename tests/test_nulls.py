"""Scorers of the search tests against the evaluators of the panel."""

import datetime as dt

import numpy as np
import pytest

from barloom.operators import analytic, metrics, nulls, rules, signal
from barloom.operators.analytic import Plan
from barloom.operators.rules import Rule
from barloom.operators.signal import Account

T0 = dt.datetime(2024, 1, 1)


def closes(n, seed):
    return 100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.01, n)))


def flat_panel(spark, close):
    rows = [("S", T0 + dt.timedelta(hours=i), i, *[float(c)] * 4, 1.0, 0.0, False, 1.0) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, bar_idx bigint, open double, high double, low double, close double, volume double, funding_rate double, funding_settled boolean, open_interest double")


def test_rates_of_a_grid_are_those_of_every_start(spark):
    c = closes(400, 1)
    plans = [Plan(stride=5, n=4, hold=10), Plan(stride=24, n=3), Plan(stride=300, n=9)]
    got = nulls.rate_scorer(plans)(c)
    assert np.isnan(got[2])
    for p, v in zip(plans, got[:2]):
        values = [r.terminal_value for r in analytic.evaluate(flat_panel(spark, c), p).collect()]
        rates = analytic.mwrr(np.array(values), p.amount, p.n, p.stride / 8760, p.horizon / 8760)
        assert v == pytest.approx(np.quantile(rates, 0.05), rel=1e-9)


def test_calmars_are_those_of_the_panel(spark):
    c, a = closes(700, 2), Account(leverage=2.0, stop_loss=0.2)
    cells = [Rule("cci_reversion", lookback_days=1, enter_level=x) for x in (80.0, 120.0)] + [Rule("cci_breakout", lookback_days=2)]
    got = nulls.calmar_scorer(cells, a, 300.0)(c, "S")
    want = [metrics.summary(signal.equity(rules.signals(flat_panel(spark, c), r), a), bars_per_year=300.0).first().calmar for r in cells]
    assert got == pytest.approx(want, rel=1e-7)
    assert np.isnan(nulls.calmar_scorer(cells, a)(c, "S")).all()  # under a year
    with pytest.raises(ValueError):
        nulls.calmar_scorer([Rule("carry_funding")], a)


def test_a_channel_of_nothing_is_missing():
    assert np.isnan(nulls.channel(np.full(50, 7.0), 24)).all() and np.isnan(nulls.channel(closes(10, 1), 24)).all()
