"""Scorers of a search on one series of closes: what the best of a grid is worth there, track by track.

They map the closes of all bars in their order to one value per cell, as `inference.path_scores` wants it. On a
resampled path only closes exist, so highs and lows are the closes and nothing is funded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from barloom import constants as K
from barloom.operators import signal
from barloom.operators.analytic import Plan, mwrr
from barloom.operators.rules import Rule, period
from barloom.operators.signal import Account
from barloom.operators.tiers import Tiers


def rate_scorer(plans: Sequence[Plan], q: float = 0.05, bars_per_year: float = K.BARS_PER_YEAR["1h"]) -> Callable[[np.ndarray], np.ndarray]:
    """The q quantile over all starts of every plan's money-weighted annual rate; NaN where a plan has no start.

    Within a plan the rate grows with the value, so a quantile of the rates lies between the rates of two neighbouring
    values, and only these are solved for.
    """

    gap = np.array([p.stride / bars_per_year for p in plans])
    n, amount, t = (np.array([float(f(p)) for p in plans]) for f in (lambda p: p.n, lambda p: p.amount, lambda p: p.horizon / bars_per_year))

    def score(close: np.ndarray) -> np.ndarray:
        two, part, r = np.full((2, len(plans)), np.nan), np.zeros(len(plans)), 1.0 / close
        for i, p in enumerate(plans):
            m = len(close) - p.horizon
            if p.horizon == 0 or m <= 0:
                continue
            units = sum(r[j * p.stride : j * p.stride + m] for j in range(p.n))
            value = p.amount / (1.0 + p.c_in) * units * close[p.horizon :] * (1.0 - p.c_out)
            at = q * (m - 1)
            k = [int(np.floor(at)), min(int(np.floor(at)) + 1, m - 1)]
            two[:, i], part[i] = np.partition(value, k)[k], at - k[0]
        low, high = mwrr(two, amount, n, gap, t)  # all plans at once
        return low + (high - low) * part

    return score


def channel(close: np.ndarray, width: int) -> np.ndarray:
    """The commodity channel index of closes; NaN while the window is short and where nothing deviates."""
    out = np.full(len(close), np.nan)
    if len(close) >= width:
        w = np.lib.stride_tricks.sliding_window_view(close, width)
        mean = w.mean(axis=1)
        mad = np.abs(w - mean[:, None]).mean(axis=1)
        ok = mad > 1e-15 * np.abs(mean)
        out[width - 1 :][ok] = (close[width - 1 :][ok] - mean[ok]) / (K.CCI_FACTOR * mad[ok])
    return out


def calmar(equity: np.ndarray, bars_per_year: float) -> float:
    """Annual growth over the deepest drawdown of a finite curve; NaN under a year or without a drawdown."""
    years = (len(equity) - 1) / bars_per_year
    if years < K.MIN_YEARS_TO_ANNUALISE or equity[0] <= 0:
        return float("nan")
    fall = float(np.max(1.0 - equity / np.maximum(np.maximum.accumulate(equity), 1e-12)))
    growth = -1.0 if equity[-1] <= 0 else (equity[-1] / equity[0]) ** (1.0 / years) - 1.0
    return growth / fall if fall >= K.MIN_DRAWDOWN_FOR_CALMAR else float("nan")


def calmar_scorer(cells: Sequence[Rule], a: Account, bars_per_year: float = K.BARS_PER_YEAR["1h"]) -> Callable[[np.ndarray, str], np.ndarray]:
    """The Calmar ratio of the account of every channel rule (reversion or breakout on the series' own bars)."""
    for r in cells:
        if r.name not in ("cci_reversion", "cci_breakout") or r.timeframe_hours != r.step_hours:
            raise ValueError(f"{r.name} is not scored on closes alone")

    def score(close: np.ndarray, symbol: str) -> np.ndarray:
        bars = {"close": close, "high": close, "low": close, "funding_rate": np.zeros(len(close))}
        tiers, read, out = Tiers(symbol), {}, []
        for r in cells:
            width = period(r.lookback_days, r.timeframe_hours)
            if width not in read:
                read[width] = channel(close, width)
            v, side = read[width], 1 if r.name == "cci_breakout" else -1
            with np.errstate(invalid="ignore"):
                entry = side * ((v >= r.enter_level).astype(int) - (v <= -r.enter_level).astype(int))
                leave = np.isnan(v) | (np.abs(v) <= r.exit_level)
            out.append(calmar(signal.run(bars, entry, leave, a, tiers)[1], bars_per_year))
        return np.array(out)

    return score
