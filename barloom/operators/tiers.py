"""Margin tiers and liquidation levels as column expressions; the tables are literals, so no join is needed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom import constants as K


def tier_name(symbol: Column) -> Column:
    return F.when(symbol.isin(*K.BTC_SYMBOLS), "BTC_LIKE").when(symbol.isin(*K.MAJOR_SYMBOLS), "MAJOR_ALT").otherwise("LONG_TAIL")


def table_for(symbol: str) -> list[tuple[float, float, float, float]]:
    return K.TIERS["BTC_LIKE" if symbol in K.BTC_SYMBOLS else "MAJOR_ALT" if symbol in K.MAJOR_SYMBOLS else "LONG_TAIL"]


def _of_table(notional: Column, name: str, field: int) -> Column:
    tiers = K.TIERS[name]
    out = None
    for t in tiers[:-1]:
        hit = F.abs(notional) <= t[0]
        out = F.when(hit, F.lit(t[field])) if out is None else out.when(hit, F.lit(t[field]))
    return out.otherwise(F.lit(tiers[-1][field]))


def _lookup(notional: Column, tier: Column, field: int) -> Column:
    return F.when(tier == "BTC_LIKE", _of_table(notional, "BTC_LIKE", field)).when(tier == "MAJOR_ALT", _of_table(notional, "MAJOR_ALT", field)).otherwise(_of_table(notional, "LONG_TAIL", field))


def mmr(notional: Column, tier: Column) -> Column:
    """Maintenance rate of the first tier whose cap holds |notional|, of the last one beyond all caps."""
    return _lookup(notional, tier, 1)


def cum(notional: Column, tier: Column) -> Column:
    return _lookup(notional, tier, 2)


def max_leverage(notional: Column, tier: Column) -> Column:
    return _lookup(notional, tier, 3)


def margin(notional: Column, tier: Column) -> Column:
    return F.abs(notional) * mmr(notional, tier) - cum(notional, tier)


def is_liquidated_long(wallet: Column, qty: Column, entry: Column, mark: Column, tier: Column) -> Column:
    return wallet + qty * (mark - entry) <= margin(qty * mark, tier)


def liquidation_level(side: int, wallet: Column, qty: Column, entry: Column, tier: Column, passes: int = 3) -> Column:
    """Price at which equity meets the maintenance margin, by fixed-point passes from the entry; at least 0."""
    def step(price: Column, _) -> Column:
        r, c = mmr(qty * price, tier), cum(qty * price, tier)
        return F.greatest(F.try_divide(qty * entry - side * (wallet + c), qty * (F.lit(1.0) - side * r)), F.lit(0.0))

    # A fold keeps the expression small: each pass names the last level many times.
    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), entry.cast("double"), step)


class Tiers:
    """The same tables for Arrow kernels."""

    def __init__(self, symbol: str):
        t = np.array(table_for(symbol))
        self.caps, self.mmr, self.cum, self.lev = t.T

    def at(self, notional):
        k = np.minimum(np.searchsorted(self.caps, np.abs(notional), side="left"), len(self.caps) - 1)
        return self.mmr[k], self.cum[k]

    def leverage(self, notional: float) -> float:
        return float(self.lev[min(int(np.searchsorted(self.caps, abs(notional), side="left")), len(self.caps) - 1)])

    def level(self, side: int, wallet, qty: float, entry: float, passes: int = 3) -> np.ndarray:
        """liquidation_level of arrays: qty * (price - entry) * side + wallet = maintenance at the price."""
        wallet = np.asarray(wallet, float)
        size = np.full(wallet.shape, qty * entry)
        for _ in range(passes):
            r, c = self.at(size)
            size = np.maximum((qty * entry - side * (wallet + c)) / (1.0 - side * r), 0.0)
        return size / qty
