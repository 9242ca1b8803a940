"""Signal rules: indicator columns to (entry, exit). No reading is null, never NaN."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import constants as K
from barloom.functions.columns import days_to_bars
from barloom.operators.asof import closed_block_asof
from barloom.operators.cleaning import tumble
from barloom.operators.timeseries import INDEX, SOURCE, change, mean_and_mad, settlement_mean


@dataclass(frozen=True)
class Rule:
    """What a signal rule reads; levels are in its indicator's units, times in days and hours."""

    name: str = "carry_funding"
    lookback_days: float = 21.0
    enter: float = 1.5e-4
    exit: float = 5e-5
    timeframe_hours: int = 1
    enter_level: float = 100.0
    exit_level: float = 0.0
    filter_level: float = 100.0
    filter_hours: int | None = None
    filter_lookback_days: float | None = None
    oi_drop: float | None = None
    step_hours: int = 1


def period(days: float, hours: int) -> int:
    """Blocks in a lookback, rounded half to even."""
    return days_to_bars(days, 24.0 / hours)


def _signals(df: DataFrame, long_: Column, short: Column, out: Column) -> DataFrame:
    entry = F.when(F.coalesce(long_, F.lit(False)), F.lit(1)).when(F.coalesce(short, F.lit(False)), F.lit(-1)).otherwise(F.lit(0)).cast("int")
    return df.withColumn("entry", entry).withColumn("exit", F.coalesce(out, F.lit(False)))


def carry_funding(panel: DataFrame, r: Rule) -> DataFrame:
    """Short while the mean settlement pays enough; a missing mean neither enters nor exits."""
    if r.enter < r.exit:
        raise ValueError("entry level under exit level")
    d = settlement_mean(panel, days_to_bars(r.lookback_days, 24.0 / r.step_hours), "reading")
    return _signals(d, F.lit(False), F.col("reading") >= r.enter, F.col("reading") < r.exit)


def carry_funding_long(panel: DataFrame, r: Rule) -> DataFrame:
    if r.enter > r.exit:
        raise ValueError("entry level over exit level")
    d = settlement_mean(panel, days_to_bars(r.lookback_days, 24.0 / r.step_hours), "reading")
    return _signals(d, F.col("reading") <= r.enter, F.lit(False), F.col("reading") > r.exit)


def cci(panel: DataFrame, days: float, hours: int, out: str, step_hours: int = 1) -> DataFrame:
    """panel with the commodity channel index of the last closed block of `hours`.

    The mean and the mean absolute deviation run over the last blocks present; null while the window
    is short, where the deviation is 0, and before the first block has closed.
    """
    width = period(days, hours)
    if width < 2:
        raise ValueError("a channel index needs two blocks")
    if hours == step_hours:
        blocks = panel.select(SOURCE, "ts", "high", "low", "close")
    else:
        blocks = tumble(panel.withColumns({"quote_volume": F.lit(0.0), "trades": F.lit(0)}), hours * 60)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    b = mean_and_mad(blocks.withColumn("__tp", typical), F.col("__tp"), width, order="ts")
    value = F.when(F.col("__mad") > 0, (F.col("__tp") - F.col("__mean")) / (F.lit(K.CCI_FACTOR) * F.col("__mad")))
    b = b.select(SOURCE, "ts", value.alias(out))
    if hours == step_hours:
        return panel.join(b, [SOURCE, "ts"])
    return closed_block_asof(panel, b, [out], block_minutes=hours * 60, step_minutes=step_hours * 60)


def _two_sided(d: DataFrame, r: Rule, hot_side: int) -> DataFrame:
    if not r.enter_level > r.exit_level >= 0:
        raise ValueError("levels must be enter > exit >= 0")
    v = F.col("reading")
    hot, cold = v >= r.enter_level, v <= -r.enter_level
    long_, short = (hot, cold) if hot_side > 0 else (cold, hot)
    return _signals(d, long_, short, v.isNull() | (F.abs(v) <= r.exit_level))


def cci_reversion(panel: DataFrame, r: Rule) -> DataFrame:
    return _two_sided(cci(panel, r.lookback_days, r.timeframe_hours, "reading", r.step_hours), r, -1)


def cci_breakout(panel: DataFrame, r: Rule) -> DataFrame:
    return _two_sided(cci(panel, r.lookback_days, r.timeframe_hours, "reading", r.step_hours), r, 1)


def oi_confirmed_reversion(panel: DataFrame, r: Rule) -> DataFrame:
    """Reversion entries where open interest has fallen by |oi_drop| over the lookback; exits as ever."""
    if r.oi_drop is None or r.oi_drop == 0:
        raise ValueError("a drop in open interest is needed")
    per_block = max(1, days_to_bars(r.timeframe_hours, 1.0 / r.step_hours))
    d = cci_reversion(panel, r).withColumn("oi_change", change("open_interest", period(r.lookback_days, r.timeframe_hours) * per_block))
    confirmed = F.coalesce(F.col("oi_change") <= -abs(r.oi_drop), F.lit(False))
    return d.withColumn("entry", F.when(confirmed, F.col("entry")).otherwise(F.lit(0)).cast("int"))


def cci_mtf(panel: DataFrame, r: Rule) -> DataFrame:
    """Slow filter picks the side, fast pullback enters; out when the trend is gone, flips, or has paid."""
    slow_hours = r.filter_hours or r.timeframe_hours
    d = cci(panel, r.filter_lookback_days or r.lookback_days, slow_hours, "slow", r.step_hours)
    d = cci(d, r.lookback_days, r.timeframe_hours, "reading", r.step_hours)
    f, b = F.col("slow"), F.col("reading")
    both = f.isNotNull() & b.isNotNull()
    prev = F.lag("slow").over(Window.partitionBy(SOURCE).orderBy(INDEX))
    # The first reading after none counts as a flip, the first bar never does.
    flip = (f != 0) & ((prev.isNull() & (F.col(INDEX) > 0)) | ((F.signum(prev) != F.signum(f)) & (prev != 0)))
    d = d.withColumn("__flip", F.coalesce(flip, F.lit(False)))
    long_ = both & (f >= r.filter_level) & (b <= -r.enter_level)
    short = both & (f <= -r.filter_level) & (b >= r.enter_level)
    out = ~both | (F.abs(f) < r.filter_level) | F.col("__flip") | (F.signum(f) * b >= r.exit_level)
    return _signals(d, long_, short, out).drop("__flip")


RULES: dict[str, Callable[[DataFrame, Rule], DataFrame]] = {
    "carry_funding": carry_funding,
    "carry_funding_long": carry_funding_long,
    "cci_reversion": cci_reversion,
    "cci_breakout": cci_breakout,
    "oi_confirmed_reversion": oi_confirmed_reversion,
    "cci_mtf": cci_mtf,
}
NEEDS_FUNDING = frozenset({"carry_funding", "carry_funding_long"})
NEEDS_POSITIONING = frozenset({"oi_confirmed_reversion"})


def register_rule(name: str, rule: Callable[[DataFrame, Rule], DataFrame]) -> None:
    """Add a rule: a function of a panel and a Rule that returns the panel with entry and exit columns."""
    if name in RULES:
        raise ValueError(f"there is a rule {name!r}")
    RULES[name] = rule


def signals(panel: DataFrame, rule: Rule) -> DataFrame:
    if rule.name not in RULES:
        raise ValueError(f"no rule {rule.name!r}; there are {', '.join(sorted(RULES))}")
    return RULES[rule.name](panel, rule)
