"""Fixed-capital metrics of an equity curve, as one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom import constants as K


def summary(curve: DataFrame, value: str = "equity", *, by: tuple[str, ...] = ("symbol",), order: str = "bar_idx", bars_per_year: float = K.BARS_PER_YEAR["1h"]) -> DataFrame:
    """(by..., cagr, max_drawdown, calmar, sharpe, total_return, bars, years).

    A curve with a missing or infinite value has no ratios. Under one year there is no annual growth;
    a curve that ends at or under 0 has growth -1; one that touches 0 has no Sharpe ratio; no drawdown, no Calmar.
    """
    w = Window.partitionBy(*by).orderBy(order)
    v = F.col(value)
    logv = F.log(F.greatest(v, F.lit(1e-12)))
    peak = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = curve.select(*by, order, value, (F.lit(1.0) - v / F.greatest(peak, F.lit(1e-12))).alias("__dd"), (logv - F.lag(logv).over(w)).alias("__r"))
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("bars"), F.count_if(bad).alias("__bad"), F.count_if(v <= 0).alias("__zero"), F.min_by(value, order).alias("__a"), F.max_by(value, order).alias("__z"),
        F.max("__dd").alias("__mdd"), F.avg("__r").alias("__mu"), F.stddev_samp("__r").alias("__sd"),
    )
    years = (F.col("bars") - 1) / F.lit(float(bars_per_year))
    whole = F.col("__bad") == 0
    ratio = F.try_divide(F.col("__z"), F.col("__a"))
    growth = F.when(whole & (F.col("bars") >= 2) & (F.col("__a") > 0) & (years >= K.MIN_YEARS_TO_ANNUALISE), F.when(ratio <= 0, F.lit(-1.0)).otherwise(F.pow(F.greatest(ratio, F.lit(1e-300)), F.try_divide(F.lit(1.0), years)) - 1.0))
    mdd = F.when(whole, F.col("__mdd"))
    sharpe = F.when(whole & (F.col("bars") >= 3) & (F.col("__zero") == 0) & (F.col("__sd") > 0), F.try_divide(F.col("__mu"), F.col("__sd")) * F.sqrt(F.lit(float(bars_per_year))))
    return g.select(
        *by, growth.alias("cagr"), mdd.alias("max_drawdown"), F.when(mdd >= K.MIN_DRAWDOWN_FOR_CALMAR, F.try_divide(growth, mdd)).alias("calmar"), sharpe.alias("sharpe"),
        F.when(F.col("__a") > 0, ratio - 1.0).alias("total_return"), "bars", years.alias("years"),
    )
