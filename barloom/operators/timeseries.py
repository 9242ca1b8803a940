"""Window operators over bars numbered per source; all JVM-side.

A source has one row per bar, so its history is bounded by the calendar; where a window can be split
further (strided sums, prefix sums over blocks) it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOURCE, INDEX = "symbol", "bar_idx"


def _w(*extra) -> Window:
    return Window.partitionBy(SOURCE, *extra).orderBy(INDEX)


def strided_sum(df: DataFrame, value: Column, k: int, n: int, out: str) -> DataFrame:
    """out: sum of n values every k bars from each bar on; null where the history ends before.

    A prefix sum per residue class of k, and the difference of two of its values: the cost of a bar does not
    depend on n.
    """
    w = Window.partitionBy(SOURCE, F.pmod(F.col(INDEX), F.lit(k))).orderBy(INDEX)
    d = df.withColumn("__x", value).withColumn("__p", F.sum("__x").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn(out, F.lead("__p", n - 1).over(w) - F.col("__p") + F.col("__x")).drop("__x", "__p")


def suffix_sum(df: DataFrame, value: Column, out: str, block: int = 4096) -> DataFrame:
    """out: sum of the values from each bar to the end of its source, in two levels.

    Sums inside blocks of bars and sums over later blocks, so no task holds more than one block of bars or
    one row per block of a source. Both run backwards, as frames that grow cost one step a row and frames
    that shrink cost one per row of the rest.
    """
    d = df.withColumn("__x", value).withColumn("__b", F.floor(F.col(INDEX) / block))
    totals = d.groupBy(SOURCE, "__b").agg(F.sum("__x").alias("__s"))
    later = Window.partitionBy(SOURCE).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(SOURCE, "__b", F.coalesce(F.sum("__s").over(later), F.lit(0.0)).alias("__later"))
    inside = Window.partitionBy(SOURCE, "__b").orderBy(F.desc(INDEX)).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("__in", F.sum("__x").over(inside)).join(totals, [SOURCE, "__b"]).withColumn(out, F.col("__in") + F.col("__later")).drop("__x", "__b", "__in", "__later")


def ahead(value: str, bars: int) -> Column:
    return F.lead(value, bars).over(_w())


def trailing_sum(df: DataFrame, value: Column, width: int, out: str) -> DataFrame:
    """out: sum over the last width bars, null until they are there; null values add nothing. Prefix sums again."""
    d = df.withColumn("__p", F.coalesce(F.sum(value).over(_w().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    total = F.col("__p") - F.coalesce(F.lag("__p", width).over(_w()), F.lit(0.0))
    return d.withColumn(out, F.when(F.col(INDEX) >= width - 1, total)).drop("__p")


def settlement_mean(df: DataFrame, width: int, out: str) -> DataFrame:
    """out: mean funding rate per settlement of the last width bars; null without a settlement or a full window."""
    d = trailing_sum(df, F.col("funding_settled").cast("double"), width, "__n")
    d = trailing_sum(d, F.col("funding_rate"), width, "__r")
    return d.withColumn(out, F.try_divide(F.col("__r"), F.when(F.col("__n") > 0.5, F.col("__n")))).drop("__n", "__r")


def mean_and_mad(df: DataFrame, value: Column, width: int, *, order: str = INDEX) -> DataFrame:
    """__mean and __mad: mean and mean absolute deviation from it over the last width rows, null until full."""
    w = Window.partitionBy(SOURCE).orderBy(order).rowsBetween(-(width - 1), 0)
    d = df.withColumn("__x", value).withColumn("__win", F.collect_list("__x").over(w)).withColumn("__mu", F.avg("__x").over(w))
    dev = F.aggregate("__win", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("__mu"))) / F.lit(float(width))
    full = F.size("__win") == width
    return d.withColumn("__mean", F.when(full, F.col("__mu"))).withColumn("__mad", F.when(full, dev)).drop("__win", "__mu", "__x")


def gate_dip(df: DataFrame, drop: float, lookback: int, out: str) -> DataFrame:
    """out: close at or under (1 - drop) of the highest close of the lookback bars before; 0 means all of them.

    The first bar that can open the gate is number lookback - 1; a source of no more than lookback bars has no
    gate. The trailing maximum is that of two running ones: blocks of lookback bars are run through forwards and
    backwards, and any window is the end of one block and the beginning of the next.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(SOURCE))
    if lookback <= 0:
        peak = F.max("close").over(_w().rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn(out, F.coalesce(F.col("close") <= peak * (1.0 - drop), F.lit(False)))
    block = F.floor(F.col(INDEX) / lookback)
    grow = Window.unboundedPreceding, 0
    d = df.withColumns({
        "__fore": F.max("close").over(Window.partitionBy(SOURCE, block).orderBy(INDEX).rowsBetween(*grow)),
        "__back": F.max("close").over(Window.partitionBy(SOURCE, block).orderBy(F.desc(INDEX)).rowsBetween(*grow)),
        "__n": n,
    })
    # Before bar `lookback` the window begins with the history: one running maximum is enough.
    peak = F.greatest(F.lag("__fore", 1).over(_w()), F.lag("__back", lookback).over(_w()))
    open_ = F.col("close") <= peak * (1.0 - drop)
    ready = (F.col(INDEX) >= max(lookback - 1, 1)) & (F.col("__n") > lookback)
    return d.withColumn(out, F.coalesce(ready & open_, F.lit(False))).drop("__fore", "__back", "__n")


def gate_sma(df: DataFrame, width: int, out: str) -> DataFrame:
    """out: close at or under the mean of the width closes before."""
    n = F.count(F.lit(1)).over(Window.partitionBy(SOURCE))
    d = trailing_sum(df.withColumn("__n", n), F.col("close"), width, "__s").withColumn("__m", F.lag("__s", 1).over(_w()) / float(width))
    return d.withColumn(out, F.coalesce((F.col("__n") > width) & (F.col("close") <= F.col("__m")), F.lit(False))).drop("__n", "__s", "__m")


def change(value: str, width: int) -> Column:
    """Fractional change over width bars, null where there is nothing to compare."""
    before = F.lag(value, width).over(_w())
    return F.try_divide(F.col(value) - before, before)


def regime(width: int) -> Column:
    """1 above, -1 at or under the close width bars ago; 0 in the first width bars and in short sources."""
    n = F.count(F.lit(1)).over(Window.partitionBy(SOURCE))
    before = F.lag("close", width).over(_w())
    return F.when((n <= width) | before.isNull(), F.lit(0)).when(F.col("close") > before, F.lit(1)).otherwise(F.lit(-1)).cast("int")


def walk_block(blocks: int) -> Column:
    """Number of the contiguous block whose edges are floor(i * n / blocks)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(SOURCE))
    # The block of bar x is the largest b with floor(b * n / blocks) <= x.
    return F.least(F.floor(((F.col(INDEX) + 1) * blocks - 1) / n), F.lit(blocks - 1)).cast("bigint")


def running_peak(value: str) -> Column:
    return F.max(value).over(_w().rowsBetween(Window.unboundedPreceding, 0))


def drawdown(value: str) -> Column:
    return F.lit(1.0) - F.col(value) / F.greatest(running_peak(value), F.lit(1e-12))


def log_return(value: str) -> Column:
    x = F.log(F.greatest(F.col(value), F.lit(1e-12)))
    return x - F.lag(x).over(_w())


def drawdown_on_invested(df: DataFrame, equity: str, contributed: str) -> DataFrame:
    """Per source: the deepest fall of profit from its peak, absolute, against capital so far, and against all of it."""
    d = df.withColumn("__pnl", F.col(equity) - F.col(contributed))
    d = d.withColumn("__peak", F.max("__pnl").over(_w().rowsBetween(Window.unboundedPreceding, 0))).withColumn("__dd", F.col("__peak") - F.col("__pnl"))
    return d.groupBy(SOURCE).agg(
        F.max("__dd").alias("max_dd_abs"),
        F.max(F.col("__dd") / F.greatest(F.col(contributed), F.lit(1.0))).alias("max_dd_running"),
        (F.max("__dd") / F.greatest(F.max(contributed), F.lit(1e-12))).alias("max_dd_total"),
        F.avg((F.col("__pnl") < 0).cast("double")).alias("frac_time_in_loss"),
        F.avg((F.col("__pnl") < F.col("__peak") - 1e-12).cast("double")).alias("frac_time_below_peak"),
    )
