"""Does a result survive dearer trading, other periods, other regimes, a finer clock?"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom import constants as K
from barloom.operators.signal import Account
from barloom.operators.timeseries import regime, walk_block


def cost_stressed(a: Account, times: float = K.COST_STRESS) -> Account:
    return replace(a, fee_bps=a.fee_bps * times, slip_bps=a.slip_bps * times)


def block_panels(panel: DataFrame, blocks: int = 4, least: int = K.MIN_BLOCK_BARS) -> DataFrame:
    """panel keyed by (symbol, block), bars numbered anew in each block; every column stays in step.

    A source whose blocks would be shorter than `least` bars is left out: a short block judges nothing. `short_blocks` names it.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    d = panel.withColumn("__all", n).where(F.floor(F.col("__all") / blocks) >= least).drop("__all").withColumn("block", walk_block(blocks))
    w = Window.partitionBy("symbol", "block").orderBy("bar_idx")
    return d.withColumn("bar_idx", (F.row_number().over(w) - 1).cast("bigint"))


def short_blocks(panel: DataFrame, blocks: int = 4, least: int = K.MIN_BLOCK_BARS) -> DataFrame:
    """(symbol, bars): the sources that block_panels leaves out."""
    return panel.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars")).where(F.floor(F.col("bars") / blocks) < least)


def walk_forward(scores: DataFrame, *, by: str = "symbol", block: str = "block", cfg: str = "cell", value: str = "value", train: int = 2) -> DataFrame:
    """(by, chosen, trained, tested, retention): the best cell of the first blocks, and how it does in the later ones."""
    t = scores.groupBy(by, cfg).agg(F.avg(F.when(F.col(block) < train, F.col(value))).alias("trained"), F.avg(F.when(F.col(block) >= train, F.col(value))).alias("tested"))
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last("trained"), cfg)
    c = t.withColumn("__k", F.row_number().over(w)).where(F.col("__k") == 1)
    keep = F.when(F.col("trained") > 0, F.try_divide(F.col("tested"), F.col("trained")))
    return c.select(by, F.col(cfg).alias("chosen"), "trained", "tested", keep.alias("retention"), F.coalesce(keep >= K.RETENTION, F.lit(False)).alias("holds"))


def regime_consistency(curve: DataFrame, *, window_bars: int = K.REGIME_DAYS * 24, equity: str = "equity") -> DataFrame:
    """(symbol, up_return, down_return, consistent): summed log returns of a curve in rising and falling regimes.

    curve holds bar_idx, close and the equity. Both regimes must have been met and have paid.
    """
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    x = F.log(F.greatest(F.col(equity), F.lit(1e-12)))
    d = curve.withColumn("__g", regime(window_bars)).withColumn("__r", x - F.lag(x).over(w))
    a = d.groupBy("symbol").agg(F.sum(F.when(F.col("__g") == 1, F.col("__r"))).alias("up_return"), F.sum(F.when(F.col("__g") == -1, F.col("__r"))).alias("down_return"))
    return a.select("symbol", "up_return", "down_return", F.coalesce((F.col("up_return") > 0) & (F.col("down_return") > 0), F.lit(False)).alias("consistent"))


def clock_drift(coarse: DataFrame, fine: DataFrame, *, value: str, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by..., coarse, fine, drift, agrees): the same settings on two clocks; unlike signs or over 10 % apart disagree."""
    j = coarse.select(*by, F.col(value).alias("coarse")).join(fine.select(*by, F.col(value).alias("fine")), list(by), "full_outer")
    drift = F.try_divide(F.abs(F.col("coarse") - F.col("fine")), F.abs(F.col("coarse")))
    ok = (drift <= K.MAX_CLOCK_DRIFT) & (F.signum("coarse") == F.signum("fine"))
    return j.select(*by, "coarse", "fine", drift.alias("drift"), F.when(drift.isNotNull(), ok).alias("agrees"))


def stressed(run: Callable[[Account], DataFrame], a: Account, *, value: str, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by..., plain, stressed, survives): a run at its costs and at twice them."""
    p, s = run(a), run(cost_stressed(a))
    j = p.select(*by, F.col(value).alias("plain")).join(s.select(*by, F.col(value).alias("stressed")), list(by), "full_outer")
    return j.withColumn("survives", F.coalesce(F.col("stressed") > 0, F.lit(False)))
