"""Response surfaces: the best cell of a grid and the shape around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import constants as K
from barloom.functions.columns import pick


def dense_surface(cells: DataFrame, measured: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Every cell of the grid with its value, null where none was measured."""
    return cells.join(measured.select(*key, value), list(key), "left")


def best_cell(surface: DataFrame, value: str, ordinal: str, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """The first cell in grid order among those of the greatest value; sources without a value have none."""
    ok = surface.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("__o", -F.col(value))
    return pick(ok, by, ("__o", ordinal)).drop("__o")


def plateau(surface: DataFrame, value: str, cell: str, ordinal_axes: Sequence[str], other_axes: Sequence[str] = (), by: Sequence[str] = ("symbol",)) -> DataFrame:
    """(by..., cells, peak, neighbours, neighbour_mean, ratio, shape): do the cells next to the peak hold up?

    Neighbours differ by one step on one ordinal axis. A peak at or under 0 is UNMEASURABLE; fewer than
    three cells or no neighbour give no ratio (NONE). Over 0.9 is a PLATEAU, over 0.7 a SLOPE, else a SPIKE.
    """
    axes = [*ordinal_axes, *other_axes]
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    # The peak is carried to every cell of its source by a window, so the surface is read once.
    top = F.min_by(F.struct(v.alias("__peak"), *[F.col(a).alias(f"__{a}") for a in axes]), F.when(v.isNotNull(), F.struct((-v).alias("v"), F.col(cell).alias("c"))))
    d = surface.withColumn("__v", v).withColumn("__t", top.over(Window.partitionBy(*by))).select(*by, "__v", *axes, "__t.*")
    step, same = F.lit(0), F.col("__v").isNotNull()
    for a in ordinal_axes:
        step = step + F.abs(F.col(a) - F.col(f"__{a}"))
    for a in other_axes:
        same = same & F.col(a).eqNullSafe(F.col(f"__{a}"))
    near = F.coalesce((step == 1) & same, F.lit(False))
    out = d.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), F.max("__peak").alias("peak"), F.count_if(near).alias("neighbours"), F.avg(F.when(near, F.col("__v"))).alias("neighbour_mean"))
    ratio = F.when((F.col("peak") > 0) & (F.col("cells") >= 3), F.try_divide(F.col("neighbour_mean"), F.col("peak")))
    shape = F.when(F.col("peak") <= 0, "UNMEASURABLE").when(ratio.isNull(), "NONE").when(ratio > K.PLATEAU_ABOVE, "PLATEAU").when(ratio > K.SLOPE_ABOVE, "SLOPE").otherwise("SPIKE")
    return out.select(*by, "cells", "peak", "neighbours", "neighbour_mean", ratio.alias("ratio"), shape.alias("shape"))


def target_met(cagr: Column, drawdown: Column) -> Column:
    """Both halves or nothing; a missing half is no."""
    return F.coalesce((cagr >= K.TARGET_CAGR) & (drawdown <= K.TARGET_MAX_DRAWDOWN) & ~F.isnan(cagr) & ~F.isnan(drawdown), F.lit(False))
