"""How much of a best result is search: split-half validation, bootstrap nulls."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom import constants as K
from barloom.functions.columns import spread


def common_starts(df: DataFrame, cfg: str, start: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., start): the starts that every configuration has."""
    pairs = df.select(*by, cfg, start).distinct()
    n = pairs.groupBy(*by).agg(F.count_distinct(cfg).alias("__g")) if by else None
    per = pairs.groupBy(*by, start).agg(F.count(F.lit(1)).alias("__n"))
    if by:
        return per.join(n, list(by)).where(F.col("__n") == F.col("__g")).select(*by, start)
    total = pairs.select(F.count_distinct(cfg).alias("__g"))
    return per.join(total, F.col("__n") == F.col("__g"), "left_semi").select(start)


def modal(df: DataFrame, value: str, order: str, by: Sequence[str]) -> DataFrame:
    """(by..., value, n): the most frequent value, the first seen of those that tie."""
    c = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__first"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "__first")
    return c.withColumn("__k", F.row_number().over(w)).where(F.col("__k") == 1).select(*by, value, "n")


def half_splits(blocks: int) -> list[int]:
    """Bit masks of all choices of half the blocks, ascending."""
    return [m for m in range(1 << blocks) if m.bit_count() == blocks // 2]


def split_scores(perf: DataFrame, *, row: str, cfg: str, value: str, by: Sequence[str] = (), blocks: int = K.CSCV_BLOCKS) -> DataFrame:
    """(by..., split, cfg, inside, outside): mean performance of every configuration in and out of every half.

    Rows are cut into blocks of nearly equal size in their order; sums and counts per block and
    configuration come first, so the splits unfold over blocks, not over rows. Configurations with a
    missing or infinite value in any row are left out.
    """
    if blocks % 2:
        blocks -= 1
    if blocks < 4:
        raise ValueError("at least four blocks are needed")
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(F.col(value)) == float("inf"))
    dropped = perf.where(bad).select(*by, cfg).distinct()
    ok = perf.join(dropped, [*by, cfg], "left_anti")
    order = ok.select(*by, row).distinct()
    w = Window.partitionBy(*by).orderBy(row)
    order = order.withColumn("__b", F.ntile(blocks).over(w) - 1)
    sums = ok.join(order, [*by, row]).groupBy(*by, cfg, "__b").agg(F.sum(value).alias("__s"), F.count(F.lit(1)).alias("__n"))
    per = sums.groupBy(*by, cfg).agg(F.collect_list(F.struct("__b", "__s", "__n")).alias("__p"))
    split = F.explode(F.array(*[F.lit(m) for m in half_splits(blocks)])).alias("split")
    d = per.select(*by, cfg, "__p", split)

    def mean(inside: bool):
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n"))

        def add(a, p):
            here = F.getbit(F.col("split").cast("bigint"), p["__b"]) == int(inside)
            return F.when(here, F.struct((a["s"] + p["__s"]).alias("s"), (a["n"] + p["__n"]).alias("n"))).otherwise(a)

        total = F.aggregate("__p", zero, add)
        return F.try_divide(total["s"], total["n"].cast("double"))

    return d.select(*by, "split", cfg, mean(True).alias("inside"), mean(False).alias("outside"))


def overfitting(scores: DataFrame, *, cfg: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., splits, configurations, pbo, degraded_fraction, median_logit, verdict) from split_scores.

    In each split the best configuration inside (ties: smallest) is ranked outside, 1 the worst (ties by
    configuration); pbo is the share of splits in which it does no better than the middle.
    """
    p = [*by, "split"]
    inside = Window.partitionBy(*p).orderBy(F.desc("inside"), F.asc(cfg))
    outside = Window.partitionBy(*p).orderBy(F.asc("outside"), F.asc(cfg))
    g = F.count(F.lit(1)).over(Window.partitionBy(*p))
    r = scores.withColumn("__i", F.row_number().over(inside)).withColumn("__o", F.row_number().over(outside)).withColumn("__g", g).where((F.col("__i") == 1) & (F.col("__g") >= 2))
    share = F.col("__o") / (F.col("__g") + 1)
    logit = F.log(share / (1 - share))
    a = r.withColumn("__l", logit).groupBy(*by).agg(
        F.count(F.lit(1)).alias("splits"), F.max("__g").alias("configurations"), F.avg((F.col("__l") <= 0).cast("double")).alias("pbo"),
        F.avg((F.col("outside") < F.col("inside")).cast("double")).alias("degraded_fraction"), F.percentile("__l", 0.5).alias("median_logit"),
    )
    verdict = F.when(F.col("pbo") >= K.PBO_USELESS, "NOISE").when(F.col("pbo") >= 0.25, "WEAK").otherwise("INFORMATIVE")
    return a.select(*by, "splits", "configurations", "pbo", "degraded_fraction", "median_logit", verdict.alias("verdict"))


def block_starts(n: int, paths: int, block: int = K.BOOTSTRAP_BLOCK, seed: int = K.SEED) -> np.ndarray:
    """(paths, ceil(n / block)) random starts of circular blocks."""
    return np.random.default_rng(seed).integers(0, n, size=(paths, -(-n // block)))


def _draws(panel: DataFrame, ids: Column, paths: int, block: int, seed: int, source: str, per_task: int) -> DataFrame:
    """(source, __part, __c, __ids, __starts): a source's closes with the starts of blocks of a range of paths.

    The starts are drawn by hashing (seed, source, path, block), so every worker draws the same ones. Sources of one
    bar have no returns and no rows.
    """
    bars = F.array_sort(F.collect_list(F.struct("bar_idx", "close")))
    series = panel.groupBy(source).agg(bars.alias("__b")).select(source, F.col("__b.close").alias("__c")).where(F.size("__c") > 1)
    parts = series.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(paths // per_task))))
    n = F.size("__c") - 1
    ks = F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / block).cast("bigint"))
    starts = F.transform(F.col("__ids"), lambda p: F.transform(ks, lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col(source), p, k), n).cast("int")))
    return spread(parts.withColumn("__ids", ids).where(F.size("__ids") > 0).withColumn("__starts", starts), source, "__part")


def _path(close: np.ndarray, returns: np.ndarray, first: np.ndarray, block: int) -> np.ndarray:
    """Closes from the first one on, by blocks of returns that wrap around the end."""
    at = (np.asarray(first, dtype=np.int64)[:, None] + np.arange(block)).ravel()[: len(returns)] % len(returns)
    return np.concatenate([close[:1], close[0] * np.exp(np.cumsum(returns[at]))])


def synthetic_paths(spark: SparkSession, panel: DataFrame, *, paths: int = K.BOOTSTRAP_PATHS, block: int = K.BOOTSTRAP_BLOCK, seed: int = K.SEED, source: str = "symbol", per_task: int = 25) -> DataFrame:
    """(source, path_id, bar_idx, close): log returns resampled in wrapping blocks, cumulated from the first close; bars are numbered from 0.

    Paths are drawn and cumulated inside tasks: only the observed closes are shuffled, once per `per_task` paths.
    """
    part = F.col("__part") * per_task
    ids = F.filter(F.transform(F.sequence(F.lit(0), F.lit(per_task - 1)), lambda k: part + k), lambda p: p < paths)
    rows = _draws(panel, ids, paths, block, seed, source, per_task)
    kind = panel.schema[source].dataType.simpleString()

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, close, path_ids, drawn in zip(pdf[source], pdf["__c"], pdf["__ids"], pdf["__starts"]):
                close = np.asarray(close, dtype=float)
                r = np.diff(np.log(close))
                for path, first in zip(path_ids, drawn):
                    yield pd.DataFrame({source: np.full(len(close), key, dtype=object), "path_id": np.int32(path), "bar_idx": np.arange(len(close)), "close": _path(close, r, first, block)})

    return rows.drop("__part").mapInPandas(make, schema=f"`{source}` {kind}, path_id int, bar_idx bigint, close double")


def best_of_grid(null_scores: DataFrame, observed: DataFrame, *, value: str, by: Sequence[str] = ("symbol",), paths: int = K.BOOTSTRAP_PATHS, alpha: float = K.ALPHA) -> DataFrame:
    """(by..., observed, paths_scored, at_least, p_value, status): how often the best of a grid on noise does as well.

    null_scores holds the value of every cell on every path. Paths without a finite value are dropped;
    with fewer than half of the paths scored, or no finite observation, there is no p-value.
    """
    fin = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf"))
    top = null_scores.where(fin).groupBy(*by, "path_id").agg(F.max(value).alias("__m"))
    j = observed.select(*by, F.col(value).alias("observed")).join(top, list(by), "left")
    a = j.groupBy(*by, "observed").agg(F.count("__m").alias("paths_scored"), F.count_if(F.col("__m") >= F.col("observed")).alias("at_least"))
    enough = (F.col("paths_scored") * 2 >= paths) & F.col("observed").isNotNull() & ~F.isnan("observed")
    p = F.when(enough, (F.col("at_least") + 1) / (F.col("paths_scored") + 1))
    status = F.when(F.col("observed").isNull() | F.isnan("observed"), "no observation").when(~enough, "too few paths scored").when(p < alpha, "survives").otherwise("explained by search")
    return a.select(*by, "observed", "paths_scored", "at_least", p.alias("p_value"), status.alias("status"))


def null_scores(paths: DataFrame, scorer: Callable[[DataFrame], DataFrame], *, source: str = "symbol") -> DataFrame:
    """(source, path_id, cell, value): a grid's scorer on every path.

    The scorer maps a panel (symbol, bar_idx, close, high, low) to (symbol, cell, value); each path of each source
    is a symbol of its own to it, so all paths are scored in one job.
    """
    keyed = paths.select(F.concat_ws("\u0001", source, F.col("path_id").cast("string")).alias("symbol"), "bar_idx", "close", F.col("close").alias("high"), F.col("close").alias("low"))
    k = F.split("symbol", "\u0001")
    return scorer(keyed).select(k[0].alias(source), k[1].cast("int").alias("path_id"), "cell", "value")


def path_scores(
    panel: DataFrame,
    scorer: Callable[[np.ndarray], np.ndarray],
    *,
    paths: int = K.BOOTSTRAP_PATHS,
    block: int = K.BOOTSTRAP_BLOCK,
    seed: int = K.SEED,
    source: str = "symbol",
    per_task: int = 25,
    keyed: bool = False,
) -> DataFrame:
    """(source, path_id, cell, value): a grid's scorer on every path of synthetic_paths, and on the observed closes as path -1.

    The scorer maps the closes of all bars in their order, and with `keyed` the source, to one value per cell. A path is made, scored and dropped
    inside a task: only the observed closes and the starts of blocks are shuffled, once per `per_task` paths. A
    source's closes are one array in a worker. A source of one bar has no returns and no rows.
    """
    ids = F.sequence(F.greatest(F.col("__part") * per_task - 1, F.lit(-1)), F.least(F.col("__part") * per_task + per_task - 2, F.lit(paths - 1)))
    # The starts that synthetic_paths draws.
    rows = _draws(panel, ids, paths, block, seed, source, per_task)
    kind = panel.schema[source].dataType.simpleString()

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, close, path_ids, drawn in zip(pdf[source], pdf["__c"], pdf["__ids"], pdf["__starts"]):
            close = np.asarray(close, dtype=float)
            r = np.diff(np.log(close))
            for path, first in zip(path_ids, drawn):
                c = close if path < 0 else _path(close, r, first, block)
                v = np.asarray(scorer(c, key) if keyed else scorer(c), dtype=float)
                out.append(pd.DataFrame({source: np.full(len(v), key, dtype=object), "path_id": path, "cell": np.arange(len(v)), "value": v}))
        return pd.concat(out)

    scored = rows.groupBy(source, "__part").applyInPandas(score, schema=f"`{source}` {kind}, path_id int, cell int, value double")
    return scored.where(F.col("value").isNotNull() & ~F.isnan("value"))
