"""Irregular readings onto a regular grid, gaps filled by iterative singular-spectrum imputation.

Readings are bucketed to slots (the last reading in a slot counts), the grid of a source is
cut into blocks of fixed length with a margin on both sides, and each block is completed on
its own: its Hankel trajectory matrix is projected on the leading singular vectors, the
missing entries take the projected values, and so on until they stand still. A block holds at
most block + 2 * margin slots, so a source of any length is spread over many small tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import epoch_us, present

STATUS_READ, STATUS_FILLED, STATUS_LINE, STATUS_MARKED = "read", "filled", "interpolated", "marked"


def ssa_impute(values: np.ndarray, window: int = 24, rank: int = 8, tol: float = 1e-5, max_iter: int = 2000, memory: int = 15) -> tuple[np.ndarray, str]:
    """Complete the NaN entries of a series, and how: `filled` if they stand still, `interpolated` if the series is too
    short or even for the method, `marked` if they still move; observed entries are returned unchanged.

    Starts from linear interpolation, then alternates the rank-limited reconstruction of the
    trajectory matrix with resetting the observed entries, until a pass changes no missing entry by
    more than tol times the series' spread. Plain passes need thousands, so each starts from the
    combination of the last `memory` ones whose changes cancel best (Anderson acceleration); what a
    pass leaves alone is the same. With fewer than two observed entries, or a series no longer than
    two windows, the interpolation stands.
    """
    x = np.asarray(values, dtype=float)
    gap = ~np.isfinite(x)
    n, seen = len(x), int((~gap).sum())
    if seen == 0 or seen == n:
        return x.copy(), STATUS_READ
    idx = np.arange(n)
    y = x.copy()
    y[gap] = np.interp(idx[gap], idx[~gap], x[~gap])
    spread = float(np.std(x[~gap]))
    if seen < 2 or n <= 2 * window or spread == 0.0:
        return y, STATUS_LINE
    mean = float(np.mean(x[~gap]))
    k = n - window + 1
    rank = min(rank, window)
    counts = np.convolve(np.ones(window), np.ones(k))
    found: list[np.ndarray] = []
    steps: list[np.ndarray] = []
    for _ in range(max_iter):
        z = y - mean
        traj = np.lib.stride_tricks.sliding_window_view(z, k)  # window x k, no copy
        _, vecs = np.linalg.eigh(traj @ traj.T)
        u = vecs[:, -rank:]
        low = u @ (u.T @ traj)
        rec = np.zeros(n)
        for i in range(window):
            rec[i : i + k] += low[i]  # sums the anti-diagonals
        new = (rec / counts + mean)[gap]
        step = new - y[gap]
        y[gap] = new
        if float(np.max(np.abs(step))) <= tol * spread:
            return y, STATUS_FILLED
        if steps and np.linalg.norm(step) > 2 * np.linalg.norm(steps[-1]):
            found, steps = [], []  # the leading vectors changed: what was learned does not hold
        found, steps = [*found, new][-memory - 1 :], [*steps, step][-memory - 1 :]
        if len(steps) > 1:
            mix = np.linalg.lstsq(np.diff(np.array(steps), axis=0).T, step, rcond=1e-10)[0]
            y[gap] = new - np.diff(np.array(found), axis=0).T @ mix
    y[gap] = new
    return y, STATUS_MARKED


def ssa_fill(values: np.ndarray, window: int = 24, rank: int = 8, tol: float = 1e-5, max_iter: int = 2000) -> np.ndarray:
    """The series of ssa_impute, whether or not its missing entries stand still."""
    return ssa_impute(values, window, rank, tol, max_iter)[0]


def _complete(batches: Iterator[pd.DataFrame], block: int, margin: int, window: int, rank: int, min_seen: float, tol: float, max_iter: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        src, slots, vals, status, n_read = [], [], [], [], []
        for key, chunk, lo, hi, ss, vv in zip(pdf["__src"], pdf["__chunk"], pdf["__lo"], pdf["__hi"], pdf["__slots"], pdf["__vals"]):
            start, end = max(chunk * block - margin, lo), min((chunk + 1) * block + margin - 1, hi)
            x = np.full(end - start + 1, np.nan)
            ss = np.asarray(ss, dtype=np.int64) - start
            x[ss] = np.asarray(vv, dtype=float)
            read = np.isfinite(x)
            own = slice(max(chunk * block, lo) - start, min((chunk + 1) * block - 1, hi) - start + 1)
            if not read[own].all() and read.sum() >= max(2, min_seen * len(x)):
                y, how = ssa_impute(x, window, rank, tol, max_iter)
                if how == STATUS_MARKED:
                    y[~read] = np.nan
                # Nothing outside the readings of this block is extrapolated.
                first, last = np.flatnonzero(read)[[0, -1]]
                y[:first] = np.nan
                y[last + 1 :] = np.nan
            else:
                y, how = x, STATUS_MARKED
            o_read, o_y = read[own], y[own]
            src.append(np.full(len(o_y), key, dtype=object))
            slots.append(np.arange(start + own.start, start + own.stop, dtype=np.int64))
            vals.append(o_y)
            status.append(np.where(o_read, STATUS_READ, np.where(np.isfinite(o_y), how, STATUS_MARKED)))
        if src:
            v = np.concatenate(vals)
            yield pd.DataFrame({"src": np.concatenate(src), "slot": np.concatenate(slots), "value": v, "status": np.concatenate(status)})


def regrid(
    readings: DataFrame,
    *,
    source: str,
    ts: str,
    value: str,
    tie: str,
    slot_s: int = 3600,
    block: int = 720,
    margin: int = 96,
    window: int = 24,
    rank: int = 8,
    min_seen: float = 0.2,
    tol: float = 1e-5,
    max_iter: int = 2000,
) -> DataFrame:
    """(source, slot_start, value, status): one row per source and slot from its first to its last reading.

    status is `read`, `filled` (completed from the readings around it by the imputation), `interpolated` (by a straight
    line, in series of no more than two windows or of one value alone) or `marked` (the value is null: fewer than min_seen of the block's slots were read, no reading lies on one side, or the
    block's missing entries still moved by more than tol spreads after max_iter passes).
    Rows with a null source or stamp, or a null or NaN value, do not exist. In a slot the last
    reading counts, then the greatest `tie`. Empty tables give no rows; a single reading gives
    one row. Other columns, whatever their names, are ignored.
    """
    us = slot_s * 1_000_000
    base = readings.where(F.col(source).isNotNull() & F.col(ts).isNotNull() & present(value)).select(
        F.col(source).alias("__src"), epoch_us(ts).alias("__t"), F.col(value).cast("double").alias("__v"), F.col(tie).alias("__tie")
    )
    base = base.withColumn("__slot", F.floor(F.col("__t") / F.lit(us)).cast("bigint"))
    spans = base.groupBy("__src").agg(F.min("__slot").alias("__lo"), F.max("__slot").alias("__hi"))
    slots = base.groupBy("__src", "__slot").agg(F.max(F.struct("__t", "__tie", "__v")).alias("__m")).select("__src", "__slot", F.col("__m.__v").alias("__v"))
    touched = F.sequence(F.floor((F.col("__slot") - margin) / F.lit(block)).cast("bigint"), F.floor((F.col("__slot") + margin) / F.lit(block)).cast("bigint"))
    rows = slots.select("__src", F.explode(touched).alias("__chunk"), F.struct("__slot", "__v").alias("__p"), F.lit(None).cast("bigint").alias("__lo"), F.lit(None).cast("bigint").alias("__hi"))
    # Every block of a source's span exists, whether or not a reading falls into it.
    frame = spans.select(
        "__src",
        F.explode(F.sequence(F.floor(F.col("__lo") / F.lit(block)).cast("bigint"), F.floor(F.col("__hi") / F.lit(block)).cast("bigint"))).alias("__chunk"),
        F.lit(None).cast("struct<__slot:bigint,__v:double>").alias("__p"),
        "__lo",
        "__hi",
    )
    blocks = (
        rows.unionByName(frame)
        .groupBy("__src", "__chunk")
        .agg(F.collect_list("__p").alias("__ps"), F.max("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
        .where(F.col("__lo").isNotNull())
        .select("__src", "__chunk", "__lo", "__hi", F.col("__ps.__slot").alias("__slots"), F.col("__ps.__v").alias("__vals"))
    )
    kind = readings.schema[source].dataType.simpleString()
    done = blocks.mapInPandas(lambda it: _complete(it, block, margin, window, rank, min_seen, tol, max_iter), schema=f"src {kind}, slot bigint, value double, status string")
    start = F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, slot * {slot_s})")
    return done.select(F.col("src").alias(source), start.alias("slot_start"), F.when(F.col("status") != STATUS_MARKED, F.col("value")).alias("value"), "status")
