"""Implausible readings: impossible values, stuck values and spikes, each source by its own behaviour.

Impossible values are a predicate of the row. Stuck values and spikes need the bars around a row, so the
first delivery of every minute stands for it, and a source's minutes are cut into blocks of so many bars with
a margin of bars on both sides: a source of any length is spread over many tasks, and an outage on
an edge takes no bar's neighbours away. In a block, how far each bar reaches (the logarithm of its distance from
the bars around it and of its own range) and the logarithm of its volume form daily profile matrices, one row
per day and channel and one column per minute of the day, over weeks of the source. Robust principal components
split them into a low-rank part, the source's normal behaviour with its restless and its quiet
times, and a sparse part. A reading is a spike if its entry in the sparse part is large, that is, if it reaches many
times further than the low-rank part lets expect there; a second look then keeps only those that
also stand outside what the bars before and after show, so that a move that later bars keep is none. Every
delivery, repeats and corrections included, is judged by its own values against its minute.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import stamp_of

PRICES = ("open", "high", "low", "close")
DAY = 1440


def with_minute(df: DataFrame, ts: str, name: str = "minute") -> DataFrame:
    """df and the minutes since 1970 of a text stamp in any of its spellings, null if it is unreadable.

    Zone-free spellings with dashes or slashes, a closing Z, outer blanks, and 13-digit milliseconds or 10-digit seconds are read.
    """
    # In steps, so that what is used often is computed once.
    d = df.withColumn("__t", F.rtrim(F.ltrim(F.col(ts)), F.lit(" Z")))
    d = d.withColumn("__n", F.when(F.length("__t").isin(10, 13), F.col("__t").try_cast("bigint"))).withColumn("__s", stamp_of(F.col("__t")))
    minutes = F.timestamp_diff("MINUTE", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("__s"))
    number = F.when(F.col("__n") > 0, F.floor(F.col("__n") / F.when(F.length("__t") == 13, F.lit(60000)).otherwise(F.lit(60))))
    return d.withColumn(name, F.coalesce(number, minutes).cast("bigint")).drop("__t", "__n", "__s")


def impossible(volume: str = "volume", taker: str = "taker_buy_base") -> Column:
    """Readings that cannot be, whatever the source; nulls and NaN break no rule."""
    v = {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in (*PRICES, volume, taker)}
    o, h, l, c = (v[p] for p in PRICES)
    rules = [*[p <= 0 for p in (o, h, l, c)], h < o, h < l, h < c, l > o, l > c, v[volume] < 0, v[taker] > F.abs(v[volume])]
    out = F.lit(False)
    for r in rules:
        out = out | F.coalesce(r, F.lit(False))
    return out


def rpca(m: np.ndarray, lam: float | None = None, tol: float = 1e-4, max_iter: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(low-rank, sparse) parts of m by principal component pursuit with inexact augmented multipliers.

    The matrix is wide (days and channels by minutes), so singular values come from its small Gram matrix.
    """
    r, c = m.shape
    norm = float(np.linalg.norm(m))
    if norm == 0.0:
        return np.zeros_like(m), np.zeros_like(m)
    lam = lam or 1.0 / np.sqrt(max(r, c))
    two = float(np.sqrt(np.linalg.eigvalsh(m @ m.T)[-1]))
    y = m / max(two, float(np.abs(m).max()) / lam)
    mu, low, sparse = 1.25 / two, np.zeros_like(m), np.zeros_like(m)
    for _ in range(max_iter):
        a = m - sparse + y / mu
        val, vec = np.linalg.eigh(a @ a.T)
        sv = np.sqrt(np.maximum(val, 0.0))
        shrunk = np.maximum(sv - 1.0 / mu, 0.0)
        on = shrunk > 0
        u = vec[:, on]
        low = (u * (shrunk[on] / sv[on])) @ (u.T @ a) if on.any() else np.zeros_like(m)
        b = m - low + y / mu
        sparse = b - np.clip(b, -lam / mu, lam / mu)
        z = m - low - sparse
        if float(np.linalg.norm(z)) <= tol * norm:
            break
        y += mu * z
        mu *= 1.6
    return low, sparse


def _neighbour_medians(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Medians of the k values before and of the k values after each value, itself left out; NaN under three."""
    n = len(x)
    pad = np.full(k, np.nan)
    w = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, x, pad]), k)
    before, after = w[:n], w[k + 1 : k + 1 + n]
    out = []
    for v in (before, after):
        s = np.sort(v, axis=1)  # NaN last
        cnt = np.sum(~np.isnan(v), axis=1)
        i = np.arange(n)
        mid = 0.5 * (s[i, np.maximum((cnt - 1) // 2, 0)] + s[i, np.minimum(cnt // 2, k - 1)])
        out.append(np.where(cnt >= 3, mid, np.nan))
    return out[0], out[1]


def _surrounding_median(x: np.ndarray, k: int) -> np.ndarray:
    """Median of the k values before and the k values after each value together; NaN if there is none."""
    pad = np.full(k, np.nan)
    w = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, x, pad]), 2 * k + 1)
    s = np.sort(np.delete(w, k, axis=1), axis=1)
    cnt = np.sum(~np.isnan(s), axis=1)
    i = np.arange(len(x))
    mid = 0.5 * (s[i, np.maximum((cnt - 1) // 2, 0)] + s[i, np.minimum(cnt // 2, 2 * k - 1)])
    return np.where(cnt > 0, mid, np.nan)


def _rolling_median(x: np.ndarray, half: int, least: int) -> np.ndarray:
    return pd.Series(x).rolling(2 * half + 1, center=True, min_periods=least).median().to_numpy()


def _run_lengths(same: np.ndarray) -> np.ndarray:
    """Length of the run of equal values that each value is in; same[i] says that i repeats i - 1."""
    start = np.flatnonzero(~same)
    size = np.diff(np.append(start, len(same)))
    return np.repeat(size, size)


PARAMETERS = {
    "stuck_run": 6,  # bars
    "around": 9,  # bars before and after that give the level
    "around_volume": 15,
    "near": 4,  # bars before and after that can make a stretch wide
    "scale_half": 30,  # bars on both sides that give the restlessness
    "profile_days": 28,  # days with bars in a profile matrix
    "range_share": 0.3,  # of a bar's own range in its reach
    "recurring": 1.0,  # a minute of day whose median over two weeks or more lies beyond this is usual by so much
    "sparse_price": 2.2,  # entry of the sparse part, natural logarithm: nine times the usual reach
    "sparse_volume": 4.0,
    "price_times": 5.0,  # second look: times the restlessness outside the level
    "volume_log": 3.0,  # second look: natural logarithm outside the level
}


def usual(day: np.ndarray, minute: np.ndarray, channels: list[np.ndarray], p: dict) -> list[np.ndarray]:
    """What the low-rank part of the daily profile matrices says of each channel at each bar.

    NaN entries take the middle of their day and channel. A matrix holds at most profile_days days with bars.
    """
    out = [np.full(len(day), np.nan) for _ in channels]
    days, drow = np.unique(day, return_inverse=True)
    with np.errstate(invalid="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # rows and columns without an entry
        for first in range(0, len(days), p["profile_days"]):
            at = np.flatnonzero((drow >= first) & (drow < first + p["profile_days"]))
            rows, r = np.unique(drow[at], return_inverse=True)
            minutes, m = np.unique(minute[at], return_inverse=True)
            parts, base = [], []
            for x in channels:
                mat = np.full((len(rows), len(minutes)), np.nan)
                mat[r, m] = x[at]
                mid = np.nan_to_num(np.nanmedian(mat))
                mat -= mid
                # Too few days for the components to see one minute of every day: what recurs is taken off before.
                often = np.nan_to_num(np.nanmedian(mat, axis=0)) if len(rows) >= 14 else np.zeros(len(minutes))
                often = np.sign(often) * np.maximum(np.abs(often) - p["recurring"], 0.0)
                mat -= often
                own = np.nan_to_num(np.nanmedian(mat, axis=1))[:, None]
                parts.append(np.where(np.isnan(mat), own, mat))
                base.append(mid + often)
            low, _ = rpca(np.concatenate(parts))
            for k, b in enumerate(base):
                out[k][at] = (low[k * len(rows) : (k + 1) * len(rows)] + b)[r, m]
    return out


CONTEXT = (
    "minute bigint, lo double, hi double, scale double, usual_reach double, flat_reach double, vlo double, vhi double, usual_volume double, "
    "stuck_p boolean, stuck_v boolean, q_open double, q_high double, q_low double, q_close double, q_volume double"
)


def _context(pdf: pd.DataFrame, block: int, p: dict) -> pd.DataFrame:
    """What the minutes of one source and block show, for those where some delivery may be stuck or a spike."""
    pdf = pdf.sort_values("minute", kind="stable")
    t = pdf["minute"].to_numpy(np.int64)
    q = {c: pdf[c].to_numpy(float) for c in PRICES}
    bv = pdf["volume"].to_numpy(float)
    n = len(t)

    def repeats(*cols: np.ndarray) -> np.ndarray:
        s = np.ones(n, bool)
        s[:1] = False
        for c in cols:
            s[1:] &= c[1:] == c[:-1]
        return s

    stuck_p = _run_lengths(repeats(*q.values())) >= p["stuck_run"]
    stuck_v = (_run_lengths(repeats(bv)) >= p["stuck_run"]) & (bv > 0)
    # What the bars around a bar show. Impossible bars show nothing, stuck bars no restlessness.
    with np.errstate(invalid="ignore", divide="ignore"):
        lg = {c: np.log(np.where(v > 0, v, np.nan)) for c, v in q.items()}
        broken = (q["high"] < np.maximum(np.maximum(q["open"], q["close"]), q["low"])) | (q["low"] > np.minimum(q["open"], q["close"])) | (bv < 0)
        broken |= ~np.isfinite(lg["open"] + lg["high"] + lg["low"] + lg["close"])
        level = np.where(broken, np.nan, 0.5 * (lg["open"] + lg["close"]))
        width = np.where(broken | stuck_p | (q["high"] == q["low"]), np.nan, lg["high"] - lg["low"])
        before, after = _neighbour_medians(level, p["around"])
        scale = np.fmax(_rolling_median(width, p["scale_half"], 5), _surrounding_median(width, p["near"]))
        lv = np.where(bv > 0, np.log(np.where(bv > 0, bv, 1.0)), np.nan)
        vb, va = _neighbour_medians(lv, p["around_volume"])
        lo, hi = np.minimum(before, after), np.maximum(before, after)
        vlo, vhi = np.minimum(vb, va), np.maximum(vb, va)
        out = np.zeros(n)
        for c in PRICES:
            out = np.fmax(out, np.fmax(lo - lg[c], lg[c] - hi))
        seen = width[np.isfinite(width)]
        flat = p["range_share"] * (float(np.median(seen)) if len(seen) else 1e-9)
        own = p["range_share"] * (lg["high"] - lg["low"])
        reach = np.log(np.where(np.isfinite(own) & (own > 0), out + own, np.maximum(out, flat)))
        usual_reach, usual_volume = usual(t // DAY, t % DAY, [np.where(broken, np.nan, reach), np.where(stuck_v, np.nan, lv)], p)
        # The rest is decided for every delivery alike; a little slack keeps the two computations from disagreeing.
        may = (reach - usual_reach > p["sparse_price"] - 0.01) | (np.abs(lv - usual_volume) > p["sparse_volume"] - 0.01) | stuck_p | stuck_v
    keep = (pdf["own_block"].to_numpy(np.int64) == block) & (may | pdf["differ"].to_numpy(bool))
    cols = {
        "minute": t, "lo": lo, "hi": hi, "scale": scale, "usual_reach": usual_reach, "flat_reach": np.full(n, flat), "vlo": vlo, "vhi": vhi, "usual_volume": usual_volume,
        "stuck_p": stuck_p, "stuck_v": stuck_v, "q_open": q["open"], "q_high": q["high"], "q_low": q["low"], "q_close": q["close"], "q_volume": bv,
    }
    return pd.DataFrame({k: v[keep] for k, v in cols.items()})


def _verdict(p: dict) -> Column:
    """`stuck`, `spike` or null, of a delivery beside the context of its minute. NaN stands for null on both sides."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c)
    same = lambda c: F.col(c).eqNullSafe(F.col(f"q_{c}"))
    prices = same("open") & same("high") & same("low") & same("close")
    stuck = (F.col("stuck_p") & prices) | (F.col("stuck_v") & same("volume"))
    lg = {c: F.when(F.col(c) > 0, F.log(c)) for c in (*PRICES, "volume")}
    lo, hi = F.col("lo"), F.col("hi")
    out = F.greatest(F.lit(0.0), *[lo - lg[c] for c in PRICES], *[lg[c] - hi for c in PRICES])  # skips nulls
    own = F.lit(p["range_share"]) * (lg["high"] - lg["low"])
    reach = F.log(F.when(own > 0, out + own).otherwise(F.greatest(out, F.col("flat_reach"))))
    price = ok(lo) & ok(F.col("scale")) & (reach - F.col("usual_reach") > p["sparse_price"]) & (out > F.lit(p["price_times"]) * F.col("scale"))
    beyond = F.greatest(F.col("vlo") - lg["volume"], lg["volume"] - F.col("vhi"))
    volume = ok(F.col("vlo")) & (F.abs(lg["volume"] - F.col("usual_volume")) > p["sparse_volume"]) & (beyond > p["volume_log"])
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(stuck), F.lit("stuck")).when(yes(price) | yes(volume), F.lit("spike"))


def implausible_bars(
    bars: DataFrame,
    *,
    row_id: str = "row_id",
    source: str = "symbol",
    ts: str = "ts",
    arrived: str = "ingested_at",
    block_bars: int = 28 * DAY,
    margin_bars: int = 64,
    parameters: dict | None = None,
) -> DataFrame:
    """(row_id, kind): every delivered row that is `impossible`, `stuck` or a `spike`; one kind per row, in this order.

    Rows with an unreadable stamp or a null source can only be impossible. Rows with a null price or
    volume can be neither stuck nor a spike in that value. Of several deliveries of a minute the first
    to arrive stands for it (ties: smallest id); every delivery is judged by its own values. An empty
    table gives no rows. A bar with fewer than three bars on either side has no level, so it is no
    spike. Columns other than the bar's own are ignored.
    """
    p = PARAMETERS | (parameters or {})
    if margin_bars < max(p["around"], p["around_volume"], p["scale_half"], p["stuck_run"]):
        raise ValueError("the margin is narrower than what a bar is compared with")
    value = [*PRICES, "volume"]
    rows = bars.select(
        F.col(row_id).alias("__id"),
        F.col(source).alias("__src"),
        F.col(ts).alias("__ts"),
        *[(F.nanvl(F.col(c), F.lit(None).cast("double")) + F.lit(0.0)).alias(c) for c in value],
        F.col(arrived).alias("__at"),
        impossible().alias("__no"),
    )
    rows = with_minute(rows, "__ts").drop("__ts")
    # A hash skips nulls, so which values are null is hashed too.
    gone = sum((F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(value)), F.lit(0))
    known = rows.where(F.col("minute").isNotNull() & F.col("__src").isNotNull()).withColumn("h", F.xxhash64(*value, gone))
    # Deliveries of a minute merge before the shuffle, so copies do not pile up.
    lead = known.groupBy("__src", "minute").agg(F.min_by(F.struct(*value), F.struct("__at", "__id")).alias("v"), (F.min("h") != F.max("h")).alias("differ"))
    lead = lead.select("__src", "minute", "v.*", "differ", F.floor(F.col("minute") / 60).cast("bigint").alias("__hour"))
    # Minutes of an hour as bits: bars are numbered from counts per hour, one small row each, of two columns of the table.
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("minute", F.lit(60)).cast("int"))
    placed = with_minute(bars.select(F.col(source).alias("__src"), F.col(ts).alias("__ts")), "__ts").where(F.col("minute").isNotNull() & F.col("__src").isNotNull())
    hours = placed.groupBy("__src", F.floor(F.col("minute") / 60).cast("bigint").alias("__hour")).agg(F.bit_count(F.bit_or(bit)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy("__src").orderBy("__hour"))
    block = lambda c: F.floor(c / F.lit(block_bars)).cast("bigint")
    hours = hours.withColumn("__to", upto).select(
        "__src", "__hour", block(F.col("__to") - F.col("__n")).alias("own_block"),
        # The last hour of a block reaches up to 60 bars over its edge.
        F.sequence(F.greatest(block(F.col("__to") - F.col("__n") - margin_bars - 60), F.lit(0).cast("bigint")), block(F.col("__to") + margin_bars)).alias("__blocks"),
    )
    blocks = lead.join(hours, ["__src", "__hour"]).withColumn("__block", F.explode("__blocks")).select("__src", "__block", "own_block", "minute", *value, "differ").groupBy("__src", "__block")
    kind = bars.schema[source].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = _context(pdf, int(key[1]), p)
        out.insert(0, "__src", key[0])
        return out

    context = blocks.applyInPandas(run, schema=f"__src {kind}, {CONTEXT}")
    return (
        rows.select("__id", "__src", "minute", *value, "__no")
        .join(context, ["__src", "minute"], "left")
        .withColumn("kind", F.when(F.col("__no"), F.lit("impossible")).otherwise(_verdict(p)))
        .where(F.col("kind").isNotNull())
        .select(F.col("__id").alias(row_id), "kind")
    )
