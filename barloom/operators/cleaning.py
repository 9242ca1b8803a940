"""Delivered minute bars to clean, tumbled and validated bar clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import constants as K
from barloom.functions.columns import epoch_us

STAMP = "yyyy-MM-dd HH:mm:ss"


def lenient_stamp(ts: str, fmt: str = STAMP) -> Column:
    """Zone-free stamp of a text without its outer blanks, null where it does not follow fmt."""
    return F.try_to_timestamp(F.trim(F.col(ts)), F.lit(fmt)).cast("timestamp_ntz")


def is_padding() -> Column:
    """A flat bar without volume; null if a value it needs is null."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return (o == h) & (h == l) & (l == c) & (F.col("volume") <= 0.0)


def _positive() -> Column:
    return (F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0)


def _violates() -> Column:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return (h < l) | (h < o) | (h < c) | (l > o) | (l > c)


def staged(raw: DataFrame, *, source: str = "symbol", order: str = "row_id", stamp: Column | None = None) -> DataFrame:
    """(source, stamp, __first, __rows, __padding, __alive, __kept): one row per source and stamp.

    __first holds the first delivered bar of the stamp that is readable and no padding, __alive how many there
    are. The quality record and the clean bars come from this one aggregation, which merges repeats before
    the shuffle; unreadable stamps only count. A bar whose padding test is null is lost.
    """
    df = raw.withColumn("stamp", stamp if stamp is not None else lenient_stamp("ts"))
    padding = F.coalesce(F.col("stamp").isNotNull() & is_padding(), F.lit(False))
    alive = F.col("stamp").isNotNull() & (is_padding() == F.lit(False))
    rest = [c for c in raw.columns if c not in (source, "ts", "stamp")]
    g = df.groupBy(source, "stamp").agg(
        F.min_by(F.struct(*rest), F.when(alive, F.col(order))).alias("__first"),
        F.count(F.lit(1)).alias("__rows"),
        F.count_if(padding).alias("__padding"),
        F.count_if(F.coalesce(alive, F.lit(False))).alias("__alive"),
    )
    return g.withColumn("__kept", F.col("__alive") > 0)


def _of_first(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def clean_bars(raw: DataFrame, *, source: str = "symbol", order: str = "row_id", stamp: Column | None = None) -> DataFrame:
    """Readable, unpadded, first-delivered bars with positive prices. Bars that violate high and low are kept."""
    s = staged(raw, source=source, order=order, stamp=stamp).where("__kept")
    return s.select(source, F.col("stamp").alias("ts"), "__first.*").where(_positive())


def quality_report(raw: DataFrame, *, source: str = "symbol", order: str = "row_id", stamp: Column | None = None, min_bars: int = K.MIN_BARS, seal: str = str(K.SEAL)) -> DataFrame:
    """One record per source: what the cleaning dropped, gaps, violations, and whether the source is usable."""
    s = staged(raw, source=source, order=order, stamp=stamp)
    s = s.select(source, "stamp", "__rows", "__padding", "__alive", "__kept", *[F.col(f"__first.{c}").alias(c) for c in ("open", "high", "low", "close")])
    final = F.col("__kept") & _of_first(_positive())
    w = Window.partitionBy(source, "__final").orderBy("stamp")
    g = s.withColumn("__final", final).withColumn(
        "__gap", F.when(final, F.greatest((epoch_us("stamp") - F.lag(epoch_us("stamp")).over(w)) / F.lit(60_000_000) - 1, F.lit(0.0)).cast("bigint"))
    )
    iff = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    nonpos = (F.col("open") <= 0) | (F.col("high") <= 0) | (F.col("low") <= 0) | (F.col("close") <= 0)
    agg = g.groupBy(source).agg(
        F.sum("__rows").alias("rows_raw"),
        F.sum("__padding").alias("rows_dropped_padding"),
        F.sum(F.greatest(F.col("__alive") - 1, F.lit(0))).alias("rows_dropped_duplicate"),
        iff(final).alias("rows_final"),
        F.min(F.when(final, F.col("stamp"))).alias("__first"),
        F.max(F.when(final, F.col("stamp"))).alias("__last"),
        iff(F.col("__gap") > 0).alias("gap_count"),
        F.coalesce(F.max("__gap"), F.lit(0)).alias("largest_gap_minutes"),
        iff(F.col("__kept") & nonpos).alias("nonpositive_price_rows"),
        iff(final & _violates()).alias("ohlc_violation_rows"),
        iff(final & (F.col("stamp") < F.lit(seal).cast("timestamp_ntz"))).alias("__dev"),
    )
    few, sealed = F.col("rows_final") < min_bars, F.col("__dev") == 0
    text = lambda c: F.when(~few, F.date_format(c, STAMP)).otherwise(F.lit(""))
    reason = F.when(few, F.concat(F.lit("only "), F.col("rows_final").cast("string"), F.lit(f" bars, need {min_bars}"))).when(
        sealed, F.lit("listed after the seal; no development history")
    )
    return agg.select(
        source, "rows_raw", "rows_dropped_padding", "rows_dropped_duplicate", "rows_final", text("__first").alias("first_ts"), text("__last").alias("last_ts"),
        "gap_count", "largest_gap_minutes", "nonpositive_price_rows", "ohlc_violation_rows", (~few & ~sealed).alias("usable"), reason.alias("reject_reason"),
    )


def tumble(bars: DataFrame, minutes: int = 60, *, source: str = "symbol", ts: str = "ts") -> DataFrame:
    """First, highest, lowest and last price and totals per slot, labelled by its start; empty slots do not appear."""
    step = f"make_dt_interval(0, 0, 0, CAST(pmod(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`), {minutes * 60}) AS DECIMAL(18, 6)))"
    start = F.expr(f"date_trunc('SECOND', CAST(`{ts}` AS TIMESTAMP_NTZ)) - {step}").cast("timestamp_ntz")
    return (
        bars.withColumn("__slot", start)
        .groupBy(source, "__slot")
        .agg(
            F.min_by("open", ts).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", ts).alias("close"),
            F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
            F.coalesce(F.sum("quote_volume"), F.lit(0.0)).alias("quote_volume"),
            F.coalesce(F.sum("trades"), F.lit(0)).alias("trades"),
            F.count(F.lit(1)).alias("minutes_present"),
        )
        .withColumnRenamed("__slot", ts)
    )


def gap_report(bars: DataFrame, step_minutes: int, *, source: str = "symbol", ts: str = "ts") -> DataFrame:
    """(source, bars, gap_count, largest_gap): missing steps between neighbouring bars."""
    w = Window.partitionBy(source).orderBy(ts)
    miss = F.greatest(F.floor((epoch_us(ts) - F.lag(epoch_us(ts)).over(w)) / F.lit(60_000_000 * step_minutes)) - 1, F.lit(0))
    return bars.withColumn("__g", miss).groupBy(source).agg(
        F.count(F.lit(1)).alias("bars"), F.count_if(F.col("__g") > 0).alias("gap_count"), F.coalesce(F.max("__g"), F.lit(0)).cast("bigint").alias("largest_gap")
    )


def clock_report(bars: DataFrame, step_minutes: int, *, source: str = "symbol", ts: str = "ts", max_missing: float = K.MAX_MISSING_FRACTION) -> DataFrame:
    """(source, bars, not_increasing, off_step, missing_fraction, valid): is this a clock of whole steps?"""
    us = 60_000_000 * step_minutes
    w = Window.partitionBy(source).orderBy(ts)
    g = bars.select(source, epoch_us(ts).alias("__t")).withColumn("__d", F.col("__t") - F.lag("__t").over(Window.partitionBy(source).orderBy("__t")))
    agg = g.groupBy(source).agg(
        F.count(F.lit(1)).alias("bars"),
        F.count_if(F.col("__d") <= 0).alias("not_increasing"),
        F.count_if((F.col("__d") > 0) & (F.col("__d") % us != 0)).alias("off_step"),
        ((F.max("__t") - F.min("__t")) / F.lit(us) + 1).alias("__expected"),
    )
    missing = F.lit(1.0) - F.col("bars") / F.col("__expected")
    ok = (F.col("not_increasing") == 0) & (F.col("off_step") == 0) & (missing <= max_missing)
    return agg.select(source, "bars", "not_increasing", "off_step", missing.alias("missing_fraction"), ok.alias("valid"))


def require_clock(bars: DataFrame, step_minutes: int, **kw) -> DataFrame:
    """bars, or an error that names the sources whose clock is not valid."""
    bad = clock_report(bars, step_minutes, **kw).where(~F.col("valid")).limit(20).collect()
    if bad:
        raise ValueError("not a clock: " + ", ".join(str(r[0]) for r in bad))
    return bars


def development(df: DataFrame, seal: str = str(K.SEAL), ts: str = "ts") -> DataFrame:
    """Rows before the seal; the filter reaches the scan."""
    return df.where(F.col(ts) < F.lit(seal).cast("timestamp_ntz"))


def sealed(df: DataFrame, seal: str = str(K.SEAL), ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) >= F.lit(seal).cast("timestamp_ntz"))


def require_development(df: DataFrame, seal: str = str(K.SEAL), ts: str = "ts") -> DataFrame:
    last = df.agg(F.max(ts)).first()[0]
    if last is not None and str(last) >= seal:
        raise ValueError(f"rows at or after the seal {seal}: {last}")
    return df


def covered(bars: DataFrame, record: DataFrame, *, source: str = "symbol", ts: str = "ts") -> DataFrame:
    """Bars from where each source's record begins; sources without a record have no bars."""
    begins = record.groupBy(source).agg(F.min(ts).alias("__begin"))
    return bars.join(begins, source).where(F.col(ts) >= F.col("__begin")).drop("__begin")


def finite_report(df: DataFrame, columns: list[str], *, source: str = "symbol") -> DataFrame:
    """(source, column_name, missing, infinite) for the columns an evaluator needs finite."""
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns]))
    x = df.select(source, long.alias("p")).select(source, "p.*")
    return x.groupBy(source, "column_name").agg(
        F.count_if(F.col("v").isNull() | F.isnan("v")).alias("missing"), F.count_if(F.abs("v") == float("inf")).alias("infinite")
    )


def panel_hash(bars: DataFrame, columns: list[str], *, source: str = "symbol", order: str = "bar_idx") -> DataFrame:
    """(source, panel_hash): 32 hex digits over the ordered values; any changed value, bar or order changes it.

    Each bar hashes to 256 bits with its position, and the digests add up in four 64-bit lanes, so the
    hash is an aggregate: nothing is collected or sorted.
    """
    text = F.concat_ws("|", F.col(order).cast("string"), *[F.coalesce(F.hex(F.col(c).cast("string")), F.lit("~")) for c in columns])
    d = F.sha2(text, 256)
    lane = lambda i: F.conv(F.substring(d, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    sums = [F.sum(lane(i)).cast("string") for i in range(4)]
    return bars.groupBy(source).agg(F.substring(F.sha2(F.concat_ws("/", F.count(F.lit(1)).cast("string"), *sums), 256), 1, 32).alias("panel_hash"))
