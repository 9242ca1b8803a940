"""The Panel: one row per source and bar of a clock, with everything an evaluator reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.cleaning import tumble


def one_bar_per_slot(bars: DataFrame, minutes: int, *, source: str = "symbol", ts: str = "ts", order: tuple[str, ...] = ("ingested_at", "bar_id")) -> DataFrame:
    """The latest delivery of each slot, stamped with the slot's start; null sources and stamps are left out."""
    rest = [c for c in bars.columns if c not in (source, ts)]
    step = f"make_dt_interval(0, 0, 0, CAST(pmod(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`), {minutes * 60_000_000}) / CAST(1000000 AS DECIMAL(10, 0)) AS DECIMAL(18, 6)))"
    start = F.expr(f"CAST(`{ts}` AS TIMESTAMP_NTZ) - {step}").cast("timestamp_ntz")
    pick = F.max(F.struct(F.struct(*[F.col(c) for c in order]).alias("o"), *[F.col(c).alias(f"c_{c}") for c in rest])).alias("m")
    return bars.where(F.col(source).isNotNull() & F.col(ts).isNotNull()).groupBy(source, start.alias(ts)).agg(pick).select(source, ts, *[F.col(f"m.c_{c}").alias(c) for c in rest])


def as_panel(bars: DataFrame, *, source: str = "symbol", ts: str = "ts") -> DataFrame:
    """Bars with positive prices, numbered from 0 per source; absent funding is rate 0 and unsettled.

    A settlement of rate 0 stays a settlement: the flag is a column of its own.
    """
    b = bars.where((F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0))
    w = Window.partitionBy(source).orderBy(ts)
    return b.select(
        source, ts, (F.row_number().over(w) - 1).cast("bigint").alias("bar_idx"), "open", "high", "low", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"),
        F.coalesce("funding_rate", F.lit(0.0)).alias("funding_rate"), F.coalesce("funding_settled", F.lit(False)).alias("funding_settled"), "open_interest",
    )


def funding_flow():
    """What one unit held through a bar pays."""
    return F.col("close") * F.col("funding_rate")


def build_panel(clean: DataFrame, minutes: int, **kw) -> DataFrame:
    """Clean minute bars straight to a panel without funding."""
    t = tumble(clean, minutes, **kw)
    return as_panel(t.withColumns({"funding_rate": F.lit(0.0), "funding_settled": F.lit(False), "open_interest": F.lit(None).cast("double")}))
