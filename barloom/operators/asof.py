"""As-of joins: settlements onto bars, levels onto bars, closed blocks onto base bars.

Both sides are unioned and the last non-null value in time order is taken, in two levels: inside buckets of
time, which are independent, and over the last values of a source's buckets, of which there are few. A source
with many readings is thereby spread over its buckets, and nothing is sorted per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import epoch_us


BUCKET_US = 7 * 86_400_000_000


def last_before(both: DataFrame, value: str, out: str, *, source: str, t: str, tie, bucket_us: int = BUCKET_US) -> DataFrame:
    """both with `out`: the last non-null `value` of its source at or before its row, by (t, tie)."""
    d = both.withColumn("__b", F.floor(F.col(t) / F.lit(bucket_us)))
    inside = Window.partitionBy(source, "__b").orderBy(t, tie).rowsBetween(Window.unboundedPreceding, 0)
    have = d.where(F.col(value).isNotNull())
    ends = have.groupBy(source, "__b").agg(F.max_by(value, F.struct(F.col(t), tie.alias("k"))).alias("__end"))
    # Every bucket that has a row, so that each finds what the buckets before it end with.
    keys = d.select(source, "__b").distinct().join(ends, [source, "__b"], "left")
    over = Window.partitionBy(source).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = keys.select(source, "__b", F.last("__end", ignorenulls=True).over(over).alias("__carry"))
    return d.withColumn("__in", F.last(value, ignorenulls=True).over(inside)).join(carry, [source, "__b"]).withColumn(out, F.coalesce("__in", "__carry")).drop("__b", "__in", "__carry")


def settle_onto_bars(bars: DataFrame, events: DataFrame, *, source: str = "symbol", ts: str = "ts", amount: str = "funding_rate") -> DataFrame:
    """bars with funding_rate (sum of the settlements in the bar, else 0) and funding_settled.

    A settlement belongs to the last bar at or before it. Settlements before the first bar, or a median
    step or more after the last one, are dropped (with one bar there is no step and no bound). Null
    amounts count as settlements of 0.
    """
    b = bars.select(source, F.col(ts).alias("__bar"), epoch_us(ts).alias("__t"))
    w = Window.partitionBy(source).orderBy("__t")
    steps = b.withColumn("__d", F.col("__t") - F.lag("__t").over(w)).groupBy(source).agg(
        F.max("__t").alias("__last"), (F.floor(F.percentile("__d", 0.5) / 1_000_000) * 1_000_000).alias("__step")
    )
    e = events.where(F.col(ts).isNotNull()).select(source, F.lit(None).cast("timestamp_ntz").alias("__bar"), epoch_us(ts).alias("__t"), F.coalesce(amount, F.lit(0.0)).alias("__x"))
    both = b.withColumn("__x", F.lit(None).cast("double")).unionByName(e)
    # At equal stamps the bar comes first, so that it takes the settlement.
    placed = last_before(both, "__bar", "__to", source=source, t="__t", tie=F.col("__bar").isNull()).where(F.col("__x").isNotNull() & F.col("__to").isNotNull())
    placed = placed.join(steps, source).where(F.col("__step").isNull() | (F.col("__t") < F.col("__last") + F.col("__step")))
    sums = placed.groupBy(source, F.col("__to").alias(ts)).agg(F.sum("__x").alias("__rate"), F.count(F.lit(1)).alias("__n"))
    return (
        bars.drop("funding_rate", "funding_settled")
        .join(sums, [source, ts], "left")
        .withColumn("funding_rate", F.coalesce("__rate", F.lit(0.0)))
        .withColumn("funding_settled", F.coalesce(F.col("__n") > 0, F.lit(False)))
        .drop("__rate", "__n")
    )


def level_asof(bars: DataFrame, readings: DataFrame, value: str, *, source: str = "symbol", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """bars with `value`: the last non-null reading at or before the bar's stamp, null before the first."""
    r = readings.where(F.col(ts).isNotNull() & F.col(value).isNotNull())
    order = [F.col(c) for c in ([tie] if tie else [value])]
    r = r.groupBy(source, ts).agg(F.max_by(value, F.struct(*order)).alias(value))
    both = bars.drop(value).select("*", F.lit(None).cast("double").alias("__v"), F.lit(True).alias("__is_bar")).unionByName(
        r.select(source, ts, F.col(value).cast("double").alias("__v"), F.lit(False).alias("__is_bar")), allowMissingColumns=True
    )
    both = both.withColumn("__t", epoch_us(ts))
    return last_before(both, "__v", value, source=source, t="__t", tie=F.col("__is_bar")).where("__is_bar").drop("__v", "__is_bar", "__t")


def closed_block_asof(bars: DataFrame, blocks: DataFrame, value: list[str], *, block_minutes: int, step_minutes: int, source: str = "symbol", ts: str = "ts") -> DataFrame:
    """bars with the values of the last block that has closed by the end of the bar.

    blocks are stamped with their start; a bar of `step_minutes` sees a block once bar end >= block end.
    """
    b = bars.select("*", (epoch_us(ts) + step_minutes * 60_000_000).alias("__t"), F.lit(1).alias("__k"))
    r = blocks.select(source, (epoch_us(ts) + block_minutes * 60_000_000).alias("__t"), F.lit(0).alias("__k"), F.struct(*value).alias("__v"))
    j = last_before(b.unionByName(r, allowMissingColumns=True), "__v", "__seen", source=source, t="__t", tie=F.col("__k"))
    return j.where(F.col("__k") == 1).select(*bars.columns, *[F.col(f"__seen.{v}").alias(v) for v in value])
