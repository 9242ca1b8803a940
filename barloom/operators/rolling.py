"""Rolling totals over trailing periods, days without activity included.

Daily totals per entity are turned into cumulative prefix sums that are forward-filled
across the calendar; the total of any trailing period is the difference of two prefix
values, so every further period costs one lag, not another scan or frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import present


def one_bar_per_hour(bars: DataFrame, *, entity: str, ts: str, values: Sequence[str], flags: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """(entity, hour, values..., flags..., bars): repeats and revisions of an hour count once.

    The latest delivery wins for values (the greatest of `order`, null values of it included);
    a flag is true if any delivery says so. Partial aggregation runs before the shuffle.
    """
    rank = F.struct(*[F.col(c) for c in order])
    v = F.max(F.struct(rank.alias("r"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)]))
    return (
        bars.where(F.col(entity).isNotNull() & F.col(ts).isNotNull())
        .withColumn("__hour", F.date_trunc("hour", F.col(ts).cast("timestamp_ntz")).cast("timestamp_ntz"))
        .groupBy(F.col(entity), F.col("__hour"))
        .agg(v.alias("__v"), *[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"__f{i}") for i, c in enumerate(flags)], F.count(F.lit(1)).alias("__n"))
        .select(entity, F.col("__hour").alias("hour"), *[F.col(f"__v.v{i}").alias(c) for i, c in enumerate(values)], *[F.col(f"__f{i}").alias(c) for i, c in enumerate(flags)], F.col("__n").alias("bars"))
    )


def daily_totals(hours: DataFrame, *, entity: str, values: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """(entity, day, bars, sum_<v>, n_<v>, n_<flag>) from one row per hour; nulls and NaN add nothing."""
    aggs = [F.sum("bars").alias("bars")]
    for v in values:
        aggs += [F.coalesce(F.sum(F.when(present(v), F.col(v))), F.lit(0.0)).alias(f"sum_{v}"), F.count(F.when(present(v), F.lit(1))).alias(f"n_{v}")]
    aggs += [F.count(F.when(F.col(f), F.lit(1))).alias(f"n_{f}") for f in flags]
    return hours.groupBy(F.col(entity), F.to_date("hour").alias("day")).agg(*aggs)


def prefix_calendar(daily: DataFrame, *, entity: str, measures: Sequence[str]) -> DataFrame:
    """One row per entity and calendar day from its first to its last day, with prefix sums p_<m>.

    The rows of an entity are its calendar days, a number bounded by the calendar, not by the data.
    A day without activity carries the prefix of the last day that had some.
    """
    w = Window.partitionBy(entity).orderBy("day")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    nxt = F.lead("day").over(w)
    active = daily.select(entity, "day", "bars", nxt.alias("__next"), *[F.sum(m).over(upto).alias(f"p_{m}") for m in measures])
    # A prefix holds until the day before the next active one.
    until = F.coalesce(F.date_sub(F.col("__next"), 1), F.col("day"))
    return active.select(
        entity,
        F.explode(F.sequence(F.col("day"), until)).alias("__d"),
        F.col("day").alias("__active"),
        "bars",
        *[f"p_{m}" for m in measures],
    ).select(entity, F.col("__d").alias("day"), F.when(F.col("__d") == F.col("__active"), F.col("bars")).otherwise(F.lit(0)).alias("bars"), *[f"p_{m}" for m in measures])


def trailing(calendar: DataFrame, *, entity: str, measure: str, days: int):
    """Column: total of a measure over the `days` days that end with the row's day."""
    w = Window.partitionBy(entity).orderBy("day")
    return F.col(f"p_{measure}") - F.coalesce(F.lag(f"p_{measure}", days).over(w), F.lit(0))


def trailing_totals(bars: DataFrame, *, entity: str, ts: str, sums: Sequence[str], averages: Sequence[str], flags: Sequence[str], periods: Sequence[int], order: Sequence[str], wide: bool = False) -> DataFrame:
    """(entity, day, days, total_<v>, avg_<v>, n_<flag>), one row per entity, calendar day and period.

    With `wide` one row per entity and day, whose columns end in the period instead: total_<v>_7.

    A total over a period without readings is 0, an average null. Repeats of an hour count once.
    Rows with null entity or stamp are ignored; an empty table gives no rows. Periods of fewer than
    one day raise. Near the start of an entity's history the period is cut at its first day.
    """
    periods = sorted({int(p) for p in periods})
    if not periods or periods[0] < 1:
        raise ValueError("periods must be at least one day")
    values = list(dict.fromkeys([*sums, *averages]))
    hours = one_bar_per_hour(bars, entity=entity, ts=ts, values=values, flags=flags, order=order)
    measures = [*[f"sum_{v}" for v in values], *[f"n_{v}" for v in averages], *[f"n_{f}" for f in flags]]
    cal = prefix_calendar(daily_totals(hours, entity=entity, values=values, flags=flags), entity=entity, measures=measures)

    def of(p: int) -> list:
        t = lambda m: trailing(cal, entity=entity, measure=m, days=p)
        return [
            *[(f"total_{v}", t(f"sum_{v}")) for v in sums],
            *[(f"avg_{v}", F.try_divide(t(f"sum_{v}"), t(f"n_{v}").cast("double"))) for v in averages],
            *[(f"n_{f}", t(f"n_{f}").cast("bigint")) for f in flags],
        ]

    # All lags share one sort per entity; the periods lie side by side, or unfold into rows.
    if wide:
        return cal.select(entity, "day", *[c.alias(f"{n}_{p}") for p in periods for n, c in of(p)])
    rows = F.array(*[F.struct(F.lit(p).cast("bigint").alias("days"), *[c.alias(n) for n, c in of(p)]) for p in periods])
    return cal.select(entity, "day", rows.alias("__p")).select(entity, "day", F.inline("__p"))


def gate_days(trials: DataFrame, calendar_days: int = 3_652_425) -> list[int]:
    """The distinct day counts named by gates dip:<drop>:<days> and sma:<days>, in either case.

    Counts above 0 and up to ten thousand years are periods; one longer than the history is the whole of it up to the
    day. Odd gates are ignored. The distinct counts, one for every gate that was ever tried, are read to the driver.
    """
    gate = F.lower(F.trim(F.get_json_object("config_json", "$.gate")))
    d = F.regexp_extract(gate, r"^(?:dip:[0-9]*\.?[0-9]+|sma):([0-9]+)$", 1)
    found = trials.select(d.try_cast("bigint").alias("d")).where(F.col("d").between(1, calendar_days)).distinct()
    return sorted(r.d for r in found.collect())
