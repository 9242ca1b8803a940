"""Column helpers shared by the operators; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n 　"


def canon_symbol(col: str | Column) -> Column:
    """Symbols compare without case and outer blanks."""
    return F.upper(F.trim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS)))


def epoch_us(col: str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{col}` AS TIMESTAMP_NTZ))")


def stamp_of(t: Column, date_only: bool = False) -> Column:
    """The zone-free timestamp that a text spells with dashes or slashes and a blank or T, else null.

    One pattern and one cast instead of several formats, which throw inside: this runs once per value of a table.
    """
    day, time = "^[0-9]{4}(-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}", "[ T][0-9]{2}:[0-9]{2}(:[0-9]{2})?"
    form = f"{day}({time})?$" if date_only else f"{day}{time}$"
    return F.when(t.rlike(form), F.replace(t, F.lit("/"), F.lit("-")).try_cast("timestamp_ntz"))


def present(col: str | Column) -> Column:
    """Neither null nor NaN."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & ~F.isnan(c)


def safe_div(a: Column, b: Column) -> Column:
    """Null on a zero or null divisor, also under ANSI mode."""
    return F.try_divide(a, b)


def days_to_bars(days: float, bars_per_day: float) -> int:
    """Half-even rounding, as Python's round."""
    return int(round(days * bars_per_day))


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df, *keys):
    """df partitioned by its keys into as many parts as there are tasks, for groups whose work is out of proportion to
    their bytes: adaptive execution would merge them into one task, as it goes by bytes."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def pick(df, keys, order, largest: bool = False):
    """One row per key: the first in `order` (or the last). An aggregation, so copies of a key merge before
    the shuffle and no key is sorted in one task. Null keys are keys; null comes first in an order."""
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys]
    by = F.max_by if largest else F.min_by
    # A struct is never null, so rows whose order values are null still count.
    return df.groupBy(*keys).agg(by(F.struct(*rest), F.struct(*order)).alias("__m")).select(*keys, "__m.*").select(*df.columns)
