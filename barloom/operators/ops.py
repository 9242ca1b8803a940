"""Operational views: busy time, merged timelines, findings, funding statistics, survivorship."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import epoch_us


def _islands(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., a, b, n, g): overlapping spans merged; g is the gap before an island."""
    w = Window.partitionBy(*keys).orderBy("a", "b")
    d = d.withColumn("__seen", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("__new", (F.col("__seen").isNull() | (F.col("a") > F.col("__seen"))).cast("int"))
    d = d.withColumn("__g", F.when((F.col("__new") == 1) & F.col("__seen").isNotNull(), F.col("a") - F.col("__seen")))
    d = d.withColumn("__isle", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "__isle").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"), F.max("__g").alias("g")).drop("__isle")


def duty_cycle(spans: DataFrame, *, by: Sequence[str], begin: str, end: str) -> DataFrame:
    """(by..., spans, islands, busy_s, window_s, duty, largest_gap_s): overlapping spans count once.

    begin and end are zone-free stamps; spans that end before they begin are left out. Equal spans are
    counted first and spans that begin on one day are merged first, so a busy key is spread over its days and
    only its islands meet in one task.
    """
    d = spans.select(*by, epoch_us(begin).alias("a"), epoch_us(end).alias("b")).where(F.col("a") <= F.col("b"))
    d = d.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("__day", F.floor(F.col("a") / F.lit(86_400_000_000)))
    isles = _islands(_islands(d, [*by, "__day"]).drop("g", "__day"), list(by))
    s = lambda c: c / F.lit(1_000_000.0)
    return isles.groupBy(*by).agg(
        F.sum("n").alias("spans"), F.count(F.lit(1)).alias("islands"), s(F.sum(F.col("b") - F.col("a"))).alias("busy_s"), s(F.max("b") - F.min("a")).alias("window_s"),
        F.try_divide(F.sum(F.col("b") - F.col("a")).cast("double"), (F.max("b") - F.min("a")).cast("double")).alias("duty"), s(F.coalesce(F.max("g"), F.lit(0))).alias("largest_gap_s"),
    )


def merged_timeline(log: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Full outer union of two records of the same things; a value of the log overrides the ledger's unless it is null."""
    both = [c for c in log.columns if c in ledger.columns and c != key]
    l, r = log.alias("l"), ledger.alias("r")
    cols = [F.coalesce(F.col(f"l.{key}"), F.col(f"r.{key}")).alias(key)]
    cols += [F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) for c in both]
    cols += [F.col(f"l.{c}") for c in log.columns if c not in both and c != key] + [F.col(f"r.{c}") for c in ledger.columns if c not in both and c != key]
    return l.join(r, F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer").select(*cols)


def finding_id(where: Column, what: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", where, what), 256), 1, 12)


def merge_findings(known: DataFrame, batch: DataFrame, *, where: str = "file", what: str = "what") -> DataFrame:
    """known and what is new of a batch, each finding once, with is_new."""
    b = batch.withColumn("finding_id", finding_id(F.col(where), F.col(what))).dropDuplicates(["finding_id"])
    return known.withColumn("is_new", F.lit(False)).unionByName(b.join(known.select("finding_id"), "finding_id", "left_anti").withColumn("is_new", F.lit(True)), allowMissingColumns=True)


def funding_stats(settlements: DataFrame, rate: str = "funding_rate", by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Count, mean, median, share positive, annual percentage and worst of the settlements with a rate other than 0."""
    r = settlements.where(F.col(rate).isNotNull() & (F.col(rate) != 0.0))
    return r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("settlements"), F.avg(rate).alias("mean_rate"), F.percentile(rate, 0.5).alias("median_rate"), F.avg((F.col(rate) > 0).cast("double")).alias("pct_positive"),
        (F.avg(rate) * 365.0 * 3.0 * 100.0).alias("naive_annualised_pct"), (F.max(rate) * 100.0).alias("worst_pct"),
    )


def hashed_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same ones for the same rows and seed; the n smallest hashes."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def survivors(groups: DataFrame, *, alive: str, value: str) -> DataFrame:
    """(alive, n, median): do those that were delisted do worse than those that were not?"""
    return groups.groupBy(alive).agg(F.count(value).alias("n"), F.percentile(value, 0.5).alias("median"))
