"""The trial ledger: append-only, first write of an identity wins, every attribution is kept."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import pick
from barloom.session import cut

IDENTITY = ("config_hash", "symbol", "evaluator", "panel_hash", "code_hash")


def json_number(column: str, key: str) -> Column:
    return F.get_json_object(F.col(column), f"$.{key}").try_cast("double")


def first_of_identity(trials: DataFrame, order: Sequence[str] = ("created_utc", "trial_id"), identity: Sequence[str] = IDENTITY) -> DataFrame:
    """One row per identity, the first written. Identities with null parts are identities of their own rows' nulls."""
    return pick(trials, identity, order)


def new_rows(held: DataFrame, batch: DataFrame, **kw) -> DataFrame:
    """The rows of a batch that a ledger does not hold yet, once each."""
    fresh = first_of_identity(batch, **kw)
    on = [fresh[c].eqNullSafe(held[c]) for c in IDENTITY]
    return fresh.join(held.select(*IDENTITY), on, "left_anti")


def attributions(trials: DataFrame) -> DataFrame:
    """(trial_id, hypothesis_id, first_seen_utc): every hypothesis that measured an identity, under its first trial."""
    first = first_of_identity(trials).select(F.col("trial_id").alias("__first"), *[F.col(c).alias(f"__{c}") for c in IDENTITY])
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in IDENTITY]
    named = trials.where(F.col("hypothesis_id").isNotNull())
    return named.join(first, on).groupBy(F.col("__first").alias("trial_id"), "hypothesis_id").agg(F.min("created_utc").alias("first_seen_utc"))


def union_ledgers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both ledgers' rows, one per identity, the earlier written first."""
    return first_of_identity(a.unionByName(b))


class Ledger:
    """A folder of parquet parts that only ever grows. Rows cannot be changed or removed through it."""

    def __init__(self, spark: SparkSession, folder: str, create: bool = False):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        if not create and not self._there():
            raise FileNotFoundError(f"no ledger at {folder}")

    def _there(self) -> bool:
        at = self._path(self.folder)
        return self._fs.exists(at) and any(not f.getPath().getName().startswith("_") for f in self._fs.listStatus(at))

    def trials(self) -> DataFrame | None:
        """All rows; parts written before a column was added show null in it."""
        return self.spark.read.option("mergeSchema", True).parquet(self.folder) if self._there() else None

    @contextmanager
    def _alone(self, patience_s: float = 60.0) -> Iterator[None]:
        """One writer at a time: a file that only one can create. One that a dead writer left must be removed by hand."""
        lock, end = self._path(f"{self.folder}/_writing"), time.monotonic() + patience_s
        self._fs.mkdirs(self._path(self.folder))
        while True:
            try:
                self._fs.create(lock, False).close()
                break
            except Exception as e:  # noqa: BLE001
                if "AlreadyExists" not in str(e) or time.monotonic() > end:
                    raise
            time.sleep(0.2)
        try:
            yield
        finally:
            self._fs.delete(lock, False)

    def record_each(self, batch: DataFrame) -> DataFrame:
        """Append what is new; (identity..., trial_id, was_new), a row per identity of the batch, with the id it is held under.

        The batch is evaluated once. Identities held already keep their first row.
        """
        with self._alone():
            held, first = self.trials(), cut(first_of_identity(batch))
            if held is None:
                out = first.select(*IDENTITY, "trial_id", F.lit(True).alias("was_new"))
                fresh = first
            else:
                old = pick(held, IDENTITY, ("created_utc", "trial_id")).select(F.col("trial_id").alias("__held"), *[F.col(c).alias(f"__{c}") for c in IDENTITY])
                j = cut(first.join(old, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in IDENTITY], "left"))
                out = j.select(*IDENTITY, F.coalesce("__held", "trial_id").alias("trial_id"), F.col("__held").isNull().alias("was_new"))
                fresh = j.where(F.col("__held").isNull()).select(*first.columns)
            if fresh.take(1):
                fresh.write.mode("append").parquet(self.folder)
            return out

    def record(self, batch: DataFrame) -> int:
        """How many identities of a batch were new; see record_each."""
        return self.record_each(batch).where("was_new").count()

    def merge(self, other: DataFrame) -> int:
        """Union with another ledger; merging nothing into nothing is refused, and a ledger never shrinks."""
        before = 0 if self.trials() is None else self.trials().count()
        if before == 0 and not other.take(1):
            raise ValueError("both ledgers are empty")
        added = self.record(other)
        after = self.trials().count()
        if after < before + added:
            raise AssertionError("the ledger shrank")
        return added


def by_family(trials: DataFrame) -> DataFrame:
    return trials.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.max("created_utc").alias("latest"))


def run_summary(trials: DataFrame) -> DataFrame:
    """(run_id, n, first_utc, last_utc, families, symbols): names of a run in order, without repeats."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return trials.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_utc").alias("first_utc"), F.max("created_utc").alias("last_utc"), names("family").alias("families"), F.count_distinct("symbol").alias("symbols")
    )


def best(trials: DataFrame, metric: str, k: int, family: str | None = None) -> DataFrame:
    """The k trials with the greatest metric; ties go to the smaller trial id."""
    t = trials if family is None else trials.where(F.col("family") == family)
    v = t.withColumn("value", json_number("metrics_json", metric)).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return v.orderBy(F.desc("value"), "trial_id").limit(k)


def newest_per_cell(trials: DataFrame, cell: Sequence[str] = ("hypothesis_id", "symbol", "config_hash")) -> DataFrame:
    return pick(trials, cell, ("created_utc", "trial_id"), largest=True)


def latest_of(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Upsert view: the newest entry of each key."""
    return pick(df, key, order, largest=True)


def revisions(trials: DataFrame) -> DataFrame:
    """(symbol, code_revisions, panel_revisions): more than one says that numbers were measured on different things."""
    return trials.groupBy("symbol").agg(F.count_distinct("code_hash").alias("code_revisions"), F.count_distinct("panel_hash").alias("panel_revisions"))


def pending(candidates: DataFrame, trials: DataFrame, on: Sequence[str]) -> DataFrame:
    """Anti-join: what has not been measured, decided before it is evaluated."""
    return candidates.join(trials.select(*on).distinct(), list(on), "left_anti")
