"""Sinks: partitioned panels, manifests, append-only logs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.cleaning import development


def _part(source: str) -> Column:
    # With a letter in front, so that no reader takes a source's name for a number or a date.
    return F.concat(F.lit("s_"), F.col(source))


def write_panel(panel: DataFrame, path: str, *, clock: str, source: str = "symbol", full: bool = False) -> list[str]:
    """One dataset partitioned by clock and source, zstd, in time order. Returns the sources that were pruned.

    Only the sources in this panel are replaced. A full build also prunes the clock's sources that it does not have;
    their names, one a source, are what is read to the driver. Rows without a source are refused.
    """
    if panel.where(F.col(source).isNull()).take(1):
        raise ValueError("rows without a source belong to no partition")
    d = panel.withColumn("clock", F.lit(clock)).withColumn("part", _part(source))
    # A hot source is spread over several tasks, each with a stretch of its history.
    d.repartitionByRange("part", "ts").sortWithinPartitions("part", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("clock", "part").parquet(path)
    if not full:
        return []
    spark = panel.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/clock={clock}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    quoted = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    have = {f"part={quoted.escapePathName(r.part)}" for r in d.select("part").distinct().collect()}
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part=") and s.getPath().getName() not in have]
    for p in gone:
        fs.delete(p, True)
    return sorted(quoted.unescapePathName(p.getName()).removeprefix("part=s_") for p in gone)


def read_panel(spark, path: str, *, clock: str, sources: list[str] | None = None) -> DataFrame:
    d = spark.read.parquet(path).where(F.col("clock") == clock)
    if sources is not None:
        d = d.where(F.col("part").isin([f"s_{s}" for s in sources]))
    return d.drop("part")


def panel_catalog(spark, path: str) -> DataFrame:
    """(clock, symbol): what a panel folder holds, from its partitions alone."""
    return spark.read.parquet(path).select("clock", F.substring("part", 3, 1 << 20).alias("symbol")).distinct()


def export_bundle(panel: DataFrame, path: str, *, seal: str, source: str = "symbol") -> DataFrame:
    """Write the development part and return its manifest: rows, span and a digest per source."""
    dev = development(panel, seal)
    dev.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    back = panel.sparkSession.read.parquet(path)
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in back.columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return back.groupBy(source).agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sha2(F.concat_ws("/", part(0), part(1), part(2), part(3)), 256).alias("digest")
    )


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A report table of at most `limit` rows; a longer one says so under the table."""
    rows = df.limit(limit + 1).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    more = f"\nThe first {limit} rows; there are more.\n" if len(rows) > limit else ""
    return f"## {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:limit]) + "\n" + more


def file_digest(spark, glob: str) -> DataFrame:
    """(path, bytes, digest): SHA-256 of whole files."""
    return spark.read.format("binaryFile").load(glob).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))
