"""Streaming forms of the bar operators: late bars within a watermark, exact repeats once, tumbling to a coarser clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bar_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def streaming_tumble(bars: DataFrame, minutes: int = 60, late: str = "1 hour", source: str = "symbol", ts: str = "ts") -> DataFrame:
    """Readable bars, the repeats of a bar within the watermark once, tumbled; late bars change a slot until it closes.

    Event time needs an instant, so zone-free stamps are read in the session's zone, which is UTC here.
    """
    b = bars.where(F.col(source).isNotNull() & F.col(ts).isNotNull()).withColumn("__et", F.col(ts).cast("timestamp")).withWatermark("__et", late)
    once = b.dropDuplicatesWithinWatermark([source, "__et", "open", "high", "low", "close", "volume"])
    return (
        once.groupBy(source, F.window("__et", f"{minutes} minutes"))
        .agg(
            F.min_by("open", "__et").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "__et").alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("minutes_present"),
        )
        .select(source, F.col("window.start").cast("timestamp_ntz").alias(ts), "open", "high", "low", "close", "volume", "minutes_present")
    )


def heartbeat_gaps(beats: DataFrame, key: str = "worker", ts: str = "ts", timeout: str = "30 minutes") -> DataFrame:
    """Sessions of heartbeats: a session ends after `timeout` without one."""
    b = beats.withColumn("__et", F.col(ts).cast("timestamp")).withWatermark("__et", timeout)
    return b.groupBy(key, F.session_window("__et", timeout)).agg(F.count(F.lit(1)).alias("beats")).select(key, F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "beats")
