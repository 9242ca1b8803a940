"""Sources: delivered files of the usual kinds, read lazily with declared schemas."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import constants as K
from barloom.functions.columns import pick

RAW_BARS = "ts string, open double, high double, low double, close double, volume double, quote_volume double, taker_buy_base double, taker_buy_quote double, trades bigint"


def csv_bars(spark: SparkSession, glob: str, schema: str = RAW_BARS) -> DataFrame:
    """Headerless delimited bars; a field that cannot be read is null and its row stays."""
    return spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE").csv(glob)


def table_bars(df: DataFrame, *, symbol: str, symbol_col: str = "symbol", ms: str = "open_time") -> DataFrame:
    """Rows of one symbol of a table keyed by epoch milliseconds, stamped as text; the filter reaches the scan."""
    return df.where(F.col(symbol_col) == symbol).withColumn("ts", F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")).drop(ms)


def symbols(df: DataFrame, col: str = "symbol") -> DataFrame:
    return df.where(F.col(col).isNotNull()).select(col).distinct()


def json_lines(spark: SparkSession, path: str, schema: str, key: str, limit: int | None = None) -> DataFrame:
    """Records of an append-only log, newest key first; lines that are no objects are skipped."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    d = rows.where(F.col("_bad").isNull()).drop("_bad").orderBy(F.desc(key))
    return d if limit is None else d.limit(limit)


def json_registry(spark: SparkSession, glob: str, schema: str, closed: DataFrame | None = None, family: str = "family") -> DataFrame:
    """Registered hypotheses, one file each, without those of closed families."""
    d = spark.read.schema(schema).option("multiLine", True).json(glob)
    return d if closed is None else d.join(closed.select(family), family, "left_anti")


def registered_universe(registry: DataFrame, col: str = "universe") -> DataFrame:
    return registry.select(F.explode(col).alias("symbol")).distinct()


def archives(spark: SparkSession, glob: str) -> DataFrame:
    """(path, content) of whole files; sources.http.fetched gives the same of URLs."""
    return spark.read.format("binaryFile").load(glob).select("path", "content")


def zip_members(files: DataFrame) -> DataFrame:
    """(path, member, text, error): every member of every archive as text, or what is wrong with the archive or the member.

    Archives are opened whole, one at a time. Directories are no members; an archive without one has an error.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                out = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for info in (i for i in z.infolist() if not i.is_dir()):
                            try:
                                out.append((path, info.filename, z.read(info).decode("utf-8"), None))
                            except (zipfile.BadZipFile, zlib.error, UnicodeDecodeError, NotImplementedError, RuntimeError) as e:
                                out.append((path, info.filename, None, f"{type(e).__name__}: {e}"))
                except zipfile.BadZipFile as e:
                    out.append((path, None, None, f"BadZipFile: {e}"))
                yield pd.DataFrame(out or [(path, None, None, "empty archive")], columns=["path", "member", "text", "error"])

    return files.mapInPandas(read, schema="path string, member string, text string, error string")


def broken_archives(files: DataFrame) -> DataFrame:
    """(path, member, error) of what `zipped_csv` cannot read."""
    return zip_members(files).where(F.col("error").isNotNull()).drop("text")


def zipped_csv(spark: SparkSession, glob: str, columns: Sequence[str], schema: str, files: DataFrame | None = None) -> DataFrame:
    """Archives of delimited files, with or without a header, all members of each; columns are taken by position.

    Values that cannot be read are null; what cannot be opened gives no rows and is named by `broken_archives`.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, text in zip(pdf["path"], pdf["text"]):
                if not text.strip():
                    continue
                head = text.split("\n", 1)[0].split(",")[0].strip()
                named = not head.lstrip("-").replace(".", "", 1).isdigit()
                d = pd.read_csv(io.StringIO(text), header=0 if named else None, dtype=str, keep_default_na=False)
                d = d.iloc[:, : len(columns)]
                d.columns = list(columns)[: d.shape[1]]
                yield pd.DataFrame({n: d[n] if n in d else None for n in columns}).assign(path=path)

    whole = zip_members(archives(spark, glob) if files is None else files).where(F.col("text").isNotNull()).select("path", "text")
    raw = whole.mapInPandas(read, schema=", ".join(f"{c} string" for c in columns) + ", path string")
    kinds = dict(c.strip().split() for c in schema.split(","))
    return raw.select(*[F.expr(f"try_cast(`{n}` AS {kinds[n]})").alias(n) for n in names], "path")


def klines(bars: DataFrame, *, ms: str = "open_time", order: Sequence[str] = (), source: str | None = None) -> DataFrame:
    """(source, ts, open, high, low, close, volume, quote_volume, trades): the first bar of each source and stamp, by `order`.

    Bars whose close is not above 0 or whose volume is under 0, null or NaN are left out after that, as are rows without a stamp.
    """
    keys = [source] if source else []
    numbers = ["open", "high", "low", "close", "volume", "quote_volume"]
    d = bars.where(F.col(ms).isNotNull()).select(*keys, F.col(ms).cast("bigint").alias("__ms"), *[F.col(c).cast("double").alias(c) for c in numbers], F.col("trades").cast("bigint").alias("trades"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
    one = pick(d, [*keys, "__ms"], [f"__o{i}" for i in range(len(order))] or numbers)
    good = (F.col("close") > 0) & ~F.isnan("close") & (F.col("volume") >= 0) & ~F.isnan("volume")
    return one.where(good).select(*keys, F.timestamp_millis("__ms").cast("timestamp_ntz").alias("ts"), *numbers, "trades")


def settlements(parts: Sequence[DataFrame], *, ms: str = "calc_time", rate: str = "last_funding_rate", hours: str = "funding_interval_hours", source: str | None = None) -> DataFrame:
    """Monthly parts to one table of (source, ts, funding_rate, interval_hours): the first of each source and stamp is kept.

    Without `source` the parts are those of one source. Ties inside a part go to the smaller rate, then interval.
    """
    d, keys = None, [source] if source else []
    for k, p in enumerate(parts):
        p = p.select(*keys, F.col(ms).cast("bigint").alias("__ms"), F.col(rate).cast("double").alias("funding_rate"), F.col(hours).cast("bigint").alias("interval_hours"), F.lit(k).alias("__part"))
        d = p if d is None else d.unionByName(p)
    return pick(d.where(F.col("__ms").isNotNull()), [*keys, "__ms"], ["__part", "funding_rate", "interval_hours"]).select(
        *keys, F.timestamp_millis("__ms").cast("timestamp_ntz").alias("ts"), "funding_rate", "interval_hours"
    )


def complete_days(readings: DataFrame, *, source: str = "symbol", ts: str = "ts", value: str = "open_interest", per_day: int = K.POSITIONING_ROWS_PER_DAY, max_missing: float = K.POSITIONING_MAX_MISSING) -> DataFrame:
    """Readings with a value, of the days that have enough of them; a thin day is left out, not filled."""
    d = readings.where(F.col(value).isNotNull()).withColumn("__day", F.to_date(ts))
    good = d.groupBy(source, "__day").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= per_day * (1.0 - max_missing))
    return d.join(good.select(source, "__day"), [source, "__day"], "left_semi").drop("__day")


def missing_days(wanted: DataFrame, held: DataFrame, *, source: str = "symbol", day: str = "day", ts: str = "ts") -> DataFrame:
    """What a resumed ingest has still to fetch."""
    have = held.select(source, F.to_date(ts).alias(day)).distinct()
    return wanted.join(have, [source, day], "left_anti")


def resumed(held: DataFrame, fetched: DataFrame, *, key: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Held and fetched readings; of each stamp the last fetched is kept."""
    both = held.withColumn("__g", F.lit(0)).unionByName(fetched.withColumn("__g", F.lit(1)))
    return pick(both, key, ["__g"], largest=True).drop("__g")


def lifecycle(months: DataFrame, live: DataFrame, *, source: str = "symbol", month: str = "month") -> DataFrame:
    """(symbol, first_month, last_month, still_listed)."""
    m = months.groupBy(source).agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"))
    alive = live.select(F.col(source), F.lit(True).alias("__live")).distinct()
    return m.join(alive, source, "left").select(source, "first_month", "last_month", F.coalesce("__live", F.lit(False)).alias("still_listed"))


def load_valid(panel: DataFrame, check: Callable[[DataFrame], DataFrame], source: str = "symbol") -> DataFrame:
    """The sources of a panel that pass a report with a `valid` column; the others are skipped."""
    return panel.join(check(panel).where("valid").select(source), source, "left_semi")
