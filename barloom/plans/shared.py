"""Inputs and SQL that several query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import table
from barloom.operators.panel import as_panel, one_bar_per_slot

PANEL_COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume", "funding_rate", "funding_settled", "open_interest", "ingested_at", "bar_id"]


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly Panel: the latest delivery of each hour, bars numbered per symbol."""
    return as_panel(one_bar_per_slot(table(spark, sf_dir, "panel_1h").select(*PANEL_COLUMNS), 60))


def stamp(c: str | Column, name: str = "ts") -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)


def rnd(c: str | Column, digits: int, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    # Adding 0 turns a negative zero into zero.
    return (F.round(col, digits) + F.lit(0.0)).alias(name or c)


PANEL = """
slots AS (
  SELECT symbol, date_trunc('hour', ts) AS ts,
         arg_max(struct_pack(o := open, h := high, l := low, c := close, v := volume, f := funding_rate, s := funding_settled, i := open_interest),
                 struct_pack(a := ingested_at, b := bar_id)) AS m
  FROM panel_1h WHERE symbol IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
panel AS (
  SELECT symbol, ts, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS BIGINT) AS bar_idx,
         m.o AS open, m.h AS high, m.l AS low, m.c AS close, coalesce(m.v, 0.0) AS volume, coalesce(m.f, 0.0) AS funding_rate,
         coalesce(m.s, false) AS funding_settled, m.i AS open_interest
  FROM slots WHERE m.o > 0 AND m.h > 0 AND m.l > 0 AND m.c > 0)"""

CLEAN = """
parsed AS (SELECT *, try_strptime(trim(ts), '%Y-%m-%d %H:%M:%S') AS tm FROM raw_1m),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, tm ORDER BY row_id) AS k FROM parsed
  WHERE tm IS NOT NULL AND NOT (open = high AND high = low AND low = close AND volume <= 0.0)),
kept AS (SELECT * FROM ranked WHERE k = 1),
clean AS (SELECT * FROM kept WHERE open > 0 AND high > 0 AND low > 0 AND close > 0)"""

WIN = "(PARTITION BY symbol ORDER BY bar_idx"
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
