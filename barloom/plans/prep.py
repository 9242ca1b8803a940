"""Queries and SQL of the core data-preparation operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import table
from barloom.operators.profile import CountStore, changed_columns, profile, value_counts
from barloom.operators.regrid import STATUS_MARKED, STATUS_READ, regrid
from barloom.operators.spikes import implausible_bars
from barloom.operators.rolling import gate_days, trailing_totals
from barloom.session import work_folder

PANEL_ORDER = ("ingested_at", "bar_id")


#: Columns of symbol_qa that are judged between loads.
QA_COLUMNS = (
    "symbol", "rows_raw", "rows_dropped_padding", "rows_dropped_duplicate", "rows_final", "first_ts", "last_ts",
    "gap_count", "largest_gap_minutes", "nonpositive_price_rows", "ohlc_violation_rows", "usable",
)
PROFILED = ("raw_1m", "panel_1h", "positioning", "funding", "symbol_qa")
#: The ledger and the texts; p3_profile's SQL names the tables of numbers only, so they have a query of their own.
PROFILED_TEXTS = ("trials", "documents")


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every implausible delivered bar and what is wrong with it."""
    return implausible_bars(table(spark, sf_dir, "raw_1m"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_kinds(spark, sf_dir).select("row_id")


#: What names the load of a row, by table; archive loads of symbol_qa, elsewhere the month in which a row came in.
LOADS = {"symbol_qa": "load_id", "trials": "created_utc", "documents": "created_utc"}


def kept_counts(spark: SparkSession, sf_dir: str, name: str, columns: tuple[str, ...] | None = None) -> CountStore:
    """The value counts of a table in a store: its loads as signed deltas, the newest withdrawn and added once more."""
    df = table(spark, sf_dir, name)
    by = LOADS.get(name, "ingested_at")
    load = F.col(by) if by == "load_id" else F.coalesce(F.substring(F.col(by).cast("string"), 1, 7), F.lit("none"))
    store = CountStore(spark, work_folder(spark, f"counts-{name}"))
    loads = store.add_loads(value_counts(df.withColumn("__load", load), columns or df.columns, by=["__load"]), "__load")
    if len(loads) > 1:
        store.add(loads[-1], store.withdraw(loads[-1]))
    return store


def p1_ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of p1_kinds that SQL can say: impossible and stuck rows."""
    return p1_kinds(spark, sf_dir).where(F.col("kind") != "spike")


def _counts(spark: SparkSession, sf_dir: str, name: str, without_newest: bool = False) -> DataFrame:
    """What a table's store keeps; an empty table has no loads and no counts."""
    store = kept_counts(spark, sf_dir, name)
    loads = store.loads()
    if without_newest and len(loads) > 1:
        store.withdraw(max(loads))
    kept = store.counts()
    return value_counts(table(spark, sf_dir, name)) if kept is None else kept


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of symbol_qa that depart plainly, in a load, from the loads around it; judged from the kept counts."""
    deltas = kept_counts(spark, sf_dir, "symbol_qa", QA_COLUMNS).by_load()
    if deltas is None:
        return spark.createDataFrame([], "load_id bigint, column_name string")
    return changed_columns(deltas).select(F.col("load").alias("load_id"), "column_name")


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact metrics of every column of the large tables of numbers, from kept counts; p3_profile_texts has the others."""
    return _profiles(spark, sf_dir, PROFILED)


def p3_profile_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of p3_profile for every column of the ledger and of the documents, of whole values."""
    return _profiles(spark, sf_dir, PROFILED_TEXTS)


def p3_withdrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of symbol_qa after its newest load is withdrawn from the kept counts."""
    return _rounded(profile(_counts(spark, sf_dir, "symbol_qa", without_newest=True)).select(F.lit("symbol_qa").alias("table_name"), "*"))


def _profiles(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    out = None
    for name in names:
        part = profile(_counts(spark, sf_dir, name)).select(F.lit(name).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return _rounded(out)


def _rounded(d: DataFrame) -> DataFrame:
    return d.select(
        "table_name", "column_name", "rows", F.round("null_share", 9).alias("null_share"), "distinct_values", "min_num", "max_num", "min_txt", "max_txt",
        F.round(F.col("entropy_bits") + 1.37e-7, 5).alias("entropy_bits"), "top_form", F.round("top_form_share", 9).alias("top_form_share"),
    )


def p4_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total funding and average close over 7, 30 and every gate's days, per symbol and calendar day."""
    periods = sorted({7, 30, *gate_days(table(spark, sf_dir, "trials"))})
    out = trailing_totals(
        table(spark, sf_dir, "panel_1h"), entity="symbol", ts="ts", sums=["funding_rate"], averages=["close"], flags=["funding_settled"], periods=periods, order=PANEL_ORDER
    )
    return out.select(
        "symbol",
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        "days",
        F.round("total_funding_rate", 9).alias("total_funding_rate"),
        # The shift keeps exact halves from rounding by the order of summation.
        F.round(F.col("avg_close") + 1.37e-7, 4).alias("avg_close"),
        F.col("n_funding_settled").alias("settlements"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose trailing 7 days hold no settled bar while the trailing 30 hold one."""
    out = trailing_totals(
        table(spark, sf_dir, "panel_1h"), entity="symbol", ts="ts", sums=[], averages=[], flags=["funding_settled"], periods=[7, 30], order=(), wide=True
    )
    return out.where((F.col("n_funding_settled_7") == 0) & (F.col("n_funding_settled_30") > 0)).select("symbol", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p5_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One close per symbol and hour, the absent hours filled or marked."""
    return regrid(table(spark, sf_dir, "panel_1h"), source="symbol", ts="ts", value="close", tie="bar_id").select(
        "symbol", F.date_format("slot_start", "yyyy-MM-dd HH:mm:ss").alias("slot"), "value", "status"
    )


def p5_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of p5_grid that SQL can say: every slot, what was read in it, and whether anything was."""
    d, read = p5_grid(spark, sf_dir), F.col("status") == STATUS_READ
    return d.select("symbol", "slot", F.round(F.when(read, F.col("value")), 9).alias("value"), read.alias("seen"), (F.col("value").isNull() == (F.col("status") == STATUS_MARKED)).alias("consistent"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours from a symbol's first to its last bar with a close in which no bar with a close falls."""
    return p5_grid(spark, sf_dir).where(F.col("status") != STATUS_READ).select("symbol", "slot")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_kinds": p1_kinds, "p1_ruled": p1_ruled, "p3_found": p3_found, "p3_profile": p3_profile, "p3_profile_texts": p3_profile_texts, "p3_withdrawn": p3_withdrawn, "p4_found": p4_found, "p4_trailing": p4_trailing, "p5_found": p5_found, "p5_grid": p5_grid, "p5_read": p5_read}


P1_RULED_SQL = r"""
WITH t AS (SELECT *, regexp_replace(trim(ts), '[Z ]+$', '') AS x FROM raw_1m),
m AS (SELECT *, CASE WHEN regexp_full_match(x, '[0-9]{13}') THEN CAST(x AS BIGINT) // 60000 WHEN regexp_full_match(x, '[0-9]{10}') THEN CAST(x AS BIGINT) // 60
    ELSE epoch_us(coalesce(try_strptime(x, '%Y-%m-%d %H:%M:%S'), try_strptime(x, '%Y-%m-%dT%H:%M:%S'), try_strptime(x, '%Y/%m/%d %H:%M'), try_strptime(x, '%Y/%m/%d %H:%M:%S'), try_strptime(x, '%Y-%m-%d %H:%M'))) // 60000000 END AS minute,
  coalesce(least(open, high, low, close) <= 0, false) OR coalesce(high < open, false) OR coalesce(high < low, false) OR coalesce(high < close, false) OR coalesce(low > open, false) OR coalesce(low > close, false)
  OR coalesce(volume < 0, false) OR coalesce(taker_buy_base > abs(volume), false) AS bad FROM t),
f AS (SELECT *, row_number() OVER (PARTITION BY symbol, minute ORDER BY ingested_at NULLS FIRST, row_id) AS k FROM m WHERE minute IS NOT NULL AND symbol IS NOT NULL),
b AS (SELECT symbol, minute, open, high, low, close, volume, lag(open) OVER w AS o, lag(high) OVER w AS h, lag(low) OVER w AS l, lag(close) OVER w AS c, lag(volume) OVER w AS v FROM f WHERE k = 1
      WINDOW w AS (PARTITION BY symbol ORDER BY minute)),
g AS (SELECT *, sum(CASE WHEN open = o AND high = h AND low = l AND close = c THEN 0 ELSE 1 END) OVER w AS gp, sum(CASE WHEN volume = v THEN 0 ELSE 1 END) OVER w AS gv FROM b WINDOW w AS (PARTITION BY symbol ORDER BY minute)),
n AS (SELECT *, count(*) OVER (PARTITION BY symbol, gp) AS np, count(*) OVER (PARTITION BY symbol, gv) AS nv FROM g)
SELECT m.row_id, CASE WHEN bad THEN 'impossible' ELSE 'stuck' END AS kind FROM m LEFT JOIN n ON m.symbol = n.symbol AND m.minute = n.minute
WHERE bad OR (np >= 6 AND m.open = n.open AND m.high = n.high AND m.low = n.low AND m.close = n.close) OR (nv >= 6 AND n.volume > 0 AND m.volume = n.volume)
"""

P4_FOUND_SQL = """
WITH d AS (
  SELECT symbol, CAST(ts AS DATE) AS day, max(CASE WHEN funding_settled THEN 1 ELSE 0 END) AS s
  FROM panel_1h WHERE symbol IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
c AS (
  SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY symbol),
j AS (SELECT c.symbol, c.day, coalesce(d.s, 0) AS s FROM c LEFT JOIN d ON c.symbol = d.symbol AND c.day = d.day),
w AS (
  SELECT symbol, day,
         sum(s) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS n7,
         sum(s) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS n30
  FROM j)
SELECT symbol, strftime(day, '%Y-%m-%d') AS day FROM w WHERE n7 = 0 AND n30 > 0
"""

P4_TRAILING_SQL = r"""
WITH g AS (
  SELECT DISTINCT CAST(nullif(regexp_extract(lower(trim(json_extract_string(config_json, '$.gate'))),
         '^(dip:[0-9]*\.?[0-9]+|sma):([0-9]+)$', 2), '') AS BIGINT) AS days FROM trials),
p AS (SELECT days FROM g WHERE days BETWEEN 1 AND 3652425 UNION SELECT 7 UNION SELECT 30),
h AS (
  SELECT symbol, date_trunc('hour', ts) AS hour,
         arg_max(struct_pack(f := funding_rate, c := close), (ingested_at, bar_id)) AS v,
         max(CASE WHEN funding_settled THEN 1 ELSE 0 END) AS s
  FROM panel_1h WHERE symbol IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
d AS (
  SELECT symbol, CAST(hour AS DATE) AS day, coalesce(sum(v.f), 0) AS f, sum(v.c) AS c, count(v.c) AS n, sum(s) AS s
  FROM h GROUP BY 1, 2),
k AS (SELECT symbol, min(day) AS a, max(day) AS b FROM d GROUP BY symbol),
c AS (SELECT symbol, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM k)
SELECT c.symbol, strftime(c.day, '%Y-%m-%d') AS day, p.days,
       round(coalesce(sum(d.f), 0), 9) AS total_funding_rate,
       round(sum(d.c) / nullif(sum(d.n), 0) + 1.37e-7, 4) AS avg_close,
       CAST(coalesce(sum(d.s), 0) AS BIGINT) AS settlements
FROM c CROSS JOIN p LEFT JOIN d ON d.symbol = c.symbol AND d.day <= c.day AND d.day > c.day - CAST(p.days AS INTEGER)
GROUP BY c.symbol, c.day, p.days
"""

P5_FOUND_SQL = """
WITH h AS (SELECT DISTINCT symbol, date_trunc('hour', ts) AS hour FROM panel_1h
           WHERE symbol IS NOT NULL AND ts IS NOT NULL AND close IS NOT NULL AND NOT isnan(close)),
g AS (SELECT symbol, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM h GROUP BY symbol)
SELECT g.symbol, strftime(g.hour, '%Y-%m-%d %H:%M:%S') AS slot
FROM g ANTI JOIN h ON g.symbol = h.symbol AND g.hour = h.hour
"""


P5_READ_SQL = """
WITH h AS (SELECT symbol, date_trunc('hour', ts) AS hour, arg_max(close, (ts, bar_id)) AS value FROM panel_1h
           WHERE symbol IS NOT NULL AND ts IS NOT NULL AND close IS NOT NULL AND NOT isnan(close) GROUP BY 1, 2),
g AS (SELECT symbol, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM h GROUP BY symbol)
SELECT g.symbol, strftime(g.hour, '%Y-%m-%d %H:%M:%S') AS slot, round(h.value, 9) AS value, h.value IS NOT NULL AS seen, true AS consistent
FROM g LEFT JOIN h ON g.symbol = h.symbol AND g.hour = h.hour
"""


#: Columns by table and kind; stamps without zone are compared as their text.
_TYPES = {
    "raw_1m": (["row_id", "open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base", "taker_buy_quote", "trades"], ["symbol", "ts", "ingested_at"]),
    "panel_1h": (["bar_id", "open", "high", "low", "close", "volume", "quote_volume", "trades", "minutes_present", "funding_rate", "open_interest"], ["symbol", "ts", "funding_settled", "ingested_at"]),
    "positioning": (["reading_id", "open_interest", "open_interest_usd", "toptrader_accounts_ls", "toptrader_positions_ls", "accounts_ls", "taker_buy_sell"], ["symbol", "ts", "ingested_at"]),
    "funding": (["settlement_id", "funding_rate", "interval_hours"], ["symbol", "ts", "ingested_at"]),
    "symbol_qa": (["qa_id", "load_id", "rows_raw", "rows_dropped_padding", "rows_dropped_duplicate", "rows_final", "gap_count", "largest_gap_minutes", "nonpositive_price_rows", "ohlc_violation_rows"], ["load_utc", "symbol", "first_ts", "last_ts", "usable", "reject_reason"]),
}


_TEXT_TYPES = {
    "trials": (["trial_id", "n_starts"], ["created_utc", "run_id", "family", "hypothesis_id", "symbol", "evaluator", "config_hash", "config_json", "code_hash", "panel_hash", "holdout_state", "metrics_json"]),
    "documents": (["doc_id", "n_chars"], ["text", "lang", "source", "hypothesis_id", "family", "symbol", "created_utc"]),
}


def _profile_sql(types: dict = _TYPES) -> str:
    parts = []
    for name, (nums, txts) in types.items():
        for c in nums:
            parts.append(f"SELECT '{name}' AS t, '{c}' AS c, CAST({c} AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS txt, count(*) AS n FROM {name} GROUP BY 3")
        for c in txts:
            # Fractions of a second are written without closing zeros, as Spark does.
            txt = f"regexp_replace(regexp_replace(CAST({c} AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')" if c == "ingested_at" or c == "load_utc" or (c == "ts" and name != "raw_1m") or (c == "created_utc" and name == "documents") else f"CAST({c} AS VARCHAR)"
            parts.append(f"SELECT '{name}', '{c}', NULL, {txt}, count(*) FROM {name} GROUP BY 4")
    return (
        "WITH v AS (" + " UNION ALL ".join(parts) + """),
w AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(txt, '\\p{Ll}+', 'a', 'g'), '\\p{Lu}+', 'A', 'g'), '[0-9]+', '9', 'g') AS form FROM v),
f AS (SELECT t, c, form, sum(n) AS m, row_number() OVER (PARTITION BY t, c ORDER BY sum(n) DESC, form) AS k
      FROM w WHERE txt IS NOT NULL GROUP BY t, c, form),
b AS (SELECT t, c, sum(n) AS rows, sum(n) FILTER (WHERE num IS NULL AND txt IS NULL) AS nulls,
             count(*) FILTER (WHERE num IS NOT NULL OR txt IS NOT NULL) AS distinct_values,
             min(num) AS min_num, max(num) AS max_num, min(txt) AS min_txt, max(txt) AS max_txt,
             sum(n) FILTER (WHERE num IS NOT NULL OR txt IS NOT NULL) AS s,
             sum(n * log2(n)) FILTER (WHERE num IS NOT NULL OR txt IS NOT NULL) AS l
      FROM v GROUP BY t, c)
SELECT b.t AS table_name, b.c AS column_name, CAST(rows AS BIGINT) AS rows, round(coalesce(nulls, 0) / rows, 9) AS null_share,
       distinct_values, min_num, max_num, min_txt, max_txt,
       round(CASE WHEN s > 0 THEN log2(CAST(s AS DOUBLE)) - l / s ELSE 0.0 END + 1.37e-7, 5) AS entropy_bits,
       f.form AS top_form, round(f.m / s, 9) AS top_form_share
FROM b LEFT JOIN f ON f.t = b.t AND f.c = b.c AND f.k = 1"""
    )


def _withdrawn_sql() -> str:
    sql = _profile_sql({"symbol_qa": _TYPES["symbol_qa"]}).replace("FROM symbol_qa", "FROM q")
    return "WITH q AS (SELECT * FROM symbol_qa WHERE load_id < (SELECT max(load_id) FROM symbol_qa)),\n" + sql.removeprefix("WITH ")


def oracle_sql() -> dict[str, str]:
    return {"p1_ruled": P1_RULED_SQL, "p3_profile": _profile_sql(), "p3_profile_texts": _profile_sql(_TEXT_TYPES), "p3_withdrawn": _withdrawn_sql(), "p4_found": P4_FOUND_SQL, "p4_trailing": P4_TRAILING_SQL, "p5_found": P5_FOUND_SQL, "p5_read": P5_READ_SQL}
