"""Queries over delivered bars: cleaning, clocks, as-of joins and window operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import canon_symbol, table
from barloom.operators import asof, cleaning, timeseries as W
from barloom.operators.panel import funding_flow
from barloom.plans.shared import CLEAN, PANEL, TS, WIN, panel, rnd, stamp

SEAL, MIN_BARS = "2019-08-01", 1000


def clean_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_bars(table(spark, sf, "raw_1m")).select("row_id", "symbol", stamp("ts"), "close", "volume")


def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.quality_report(table(spark, sf, "raw_1m"), min_bars=MIN_BARS, seal=SEAL)


def tumble_1h(spark: SparkSession, sf: str) -> DataFrame:
    t = cleaning.tumble(cleaning.clean_bars(table(spark, sf, "raw_1m")), 60)
    return t.select("symbol", stamp("ts"), "open", "high", "low", "close", rnd("volume", 3), rnd("quote_volume", 2), "trades", "minutes_present")


def _resample(hours: int):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        p = panel(spark, sf).withColumns({"quote_volume": F.lit(0.0), "trades": F.lit(0)})
        return cleaning.tumble(p, hours * 60).select("symbol", stamp("ts"), "open", "high", "low", "close", "minutes_present")

    return query


def gap_report(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.gap_report(panel(spark, sf), 60)


def clock_report(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clock_report(panel(spark, sf), 60).withColumn("missing_fraction", F.round("missing_fraction", 9))


def development_slice(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.development(table(spark, sf, "panel_1h"), SEAL).select("bar_id", "symbol", "close")


def sealed_slice(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.sealed(table(spark, sf, "panel_1h"), SEAL).select("bar_id", "symbol", "close")


def _funding(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "funding").withColumn("symbol", canon_symbol("symbol"))
    # Repeats of a settlement count once.
    return f.where(F.col("symbol").isNotNull() & F.col("ts").isNotNull()).groupBy("symbol", "ts").agg(F.min_by("funding_rate", "settlement_id").alias("funding_rate"))


def covered_bars(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.covered(panel(spark, sf), _funding(spark, sf)).select("symbol", stamp("ts"), "close")


def funding_onto_bars(spark: SparkSession, sf: str) -> DataFrame:
    return asof.settle_onto_bars(panel(spark, sf), _funding(spark, sf)).select("symbol", stamp("ts"), rnd("funding_rate", 9), "funding_settled")


def open_interest_asof(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "positioning").withColumn("symbol", canon_symbol("symbol")).where(F.col("open_interest") > 0)
    return asof.level_asof(panel(spark, sf), r.where(F.col("symbol").isNotNull()), "open_interest", tie="reading_id").select("symbol", stamp("ts"), "open_interest")


def closed_block_asof(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    b = cleaning.tumble(p.withColumns({"quote_volume": F.lit(0.0), "trades": F.lit(0)}), 240).select("symbol", "ts", F.col("close").alias("block_close"))
    return asof.closed_block_asof(p, b, ["block_close"], block_minutes=240, step_minutes=60).select("symbol", stamp("ts"), "block_close")


def flow(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).select("symbol", stamp("ts"), rnd(funding_flow(), 9, "flow"))


def finite_report(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.finite_report(table(spark, sf, "panel_1h"), ["close", "funding_rate", "open_interest"])


def panel_hash(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.panel_hash(panel(spark, sf), ["close", "funding_rate", "funding_settled", "high", "low", "open_interest"])


K_STRIDE, N_STRIDE = 24, 5


def strided_sum(spark: SparkSession, sf: str) -> DataFrame:
    return W.strided_sum(panel(spark, sf), F.lit(1.0) / F.col("close"), K_STRIDE, N_STRIDE, "s").select("symbol", "bar_idx", rnd("s", 6))


def suffix_flow(spark: SparkSession, sf: str) -> DataFrame:
    return W.suffix_sum(panel(spark, sf), funding_flow(), "w").select("symbol", "bar_idx", rnd("w", 6))


def trailing_volume(spark: SparkSession, sf: str) -> DataFrame:
    return W.trailing_sum(panel(spark, sf), F.col("volume"), 24, "volume_24").select("symbol", "bar_idx", rnd(F.col("volume_24") + 1.37e-6, 2, "volume_24"))


def settlement_mean(spark: SparkSession, sf: str) -> DataFrame:
    return W.settlement_mean(panel(spark, sf), 168, "mean_rate").select("symbol", "bar_idx", rnd("mean_rate", 10))


def rolling_mad(spark: SparkSession, sf: str) -> DataFrame:
    d = W.mean_and_mad(panel(spark, sf).withColumn("lc", F.log("close")), F.col("lc"), 20)
    return d.select("symbol", "bar_idx", rnd("__mean", 8, "mean"), rnd("__mad", 8, "mad"))


def gates(spark: SparkSession, sf: str) -> DataFrame:
    d = W.gate_dip(W.gate_dip(panel(spark, sf), 0.05, 168, "dip_7"), 0.2, 0, "dip_all")
    return W.gate_sma(d, 168, "sma_7").select("symbol", "bar_idx", "dip_7", "dip_all", "sma_7")


def oi_change(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).select("symbol", "bar_idx", rnd(W.change("open_interest", 24), 8, "change"))


def regimes(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).select("symbol", "bar_idx", W.regime(720).alias("regime"))


def walk_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).select("symbol", "bar_idx", W.walk_block(4).alias("block"))


def equal_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).select("symbol", "bar_idx", F.ntile(10).over(Window.partitionBy("symbol").orderBy("bar_idx")).cast("bigint").alias("block"))


def drawdowns(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).select("symbol", "bar_idx", rnd(W.drawdown("close"), 9, "dd"), rnd(W.log_return("close"), 9, "r"))


def invested_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    d = panel(spark, sf)
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    d = d.withColumn("put", (F.floor(F.col("bar_idx") / 24) + 1) * 100.0).withColumn("worth", F.col("put") * F.col("close") / F.first("close").over(w))
    out = W.drawdown_on_invested(d, "worth", "put")
    return out.select("symbol", *[rnd(c, 6) for c in out.columns[1:]])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "clean_minutes": clean_minutes, "quality_report": quality_report, "tumble_1h": tumble_1h, "resample_4h": _resample(4), "resample_5h": _resample(5),
        "gap_report": gap_report, "clock_report": clock_report, "development_slice": development_slice, "sealed_slice": sealed_slice, "covered_bars": covered_bars,
        "funding_onto_bars": funding_onto_bars, "open_interest_asof": open_interest_asof, "closed_block_asof": closed_block_asof, "funding_flow": flow,
        "finite_report": finite_report, "panel_hash": panel_hash, "strided_sum": strided_sum, "suffix_flow": suffix_flow, "trailing_volume": trailing_volume,
        "settlement_mean": settlement_mean, "rolling_mad": rolling_mad, "gates": gates, "oi_change": oi_change, "regimes": regimes, "walk_blocks": walk_blocks,
        "equal_blocks": equal_blocks, "drawdowns": drawdowns, "invested_drawdown": invested_drawdown,
    }


def _resample_sql(hours: int) -> str:
    return f"""WITH {PANEL}
SELECT symbol, strftime(b, '%Y-%m-%d %H:%M:%S') AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, count(*) AS minutes_present
FROM (SELECT *, time_bucket(INTERVAL {hours} HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM panel) GROUP BY symbol, b"""


FUND = """fund AS (
  SELECT upper(trim(symbol)) AS symbol, ts, arg_min(funding_rate, settlement_id) FILTER (WHERE funding_rate IS NOT NULL) AS any_rate,
         first(funding_rate ORDER BY settlement_id) AS funding_rate
  FROM funding WHERE symbol IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2)"""


def oracle_sql() -> dict[str, str]:
    viol = "high < low OR high < open OR high < close OR low > open OR low > close"
    return {
        "clean_minutes": f"WITH {CLEAN} SELECT row_id, symbol, strftime(tm, '%Y-%m-%d %H:%M:%S') AS ts, close, volume FROM clean",
        "quality_report": f"""WITH {CLEAN},
g AS (SELECT symbol, greatest(date_diff('minute', lag(tm) OVER (PARTITION BY symbol ORDER BY tm), tm) - 1, 0) AS gap, tm, ({viol}) AS bad FROM clean),
f AS (SELECT symbol, count(*) AS n, min(tm) AS a, max(tm) AS b, count_if(gap > 0) AS gaps, max(gap) AS largest, count_if(bad) AS viol, count_if(tm < TIMESTAMP '{SEAL}') AS dev FROM g GROUP BY symbol),
r AS (SELECT symbol, count(*) AS rows_raw, count_if(tm IS NOT NULL AND open = high AND high = low AND low = close AND volume <= 0.0) AS pad FROM parsed GROUP BY symbol),
d AS (SELECT symbol, count_if(k > 1) AS dup, count_if(k = 1 AND (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0)) AS nonpos FROM ranked GROUP BY symbol)
SELECT r.symbol, rows_raw, CAST(pad AS BIGINT) AS rows_dropped_padding, CAST(coalesce(dup, 0) AS BIGINT) AS rows_dropped_duplicate, coalesce(n, 0) AS rows_final,
       CASE WHEN coalesce(n, 0) < {MIN_BARS} THEN '' ELSE strftime(a, '%Y-%m-%d %H:%M:%S') END AS first_ts,
       CASE WHEN coalesce(n, 0) < {MIN_BARS} THEN '' ELSE strftime(b, '%Y-%m-%d %H:%M:%S') END AS last_ts,
       CAST(coalesce(gaps, 0) AS BIGINT) AS gap_count, coalesce(largest, 0) AS largest_gap_minutes, CAST(coalesce(nonpos, 0) AS BIGINT) AS nonpositive_price_rows,
       CAST(coalesce(viol, 0) AS BIGINT) AS ohlc_violation_rows, coalesce(n, 0) >= {MIN_BARS} AND coalesce(dev, 0) > 0 AS usable,
       CASE WHEN coalesce(n, 0) < {MIN_BARS} THEN 'only ' || coalesce(n, 0) || ' bars, need {MIN_BARS}'
            WHEN coalesce(dev, 0) = 0 THEN 'listed after the seal; no development history' END AS reject_reason
FROM r LEFT JOIN f ON r.symbol = f.symbol LEFT JOIN d ON r.symbol = d.symbol""",
        "tumble_1h": f"""WITH {CLEAN}
SELECT symbol, strftime(date_trunc('hour', tm), '%Y-%m-%d %H:%M:%S') AS ts, arg_min(open, tm) AS open, max(high) AS high, min(low) AS low, arg_max(close, tm) AS close,
       round(coalesce(sum(volume), 0), 3) AS volume, round(coalesce(sum(quote_volume), 0), 2) AS quote_volume, CAST(coalesce(sum(trades), 0) AS BIGINT) AS trades, count(*) AS minutes_present
FROM clean GROUP BY symbol, date_trunc('hour', tm)""",
        "resample_4h": _resample_sql(4),
        "resample_5h": _resample_sql(5),
        "gap_report": f"""WITH {PANEL}, g AS (SELECT symbol, greatest(date_diff('hour', lag(ts) OVER {WIN}), ts) - 1, 0) AS g FROM panel)
SELECT symbol, count(*) AS bars, CAST(count_if(g > 0) AS BIGINT) AS gap_count, coalesce(max(g), 0) AS largest_gap FROM g GROUP BY symbol""",
        "clock_report": f"""WITH {PANEL}, g AS (SELECT symbol, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER {WIN}) AS d FROM panel),
a AS (SELECT symbol, count(*) AS bars, CAST(count_if(d <= 0) AS BIGINT) AS not_increasing, CAST(count_if(d > 0 AND d % 3600000000 <> 0) AS BIGINT) AS off_step,
             1.0 - count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 + 1) AS m FROM g GROUP BY symbol)
SELECT symbol, bars, not_increasing, off_step, round(m, 9) AS missing_fraction, not_increasing = 0 AND off_step = 0 AND m <= 0.005 AS valid FROM a""",
        "development_slice": f"SELECT bar_id, symbol, close FROM panel_1h WHERE ts < TIMESTAMP '{SEAL}'",
        "sealed_slice": f"SELECT bar_id, symbol, close FROM panel_1h WHERE ts >= TIMESTAMP '{SEAL}'",
        "covered_bars": f"""WITH {PANEL}, {FUND}, b AS (SELECT symbol, min(ts) AS a FROM fund GROUP BY symbol)
SELECT p.symbol, strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS ts, p.close FROM panel p JOIN b ON p.symbol = b.symbol AND p.ts >= b.a""",
        "funding_onto_bars": f"""WITH {PANEL}, {FUND},
d AS (SELECT symbol, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER {WIN}) AS d FROM panel),
s AS (SELECT symbol, max(t) AS z, floor(quantile_cont(d, 0.5) / 1000000) * 1000000 AS step FROM d GROUP BY symbol),
e AS (SELECT f.symbol, p.ts, coalesce(f.funding_rate, 0.0) AS r FROM fund f ASOF JOIN panel p ON f.symbol = p.symbol AND f.ts >= p.ts
      JOIN s ON s.symbol = f.symbol WHERE s.step IS NULL OR epoch_us(f.ts) < s.z + s.step),
a AS (SELECT symbol, ts, sum(r) AS r FROM e GROUP BY 1, 2)
SELECT p.symbol, strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(coalesce(a.r, 0.0), 9) AS funding_rate, a.r IS NOT NULL AS funding_settled
FROM panel p LEFT JOIN a ON a.symbol = p.symbol AND a.ts = p.ts""",
        "open_interest_asof": f"""WITH {PANEL}, r AS (
  SELECT upper(trim(symbol)) AS symbol, ts, arg_max(open_interest, reading_id) AS oi FROM positioning WHERE symbol IS NOT NULL AND open_interest > 0 GROUP BY 1, 2)
SELECT p.symbol, strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS ts, r.oi AS open_interest FROM panel p ASOF LEFT JOIN r ON p.symbol = r.symbol AND p.ts >= r.ts""",
        "closed_block_asof": f"""WITH {PANEL}, b AS (
  SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 4 HOUR AS e, arg_max(close, ts) AS c FROM panel GROUP BY 1, 2)
SELECT p.symbol, strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS ts, b.c AS block_close FROM panel p ASOF LEFT JOIN b ON p.symbol = b.symbol AND p.ts + INTERVAL 1 HOUR >= b.e""",
        "funding_flow": f"WITH {PANEL} SELECT symbol, {TS}, round(close * funding_rate, 9) + 0.0 AS flow FROM panel",
        "finite_report": " UNION ALL ".join(
            f"SELECT symbol, '{c}' AS column_name, CAST(count_if({c} IS NULL OR isnan({c})) AS BIGINT) AS missing, CAST(count_if(coalesce(isinf({c}), false)) AS BIGINT) AS infinite FROM panel_1h GROUP BY symbol"
            for c in ("close", "funding_rate", "open_interest")
        ),
        "strided_sum": f"""WITH {PANEL}, s AS (SELECT symbol, bar_idx, sum(1.0 / close) OVER w AS s, count(*) OVER w AS n FROM panel
  WINDOW w AS (PARTITION BY symbol, bar_idx % {K_STRIDE} ORDER BY bar_idx ROWS BETWEEN CURRENT ROW AND {N_STRIDE - 1} FOLLOWING))
SELECT symbol, bar_idx, CASE WHEN n = {N_STRIDE} THEN round(s, 6) END AS s FROM s""",
        "suffix_flow": f"WITH {PANEL} SELECT symbol, bar_idx, round(sum(close * funding_rate) OVER {WIN} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS w FROM panel",
        "trailing_volume": f"""WITH {PANEL} SELECT symbol, bar_idx, CASE WHEN bar_idx >= 23 THEN round(sum(volume) OVER {WIN} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) + 1.37e-6, 2) END AS volume_24 FROM panel""",
        "settlement_mean": f"""WITH {PANEL}, s AS (SELECT symbol, bar_idx, sum(funding_rate) OVER w AS r, sum(funding_settled::INT) OVER w AS n FROM panel WINDOW w AS {WIN} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW))
SELECT symbol, bar_idx, CASE WHEN bar_idx >= 167 THEN round(r / nullif(n, 0), 10) + 0.0 END AS mean_rate FROM s""",
        "rolling_mad": f"""WITH {PANEL}, s AS (SELECT symbol, bar_idx, avg(ln(close)) OVER w AS mu, list(ln(close)) OVER w AS l FROM panel WINDOW w AS {WIN} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT symbol, bar_idx, CASE WHEN bar_idx >= 19 THEN round(mu, 8) END AS mean, CASE WHEN bar_idx >= 19 THEN round(list_sum(list_transform(l, lambda x: abs(x - mu))) / 20, 8) END AS mad FROM s""",
        "gates": f"""WITH {PANEL}, s AS (SELECT symbol, bar_idx, close, count(*) OVER (PARTITION BY symbol) AS n,
  max(close) OVER {WIN} ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS p7, max(close) OVER {WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pa,
  avg(close) OVER {WIN} ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS m7 FROM panel)
SELECT symbol, bar_idx, coalesce(bar_idx >= 167 AND n > 168 AND close <= p7 * 0.95, false) AS dip_7, coalesce(close <= pa * 0.8, false) AS dip_all,
       coalesce(bar_idx >= 168 AND n > 168 AND close <= m7, false) AS sma_7 FROM s""",
        "oi_change": f"WITH {PANEL}, s AS (SELECT symbol, bar_idx, open_interest AS o, lag(open_interest, 24) OVER {WIN}) AS b FROM panel) SELECT symbol, bar_idx, round((o - b) / nullif(b, 0), 8) + 0.0 AS change FROM s",
        "regimes": f"""WITH {PANEL}, s AS (SELECT symbol, bar_idx, close, lag(close, 720) OVER {WIN}) AS b FROM panel)
SELECT symbol, bar_idx, CAST(CASE WHEN b IS NULL THEN 0 WHEN close > b THEN 1 ELSE -1 END AS INTEGER) AS regime FROM s""",
        "walk_blocks": f"""WITH {PANEL}, n AS (SELECT symbol, count(*) AS n FROM panel GROUP BY symbol), e AS (SELECT symbol, i, floor(i * n / 4) AS a, floor((i + 1) * n / 4) AS b FROM n, range(4) r(i))
SELECT p.symbol, p.bar_idx, e.i AS block FROM panel p JOIN e ON p.symbol = e.symbol AND p.bar_idx >= e.a AND p.bar_idx < e.b""",
        "equal_blocks": f"WITH {PANEL} SELECT symbol, bar_idx, ntile(10) OVER {WIN}) AS block FROM panel",
        "drawdowns": f"""WITH {PANEL} SELECT symbol, bar_idx, round(1 - close / greatest(max(close) OVER {WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1e-12), 9) + 0.0 AS dd,
  round(ln(greatest(close, 1e-12)) - lag(ln(greatest(close, 1e-12))) OVER {WIN}), 9) + 0.0 AS r FROM panel""",
        "invested_drawdown": f"""WITH {PANEL}, a AS (SELECT symbol, bar_idx, (bar_idx // 24 + 1) * 100.0 AS put, first(close) OVER {WIN}) AS c0, close FROM panel),
b AS (SELECT symbol, bar_idx, CAST(put AS DOUBLE) AS put, put * close / c0 - put AS pnl FROM a),
c AS (SELECT *, max(pnl) OVER {WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM b)
SELECT symbol, round(max(peak - pnl), 6) AS max_dd_abs, round(max((peak - pnl) / greatest(put, 1.0)), 6) AS max_dd_running, round(max(peak - pnl) / max(put), 6) AS max_dd_total,
       round(avg((pnl < 0)::INT), 6) AS frac_time_in_loss, round(avg((pnl < peak - 1e-12)::INT), 6) AS frac_time_below_peak FROM c GROUP BY symbol""",
    }
