"""Queries over evaluators: accumulation plans, liquidation levels, signal rules, metrics, the funding-drag report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom import constants as K
from barloom.operators import analytic, metrics, rules, signal, tiers
from barloom.operators.analytic import Plan
from barloom.operators.ops import funding_stats
from barloom.operators.rules import Rule
from barloom.operators.signal import Account
from barloom.operators.simulate import PathPlan, simulate_panel
from barloom.operators.timeseries import gate_dip
from barloom.plans.paths_sql import PATH_COLUMNS, TIER_OF, deals, paths, rates, tier_case
from barloom.plans.shared import PANEL, TS, WIN, panel, rnd, stamp

PLAN = Plan(amount=100.0, stride=24, n=5, hold=48)
H, C_IN, C_OUT, PAID, PUT = PLAN.horizon, PLAN.c_in, PLAN.c_out, PLAN.amount / (1 + PLAN.c_in), PLAN.amount * PLAN.n


def _outcome(d: DataFrame) -> DataFrame:
    return d.select("symbol", "start_idx", rnd("terminal_value", 6), rnd("terminal_multiple", 8), rnd("funding_paid", 6))


def dca_free(spark: SparkSession, sf: str) -> DataFrame:
    d = analytic.evaluate(panel(spark, sf), PLAN)
    return d.select("symbol", "start_idx", rnd("terminal_value", 6), rnd("terminal_multiple", 8), rnd("funding_paid", 6), F.round(F.col("avg_fill") / F.col("final_price"), 8).alias("fill_to_final"), "ruined")


def dca_funded(spark: SparkSession, sf: str) -> DataFrame:
    return _outcome(analytic.evaluate(panel(spark, sf), PLAN, funding=True))


def dca_lump_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _outcome(analytic.lump_sum(panel(spark, sf), PLAN, funding=True))


def vs_lump_sum(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    med = lambda d, n: d.groupBy("symbol").agg(F.percentile("terminal_multiple", 0.5).alias(n))
    j = med(analytic.evaluate(p, PLAN), "plan").join(med(analytic.lump_sum(p, PLAN), "lump"), "symbol")
    return j.select("symbol", rnd("plan", 8), rnd("lump", 8), rnd(F.col("plan") - F.col("lump"), 8, "difference"))


def start_profile(spark: SparkSession, sf: str) -> DataFrame:
    d = analytic.start_profile(analytic.evaluate(panel(spark, sf), PLAN), "terminal_multiple", "tm")
    return d.select("symbol", *[rnd(c, 7) if t == "double" else F.col(c) for c, t in d.dtypes[1:]])


def dca_spans(spark: SparkSession, sf: str) -> DataFrame:
    d = analytic.spans(analytic.evaluate(panel(spark, sf), PLAN), H, 24)
    return d.select("symbol", stamp("start_first", "start_first"), stamp("start_last", "start_last"), rnd("span_days", 6), "horizon_days", "effective_independent_paths")


def simulate_plain(spark: SparkSession, sf: str) -> DataFrame:
    """The path simulator where the closed form is exact: compared with the closed form's SQL."""
    d = simulate_panel(panel(spark, sf), PathPlan(PLAN, funding=False), drop_last=False)
    return d.select("symbol", "start_idx", rnd("terminal_equity", 6, "terminal_value"), rnd("terminal_multiple", 7), F.lit(0.0).alias("funding_paid"))


def _sim(d: DataFrame) -> DataFrame:
    return d.select("symbol", "start_idx", "exit_reason", "exit_bar", "liquidated", rnd("terminal_multiple", 6), rnd("max_dd_total", 6), rnd("frac_time_in_loss", 6), rnd("funding_paid", 6))


def simulate_levered(spark: SparkSession, sf: str) -> DataFrame:
    return _sim(simulate_panel(panel(spark, sf), PathPlan(PLAN, leverage=5.0, take_profit=0.5, stop_loss=0.5), step=24))


def simulate_gated(spark: SparkSession, sf: str) -> DataFrame:
    p = gate_dip(panel(spark, sf), 0.05, 168, "gate")
    return _sim(simulate_panel(p, PathPlan(PLAN), gate="gate", step=24))


LEVERAGES = (1.0, 2.0, 3.0, 5.0, 10.0)


def liquidation_map(spark: SparkSession, sf: str) -> DataFrame:
    """Share of starts that are liquidated, by leverage."""
    p, out = panel(spark, sf), None
    for lev in LEVERAGES:
        d = simulate_panel(p, PathPlan(PLAN, leverage=lev), step=24).groupBy("symbol").agg(
            F.lit(lev).alias("leverage"), F.count(F.lit(1)).alias("starts"), rnd(F.avg(F.col("liquidated").cast("double")), 6, "liquidation_rate"), rnd(F.percentile("terminal_multiple", 0.5), 6, "tm_q50")
        )
        out = d if out is None else out.unionByName(d)
    return out


GAP_YEARS, YEARS = PLAN.stride / (24 * 365.0), H / (24 * 365.0)


def money_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Annual money-weighted rate of every start."""
    d = analytic.evaluate(panel(spark, sf), PLAN)
    rate = analytic.mwrr_column(F.col("terminal_value"), F.lit(PLAN.amount), F.lit(PLAN.n), F.lit(GAP_YEARS), F.lit(YEARS))
    return d.withColumn("rate", rate).select("symbol", "start_idx", rnd("rate", 5))


def money_weighted_irregular(spark: SparkSession, sf: str) -> DataFrame:
    """Rate of each symbol's first start as a series of dated flows, deposits out and the value in."""
    first = analytic.evaluate(panel(spark, sf), PLAN).where(F.col("start_idx") == 0)
    put = [F.struct(F.lit(-PLAN.amount).alias("flow"), F.lit(GAP_YEARS * j).alias("years")) for j in range(PLAN.n)]
    flows = first.select("symbol", F.explode(F.array(*put, F.struct(F.col("terminal_value").alias("flow"), F.lit(YEARS).alias("years")))).alias("f")).select("symbol", "f.*")
    return analytic.mwrr_by_group(flows, ["symbol"], "flow", "years").select("symbol", rnd("mwrr", 5))


def _notionals(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    return p.select("symbol", "bar_idx", (F.col("volume") * 7.0).alias("notional"), "close").withColumn("tier", tiers.tier_name(F.col("symbol")))


def tier_lookup(spark: SparkSession, sf: str) -> DataFrame:
    d, n, t = _notionals(spark, sf), F.col("notional"), F.col("tier")
    return d.select("symbol", "bar_idx", "tier", rnd(tiers.mmr(n, t), 6, "mmr"), rnd(tiers.cum(n, t), 2, "cum"), tiers.max_leverage(n, t).alias("max_leverage"), rnd(tiers.margin(n, t) + 1.37e-7, 4, "margin"))


def liquidation_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Price levels, as a share of the entry, at which 10x positions of 5,000 are liquidated."""
    d = panel(spark, sf).select("symbol", "bar_idx", "close").withColumn("tier", tiers.tier_name(F.col("symbol")))
    w, q = F.lit(500.0), F.lit(5000.0) / F.col("close")
    lvl = lambda side, n: F.round(tiers.liquidation_level(side, w, q, F.col("close"), F.col("tier"), n) / F.col("close"), 8)
    hit = tiers.is_liquidated_long(w, q, F.col("close"), F.col("close") * 0.905, F.col("tier"))
    return d.select("symbol", "bar_idx", lvl(1, 3).alias("long_3"), lvl(-1, 3).alias("short_3"), lvl(1, 8).alias("long_8"), hit.alias("gone_at_905"))


def _rule(r: Rule, reading: str | None = "reading", digits: int = 5):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        d = rules.signals(panel(spark, sf), r)
        return d.select("symbol", "bar_idx", *([rnd(reading, digits)] if reading else []), "entry", "exit")

    return query


# Levels that no mean of recorded rates meets exactly, so that the order of summation cannot decide.
CARRY_SHORT = Rule("carry_funding", lookback_days=3, enter=1.00137e-4, exit=5.00137e-5)
CARRY_LONG = Rule("carry_funding_long", lookback_days=3, enter=-2.00137e-5, exit=2.00137e-5)
REVERSION = Rule("cci_reversion", lookback_days=1, timeframe_hours=1)
BREAKOUT = Rule("cci_breakout", lookback_days=3, timeframe_hours=4, exit_level=20.0)
CONFIRMED = Rule("oi_confirmed_reversion", lookback_days=1, timeframe_hours=1, oi_drop=0.02)
MTF = Rule("cci_mtf", lookback_days=1, timeframe_hours=1, filter_hours=4, filter_lookback_days=3, filter_level=50.0, exit_level=100.0)
ACCOUNT = Account(leverage=2.0, stop_loss=0.2, take_profit=0.5, max_hold=240)


def _deals(spark: SparkSession, sf: str) -> DataFrame:
    return signal.trades(rules.signals(panel(spark, sf), REVERSION), ACCOUNT)


def signal_trades(spark: SparkSession, sf: str) -> DataFrame:
    over = F.round(F.col("exit_price") / F.col("entry_price"), 8).alias("exit_over_entry")
    return _deals(spark, sf).select("symbol", "trade", "side", "entry_bar", "exit_bar", "bars_held", "reason", over, *[rnd(c, 4) for c in ("funding", "gross", "pnl", "equity_after")])


def signal_equity(spark: SparkSession, sf: str) -> DataFrame:
    return signal.equity(rules.signals(panel(spark, sf), BREAKOUT), ACCOUNT).select("symbol", "bar_idx", rnd("equity", 4))


def exit_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return signal.exit_histogram(_deals(spark, sf))


def trade_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = signal.trade_summary(_deals(spark, sf))
    return d.select("symbol", "n_trades", rnd("win_rate", 8), *[rnd(c, 4) for c in ("funding_total", "gross_total", "pnl_total")], "n_liquidations")


def curve_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-capital metrics of holding each symbol, with a year of 2,000 bars so that short histories have one."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    d = panel(spark, sf).select("symbol", "bar_idx", (10_000.0 * F.col("close") / F.first("close").over(w)).alias("equity"))
    m = metrics.summary(d, bars_per_year=2000.0)
    return m.select("symbol", *[rnd(c, 6) if t == "double" else F.col(c) for c, t in m.dtypes[1:]])


def funding_statistics(spark: SparkSession, sf: str) -> DataFrame:
    d = funding_stats(panel(spark, sf))
    return d.select("symbol", "settlements", *[rnd(c, 9) for c in d.columns[2:]])


def funding_drag(spark: SparkSession, sf: str) -> DataFrame:
    """What funding takes from scheduled long accumulation: per symbol the median and tail bill of all starts, and the multiples with and without it."""
    p = panel(spark, sf)
    has = p.groupBy("symbol").agg(F.bool_or("funding_settled").alias("has")).where("has").select("symbol")
    p = p.join(has, "symbol", "left_semi")
    # One evaluation has both: what is left after the bill, and what would have been left without it.
    free = F.col("units") * F.col("final_price") * (1.0 - C_OUT) / F.col("invested")
    f = analytic.evaluate(p, PLAN, funding=True).withColumns({"bill": F.col("funding_paid") / F.col("invested"), "free": F.when(free > 0, free)})
    q = lambda c, x, n: rnd(F.percentile(c, x), 8, n)
    return f.groupBy("symbol").agg(F.count(F.lit(1)).alias("starts"), q("bill", 0.5, "bill_q50"), q("bill", 0.95, "bill_q95"), q("terminal_multiple", 0.5, "funded_q50"), q("free", 0.5, "free_q50"))


def universe_drag(spark: SparkSession, sf: str) -> DataFrame:
    """Medians over symbols of the per-symbol bills."""
    return funding_drag(spark, sf).agg(F.count(F.lit(1)).alias("symbols"), rnd(F.percentile("bill_q50", 0.5), 8, "median_bill"), rnd(F.percentile("bill_q95", 0.5), 8, "median_q95"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "dca_free": dca_free, "dca_funded": dca_funded, "dca_lump_sum": dca_lump_sum, "vs_lump_sum": vs_lump_sum, "start_profile": start_profile, "dca_spans": dca_spans,
        "simulate_plain": simulate_plain, "simulate_levered": simulate_levered, "simulate_gated": simulate_gated, "liquidation_map": liquidation_map, "money_weighted": money_weighted, "money_weighted_irregular": money_weighted_irregular,
        "tier_lookup": tier_lookup, "liquidation_levels": liquidation_levels, "carry_short": _rule(CARRY_SHORT, digits=10), "carry_long": _rule(CARRY_LONG, digits=10),
        "cci_reversion": _rule(REVERSION), "cci_breakout": _rule(BREAKOUT), "oi_confirmed": _rule(CONFIRMED), "cci_mtf": _rule(MTF), "signal_trades": signal_trades,
        "signal_equity": signal_equity, "exit_histogram": exit_histogram, "trade_summary": trade_summary, "curve_metrics": curve_metrics,
        "funding_statistics": funding_statistics, "funding_drag": funding_drag, "universe_drag": universe_drag,
    }


def _dca(funding: bool) -> str:
    w = f"PARTITION BY symbol, bar_idx % {PLAN.stride} ORDER BY bar_idx ROWS BETWEEN CURRENT ROW AND {PLAN.n - 1} FOLLOWING"
    suffix = f"sum(close * funding_rate) OVER {WIN} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)" if funding else "0.0"
    return f"""a AS (SELECT *, {suffix} AS w FROM panel),
b AS (SELECT symbol, ts, bar_idx, close, w, sum(1.0 / close) OVER (W1) AS u, sum(w / close) OVER (W1) AS uw, count(*) OVER (W1) AS n,
             lead(close, {H}) OVER {WIN}) AS fin, coalesce(lead(w, {H + 1}) OVER {WIN}), 0.0) AS w2 FROM a),
c AS (SELECT symbol, ts, bar_idx AS start_idx, close, w, w2, u, fin, {PAID!r} * (uw - w2 * u) AS paid, {PAID!r} * u * fin * {1 - C_OUT!r} - {PAID!r} * (uw - w2 * u) AS term
      FROM b WHERE n = {PLAN.n} AND fin IS NOT NULL)""".replace("(W1)", f"({w})")


def _cci(hours: int, width: int, src: str, name: str) -> str:
    return f"""{name}b AS (SELECT symbol, time_bucket(INTERVAL {hours} HOUR, ts, TIMESTAMP '1970-01-01') AS b, (max(high) + min(low) + arg_max(close, ts)) / 3.0 AS tp FROM {src} GROUP BY 1, 2),
{name}w AS (SELECT symbol, b, tp, avg(tp) OVER w AS mu, list(tp) OVER w AS l FROM {name}b WINDOW w AS (PARTITION BY symbol ORDER BY b ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)),
{name}m AS (SELECT symbol, b + INTERVAL {hours} HOUR AS e, tp, mu, CASE WHEN len(l) = {width} THEN list_sum(list_transform(l, lambda x: abs(x - mu))) / {width} END AS mad FROM {name}w),
{name}v AS (SELECT symbol, e, CASE WHEN mad > 0 THEN (tp - mu) / (0.015 * mad) END AS v FROM {name}m),
{name} AS (SELECT p.*, {name}v.v AS {name}_v FROM panel p ASOF LEFT JOIN {name}v ON p.symbol = {name}v.symbol AND p.ts + INTERVAL 1 HOUR >= {name}v.e)"""


def _two_sided(table: str, col: str, side: int, exit_level: float, extra: str = "true", level: float = 100.0) -> str:
    hot, cold = (1, -1) if side > 0 else (-1, 1)
    return f"""SELECT symbol, bar_idx, round({col}, 5) + 0.0 AS reading,
  CAST(CASE WHEN {col} >= {level} AND {extra} THEN {hot} WHEN {col} <= -{level} AND {extra} THEN {cold} ELSE 0 END AS INTEGER) AS entry, {col} IS NULL OR abs({col}) <= {exit_level} AS exit FROM {table}"""


def _carry(enter: str, exit_: str, side: int) -> str:
    return f"""WITH {PANEL}, s AS (SELECT symbol, bar_idx, sum(funding_rate) OVER w AS r, sum(funding_settled::INT) OVER w AS n FROM panel WINDOW w AS {WIN} ROWS BETWEEN 71 PRECEDING AND CURRENT ROW)),
v AS (SELECT symbol, bar_idx, CASE WHEN bar_idx >= 71 THEN r / nullif(n, 0) END AS v FROM s)
SELECT symbol, bar_idx, round(v, 10) + 0.0 AS reading, CAST(CASE WHEN v {enter} THEN {side} ELSE 0 END AS INTEGER) AS entry, coalesce(v {exit_}, false) AS exit FROM v"""


def _level_sql() -> str:
    ctes, cols = [f"x0 AS (SELECT symbol, bar_idx, close, 5000.0 / close AS q, {TIER_OF}, CAST(close AS DOUBLE) AS l0, CAST(close AS DOUBLE) AS s0 FROM panel)"], []
    for i in range(8):
        r, c = tier_case(1, f"q * l{i}"), tier_case(2, f"q * l{i}")
        r2, c2 = tier_case(1, f"q * s{i}"), tier_case(2, f"q * s{i}")
        ctes.append(
            f"x{i + 1} AS (SELECT *, greatest((q * close - 500.0 - ({c})) / (q * (1.0 - ({r}))), 0.0) AS l{i + 1}, greatest((q * close + 500.0 + ({c2})) / (q * (1.0 + ({r2}))), 0.0) AS s{i + 1} FROM x{i})"
        )
    m = f"abs(q * close * 0.905) * ({tier_case(1, 'q * close * 0.905')}) - ({tier_case(2, 'q * close * 0.905')})"
    return f"WITH {PANEL}, " + ", ".join(ctes) + f"""
SELECT symbol, bar_idx, round(l3 / close, 8) AS long_3, round(s3 / close, 8) AS short_3, round(l8 / close, 8) AS long_8, 500.0 + q * (close * 0.905 - close) <= {m} AS gone_at_905 FROM x8"""


CURVE = """d AS (SELECT *, 1 - equity / max(equity) OVER w AS dd, ln(greatest(equity, 1e-12)) - lag(ln(greatest(equity, 1e-12))) OVER (PARTITION BY symbol ORDER BY bar_idx) AS r FROM line
      WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT symbol, count(*) AS bars, (count(*) - 1) / 8760.0 AS years, arg_max(equity, bar_idx) / arg_min(equity, bar_idx) AS ratio, max(dd) AS mdd, avg(r) AS mu, stddev_samp(r) AS sd, min(equity) AS least FROM d GROUP BY symbol),
c AS (SELECT *, CASE WHEN years >= 1.0 THEN CASE WHEN ratio <= 0 THEN -1.0 ELSE ratio ** (1.0 / years) - 1.0 END END AS cagr FROM k),
t AS (SELECT symbol, count(*) AS n_trades, round(avg((pnl > 0)::INT), 8) AS win_rate, sum(funding) AS funding_total, sum(gross) AS gross_total, sum(pnl) AS pnl_total, count_if(reason = 'liquidation') AS n_liquidations FROM deal GROUP BY symbol)
"""


def account_row(cell: int, signals: str, a: Account) -> str:
    """SQL of the fixed-capital metrics and trade totals of one signal cell."""
    return f"""SELECT * FROM ({deals(signals, a)}, {CURVE} SELECT symbol, {cell} AS cell, round(cagr, 6) AS cagr, round(mdd, 6) AS max_drawdown, round(CASE WHEN mdd >= 1e-9 THEN cagr / mdd END, 6) AS calmar,
  round(CASE WHEN bars >= 3 AND least > 0 AND sd > 0 THEN mu / sd * sqrt(8760.0) END, 6) AS sharpe, round(ratio - 1.0, 6) AS total_return, bars, coalesce(n_trades, 0) AS n_trades, win_rate,
  round(coalesce(funding_total, 0.0), 4) + 0.0 AS funding_total, round(coalesce(gross_total, 0.0), 4) + 0.0 AS gross_total, round(coalesce(pnl_total, 0.0), 4) + 0.0 AS pnl_total, CAST(coalesce(n_liquidations, 0) AS BIGINT) AS n_liquidations
  FROM c LEFT JOIN t USING (symbol))"""


def mtf_signals(filter_level: float, exit_level: float) -> str:
    return f"""WITH RECURSIVE {PANEL}, {_cci(4, 18, 'panel', 's')}, {_cci(1, 24, 'panel', 'f')},
j AS (SELECT f.symbol, f.bar_idx, f.f_v AS b, s.s_v AS f, lag(s.s_v) OVER (PARTITION BY f.symbol ORDER BY f.bar_idx) AS p FROM f JOIN s ON f.symbol = s.symbol AND f.bar_idx = s.bar_idx),
sig AS (SELECT symbol, bar_idx, CASE WHEN f >= {filter_level} AND b <= -100.0 THEN 1 WHEN f <= -{filter_level} AND b >= 100.0 THEN -1 ELSE 0 END AS entry,
  f IS NULL OR b IS NULL OR abs(f) < {filter_level} OR coalesce(f <> 0 AND ((p IS NULL AND bar_idx > 0) OR (sign(p) <> sign(f) AND p <> 0)), false) OR sign(f) * b >= {exit_level} AS exit FROM j)"""


def carry_signals(enter: str, exit_: str) -> str:
    return f"WITH RECURSIVE {_carry(enter, exit_, -1).removeprefix('WITH ').replace('SELECT symbol, bar_idx, round(v, 10)', 'sig AS (SELECT symbol, bar_idx, round(v, 10)').replace('FROM s)' + chr(10) + 'sig', 'FROM s),' + chr(10) + 'sig')})"


def reversion_signals(level: float = 100.0) -> str:
    return f"WITH RECURSIVE {PANEL}, {_cci(1, 24, 'panel', 'f')}, sig AS ({_two_sided('f', 'f_v', -1, 0.0, level=level)})"


def plan_row(cell: int, p: PathPlan, evaluator: str, gate: str = "true", gate_ctes: str = "") -> str:
    """SQL of the metrics of one accumulation cell."""
    plan, years = p.plan, p.plan.horizon / 8760.0
    gap = plan.stride / 8760.0
    if evaluator == "analytic":
        w = f"PARTITION BY symbol, bar_idx % {plan.stride} ORDER BY bar_idx ROWS BETWEEN CURRENT ROW AND {plan.n - 1} FOLLOWING"
        paid = plan.amount / (1 + plan.c_in)
        base = f"""WITH RECURSIVE {PANEL},
b AS (SELECT symbol, ts, bar_idx, close, sum(1.0 / close) OVER ({w}) AS u, count(*) OVER ({w}) AS n, lead(close, {plan.horizon}) OVER {WIN}) AS fin FROM panel),
o AS (SELECT symbol, ts, bar_idx AS s, {paid!r} * u * fin * {1 - plan.c_out!r} AS term, {plan.n} AS made, {years!r} AS held, CAST(NULL AS DOUBLE) AS dd, 0.0 AS frac, false AS gone,
             fin * {1 - plan.c_out!r} / (close * {1 + plan.c_in!r}) AS lump FROM b WHERE n = {plan.n} AND fin IS NOT NULL),"""
        tm = f"CASE WHEN term > 0 THEN term / {plan.amount * plan.n!r} END"
    else:
        base = paths(plan, (p.leverage,), p.take_profit, p.stop_loss, gate=gate, gate_ctes=gate_ctes) + f""",
o AS (SELECT x.symbol, a.ts, x.s, x.value AS term, CAST(greatest(round(x.put / {plan.amount!r}), 1) AS INTEGER) AS made, greatest(x.e / 8760.0, {gap!r} * (greatest(round(x.put / {plan.amount!r}), 1) - 1)) AS held,
             x.dd / x.put AS dd, x.paid / x.put AS frac, x.reason = 1 AS gone, x.value / x.put AS tm,
             (z.close * {1 - plan.c_out!r} - (SELECT sum(q.close * q.funding_rate) FROM panel q WHERE q.symbol = x.symbol AND q.bar_idx BETWEEN x.s AND x.s + {plan.horizon})) / (a.close * {1 + plan.c_in!r}) AS lump
      FROM ended x JOIN panel a ON a.symbol = x.symbol AND a.bar_idx = x.s JOIN panel z ON z.symbol = x.symbol AND z.bar_idx = x.s + {plan.horizon}),"""
        tm = "tm"
    q = lambda c, x, name: f"round(quantile_cont({c}, {x}), 6) + 0.0 AS {name}"
    return f"""SELECT * FROM ({base} {rates('term', plan.amount, plan.n, gap, 'held', 'o', 'symbol, s', 'made')}
SELECT o.symbol, {cell} AS cell, '{evaluator}' AS evaluator, count(*) AS n_starts, {q(tm, 0.05, 'tm_q05')}, {q(tm, 0.5, 'tm_q50')}, {q('rate', 0.05, 'mwrr_q05')}, {q('rate', 0.5, 'mwrr_q50')}, {q('dd', 0.5, 'dd_q50')}, {q('frac', 0.5, 'funding_frac_q50')},
  round(avg(gone::INT), 6) AS liquidation_rate, round(quantile_cont({tm}, 0.5) - quantile_cont(lump, 0.5), 6) + 0.0 AS vs_lump_sum, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0, 6) AS span_days,
  CAST({plan.horizon / 24.0!r} AS DOUBLE) AS horizon_days FROM o JOIN solved USING (symbol, s) GROUP BY o.symbol)"""


def oracle_sql() -> dict[str, str]:
    free, paid = f"WITH {PANEL}, {_dca(False)}", f"WITH {PANEL}, {_dca(True)}"
    lump = f"{PUT!r} / (close * {1 + C_IN!r})"
    drag = f"""{paid}, z AS (SELECT symbol, bool_or(funding_settled) AS has FROM panel GROUP BY symbol),
f AS (SELECT c.symbol, paid / {PUT!r} AS bill, CASE WHEN term > 0 THEN term / {PUT!r} END AS tm, {PAID!r} * u * fin * {1 - C_OUT!r} / {PUT!r} AS free FROM c JOIN z ON z.symbol = c.symbol AND z.has),
k AS (SELECT symbol, count(*) AS starts, round(quantile_cont(bill, 0.5), 8) + 0.0 AS bill_q50, round(quantile_cont(bill, 0.95), 8) + 0.0 AS bill_q95, round(quantile_cont(tm, 0.5), 8) AS funded_q50,
             round(quantile_cont(free, 0.5), 8) AS free_q50 FROM f GROUP BY symbol)"""
    trades = deals(f"WITH RECURSIVE {PANEL}, {_cci(1, 24, 'panel', 'f')}, sig AS ({_two_sided('f', 'f_v', -1, 0.0)})", ACCOUNT)
    tm = f"CASE WHEN term > 0 THEN term / {PUT!r} END"
    qs = ", ".join(f"round(quantile_cont(tm, {x}), 7) AS tm_q{round(x * 100):02d}" for x in K.QUANTILES)
    return {
        "dca_free": f"""{free} SELECT symbol, start_idx, round(term, 6) AS terminal_value, round({tm}, 8) AS terminal_multiple, 0.0 AS funding_paid,
  round({PLAN.n * PAID!r} / ({PAID!r} * u) / fin, 8) AS fill_to_final, term <= 0 AS ruined FROM c""",
        "dca_funded": f"{paid} SELECT symbol, start_idx, round(term, 6) AS terminal_value, round({tm}, 8) AS terminal_multiple, round(paid, 6) + 0.0 AS funding_paid FROM c",
        "simulate_plain": f"{free} SELECT symbol, start_idx, round(term, 6) AS terminal_value, round({tm}, 7) AS terminal_multiple, 0.0 AS funding_paid FROM c",
        "dca_lump_sum": f"""{paid}, e AS (SELECT symbol, bar_idx AS start_idx, {lump} AS units, {lump} * (w - w2) AS paid, fin FROM b WHERE fin IS NOT NULL)
SELECT symbol, start_idx, round(units * fin * {1 - C_OUT!r} - paid, 6) AS terminal_value, round((units * fin * {1 - C_OUT!r} - paid) / {PUT!r}, 8) AS terminal_multiple, round(paid, 6) + 0.0 AS funding_paid FROM e""",
        "vs_lump_sum": f"""{free}, e AS (SELECT symbol, quantile_cont({lump} * fin * {1 - C_OUT!r} / {PUT!r}, 0.5) AS lump FROM b WHERE fin IS NOT NULL GROUP BY symbol),
g AS (SELECT symbol, quantile_cont({tm}, 0.5) AS plan FROM c GROUP BY symbol)
SELECT symbol, round(plan, 8) AS plan, round(lump, 8) AS lump, round(plan - lump, 8) + 0.0 AS difference FROM e JOIN g USING (symbol)""",
        "start_profile": f"""{free}, t AS (SELECT symbol, {tm} AS tm FROM c)
SELECT symbol, {qs}, count(tm) AS tm_n, round(avg(tm), 7) AS tm_mean, round(CASE WHEN count(tm) = 1 THEN 0.0 ELSE stddev_samp(tm) END, 7) AS tm_std, round(min(tm), 7) AS tm_worst, round(max(tm), 7) AS tm_best,
  CAST(count_if(tm IS NULL) AS BIGINT) AS tm_n_non_finite, round(count_if(tm IS NULL) / count(*), 7) AS tm_frac_non_finite FROM t GROUP BY symbol""",
        "dca_spans": f"""{free}, t AS (SELECT symbol, min(ts) AS a, max(ts) AS b, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 AS d FROM c GROUP BY symbol)
SELECT symbol, strftime(a, '%Y-%m-%d %H:%M:%S') AS start_first, strftime(b, '%Y-%m-%d %H:%M:%S') AS start_last, round(d, 6) AS span_days, CAST({H / 24!r} AS DOUBLE) AS horizon_days,
  round_even(d / {max(H / 24, 1.0)!r} + 1.0, 2) AS effective_independent_paths FROM t""",
        "money_weighted": f"{free.replace('WITH', 'WITH RECURSIVE', 1)}, {rates('term', PLAN.amount, PLAN.n, GAP_YEARS, repr(YEARS), 'c')} SELECT symbol, start_idx, round(rate, 5) + 0.0 AS rate FROM solved",
        "money_weighted_irregular": f"""{free.replace('WITH', 'WITH RECURSIVE', 1)}, c0 AS (SELECT * FROM c WHERE start_idx = 0), {rates('term', PLAN.amount, PLAN.n, GAP_YEARS, repr(YEARS), 'c0')}
SELECT symbol, CASE WHEN rate > {analytic.LOW!r} AND rate < {analytic.HIGH!r} THEN round(rate, 5) + 0.0 END AS mwrr FROM solved""",
        "simulate_levered": paths(PLAN, (5.0,), 0.5, 0.5) + PATH_COLUMNS,
        "simulate_gated": paths(PLAN, (1.0,), gate="coalesce(bar_idx >= 167 AND close <= top * 0.95, false)", gate_ctes=f", g AS (SELECT *, max(close) OVER {WIN} ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS top FROM panel)") + PATH_COLUMNS,
        "liquidation_map": paths(PLAN, LEVERAGES) + """SELECT symbol, lev AS leverage, count(*) AS starts, round(avg((reason = 1)::INT), 6) AS liquidation_rate, round(quantile_cont(value / put, 0.5), 6) AS tm_q50 FROM ended GROUP BY symbol, lev""",
        "signal_trades": trades + """SELECT symbol, trade, side, entry_bar, exit_bar, bars_held, reason, round(exit_price / entry_price, 8) AS exit_over_entry, round(funding, 4) + 0.0 AS funding, round(gross, 4) + 0.0 AS gross,
  round(pnl, 4) + 0.0 AS pnl, round(equity_after, 4) + 0.0 AS equity_after FROM deal""",
        "exit_histogram": trades + "SELECT symbol, reason, count(*) AS n FROM deal GROUP BY symbol, reason",
        "trade_summary": trades + """SELECT symbol, count(*) AS n_trades, round(avg((pnl > 0)::INT), 8) AS win_rate, round(sum(funding), 4) + 0.0 AS funding_total, round(sum(gross), 4) + 0.0 AS gross_total,
  round(sum(pnl), 4) + 0.0 AS pnl_total, count_if(reason = 'liquidation') AS n_liquidations FROM deal GROUP BY symbol""",
        "signal_equity": deals(f"WITH RECURSIVE {PANEL}, {_cci(4, 18, 'panel', 'f')}, sig AS ({_two_sided('f', 'f_v', 1, 20.0)})", ACCOUNT) + "SELECT symbol, bar_idx, round(equity, 4) + 0.0 AS equity FROM line",
        "tier_lookup": f"""WITH {PANEL}, x AS (SELECT symbol, bar_idx, volume * 7.0 AS n, {TIER_OF} FROM panel), y AS (SELECT *, {tier_case(1, 'n')} AS m, {tier_case(2, 'n')} AS c, {tier_case(3, 'n')} AS lev FROM x)
SELECT symbol, bar_idx, tier, CAST(round(m, 6) AS DOUBLE) AS mmr, CAST(round(c, 2) AS DOUBLE) AS cum, CAST(lev AS DOUBLE) AS max_leverage, round(abs(n) * CAST(m AS DOUBLE) - CAST(c AS DOUBLE) + 1.37e-7, 4) AS margin FROM y""",
        "liquidation_levels": _level_sql(),
        "carry_short": _carry(">= 1.00137e-4", "< 5.00137e-5", -1),
        "carry_long": _carry("<= -2.00137e-5", "> 2.00137e-5", 1),
        "cci_reversion": f"WITH {PANEL}, {_cci(1, 24, 'panel', 'f')} " + _two_sided("f", "f_v", -1, 0.0),
        "cci_breakout": f"WITH {PANEL}, {_cci(4, 18, 'panel', 'f')} " + _two_sided("f", "f_v", 1, 20.0),
        "oi_confirmed": f"WITH {PANEL}, {_cci(1, 24, 'panel', 'f')}, g AS (SELECT *, lag(open_interest, 24) OVER {WIN}) AS ob FROM f) " + _two_sided("g", "f_v", -1, 0.0, "(open_interest - ob) / nullif(ob, 0) <= -0.02"),
        "cci_mtf": f"""WITH {PANEL}, {_cci(4, 18, 'panel', 's')}, {_cci(1, 24, 'panel', 'f')},
j AS (SELECT f.symbol, f.bar_idx, f.f_v AS b, s.s_v AS f, lag(s.s_v) OVER (PARTITION BY f.symbol ORDER BY f.bar_idx) AS p FROM f JOIN s ON f.symbol = s.symbol AND f.bar_idx = s.bar_idx)
SELECT symbol, bar_idx, round(b, 5) + 0.0 AS reading,
  CAST(CASE WHEN f >= 50.0 AND b <= -100.0 THEN 1 WHEN f <= -50.0 AND b >= 100.0 THEN -1 ELSE 0 END AS INTEGER) AS entry,
  f IS NULL OR b IS NULL OR abs(f) < 50.0 OR coalesce(f <> 0 AND ((p IS NULL AND bar_idx > 0) OR (sign(p) <> sign(f) AND p <> 0)), false) OR sign(f) * b >= 100.0 AS exit FROM j""",
        "curve_metrics": f"""WITH {PANEL}, e AS (SELECT symbol, bar_idx, 10000.0 * close / first(close) OVER {WIN}) AS v FROM panel),
d AS (SELECT *, 1 - v / max(v) OVER {WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dd, ln(v) - lag(ln(v)) OVER {WIN}) AS r FROM e),
g AS (SELECT symbol, count(*) AS bars, (count(*) - 1) / 2000.0 AS years, arg_max(v, bar_idx) / arg_min(v, bar_idx) AS ratio, max(dd) AS mdd, avg(r) AS mu, stddev_samp(r) AS sd FROM d GROUP BY symbol),
k AS (SELECT *, CASE WHEN years >= 1.0 THEN ratio ** (1.0 / years) - 1.0 END AS cagr FROM g)
SELECT symbol, round(cagr, 6) AS cagr, round(mdd, 6) AS max_drawdown, round(CASE WHEN mdd >= 1e-9 THEN cagr / mdd END, 6) AS calmar, round(CASE WHEN bars >= 3 AND sd > 0 THEN mu / sd * sqrt(2000.0) END, 6) AS sharpe,
  round(ratio - 1.0, 6) AS total_return, bars, round(years, 6) AS years FROM k""",
        "funding_statistics": f"""WITH {PANEL} SELECT symbol, count(*) AS settlements, round(avg(funding_rate), 9) + 0.0 AS mean_rate, round(quantile_cont(funding_rate, 0.5), 9) + 0.0 AS median_rate,
  round(avg((funding_rate > 0)::INT), 9) AS pct_positive, round(avg(funding_rate) * 365.0 * 3.0 * 100.0, 9) + 0.0 AS naive_annualised_pct, round(max(funding_rate) * 100.0, 9) + 0.0 AS worst_pct
FROM panel WHERE funding_rate <> 0.0 GROUP BY symbol""",
        "funding_drag": f"{drag} SELECT * FROM k",
        "universe_drag": f"{drag} SELECT count(*) AS symbols, round(quantile_cont(bill_q50, 0.5), 8) + 0.0 AS median_bill, round(quantile_cont(bill_q95, 0.5), 8) + 0.0 AS median_q95 FROM k",
    }
