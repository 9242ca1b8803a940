"""From configurations to recorded metrics: every cell of a grid is routed to the cheapest evaluator that is exact for it.

All cells of the closed form run as one plan over the panel, all simulated cells as another in which they are data; one
solver finds the rates of all. Signal cells are a branch each, whose one scan gives trades and equity. Cells that
cannot be evaluated are named with their reason, and so are symbols that a cell cannot be measured on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import constants as K
from barloom.functions.columns import days_to_bars, epoch_us
from barloom.operators import analytic, metrics, rules, signal
from barloom.operators.analytic import Plan
from barloom.operators.grid import canonical, canonical_hash
from barloom.operators.rules import Rule
from barloom.operators.signal import Account
from barloom.operators.simulate import PathPlan, simulate_many
from barloom.operators.tiers import max_leverage, tier_name
from barloom.operators.timeseries import gate_dip, gate_sma
from barloom.session import cut

#: Settings of an accumulation trial that are not given.
DCA_DEFAULTS = {
    "contribution": 100.0, "stride_days": 7.0, "n_contributions": 156, "hold_days": 0.0, "leverage": 1.0, "gate": "none", "include_funding": True, "take_profit": None,
    "stop_loss": None, "clock": "1h", "fee_bps": K.TAKER_BPS, "slippage_bps": K.SLIPPAGE_BPS, "cost_multiplier": 1.0,
}
SIGNAL_DEFAULTS = {
    "rule": "carry_funding", "lookback_days": 21.0, "enter_rate": 1.5e-4, "exit_rate": 5e-5, "timeframe_hours": 1, "enter_level": 100.0, "exit_level": 0.0, "filter_level": 100.0,
    "filter_hours": None, "filter_lookback_days": None, "oi_drop": None, "capital": 10_000.0, "leverage": 1.0, "stop_loss": None, "take_profit": None, "max_hold_days": None,
    "clock": "1h", "fee_bps": K.TAKER_BPS, "slippage_bps": K.SLIPPAGE_BPS, "cost_multiplier": 1.0,
}
SIM_STRIDE_DAYS = 1.0


class Unsupported(ValueError):
    """A configuration that no evaluator takes; its text is the reason."""


def parse_gate(gate: str | None) -> tuple[str, float, float]:
    """(kind, drop, days) of none, dip:<drop>:<days> or sma:<days>."""
    g = (gate or "none").strip().lower()
    if g == "none":
        return "none", 0.0, 0.0
    if m := re.fullmatch(r"dip:(\d*\.?\d+):(\d+)", g):
        return "dip", float(m[1]), float(m[2])
    if m := re.fullmatch(r"sma:(\d+)", g):
        return "sma", 0.0, float(m[1])
    raise Unsupported(f"gate_not_understood({gate})")


def dca_plan(cfg: Mapping) -> tuple[str, PathPlan, tuple[str, float, float]]:
    """(evaluator, plan, gate) of a configuration."""
    c = DCA_DEFAULTS | dict(cfg)
    per_day = K.BARS_PER_DAY[c["clock"]]
    stride = days_to_bars(c["stride_days"], per_day)
    if stride < 1:
        raise Unsupported("stride_under_one_bar")
    times = c["cost_multiplier"]
    plan = Plan(c["contribution"], stride, int(c["n_contributions"]), days_to_bars(c["hold_days"], per_day), c["fee_bps"] * times, c["slippage_bps"] * times, c["fee_bps"] * times)
    if plan.horizon == 0:
        raise Unsupported("no_horizon")
    gate = parse_gate(c["gate"])
    closed = gate[0] == "none" and c["leverage"] == 1.0 and c["take_profit"] is None and c["stop_loss"] is None and not c["include_funding"]
    return "analytic" if closed else "simulate", PathPlan(plan, c["leverage"], c["take_profit"], c["stop_loss"], bool(c["include_funding"])), gate


def _profiles(d: DataFrame, columns: Mapping[str, str], by: Sequence[str]) -> DataFrame:
    """Quantiles, mean and counts of several columns side by side, in one aggregation."""
    aggs, names = [], []
    for col, prefix in columns.items():
        v = F.when(F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(F.col(col)) != float("inf")), F.col(col))
        aggs += [F.percentile(v, F.array(*[F.lit(q) for q in K.QUANTILES])).alias(f"__{prefix}"), F.avg(v).alias(f"{prefix}_mean"), F.count(v).alias(f"{prefix}_n")]
        names += [F.col(f"__{prefix}")[i].alias(f"{prefix}_q{round(q * 100):02d}") for i, q in enumerate(K.QUANTILES)] + [F.col(f"{prefix}_mean"), F.col(f"{prefix}_n")]
    days = (F.max("start_us") - F.min("start_us")) / F.lit(86_400_000_000.0)
    g = d.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("n_starts"), F.avg(F.col("liquidated").cast("double")).alias("liquidation_rate"), days.alias("span_days"), F.max("horizon_days").alias("horizon_days"))
    paths = F.bround(F.col("span_days") / F.greatest(F.col("horizon_days"), F.lit(1.0)) + 1.0, 2)
    return g.select(*by, "n_starts", "liquidation_rate", "span_days", "horizon_days", paths.alias("effective_independent_paths"), *names).withColumn("vs_lump_sum", F.col("tm_q50") - F.col("lump_q50"))


def _routed(configs: Sequence[Mapping]) -> tuple[list[tuple[int, str, PathPlan, tuple[str, float, float], str | None]], list[tuple[int, str]]]:
    routed, skipped = [], []
    for i, cfg in enumerate(configs):
        try:
            routed.append((i, *dca_plan(cfg), cfg.get("symbol")))
        except Unsupported as e:
            skipped.append((i, str(e)))
    return routed, skipped


def run_dca(panel: DataFrame, configs: Sequence[Mapping]) -> tuple[DataFrame | None, list[tuple[int, str]]]:
    """((symbol, cell, evaluator, n_starts, metrics...), skipped cells with reasons); cell is the place in configs.

    Every cell is evaluated for every symbol of the panel, or for its own if the configuration names one.
    Symbols whose history is shorter than a cell's horizon give no row for it; `unmeasured_dca` names them.
    """
    per_day = K.BARS_PER_DAY["1h"]
    year = per_day * 365.0
    routed, skipped = _routed(configs)
    if not routed:
        return None, skipped
    about = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(float(p.plan.amount)).alias("amount"), F.lit(p.plan.n).alias("n"), F.lit(p.plan.stride / year).alias("gap"), F.lit(p.plan.horizon).alias("horizon"), F.lit(only).cast("string").alias("only")) for i, _, p, _, only in routed])
    place = {i: k for k, (i, *_) in enumerate(routed)}
    common = ["symbol", "evaluator", "__k", "start_us", "terminal_value", "terminal_multiple", "lump_multiple", "deposits", "bars", "dd", "funding_frac", "liquidated"]
    parts = []
    closed = [(i, p.plan) for i, route, p, _, _ in routed if route == "analytic"]
    if closed:
        d = analytic.evaluate_many(panel, [p for _, p in closed])
        k = F.element_at(about, F.element_at(F.array(*[F.lit(place[i] + 1) for i, _ in closed]), F.col("cell") + 1))
        d = d.withColumn("__k", k).where(F.col("__k.only").isNull() | (F.col("__k.only") == F.col("symbol")))
        none = F.lit(None).cast("double")
        d = d.withColumns({"evaluator": F.lit("analytic"), "start_us": epoch_us("ts"), "deposits": F.col("__k.n").cast("double"), "bars": F.col("horizon").cast("double"), "dd": none, "funding_frac": F.lit(0.0), "liquidated": F.lit(False)})
        parts.append(d.select(*common))
    simulated = [r for r in routed if r[1] == "simulate"]
    if simulated:
        p, gates = panel, {}
        for _, _, _, gate, _ in simulated:
            if gate[0] != "none" and gate not in gates:
                gates[gate] = f"__gate_{len(gates)}"
                look = days_to_bars(gate[2], per_day)
                p = gate_dip(p, gate[1], look, gates[gate]) if gate[0] == "dip" else gate_sma(p, look, gates[gate])
        d = simulate_many(p, [(i, path, gates.get(gate), only) for i, _, path, gate, only in simulated], step=max(1, days_to_bars(SIM_STRIDE_DAYS, per_day)))
        k = F.element_at(about, F.element_at(F.create_map(*[x for i, *_ in simulated for x in (F.lit(i), F.lit(place[i] + 1))]), F.col("cell")))
        d = d.withColumn("__k", k).withColumns({
            "evaluator": F.lit("simulate"), "terminal_value": F.col("terminal_equity"), "deposits": F.greatest(F.round(F.col("invested") / F.col("__k.amount")), F.lit(1.0)), "bars": F.col("exit_bar").cast("double"),
            "dd": F.col("max_dd_total"), "funding_frac": F.col("funding_paid") / F.greatest(F.col("invested"), F.lit(1e-9)),
        })
        parts.append(d.select(*common))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rate = analytic.mwrr_column(F.col("terminal_value"), F.col("__k.amount"), F.col("deposits"), F.col("__k.gap"), F.col("bars") / F.lit(year))
    out = out.withColumns({"mwrr": rate, "cell": F.col("__k.cell"), "horizon_days": F.col("__k.horizon") / F.lit(float(per_day))})
    return _profiles(out, {"terminal_multiple": "tm", "mwrr": "mwrr", "dd": "dd", "funding_frac": "funding_frac", "lump_multiple": "lump"}, ["symbol", "cell", "evaluator"]), skipped


def unmeasured_dca(panel: DataFrame, configs: Sequence[Mapping]) -> DataFrame:
    """(symbol, cell, reason): the symbols that a cell cannot be measured on; symbol is null where it is the cell itself."""
    routed, skipped = _routed(configs)
    # A path simulation leaves out the last admissible start.
    table = [(i, p.plan.horizon + (1 if route == "simulate" else 0), only) for i, route, p, _, only in routed]
    sizes = panel.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
    spark = panel.sparkSession
    cells = spark.createDataFrame(table, "cell int, needs bigint, only string")
    short = sizes.join(cells, (F.col("bars") <= F.col("needs")) & (F.col("only").isNull() | (F.col("only") == F.col("symbol"))))
    named = spark.createDataFrame([(None, i, why) for i, why in skipped], "symbol string, cell int, reason string")
    return short.select("symbol", "cell", F.lit("history_shorter_than_horizon").alias("reason")).unionByName(named)


def signal_setting(cfg: Mapping) -> tuple[Rule, Account, str]:
    """(rule, account, clock) of a configuration."""
    c = SIGNAL_DEFAULTS | dict(cfg)
    per_day, times = K.BARS_PER_DAY[c["clock"]], c["cost_multiplier"]
    rule = Rule(c["rule"], c["lookback_days"], c["enter_rate"], c["exit_rate"], int(c["timeframe_hours"]), c["enter_level"], c["exit_level"], c["filter_level"], c["filter_hours"], c["filter_lookback_days"], c["oi_drop"])
    a = Account(c["capital"], c["leverage"], c["fee_bps"] * times, c["slippage_bps"] * times, c["stop_loss"], c["take_profit"], None if c["max_hold_days"] is None else days_to_bars(c["max_hold_days"], per_day))
    return rule, a, c["clock"]


def _allowed(a: Account) -> Column:
    return F.lit(a.leverage) <= max_leverage(F.lit(a.capital * a.leverage), tier_name(F.col("symbol")))


def run_signals(panel: DataFrame, configs: Sequence[Mapping]) -> tuple[DataFrame | None, list[tuple[int, str]]]:
    """((symbol, cell, evaluator, metrics...), skipped): fixed-capital metrics and trade totals of signal configurations.

    Symbols whose margin tier forbids a cell's leverage give no row for it; `unmeasured_signals` names them.
    """
    parts, skipped = [], []
    for i, cfg in enumerate(configs):
        rule, a, clock = signal_setting(cfg)
        p = panel if cfg.get("symbol") is None else panel.where(F.col("symbol") == cfg["symbol"])
        try:
            s = rules.signals(p.where(_allowed(a)), rule)
        except ValueError as e:
            skipped.append((i, str(e)))
            continue
        d = signal.account(s, a).withColumn("cell", F.lit(i)).withColumn("per_year", F.lit(float(K.BARS_PER_YEAR[clock])))
        parts.append(d)
    if not parts:
        return None, skipped
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    # One scan serves both: trades stand at the bars in which they end.
    out, by, result = cut(out), ("symbol", "cell"), None
    years = {K.BARS_PER_YEAR[signal_setting(c)[2]] for c in configs}
    for y in sorted(years):
        m = metrics.summary(out.where(F.col("per_year") == float(y)), by=by, bars_per_year=y)
        result = m if result is None else result.unionByName(m)
    t = signal.trade_summary(out.where(F.col("trade").isNotNull()), by=by)
    zero = {"n_trades": 0, "funding_total": 0.0, "gross_total": 0.0, "pnl_total": 0.0, "n_liquidations": 0}
    return result.join(t, list(by), "left").na.fill(zero).select("symbol", "cell", F.lit("signal").alias("evaluator"), *[x for x in result.columns if x not in by], *[x for x in t.columns if x not in by]), skipped


def unmeasured_signals(panel: DataFrame, configs: Sequence[Mapping]) -> DataFrame:
    """(symbol, cell, reason): the symbols on which no tier allows a cell's leverage."""
    names = panel.select("symbol").distinct()
    out = None
    for i, cfg in enumerate(configs):
        _, a, _ = signal_setting(cfg)
        d = names if cfg.get("symbol") is None else names.where(F.col("symbol") == cfg["symbol"])
        part = d.where(~_allowed(a)).select("symbol", F.lit(i).alias("cell"), F.lit(f"no_tier_allows_leverage({a.leverage:g})").alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def as_trials(results: DataFrame, configs: Sequence[Mapping], *, run_id: str, family: str, hypothesis_id: str | None, panel_hashes: DataFrame, code_hash: str, created_utc: str, holdout_state: str = "DEVELOPMENT") -> DataFrame:
    """Ledger rows of results: configuration and metrics as text, identities as hashes."""
    spark: SparkSession = results.sparkSession
    metric = [c for c in results.columns if c not in ("symbol", "cell", "evaluator", "n_starts")]
    table = spark.createDataFrame([(i, json.dumps(canonical(dict(c))), canonical_hash({k: v for k, v in c.items() if k != "symbol"})) for i, c in enumerate(configs)], "cell int, config_json string, config_hash string")
    d = results.join(table, "cell").join(panel_hashes, "symbol")
    ident = F.sha2(F.concat_ws("|", "config_hash", "symbol", "evaluator", "panel_hash", F.lit(code_hash)), 256)
    starts = F.col("n_starts") if "n_starts" in results.columns else F.col("bars")
    return d.select(
        F.conv(F.substring(ident, 1, 15), 16, 10).cast("bigint").alias("trial_id"), F.lit(created_utc).alias("created_utc"), F.lit(run_id).alias("run_id"), F.lit(family).alias("family"),
        F.lit(hypothesis_id).cast("string").alias("hypothesis_id"), "symbol", "evaluator", "config_hash", "config_json", F.lit(code_hash).alias("code_hash"), "panel_hash",
        F.lit(holdout_state).alias("holdout_state"), starts.cast("bigint").alias("n_starts"), F.to_json(F.struct(*metric)).alias("metrics_json"),
    )
