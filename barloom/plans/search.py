"""Queries over the ledger, grids, surfaces, inference, verdicts and operational views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom import constants as K
from barloom.functions.columns import canon_symbol, table
from barloom.operators import analytic, grid, inference, ledger, metrics, nulls, ops, report, robustness, rules, runner, signal, surface, verdict
from barloom.operators.analytic import Plan
from barloom.operators.cleaning import clean_bars, development
from barloom.operators.panel import build_panel
from barloom.operators.rules import Rule
from barloom.operators.signal import Account
from barloom.plans.shared import PANEL, WIN, panel, rnd
from barloom.session import cut
from barloom.sources import readers

# Cells of the demonstration grid: stride in hours, deposits. The horizons differ.
GRID = {"stride": [12, 24, 36], "n": [3, 5, 7]}
RULE_LEVELS = [80.0, 100.0, 120.0, 140.0]


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "trials")


def _config(key: str):
    return F.get_json_object("config_json", f"$.{key}")


# Ledger


def ledger_first(spark, sf):
    return ledger.first_of_identity(_trials(spark, sf)).select("trial_id", "symbol", "evaluator", "config_hash")


def ledger_union(spark, sf):
    t = _trials(spark, sf)
    # Two overlapping ledgers: one by analytic and old trials, one by simulated and new ones.
    a, b = t.where((F.col("evaluator") == "analytic") | (F.col("created_utc") < "2019-07-01")), t.where((F.col("evaluator") != "analytic") | (F.col("created_utc") >= "2019-07-01"))
    return ledger.union_ledgers(a, b).select("trial_id", "config_hash")


def ledger_new(spark, sf):
    """Trials measured after a date whose identity was not in the ledger before it."""
    t = _trials(spark, sf)
    return ledger.new_rows(t.where(F.col("created_utc") < "2019-07-01"), t.where(F.col("created_utc") >= "2019-07-01")).select("trial_id", "config_hash")


def ledger_attributions(spark, sf):
    return ledger.attributions(_trials(spark, sf))


def ledger_families(spark, sf):
    return ledger.by_family(_trials(spark, sf))


def ledger_runs(spark, sf):
    return ledger.run_summary(_trials(spark, sf))


def ledger_best(spark, sf):
    """The ten best trials by a metric inside their json; the limit is the report."""
    return ledger.best(_trials(spark, sf), "mwrr_q05", 10).select("trial_id", "symbol", "value")


def ledger_revisions(spark, sf):
    return ledger.revisions(_trials(spark, sf))


def newest_per_cell(spark, sf):
    return ledger.newest_per_cell(_trials(spark, sf)).select("trial_id", "hypothesis_id", "symbol", "config_hash")


def pending_pairs(spark, sf):
    """Pairs of hypothesis and symbol that texts name and no development trial has measured."""
    want = table(spark, sf, "documents").select("hypothesis_id", "symbol").where(F.col("hypothesis_id").isNotNull() & F.col("symbol").isNotNull()).distinct()
    done = _trials(spark, sf).where((F.col("holdout_state") == "DEVELOPMENT") & F.col("hypothesis_id").isNotNull())
    return ledger.pending(want, done, ["hypothesis_id", "symbol"])


def measured_symbols(spark, sf):
    """Semi-join: symbols with funding that trials have measured."""
    f = table(spark, sf, "funding").select(canon_symbol("symbol").alias("symbol")).where(F.col("symbol").isNotNull()).distinct()
    return f.join(_trials(spark, sf).select("symbol"), "symbol", "left_semi")


def symbol_sets(spark, sf):
    """Union, intersection and differences of the symbols of bars, settlements and readings."""
    s = lambda t: table(spark, sf, t).select(canon_symbol("symbol").alias("symbol")).where(F.col("symbol").isNotNull())
    bars, fund, pos = s("panel_1h"), s("funding"), s("positioning")
    tag = lambda d, n: d.select(F.lit(n).alias("set"), "symbol")
    return (
        tag(bars.union(fund).union(pos).distinct(), "any").unionByName(tag(bars.intersect(fund).intersect(pos), "all"))
        .unionByName(tag(bars.select("symbol").distinct().exceptAll(fund.distinct()), "bars_only")).unionByName(tag(fund.subtract(bars), "funding_only"))
    )


def uses_closed_form(spark, sf):
    num = lambda k: _config(k).try_cast("double")
    ok = grid.uses_closed_form(_config("gate"), F.coalesce(num("leverage"), F.lit(1.0)), num("take_profit"), num("stop_loss"), _config("include_funding") == "true")
    return _trials(spark, sf).select("trial_id", ok.alias("closed_form"))


def skip_reasons(spark, sf):
    num = lambda k: _config(k).try_cast("double")
    gate = F.lower(F.coalesce(_config("gate"), F.lit("none")))
    reason = (
        F.when(~gate.rlike(r"^(none|dip:[0-9]*\.?[0-9]+:[0-9]+|sma:[0-9]+)$"), F.concat(F.lit("gate_not_understood("), gate, F.lit(")")))
        .when(num("stride_days") * 24 < 1, F.lit("stride_under_one_bar"))
        .when((num("n_contributions") - 1) * num("stride_days") + num("hold_days") >= 100, F.concat(F.lit("horizon_longer_than_history("), _config("n_contributions"), F.lit(")")))
    )
    return grid.skip_reasons(_trials(spark, sf).withColumn("reason", reason), "reason")


# Grids and surfaces


def grid_expand(spark, sf):
    s = table(spark, sf, "panel_1h").select("symbol").where(F.col("symbol").isNotNull()).distinct()
    return grid.expand_relational(s, GRID).select("symbol", F.col("stride").cast("bigint").alias("stride"), F.col("n").cast("bigint").alias("n"))


PLANS = [Plan(stride=k, n=n, hold=48) for n in GRID["n"] for k in GRID["stride"]]


def _grid_outcomes(spark, sf, keep=lambda i: True) -> DataFrame:
    """(symbol, cell, stride_ord, n_ord, horizon, start_idx, tm) of the grid's cells and every start, in one pass."""
    wide = len(GRID["stride"])
    kept = [i for i in range(len(PLANS)) if keep(i)]
    d = analytic.evaluate_many(panel(spark, sf), [PLANS[i] for i in kept])
    cell = F.element_at(F.array(*[F.lit(i) for i in kept]), F.col("cell") + 1)
    return d.select(
        "symbol", cell.alias("cell"), (cell % wide).alias("stride_ord"), F.floor(cell / wide).cast("int").alias("n_ord"), "horizon", "start_idx", F.col("terminal_multiple").alias("tm")
    )


def _surface(spark, sf) -> DataFrame:
    """The 5 % quantile of every cell's outcomes."""
    return _grid_outcomes(spark, sf).groupBy("symbol", "cell", "stride_ord", "n_ord").agg(F.percentile("tm", 0.05).alias("tm_q05"))


def surface_best(spark, sf):
    return surface.best_cell(_surface(spark, sf).withColumn("tm_q05", F.round("tm_q05", 9)), "tm_q05", "cell").select("symbol", "cell", rnd("tm_q05", 7))


def plateau(spark, sf):
    d = surface.plateau(_surface(spark, sf).withColumn("tm_q05", F.round("tm_q05", 9)), "tm_q05", "cell", ["stride_ord", "n_ord"])
    return d.select("symbol", "cells", rnd("peak", 7), "neighbours", rnd("neighbour_mean", 7), rnd("ratio", 6), "shape")


def common_starts(spark, sf):
    return inference.common_starts(_grid_outcomes(spark, sf), "cell", "start_idx", ["symbol"])


def modal_horizon(spark, sf):
    return inference.modal(_grid_outcomes(spark, sf), "horizon", "cell", ["symbol"])


#: The horizon that most cells share, the first of those that tie: only cells of one horizon are columns of one matrix.
MODAL_HORIZON = max(dict.fromkeys(p.horizon for p in PLANS), key=[p.horizon for p in PLANS].count)


def _shared_matrix(spark, sf) -> DataFrame:
    """All cells of the modal horizon on the starts that all of them have; read several times, so it is written once."""
    d = cut(_grid_outcomes(spark, sf, lambda i: PLANS[i].horizon == MODAL_HORIZON).select("symbol", "cell", "start_idx", "tm"))
    return d.join(inference.common_starts(d, "cell", "start_idx", ["symbol"]), ["symbol", "start_idx"])


def split_scores(spark, sf):
    d = inference.split_scores(_shared_matrix(spark, sf), row="start_idx", cfg="cell", value="tm", by=["symbol"])
    return d.select("symbol", "split", "cell", rnd("inside", 9), rnd("outside", 9))


def overfitting(spark, sf):
    d = inference.overfitting(inference.split_scores(_shared_matrix(spark, sf), row="start_idx", cfg="cell", value="tm", by=["symbol"]), cfg="cell", by=["symbol"])
    return d.select("symbol", "splits", "configurations", rnd("pbo", 6), rnd("degraded_fraction", 6), rnd("median_logit", 6), "verdict")


def overfitting_best(spark, sf):
    """Split validation of each symbol's best cell of all, among the cells of the grid that share its horizon.

    A multiple grows with the horizon, so cells of other horizons are no columns of the same matrix. A symbol whose
    best cell shares its horizon with none, or whose starts span less than a horizon or blocks of ten, gets the reason.
    """
    d = cut(_grid_outcomes(spark, sf).select("symbol", "cell", "stride_ord", "n_ord", "horizon", "start_idx", "tm"))
    q = d.groupBy("symbol", "cell", "horizon").agg(F.round(F.percentile("tm", 0.05), 9).alias("v"))
    best = surface.best_cell(q, "v", "cell").select("symbol", F.col("cell").alias("best"), "horizon")
    same = d.join(best, ["symbol", "horizon"])
    shared = same.join(inference.common_starts(same, "cell", "start_idx", ["symbol"]), ["symbol", "start_idx"])
    size = shared.groupBy("symbol", "best", "horizon").agg(F.count_distinct("cell").alias("cells"), F.count_distinct("start_idx").alias("starts"))
    reason = F.when(F.col("cells") < 2, "fewer than two share a horizon").when((F.col("starts") < 10 * K.CSCV_BLOCKS) | (F.col("starts") < F.col("horizon")), "too few common starts")
    size = size.withColumn("status", F.coalesce(reason, F.lit("ok")))
    good = shared.join(size.where(F.col("status") == "ok").select("symbol"), "symbol", "left_semi")
    v = inference.overfitting(inference.split_scores(good, row="start_idx", cfg="cell", value="tm", by=["symbol"]), cfg="cell", by=["symbol"])
    j = size.join(v, "symbol", "left")
    return j.select("symbol", "best", "horizon", "cells", "status", rnd("pbo", 6), rnd("degraded_fraction", 6), rnd("median_logit", 6), "verdict")


def overfitting_signals(spark, sf):
    """The same validation for a signal rule: rows are bars, performance is the account's log return."""
    p, out = panel(spark, sf), None
    for i, level in enumerate(RULE_LEVELS):
        d = _rule_equity(p, rule=replace(RULE, enter_level=level)).select("symbol", "bar_idx", F.lit(i).alias("cell"), "equity")
        out = d if out is None else out.unionByName(d)
    w = Window.partitionBy("symbol", "cell").orderBy("bar_idx")
    x = F.log(F.greatest(F.col("equity"), F.lit(1e-12)))
    perf = cut(out.withColumn("r", F.coalesce(x - F.lag(x).over(w), F.lit(0.0))).select("symbol", "bar_idx", "cell", "r"))
    # Levels that trade alike have the same scores: the order of summation must not rank them.
    scores = inference.split_scores(perf, row="bar_idx", cfg="cell", value="r", by=["symbol"]).withColumns({c: F.round(c, 12) for c in ("inside", "outside")})
    d = inference.overfitting(scores, cfg="cell", by=["symbol"])
    return d.select("symbol", "splits", "configurations", rnd("pbo", 6), rnd("degraded_fraction", 6), rnd("median_logit", 6), "verdict")


DCA_CELLS = [
    {"stride_days": 1.0, "n_contributions": 5, "hold_days": 2.0, "include_funding": False},
    {"stride_days": 2.0, "n_contributions": 5, "hold_days": 2.0, "include_funding": False},
    {"stride_days": 1.0, "n_contributions": 5, "hold_days": 2.0},
    {"stride_days": 1.0, "n_contributions": 5, "hold_days": 2.0, "gate": "dip:0.05:7"},
    {"stride_days": 1.0, "n_contributions": 5, "hold_days": 2.0, "leverage": 3.0, "gate": "SMA:7", "stop_loss": 0.5},
    {"stride_days": 0.01, "n_contributions": 5},
    {"gate": "moon:1"},
]
# Rates that no mean of recorded ones meets exactly, so that the order of summation cannot decide.
SIGNAL_CELLS = [
    {"rule": "carry_funding", "lookback_days": 3.0, "enter_rate": 1.00137e-4, "exit_rate": 5.00137e-5},
    {"rule": "cci_reversion", "lookback_days": 1.0, "stop_loss": 0.2},
    {"rule": "cci_mtf", "lookback_days": 1.0, "filter_hours": 4, "filter_lookback_days": 3.0, "filter_level": 50.0, "exit_level": 100.0, "leverage": 2.0},
    {"rule": "cci_reversion", "lookback_days": 1.0, "leverage": 60.0},
]


def dca_trials(spark, sf):
    """Metrics of a small grid of accumulation plans, routed to the closed form or the simulator."""
    d = runner.run_dca(panel(spark, sf), DCA_CELLS)[0]
    digits = ("tm_q05", "tm_q50", "mwrr_q05", "mwrr_q50", "dd_q50", "funding_frac_q50", "liquidation_rate", "vs_lump_sum", "span_days")
    return d.select("symbol", "cell", "evaluator", "n_starts", *[rnd(c, 6) for c in digits], "horizon_days")


def dca_unmeasured(spark, sf):
    """Cells of a grid with long plans that cannot be measured, and on which symbols."""
    return runner.unmeasured_dca(panel(spark, sf), [*DCA_CELLS, {"stride_days": 7.0, "n_contributions": 12}])


def signal_trials(spark, sf):
    d = runner.run_signals(panel(spark, sf), SIGNAL_CELLS)[0]
    return d.select("symbol", "cell", *[rnd(c, 6) for c in ("cagr", "max_drawdown", "calmar", "sharpe", "total_return")], "bars", "n_trades", rnd("win_rate", 8), *[rnd(c, 4) for c in ("funding_total", "gross_total", "pnl_total")], "n_liquidations")


def signal_unmeasured(spark, sf):
    return runner.unmeasured_signals(panel(spark, sf), SIGNAL_CELLS)


def synthetic_paths(spark, sf):
    return inference.synthetic_paths(spark, panel(spark, sf))


def best_of_grid(spark, sf):
    """p-values of the best accumulation cell against the same search on resampled hourly closes, 199 paths."""
    plans = PLANS
    d = cut(inference.path_scores(panel(spark, sf), lambda close: analytic.grid_quantiles(close, plans, 0.05)))
    seen = d.where(F.col("path_id") < 0).groupBy("symbol").agg(F.max("value").alias("value"))
    return inference.best_of_grid(d.where(F.col("path_id") >= 0), seen, value="value")


def _search_test(spark, sf, scorer, **how) -> DataFrame:
    d = cut(inference.path_scores(panel(spark, sf), scorer, **how))
    seen = d.where(F.col("path_id") < 0).groupBy("symbol").agg(F.max("value").alias("value"))
    return inference.best_of_grid(d.where(F.col("path_id") >= 0), seen, value="value")


def best_of_rates(spark, sf):
    """The search test of accumulation plans by the 5 % quantile of their money-weighted rate."""
    return _search_test(spark, sf, nulls.rate_scorer(PLANS))


def best_of_signals(spark, sf):
    """The search test of signal rules by the Calmar ratio, with a year of 500 bars so that short histories have one."""
    return _search_test(spark, sf, nulls.calmar_scorer(SCORED_RULES, ACCOUNT, 500.0), keyed=True)


def grid_rates(spark, sf):
    """The observed side of best_of_rates: the rate's 5 % quantile of every cell."""
    d = inference.path_scores(panel(spark, sf), nulls.rate_scorer(PLANS), paths=0)
    return d.select("symbol", "cell", rnd("value", 5, "mwrr_q05"))


def rule_calmars(spark, sf):
    """The observed side of best_of_signals: the Calmar ratio of every cell on closes alone."""
    d = inference.path_scores(panel(spark, sf), nulls.calmar_scorer(SCORED_RULES, ACCOUNT, 500.0), paths=0, keyed=True)
    return d.select("symbol", "cell", rnd("value", 6, "calmar"))


# Robustness of a signal rule

RULE = Rule("cci_reversion", lookback_days=1, timeframe_hours=1)
ACCOUNT = Account()
SCORED_RULES = [replace(RULE, enter_level=x) for x in RULE_LEVELS]


def _rule_equity(p: DataFrame, a: Account = ACCOUNT, rule: Rule = RULE) -> DataFrame:
    return signal.equity(rules.signals(p, rule), a)


def cost_stress(spark, sf):
    p = rules.signals(panel(spark, sf), RULE)
    d = robustness.stressed(lambda a: signal.trade_summary(signal.trades(p, a)).select("symbol", F.col("pnl_total").alias("value")), ACCOUNT, value="value")
    return d.select("symbol", rnd("plain", 4), rnd("stressed", 4), "survives")


#: Bars of a block at least; the test tables have few symbols with four months of hourly bars.
BLOCK_BARS = 100


def walk_forward(spark, sf):
    """Four contiguous blocks per symbol; the best entry level of the first two is followed into the others. Symbols with short blocks say so."""
    p0 = panel(spark, sf)
    b = robustness.block_panels(p0, least=BLOCK_BARS)
    p = b.select(F.concat_ws("\u0001", "symbol", F.col("block").cast("string")).alias("symbol"), *[c for c in b.columns if c not in ("symbol", "block")])
    out = None
    for level in RULE_LEVELS:
        m = metrics.summary(_rule_equity(p, rule=replace(RULE, enter_level=level)), bars_per_year=100.0).select("symbol", F.lit(f"{level:g}").alias("cell"), F.col("total_return").alias("value"))
        out = m if out is None else out.unionByName(m)
    k = F.split("symbol", "\u0001")
    d = robustness.walk_forward(out.select(k[0].alias("symbol"), k[1].cast("int").alias("block"), "cell", F.round("value", 12).alias("value")))
    d = d.select("symbol", "chosen", rnd("trained", 8), rnd("tested", 8), rnd("retention", 5), "holds", F.lit("ok").alias("status"))
    return d.unionByName(robustness.short_blocks(p0, least=BLOCK_BARS).select("symbol", F.lit(False).alias("holds"), F.lit("blocks too short").alias("status")), allowMissingColumns=True)


def regime_consistency(spark, sf):
    p = panel(spark, sf)
    d = robustness.regime_consistency(p.select("symbol", "bar_idx", "close").join(_rule_equity(p), ["symbol", "bar_idx"]), window_bars=168)
    return d.select("symbol", rnd("up_return", 7), rnd("down_return", 7), "consistent")


def clock_drift(spark, sf):
    """The same rule on one-minute and on hourly bars made of them."""
    clean = clean_bars(table(spark, sf, "raw_1m"))
    out = []
    for minutes in (60, 1):
        p = build_panel(clean, minutes)
        r = replace(RULE, lookback_days=0.25, enter_level=60.0, timeframe_hours=1, step_hours=1)
        if minutes != 60:
            hourly = rules.signals(build_panel(clean, 60), r).select("symbol", F.col("ts").alias("__h"), "entry", "exit")
            at = F.expr("ts - make_dt_interval(0, 0, 0, CAST(pmod(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts), 3600) AS DECIMAL(18, 6)))").cast("timestamp_ntz")
            w = Window.partitionBy("symbol", "__h").orderBy(F.desc("bar_idx"))
            # A signal of an hour is read at its last bar.
            p = p.withColumn("__h", at).withColumn("__k", F.row_number().over(w)).join(hourly, ["symbol", "__h"], "left")
            p = p.withColumns({"entry": F.when(F.col("__k") == 1, F.col("entry")).otherwise(F.lit(0)), "exit": F.coalesce((F.col("__k") == 1) & F.col("exit"), F.lit(False))})
        else:
            p = rules.signals(p, r)
        out.append(signal.trade_summary(signal.trades(p, ACCOUNT)).select("symbol", F.col("pnl_total").alias("value")))
    return robustness.clock_drift(out[0], out[1], value="value")


# Verdicts


def _recorded(spark, sf) -> DataFrame:
    t = ledger.newest_per_cell(_trials(spark, sf).where((F.col("holdout_state") == "DEVELOPMENT") & F.col("hypothesis_id").isNotNull()))
    return t.select("trial_id", "hypothesis_id", "family", "symbol", "config_hash", "n_starts", *[ledger.json_number("metrics_json", k).alias(k) for k in ("tm_q05", "mwrr_q05", "liquidation_rate")])


def disqualifiers(spark, sf):
    """Reasons against the best cell of every hypothesis and symbol; shapes and paths from the ledger, the rest unmeasured."""
    r = _recorded(spark, sf).where(F.col("tm_q05").isNotNull())
    best = surface.best_cell(r, "tm_q05", "trial_id", ["hypothesis_id", "symbol"])
    none = F.lit(None)
    shape = F.when(F.col("liquidation_rate") > 0.05, "SPIKE").when(F.col("liquidation_rate").isNotNull(), "PLATEAU")
    why = verdict.disqualifiers(F.col("tm_q05"), F.lit(1.0), shape, F.col("n_starts") / 1000.0, F.lit(0.25), F.lit(True), none.cast("double"), none.cast("boolean"))
    return best.select("hypothesis_id", "symbol", "trial_id", F.array_join(why, "; ").alias("reasons"))


def target_candidates(spark, sf):
    """Hypotheses and parameters whose cells meet a target, with the symbols on which they do."""
    t = ledger.newest_per_cell(_trials(spark, sf).where((F.col("holdout_state") == "DEVELOPMENT") & F.col("hypothesis_id").isNotNull()))
    sig = F.concat_ws("|", *[F.coalesce(_config(k), F.lit("~")) for k in ("contribution", "gate", "include_funding", "leverage", "n_contributions", "stop_loss", "stride_days", "take_profit")])
    # The ledger of accumulation plans has no growth; its multiple and liquidation rate stand for the two halves.
    r = t.select("hypothesis_id", sig.alias("signature"), "symbol", (ledger.json_number("metrics_json", "tm_q05") * 1.0).alias("cagr"), ledger.json_number("metrics_json", "liquidation_rate").alias("dd"))
    c = verdict.candidates(r, hypothesis="hypothesis_id", signature="signature", symbol="symbol", cagr="cagr", drawdown="dd")
    return c.select("hypothesis_id", "signature", F.array_join("symbols", ",").alias("symbols"), "n_symbols", "worst_cagr", "best_cagr")


def _candidates(spark, sf) -> DataFrame:
    """Parameters that meet the target on some symbol, with what the ledger says of each check; null is unmeasured.

    The ledger of accumulation plans stands in for growth by its multiple and for drawdown by its liquidation rate.
    """
    t = ledger.newest_per_cell(_trials(spark, sf).where(F.col("hypothesis_id").isNotNull()), ("hypothesis_id", "symbol", "config_hash", "holdout_state"))
    sig = F.concat_ws("|", *[F.coalesce(_config(k), F.lit("~")) for k in ("contribution", "gate", "include_funding", "leverage", "n_contributions", "stop_loss", "stride_days", "take_profit")])
    num = lambda k: ledger.json_number("metrics_json", k)
    r = t.select("hypothesis_id", sig.alias("signature"), "symbol", "evaluator", "holdout_state", num("tm_q05").alias("cagr"), num("liquidation_rate").alias("dd"), num("mwrr_q05").alias("rate"))
    met = surface.target_met(F.col("cagr"), F.col("dd"))
    dev = r.where(F.col("holdout_state") == "DEVELOPMENT")
    c = verdict.candidates(dev, hypothesis="hypothesis_id", signature="signature", symbol="symbol", cagr="cagr", drawdown="dd")
    known = lambda x: F.when(F.count(x) == F.count(F.lit(1)), F.bool_and(x))
    checks = dev.where(met).groupBy("hypothesis_id", "signature").agg(
        F.bool_or(F.col("dd") > 0.05).alias("disqualified"), known(F.col("rate") > 0).alias("robust"), known(F.when(F.col("evaluator") == "simulate", F.col("dd") <= 0.1)).alias("executed"),
    )
    sealed = r.where(F.col("holdout_state") == "SEALED_ONLY").groupBy("hypothesis_id", "signature").agg(F.bool_and(met).alias("holdout"))
    keys = ["hypothesis_id", "signature"]
    return verdict.checked_state(c.join(checks, keys).join(sealed, keys, "left"), disqualified="disqualified", robust="robust", executed="executed", holdout="holdout")


def stop_condition(spark, sf):
    """How far every candidate has come on the way to the target."""
    return _candidates(spark, sf).select("hypothesis_id", "signature", "n_symbols", "failed", "unmeasured", "state")


def stop_state(spark, sf):
    return verdict.overall_state(_candidates(spark, sf))


def cycle_report(spark, sf):
    """The lines of the cycle's report: project, families, the best cell of every hypothesis and symbol, closed hypotheses."""
    t = _trials(spark, sf)
    r = _recorded(spark, sf).where(F.col("tm_q05").isNotNull())
    head = disqualifiers(spark, sf).join(r.select("trial_id", F.col("tm_q05").alias("value")), "trial_id").select("hypothesis_id", "symbol", "value", "reasons")
    # A hypothesis with enough cells none of which ends above what was put in is answered.
    closed = r.groupBy("hypothesis_id").agg(F.max("tm_q05").alias("best"), F.count(F.lit(1)).alias("n")).where((F.col("best") <= 1.0) & (F.col("n") >= 3)).select("hypothesis_id", F.concat(F.lit("no cell of "), F.col("n").cast("string"), F.lit(" above 1")).alias("reason"))
    return report.cycle_report(t, head, closed).select("section", "subject", "symbol", rnd("value", 9), "text")


def best_within_limit(spark, sf):
    d = verdict.best_within(_recorded(spark, sf), value="mwrr_q05", limit_on="liquidation_rate", limit=0.005, order=["trial_id"])
    return d.select("which", "trial_id", "mwrr_q05", "liquidation_rate")


def vote_tally(spark, sf):
    """Families vote on symbols: does a family's trial end above what was put in?"""
    v = _recorded(spark, sf).where(F.col("tm_q05").isNotNull()).select("symbol", "family", F.when(F.col("tm_q05") >= 1.0, "CONTINUE").otherwise("CLOSE").alias("vote"))
    return verdict.vote_tally(v, subject="symbol", voter="family", vote="vote")


# Operational views


def duty_cycle(spark, sf):
    """Runs as spans of ninety minutes from each trial on."""
    t = _trials(spark, sf).select("family", F.try_to_timestamp("created_utc", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("a")).where(F.col("a").isNotNull())
    d = ops.duty_cycle(t.withColumn("b", F.expr("a + INTERVAL 90 MINUTE").cast("timestamp_ntz")), by=["family"], begin="a", end="b")
    return d.select("family", "spans", "islands", "busy_s", "window_s", rnd("duty", 9), "largest_gap_s")


def merged_timeline(spark, sf):
    t = _trials(spark, sf)
    log = t.where(F.col("evaluator") == "analytic").groupBy("run_id").agg(F.max("created_utc").alias("at"), F.count(F.lit(1)).alias("log_rows"))
    led = t.where(F.col("evaluator") != "analytic").groupBy("run_id").agg(F.max("created_utc").alias("at"), F.count(F.lit(1)).alias("ledger_rows"))
    return ops.merged_timeline(log, led, "run_id")


def findings(spark, sf):
    d = table(spark, sf, "documents").where(F.col("hypothesis_id").isNotNull()).select(F.col("source").alias("file"), F.col("hypothesis_id").alias("what"), "created_utc")
    old, new = d.where(F.col("created_utc") < F.lit("2020-01-01").cast("timestamp_ntz")), d.where(F.col("created_utc") >= F.lit("2020-01-01").cast("timestamp_ntz"))
    known = old.select("file", "what").distinct().withColumn("finding_id", ops.finding_id(F.col("file"), F.col("what")))
    return ops.merge_findings(known.select("finding_id", "file", "what"), new.select("file", "what")).select("finding_id", "file", "what", "is_new")


def survivorship(spark, sf):
    """Median multiple of symbols whose bars end early against that of those that last."""
    p = panel(spark, sf)
    ends = p.groupBy("symbol").agg(F.max("ts").alias("z"))
    # One row per symbol: small enough for one window without keys.
    life = ends.withColumn("zz", F.max("z").over(Window.partitionBy(F.lit(0))))
    tm = analytic.evaluate(p, Plan(stride=24, n=5, hold=48)).groupBy("symbol").agg(F.percentile("terminal_multiple", 0.5).alias("tm"))
    alive = life.select("symbol", (F.col("z") >= F.col("zz") - F.expr("INTERVAL 7 DAY")).alias("alive"))
    return ops.survivors(tm.join(alive, "symbol"), alive="alive", value="tm").select("alive", "n", rnd("median", 8))


def hashed_sample(spark, sf):
    """Twelve symbols without replacement; sampling is the feature."""
    return ops.hashed_sample(readers.symbols(table(spark, sf, "raw_1m")), "symbol", 12, 20260902)


# Sources over the delivered tables


def listed_symbols(spark, sf):
    return readers.symbols(table(spark, sf, "raw_1m"))


def merged_settlements(spark, sf):
    """Settlements of two overlapping deliveries, one of each symbol and stamp, with rate and interval."""
    f = table(spark, sf, "funding").withColumn("symbol", canon_symbol("symbol")).where(F.col("symbol").isNotNull() & F.col("ts").isNotNull())
    f = f.withColumn("ms", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000))
    cut = F.lit("2019-09-01").cast("timestamp_ntz")
    d = readers.settlements([f.where(F.col("ts") < cut), f.where(F.col("ts") >= cut)], ms="ms", rate="funding_rate", hours="interval_hours", source="symbol")
    return d.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "funding_rate", F.col("interval_hours").cast("double").alias("interval_hours"))


def complete_days(spark, sf):
    d = table(spark, sf, "positioning").withColumn("symbol", canon_symbol("symbol")).where(F.col("symbol").isNotNull())
    return readers.complete_days(d, per_day=130).select("reading_id", "symbol")


def missing_days(spark, sf):
    """Days between a symbol's first and last reading whose readings are too few, so that they are to be fetched again."""
    d = table(spark, sf, "positioning").withColumn("symbol", canon_symbol("symbol")).where(F.col("symbol").isNotNull() & F.col("ts").isNotNull())
    span = d.groupBy("symbol").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    want = span.select("symbol", F.explode(F.sequence("a", "b")).alias("day"))
    return readers.missing_days(want, readers.complete_days(d, per_day=130)).select("symbol", F.date_format("day", "yyyy-MM-dd").alias("day"))


def resumed_ingest(spark, sf):
    """Held and newly arrived readings, the newer of each stamp."""
    d = table(spark, sf, "positioning").withColumn("symbol", canon_symbol("symbol")).where(F.col("symbol").isNotNull() & F.col("ts").isNotNull())
    one = ledger.latest_of(d.where(F.col("ingested_at") < F.lit("2019-09-01").cast("timestamp_ntz")), ["symbol", "ts"], ["reading_id"])
    two = ledger.latest_of(d.where(F.col("ingested_at") >= F.lit("2019-09-01").cast("timestamp_ntz")), ["symbol", "ts"], ["reading_id"])
    return readers.resumed(one, two).select("reading_id")


def lifecycle(spark, sf):
    d = table(spark, sf, "panel_1h").where(F.col("symbol").isNotNull() & F.col("ts").isNotNull())
    months = d.select("symbol", F.date_format("ts", "yyyy-MM").alias("month"))
    live = _trials(spark, sf).select("symbol")
    return readers.lifecycle(months, live)


def development_rows(spark, sf):
    """What a sealed bundle would hold, by symbol."""
    d = development(table(spark, sf, "panel_1h").where(F.col("symbol").isNotNull()), "2019-08-01")
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


def _robust_sql() -> dict[str, str]:
    from barloom.plans import tracks

    lines = tracks.reversion_signals()
    flat = lambda level: "WITH RECURSIVE " + PANEL.replace("m.h AS high, m.l AS low", "m.c AS high, m.c AS low").replace("coalesce(m.f, 0.0) AS funding_rate", "0.0 AS funding_rate") + tracks.reversion_signals(level).split(PANEL, 1)[1]
    rate = lambda i, p: f"""SELECT symbol, {i} AS cell, round(quantile_cont(rate, 0.05), 5) + 0.0 AS mwrr_q05 FROM ({_grid_sql().replace('WITH', 'WITH RECURSIVE', 1)}, o AS (SELECT symbol, start_idx, tm * {p.amount * p.n!r} AS term FROM outcomes WHERE cell = {i}),
{tracks.rates('term', p.amount, p.n, p.stride / 8760.0, repr(p.horizon / 8760.0), 'o')} SELECT * FROM solved) GROUP BY symbol"""  # noqa: E731
    ratio = lambda i, x: f"""SELECT symbol, {i} AS cell, round((CASE WHEN ratio <= 0 THEN -1.0 ELSE ratio ** (500.0 / (bars - 1)) - 1.0 END) / mdd, 6) + 0.0 AS calmar FROM ({tracks.deals(flat(x), ACCOUNT)}, {tracks.CURVE} SELECT * FROM k) WHERE (bars - 1) / 500.0 >= 1.0 AND mdd >= 1e-9"""
    deal = lambda a: f"(SELECT * FROM ({tracks.deals(lines, a)} SELECT symbol, sum(pnl) AS v FROM deal GROUP BY symbol))"
    cells = " UNION ALL ".join(f"SELECT symbol, {i} AS cell, bar_idx AS start_idx, equity FROM ({tracks.deals(tracks.reversion_signals(x), ACCOUNT)} SELECT symbol, bar_idx, equity FROM line)" for i, x in enumerate(RULE_LEVELS))
    blocks = PANEL.replace("panel AS (", "whole AS (") + f""",
edged AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM whole),
panel AS (SELECT symbol || chr(1) || b AS symbol, ts, CAST(row_number() OVER (PARTITION BY symbol, b ORDER BY bar_idx) - 1 AS BIGINT) AS bar_idx, open, high, low, close, volume, funding_rate, funding_settled, open_interest
  FROM (SELECT *, (bar_idx >= n // 4)::INT + (bar_idx >= n * 2 // 4)::INT + (bar_idx >= n * 3 // 4)::INT AS b FROM edged WHERE n // 4 >= {BLOCK_BARS}))"""
    walked = " UNION ALL ".join(
        f"SELECT split_part(symbol, chr(1), 1) AS symbol, CAST(split_part(symbol, chr(1), 2) AS INTEGER) AS block, '{x:g}' AS cell, round(ratio - 1.0, 12) AS v FROM ({tracks.deals('WITH RECURSIVE ' + blocks + tracks.reversion_signals(x).split(PANEL, 1)[1], ACCOUNT)}, {tracks.CURVE} SELECT * FROM k)"
        for x in RULE_LEVELS
    )
    return {
        "walk_forward": f"""WITH {PANEL}, x AS ({walked}), t AS (SELECT symbol, cell, avg(v) FILTER (WHERE block < 2) AS trained, avg(v) FILTER (WHERE block >= 2) AS tested FROM x GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trained DESC NULLS LAST, cell) AS k, CASE WHEN trained > 0 THEN tested / trained END AS keep FROM t)
SELECT symbol, cell AS chosen, round(trained, 8) + 0.0 AS trained, round(tested, 8) + 0.0 AS tested, round(keep, 5) + 0.0 AS retention, coalesce(keep >= 0.5, false) AS holds, 'ok' AS status FROM r WHERE k = 1
UNION ALL SELECT symbol, NULL, NULL, NULL, NULL, false, 'blocks too short' FROM panel GROUP BY symbol HAVING count(*) // 4 < {BLOCK_BARS}""",
        "grid_rates": " UNION ALL ".join(rate(i, p) for i, p in enumerate(PLANS)),
        "rule_calmars": " UNION ALL ".join(ratio(i, x) for i, x in enumerate(RULE_LEVELS)),
        "cost_stress": f"""SELECT symbol, round(p.v, 4) + 0.0 AS plain, round(s.v, 4) + 0.0 AS stressed, coalesce(s.v > 0, false) AS survives FROM {deal(ACCOUNT)} p FULL JOIN {deal(robustness.cost_stressed(ACCOUNT))} s USING (symbol)""",
        "regime_consistency": f"""{tracks.deals(lines, ACCOUNT)}, g AS (SELECT symbol, bar_idx, CASE WHEN lag(close, 168) OVER {WIN}) IS NULL THEN 0 WHEN close > lag(close, 168) OVER {WIN}) THEN 1 ELSE -1 END AS g FROM panel),
x AS (SELECT symbol, bar_idx, ln(greatest(equity, 1e-12)) - lag(ln(greatest(equity, 1e-12))) OVER {WIN}) AS r FROM line),
a AS (SELECT symbol, sum(r) FILTER (WHERE g = 1) AS up, sum(r) FILTER (WHERE g = -1) AS down FROM g JOIN x USING (symbol, bar_idx) GROUP BY symbol)
SELECT symbol, round(up, 7) + 0.0 AS up_return, round(down, 7) + 0.0 AS down_return, coalesce(up > 0 AND down > 0, false) AS consistent FROM a""",
        "overfitting_signals": f"""WITH e AS ({cells}), mat AS (SELECT symbol, cell, start_idx, coalesce(ln(greatest(equity, 1e-12)) - lag(ln(greatest(equity, 1e-12))) OVER (PARTITION BY symbol, cell ORDER BY start_idx), 0.0) AS tm FROM e),
{SPLITS[SPLITS.index("rws AS"):]}, sr AS (SELECT symbol, split, cell, round(inside, 12) AS inside, round(outside, 12) AS outside FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, split ORDER BY inside DESC, cell) AS i, row_number() OVER (PARTITION BY symbol, split ORDER BY outside, cell) AS o,
  count(*) OVER (PARTITION BY symbol, split) AS g FROM sr), w AS (SELECT *, ln((o / (g + 1)) / (1 - o / (g + 1))) AS l FROM rk WHERE i = 1 AND g >= 2),
a AS (SELECT symbol, count(*) AS splits, max(g) AS configurations, avg((l <= 0)::INT) AS pbo, avg((outside < inside)::INT) AS deg, quantile_cont(l, 0.5) AS ml FROM w GROUP BY symbol)
SELECT symbol, splits, configurations, round(pbo, 6) AS pbo, round(deg, 6) AS degraded_fraction, round(ml, 6) + 0.0 AS median_logit, CASE WHEN pbo >= 0.5 THEN 'NOISE' WHEN pbo >= 0.25 THEN 'WEAK' ELSE 'INFORMATIVE' END AS verdict FROM a""",
    }


def _state_sql(sig: str) -> dict[str, str]:
    num = lambda k: f"TRY_CAST(json_extract_string(metrics_json, '$.{k}') AS DOUBLE)"
    base = f"""WITH nw AS (SELECT *, row_number() OVER (PARTITION BY hypothesis_id, symbol, config_hash, holdout_state ORDER BY created_utc DESC, trial_id DESC) AS k FROM trials WHERE hypothesis_id IS NOT NULL),
r AS (SELECT hypothesis_id, {sig} AS signature, symbol, evaluator, holdout_state, {num('tm_q05')} AS c, {num('liquidation_rate')} AS d, {num('mwrr_q05')} AS rate FROM nw WHERE k = 1),
m AS (SELECT *, coalesce(c >= 1.0 AND d <= 0.25, false) AS met FROM r),
cand AS (SELECT hypothesis_id, signature, count(DISTINCT symbol) AS n_symbols, bool_or(d > 0.05) AS disq, CASE WHEN count(rate) = count(*) THEN bool_and(rate > 0) END AS robust,
  CASE WHEN count(*) = count_if(evaluator = 'simulate') THEN bool_and(d <= 0.1) END AS executed FROM m WHERE holdout_state = 'DEVELOPMENT' AND met GROUP BY 1, 2),
seal AS (SELECT hypothesis_id, signature, bool_and(met) AS holdout FROM m WHERE holdout_state = 'SEALED_ONLY' GROUP BY 1, 2),
z AS (SELECT cand.*, holdout FROM cand LEFT JOIN seal USING (hypothesis_id, signature)),
y AS (SELECT hypothesis_id, signature, n_symbols, concat_ws(',', CASE WHEN NOT executed THEN 'execution' END, CASE WHEN NOT holdout THEN 'holdout' END, CASE WHEN disq THEN 'not_disqualified' END, CASE WHEN NOT robust THEN 'robustness' END,
  CASE WHEN n_symbols < 3 THEN 'symbols' END) AS failed, concat_ws(',', CASE WHEN executed IS NULL THEN 'execution' END, CASE WHEN holdout IS NULL THEN 'holdout' END, CASE WHEN robust IS NULL THEN 'robustness' END) AS unmeasured FROM z),
x AS (SELECT *, CASE WHEN failed = '' AND unmeasured = '' THEN 'COMPLETE' WHEN failed = '' AND unmeasured = 'holdout' THEN 'VERIFIED_ON_DEVELOPMENT' ELSE 'CANDIDATE_UNVERIFIED' END AS state FROM y)"""
    return {
        "stop_condition": f"{base} SELECT hypothesis_id, signature, n_symbols, failed, unmeasured, state FROM x",
        "stop_state": f"{base} SELECT CASE WHEN count(*) = 0 THEN 'NO_CANDIDATE' WHEN bool_or(state = 'COMPLETE') THEN 'COMPLETE' WHEN bool_or(state = 'VERIFIED_ON_DEVELOPMENT') THEN 'VERIFIED_ON_DEVELOPMENT' ELSE 'CANDIDATE_UNVERIFIED' END AS state, count(*) AS candidates FROM x",
        "cycle_report": f"""WITH {NEWEST}, b AS (SELECT *, row_number() OVER (PARTITION BY hypothesis_id, symbol ORDER BY tm DESC, trial_id) AS j FROM recorded WHERE tm IS NOT NULL AND NOT isnan(tm)),
shut AS (SELECT hypothesis_id, count(*) AS n FROM recorded WHERE tm IS NOT NULL GROUP BY 1 HAVING max(tm) <= 1.0 AND count(*) >= 3),
h AS (SELECT *, concat_ws('; ', CASE WHEN tm <= 1.0 THEN 'at or below 1.0' END, CASE WHEN lr IS NULL THEN 'shape unmeasured' WHEN lr > 0.05 THEN 'spike' END,
  CASE WHEN n_starts IS NULL THEN 'path count unmeasured' WHEN n_starts / 1000.0 < 5 THEN format('{{:.2f}}', n_starts / 1000.0) || ' paths' END, 'search test unmeasured') AS reasons FROM b WHERE j = 1)
SELECT 'project' AS section, 'trials' AS subject, NULL AS symbol, CAST(count(*) AS DOUBLE) AS value, max(created_utc) AS text FROM trials
UNION ALL SELECT 'family', family, NULL, CAST(count(*) AS DOUBLE), CAST(count(DISTINCT hypothesis_id) AS VARCHAR) FROM trials GROUP BY family
UNION ALL SELECT 'headline', hypothesis_id, symbol, round(tm, 9), CASE WHEN reasons = '' THEN 'CLEARS EVERY CHECK' ELSE reasons END FROM h WHERE hypothesis_id NOT IN (SELECT hypothesis_id FROM shut)
UNION ALL SELECT 'closed', hypothesis_id, NULL, NULL, 'no cell of ' || n || ' above 1' FROM shut""",
    }


def _trial_sql() -> dict[str, str]:
    from barloom.plans import tracks

    gates = {
        ("dip", 0.05, 7.0): ("coalesce(bar_idx >= 167 AND close <= top * 0.95, false)", f", g AS (SELECT *, max(close) OVER {WIN} ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS top FROM panel)"),
        ("sma", 0.0, 7.0): ("coalesce(bar_idx >= 168 AND close <= mean, false)", f", g AS (SELECT *, avg(close) OVER {WIN} ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS mean FROM panel)"),
        ("none", 0.0, 0.0): ("true", ""),
    }
    routed, skipped = runner._routed(DCA_CELLS)
    rows = [tracks.plan_row(i, p, route, *gates[gate]) for i, route, p, gate, _ in routed]
    accounts = [runner.signal_setting(c)[1] for c in SIGNAL_CELLS]
    sig = [tracks.carry_signals(">= 1.00137e-4", "< 5.00137e-5"), tracks.reversion_signals(), tracks.mtf_signals(50.0, 100.0), tracks.reversion_signals()]
    more, _ = runner._routed([*DCA_CELLS, {"stride_days": 7.0, "n_contributions": 12}])
    needs = " UNION ALL ".join(f"SELECT {i} AS cell, {p.plan.horizon + (route == 'simulate')} AS needs" for i, route, p, _, _ in more)
    named = "".join(f" UNION ALL SELECT NULL, {i}, '{why}'" for i, why in skipped)
    names = "SELECT DISTINCT symbol FROM panel"
    levels = f"WITH {PANEL}, x AS (SELECT symbol, {tracks.TIER_OF} FROM ({names}))"
    forbidden = " UNION ALL ".join(f"SELECT symbol, {i} AS cell, 'no_tier_allows_leverage({a.leverage:g})' AS reason FROM x WHERE {a.leverage} > {tracks.tier_case(3, repr(a.capital * a.leverage))}" for i, a in enumerate(accounts))
    allowed = f"SELECT symbol FROM (WITH {PANEL} SELECT DISTINCT symbol, {tracks.TIER_OF} FROM panel) WHERE {accounts[3].leverage} <= {tracks.tier_case(3, repr(accounts[3].capital * accounts[3].leverage))}"
    cells = [tracks.account_row(i, s, a) for i, (s, a) in enumerate(zip(sig, accounts))]
    cells[3] += f" WHERE symbol IN ({allowed})"
    return {
        "dca_trials": " UNION ALL ".join(rows),
        "signal_trials": " UNION ALL ".join(cells),
        "dca_unmeasured": f"WITH {PANEL}, n AS (SELECT symbol, count(*) AS bars FROM panel GROUP BY symbol), k AS ({needs}) SELECT symbol, cell, 'history_shorter_than_horizon' AS reason FROM n JOIN k ON bars <= needs{named}",
        "signal_unmeasured": f"{levels} {forbidden}",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [
        ledger_first, ledger_union, ledger_new, ledger_attributions, ledger_families, ledger_runs, ledger_best, ledger_revisions, newest_per_cell, pending_pairs, measured_symbols,
        symbol_sets, uses_closed_form, skip_reasons, grid_expand, surface_best, plateau, common_starts, modal_horizon, split_scores, overfitting, overfitting_best, overfitting_signals, dca_trials, dca_unmeasured, signal_trials, signal_unmeasured, synthetic_paths, best_of_grid, best_of_rates, best_of_signals, grid_rates, rule_calmars,
        cost_stress, walk_forward, regime_consistency, clock_drift, disqualifiers, target_candidates, best_within_limit, stop_condition, stop_state, cycle_report, vote_tally, duty_cycle, merged_timeline, findings,
        survivorship, hashed_sample, listed_symbols, merged_settlements, complete_days, missing_days, resumed_ingest, lifecycle, development_rows,
    ]
    return {f.__name__: f for f in names}


IDENT = "config_hash, symbol, evaluator, panel_hash, code_hash"
FIRST = f"first_of AS (SELECT *, row_number() OVER (PARTITION BY {IDENT} ORDER BY created_utc, trial_id) AS k FROM trials)"
NEWEST = """newest AS (SELECT *, row_number() OVER (PARTITION BY hypothesis_id, symbol, config_hash ORDER BY created_utc DESC, trial_id DESC) AS k FROM trials
  WHERE holdout_state = 'DEVELOPMENT' AND hypothesis_id IS NOT NULL),
recorded AS (SELECT *, CAST(json_extract_string(metrics_json, '$.tm_q05') AS DOUBLE) AS tm, CAST(json_extract_string(metrics_json, '$.mwrr_q05') AS DOUBLE) AS mw,
  CAST(json_extract_string(metrics_json, '$.liquidation_rate') AS DOUBLE) AS lr FROM newest WHERE k = 1)"""


def _cfg(k: str) -> str:
    return f"json_extract_string(config_json, '$.{k}')"


def _grid_sql() -> str:
    parts, cell = [], 0
    for j, n in enumerate(GRID["n"]):
        for i, k in enumerate(GRID["stride"]):
            p = Plan(stride=k, n=n, hold=48)
            paid, put = p.amount / (1 + p.c_in), p.amount * n
            parts.append(
                f"""SELECT symbol, {cell} AS cell, {i} AS stride_ord, {j} AS n_ord, {p.horizon} AS horizon, bar_idx AS start_idx, {paid!r} * u * fin * {1 - p.c_out!r} / {put!r} AS tm FROM (
SELECT symbol, bar_idx, sum(1.0 / close) OVER w AS u, count(*) OVER w AS n, lead(close, {p.horizon}) OVER {WIN}) AS fin FROM panel
WINDOW w AS (PARTITION BY symbol, bar_idx % {k} ORDER BY bar_idx ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) WHERE n = {n} AND fin IS NOT NULL"""
            )
            cell += 1
    return f"WITH {PANEL}, outcomes AS ({' UNION ALL '.join(parts)})"


SURFACE = "surf AS (SELECT symbol, cell, stride_ord, n_ord, round(quantile_cont(tm, 0.05), 9) AS v FROM outcomes GROUP BY ALL)"
PEAK = "peak AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY v DESC, cell) AS k FROM surf)"
SPLITS = f"""cnt AS (SELECT symbol, count(DISTINCT cell) AS g FROM outcomes WHERE horizon = {MODAL_HORIZON} GROUP BY 1),
com AS (SELECT o.symbol, start_idx FROM outcomes o JOIN cnt USING (symbol) WHERE horizon = {MODAL_HORIZON} GROUP BY o.symbol, start_idx, cnt.g HAVING count(DISTINCT cell) = cnt.g),
mat AS (SELECT o.* FROM outcomes o JOIN com USING (symbol, start_idx) WHERE horizon = {MODAL_HORIZON}),
rws AS (SELECT symbol, start_idx, ntile(10) OVER (PARTITION BY symbol ORDER BY start_idx) - 1 AS b FROM (SELECT DISTINCT symbol, start_idx FROM mat)),
blk AS (SELECT symbol, cell, b, sum(tm) AS s, count(*) AS n FROM mat JOIN rws USING (symbol, start_idx) GROUP BY ALL),
spl AS (SELECT i AS split FROM range(1024) r(i) WHERE bit_count(i::INTEGER) = 5),
sc AS (SELECT symbol, CAST(split AS INTEGER) AS split, cell, sum(CASE WHEN (split >> b) & 1 = 1 THEN s END) / sum(CASE WHEN (split >> b) & 1 = 1 THEN n END) AS inside,
  sum(CASE WHEN (split >> b) & 1 = 0 THEN s END) / sum(CASE WHEN (split >> b) & 1 = 0 THEN n END) AS outside FROM blk, spl GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    sym = lambda t: f"SELECT upper(trim(symbol)) AS symbol FROM {t} WHERE symbol IS NOT NULL"
    g = _grid_sql()
    gate = f"lower(coalesce({_cfg('gate')}, 'none'))"
    num = lambda k: f"TRY_CAST({_cfg(k)} AS DOUBLE)"
    pos = "pos AS (SELECT *, upper(trim(symbol)) AS s FROM positioning WHERE symbol IS NOT NULL)"
    sig = "concat_ws('|', " + ", ".join(f"coalesce({_cfg(k)}, '~')" for k in ("contribution", "gate", "include_funding", "leverage", "n_contributions", "stop_loss", "stride_days", "take_profit")) + ")"
    return _trial_sql() | _robust_sql() | _state_sql(sig) | {
        "ledger_first": f"WITH {FIRST} SELECT trial_id, symbol, evaluator, config_hash FROM first_of WHERE k = 1",
        "ledger_union": f"""WITH u AS (SELECT * FROM trials WHERE evaluator = 'analytic' OR created_utc < '2019-07-01' UNION ALL SELECT * FROM trials WHERE evaluator <> 'analytic' OR created_utc >= '2019-07-01'),
f AS (SELECT *, row_number() OVER (PARTITION BY {IDENT} ORDER BY created_utc, trial_id) AS k FROM u) SELECT trial_id, config_hash FROM f WHERE k = 1""",
        "ledger_new": f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY {IDENT} ORDER BY created_utc, trial_id) AS k FROM trials WHERE created_utc >= '2019-07-01')
SELECT trial_id, config_hash FROM f WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM trials t WHERE t.created_utc < '2019-07-01' AND t.config_hash = f.config_hash AND t.symbol = f.symbol AND t.evaluator = f.evaluator
  AND t.panel_hash = f.panel_hash AND t.code_hash = f.code_hash)""",
        "ledger_attributions": f"""WITH f AS (SELECT hypothesis_id, created_utc, first_value(trial_id) OVER (PARTITION BY {IDENT} ORDER BY created_utc, trial_id) AS first_id FROM trials)
SELECT first_id AS trial_id, hypothesis_id, min(created_utc) AS first_seen_utc FROM f WHERE hypothesis_id IS NOT NULL GROUP BY 1, 2""",
        "ledger_families": "SELECT family, count(*) AS n, max(created_utc) AS latest FROM trials GROUP BY family",
        "ledger_runs": """SELECT run_id, count(*) AS n, min(created_utc) AS first_utc, max(created_utc) AS last_utc, string_agg(DISTINCT family, ',' ORDER BY family) AS families, count(DISTINCT symbol) AS symbols
FROM trials GROUP BY run_id""",
        "ledger_best": """SELECT trial_id, symbol, CAST(json_extract_string(metrics_json, '$.mwrr_q05') AS DOUBLE) AS value FROM trials
WHERE json_extract_string(metrics_json, '$.mwrr_q05') IS NOT NULL ORDER BY value DESC, trial_id LIMIT 10""",
        "ledger_revisions": "SELECT symbol, count(DISTINCT code_hash) AS code_revisions, count(DISTINCT panel_hash) AS panel_revisions FROM trials GROUP BY symbol",
        "newest_per_cell": """SELECT trial_id, hypothesis_id, symbol, config_hash FROM (SELECT *, row_number() OVER (PARTITION BY hypothesis_id, symbol, config_hash ORDER BY created_utc DESC, trial_id DESC) AS k FROM trials) WHERE k = 1""",
        "pending_pairs": """SELECT DISTINCT hypothesis_id, symbol FROM documents t WHERE hypothesis_id IS NOT NULL AND symbol IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM trials d WHERE d.holdout_state = 'DEVELOPMENT' AND d.hypothesis_id = t.hypothesis_id AND d.symbol = t.symbol)""",
        "measured_symbols": f"SELECT DISTINCT symbol FROM ({sym('funding')}) WHERE symbol IN (SELECT symbol FROM trials)",
        "symbol_sets": f"""WITH b AS ({sym('panel_1h')}), f AS ({sym('funding')}), p AS ({sym('positioning')})
SELECT 'any' AS set, symbol FROM (SELECT symbol FROM b UNION SELECT symbol FROM f UNION SELECT symbol FROM p)
UNION ALL SELECT 'all', symbol FROM (SELECT symbol FROM b INTERSECT SELECT symbol FROM f INTERSECT SELECT symbol FROM p)
UNION ALL SELECT 'bars_only', symbol FROM (SELECT symbol FROM b EXCEPT SELECT symbol FROM f) UNION ALL SELECT 'funding_only', symbol FROM (SELECT symbol FROM f EXCEPT SELECT symbol FROM b)""",
        "uses_closed_form": f"""SELECT trial_id, coalesce({_cfg('gate')}, 'none') = 'none' AND coalesce({num('leverage')}, 1.0) = 1.0 AND {num('take_profit')} IS NULL AND {num('stop_loss')} IS NULL
  AND NOT coalesce({_cfg('include_funding')} = 'true', true) AS closed_form FROM trials""",
        "skip_reasons": f"""WITH r AS (SELECT CASE WHEN NOT regexp_full_match({gate}, '(none|dip:[0-9]*\\.?[0-9]+:[0-9]+|sma:[0-9]+)') THEN 'gate_not_understood'
  WHEN {num('stride_days')} * 24 < 1 THEN 'stride_under_one_bar' WHEN ({num('n_contributions')} - 1) * {num('stride_days')} + {num('hold_days')} >= 100 THEN 'horizon_longer_than_history' END AS reason FROM trials)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason""",
        "grid_expand": f"SELECT symbol, CAST(k AS BIGINT) AS stride, CAST(n AS BIGINT) AS n FROM (SELECT DISTINCT symbol FROM panel_1h WHERE symbol IS NOT NULL), (SELECT unnest({GRID['stride']}) AS k), (SELECT unnest({GRID['n']}) AS n)",
        "surface_best": f"{g}, {SURFACE}, {PEAK} SELECT symbol, CAST(cell AS INTEGER) AS cell, round(v, 7) AS tm_q05 FROM peak WHERE k = 1",
        "plateau": f"""{g}, {SURFACE}, {PEAK}, nb AS (SELECT s.symbol, count(*) AS cells, max(p.v) AS peak, count_if(abs(s.stride_ord - p.stride_ord) + abs(s.n_ord - p.n_ord) = 1) AS neighbours,
  avg(CASE WHEN abs(s.stride_ord - p.stride_ord) + abs(s.n_ord - p.n_ord) = 1 THEN s.v END) AS m FROM surf s JOIN peak p ON s.symbol = p.symbol AND p.k = 1 GROUP BY s.symbol),
r AS (SELECT *, CASE WHEN peak > 0 AND cells >= 3 THEN m / peak END AS ratio FROM nb)
SELECT symbol, cells, round(peak, 7) AS peak, CAST(neighbours AS BIGINT) AS neighbours, round(m, 7) AS neighbour_mean, round(ratio, 6) AS ratio,
  CASE WHEN peak <= 0 THEN 'UNMEASURABLE' WHEN ratio IS NULL THEN 'NONE' WHEN ratio > 0.9 THEN 'PLATEAU' WHEN ratio > 0.7 THEN 'SLOPE' ELSE 'SPIKE' END AS shape FROM r""",
        "common_starts": f"""{g}, c AS (SELECT symbol, count(DISTINCT cell) AS g FROM outcomes GROUP BY 1) SELECT o.symbol, start_idx FROM outcomes o JOIN c USING (symbol) GROUP BY o.symbol, start_idx, c.g HAVING count(DISTINCT cell) = c.g""",
        "modal_horizon": f"""{g}, c AS (SELECT symbol, horizon, count(*) AS n, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, min(cell)) AS k FROM outcomes GROUP BY 1, 2)
SELECT symbol, CAST(horizon AS INTEGER) AS horizon, n FROM c WHERE k = 1""",
        "split_scores": f"{g}, {SPLITS} SELECT symbol, split, CAST(cell AS INTEGER) AS cell, round(inside, 9) AS inside, round(outside, 9) AS outside FROM sc",
        "overfitting_best": f"""{g}, {SURFACE}, {PEAK}, bst AS (SELECT p.symbol, p.cell AS best, h.horizon FROM peak p JOIN (SELECT DISTINCT symbol, cell, horizon FROM outcomes) h ON p.symbol = h.symbol AND p.cell = h.cell WHERE p.k = 1),
same AS (SELECT o.*, b.best FROM outcomes o JOIN bst b ON o.symbol = b.symbol AND o.horizon = b.horizon),
siz AS (SELECT symbol, best, horizon, count(DISTINCT cell) AS cells, count(DISTINCT start_idx) AS starts FROM same GROUP BY ALL),
sta AS (SELECT *, CASE WHEN cells < 2 THEN 'fewer than two share a horizon' WHEN starts < 100 OR starts < horizon THEN 'too few common starts' ELSE 'ok' END AS status FROM siz),
mat AS (SELECT o.* FROM same o JOIN sta USING (symbol) WHERE status = 'ok'),
{SPLITS[SPLITS.index("rws AS"):]}, rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, split ORDER BY inside DESC, cell) AS i, row_number() OVER (PARTITION BY symbol, split ORDER BY outside, cell) AS o,
  count(*) OVER (PARTITION BY symbol, split) AS g FROM sc), w AS (SELECT *, ln((o / (g + 1)) / (1 - o / (g + 1))) AS l FROM rk WHERE i = 1),
a AS (SELECT symbol, avg((l <= 0)::INT) AS pbo, avg((outside < inside)::INT) AS deg, quantile_cont(l, 0.5) AS ml FROM w GROUP BY symbol)
SELECT sta.symbol, CAST(best AS INTEGER) AS best, CAST(horizon AS INTEGER) AS horizon, cells, status, round(pbo, 6) AS pbo, round(deg, 6) AS degraded_fraction, round(ml, 6) + 0.0 AS median_logit,
  CASE WHEN pbo >= 0.5 THEN 'NOISE' WHEN pbo >= 0.25 THEN 'WEAK' WHEN pbo IS NOT NULL THEN 'INFORMATIVE' END AS verdict FROM sta LEFT JOIN a USING (symbol)""",
        "overfitting": f"""{g}, {SPLITS}, rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, split ORDER BY inside DESC, cell) AS i, row_number() OVER (PARTITION BY symbol, split ORDER BY outside, cell) AS o,
  count(*) OVER (PARTITION BY symbol, split) AS g FROM sc), w AS (SELECT *, ln((o / (g + 1)) / (1 - o / (g + 1))) AS l FROM rk WHERE i = 1 AND g >= 2),
a AS (SELECT symbol, count(*) AS splits, max(g) AS configurations, avg((l <= 0)::INT) AS pbo, avg((outside < inside)::INT) AS deg, quantile_cont(l, 0.5) AS ml FROM w GROUP BY symbol)
SELECT symbol, splits, configurations, round(pbo, 6) AS pbo, round(deg, 6) AS degraded_fraction, round(ml, 6) + 0.0 AS median_logit, CASE WHEN pbo >= 0.5 THEN 'NOISE' WHEN pbo >= 0.25 THEN 'WEAK' ELSE 'INFORMATIVE' END AS verdict FROM a""",
        "disqualifiers": f"""WITH {NEWEST}, b AS (SELECT *, row_number() OVER (PARTITION BY hypothesis_id, symbol ORDER BY tm DESC, trial_id) AS j FROM recorded WHERE tm IS NOT NULL AND NOT isnan(tm))
SELECT hypothesis_id, symbol, trial_id, concat_ws('; ', CASE WHEN tm <= 1.0 THEN 'at or below 1.0' END, CASE WHEN lr IS NULL THEN 'shape unmeasured' WHEN lr > 0.05 THEN 'spike' END,
  CASE WHEN n_starts IS NULL THEN 'path count unmeasured' WHEN n_starts / 1000.0 < 5 THEN format('{{:.2f}}', n_starts / 1000.0) || ' paths' END, 'search test unmeasured') AS reasons FROM b WHERE j = 1""",
        "target_candidates": f"""WITH {NEWEST}, r AS (SELECT hypothesis_id, {sig} AS signature, symbol, tm, lr FROM recorded WHERE tm >= 1.0 AND lr <= 0.25)
SELECT hypothesis_id, signature, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols, count(DISTINCT symbol) AS n_symbols, min(tm) AS worst_cagr, max(tm) AS best_cagr FROM r GROUP BY 1, 2""",
        "best_within_limit": f"""WITH {NEWEST}, r AS (SELECT * FROM recorded WHERE mw IS NOT NULL AND lr IS NOT NULL)
SELECT 'best' AS which, trial_id, mw AS mwrr_q05, lr AS liquidation_rate FROM (SELECT * FROM r ORDER BY mw DESC, trial_id LIMIT 1)
UNION ALL SELECT 'best_within_limit', trial_id, mw, lr FROM (SELECT * FROM r WHERE lr <= 0.005 ORDER BY mw DESC, trial_id LIMIT 1)""",
        "vote_tally": f"""WITH {NEWEST}, v AS (SELECT symbol, family, CASE WHEN tm >= 1.0 THEN 'CONTINUE' ELSE 'CLOSE' END AS vote FROM recorded WHERE tm IS NOT NULL),
p AS (SELECT symbol, family, max(vote) AS vote FROM v GROUP BY 1, 2 HAVING count(DISTINCT vote) = 1)
SELECT symbol, count(*) AS voters, CASE WHEN count(DISTINCT vote) = 1 THEN max(vote) ELSE 'SPLIT' END AS outcome FROM p GROUP BY symbol""",
        "duty_cycle": """WITH s AS (SELECT family, epoch_us(try_strptime(created_utc, '%Y-%m-%d %H:%M:%S')) AS a FROM trials), t AS (SELECT family, a, a + 5400000000 AS b FROM s WHERE a IS NOT NULL),
u AS (SELECT *, max(b) OVER (PARTITION BY family ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM t),
v AS (SELECT *, (seen IS NULL OR a > seen)::INT AS new, CASE WHEN a > seen THEN a - seen END AS gap FROM u),
w AS (SELECT *, sum(new) OVER (PARTITION BY family ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isle FROM v),
x AS (SELECT family, isle, min(a) AS a, max(b) AS b, count(*) AS n, max(gap) AS g FROM w GROUP BY 1, 2)
SELECT family, CAST(sum(n) AS BIGINT) AS spans, count(*) AS islands, CAST(sum(b - a) / 1000000.0 AS DOUBLE) AS busy_s, (max(b) - min(a)) / 1000000.0 AS window_s, round(CAST(sum(b - a) AS DOUBLE) / (max(b) - min(a)), 9) AS duty,
  coalesce(max(g), 0) / 1000000.0 AS largest_gap_s FROM x GROUP BY family""",
        "merged_timeline": """WITH l AS (SELECT run_id, max(created_utc) AS at_, count(*) AS n FROM trials WHERE evaluator = 'analytic' GROUP BY 1), r AS (SELECT run_id, max(created_utc) AS at_, count(*) AS n FROM trials WHERE evaluator <> 'analytic' GROUP BY 1)
SELECT coalesce(l.run_id, r.run_id) AS run_id, coalesce(l.at_, r.at_) AS "at", l.n AS log_rows, r.n AS ledger_rows FROM l FULL JOIN r ON l.run_id = r.run_id""",
        "findings": """WITH d AS (SELECT source AS file, hypothesis_id AS what, created_utc AS c FROM documents WHERE hypothesis_id IS NOT NULL)
SELECT substr(sha256(concat_ws('|', file, what)), 1, 12) AS finding_id, file, what, min(c) >= TIMESTAMP '2020-01-01' AS is_new FROM d WHERE c IS NOT NULL GROUP BY file, what""",
        "survivorship": f"""{g}, e AS (SELECT symbol, max(ts) AS z FROM panel GROUP BY 1), t AS (SELECT symbol, quantile_cont(tm, 0.5) AS tm FROM outcomes WHERE cell = 4 GROUP BY 1)
SELECT z >= (SELECT max(z) FROM e) - INTERVAL 7 DAY AS alive, count(tm) AS n, round(quantile_cont(tm, 0.5), 8) AS median FROM t JOIN e USING (symbol) GROUP BY 1""",
        "listed_symbols": "SELECT DISTINCT symbol FROM raw_1m WHERE symbol IS NOT NULL",
        "merged_settlements": """WITH f AS (SELECT upper(trim(symbol)) AS symbol, date_trunc('millisecond', ts) AS t, funding_rate, interval_hours, ts >= TIMESTAMP '2019-09-01' AS part FROM funding
  WHERE symbol IS NOT NULL AND ts IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY part, funding_rate NULLS FIRST, interval_hours NULLS FIRST) AS k FROM f)
SELECT symbol, strftime(t, '%Y-%m-%d %H:%M:%S.%g') AS ts, funding_rate, CAST(interval_hours AS DOUBLE) AS interval_hours FROM k WHERE k = 1""",
        "complete_days": f"""WITH {pos}, o AS (SELECT * FROM pos WHERE open_interest IS NOT NULL), g AS (SELECT s, CAST(ts AS DATE) AS d FROM o GROUP BY 1, 2 HAVING count(*) >= 97.5)
SELECT reading_id, o.s AS symbol FROM o JOIN g ON o.s = g.s AND CAST(o.ts AS DATE) = g.d""",
        "missing_days": f"""WITH {pos}, q AS (SELECT s, CAST(ts AS DATE) AS d, count(open_interest) AS n FROM pos WHERE ts IS NOT NULL GROUP BY 1, 2),
w AS (SELECT s, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM q GROUP BY s)
SELECT w.s AS symbol, strftime(w.d, '%Y-%m-%d') AS day FROM w WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.s = w.s AND q.d = w.d AND q.n >= 97.5)""",
        "resumed_ingest": f"""WITH {pos}, k AS (SELECT reading_id, row_number() OVER (PARTITION BY s, ts ORDER BY ingested_at >= TIMESTAMP '2019-09-01' DESC, reading_id DESC) AS k FROM pos WHERE ts IS NOT NULL AND ingested_at IS NOT NULL)
SELECT reading_id FROM k WHERE k = 1""",
        "lifecycle": "SELECT symbol, strftime(min(ts), '%Y-%m') AS first_month, strftime(max(ts), '%Y-%m') AS last_month, symbol IN (SELECT symbol FROM trials) AS still_listed FROM panel_1h WHERE symbol IS NOT NULL AND ts IS NOT NULL GROUP BY symbol",
        "development_rows": """SELECT symbol, count(*) AS rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM panel_1h WHERE symbol IS NOT NULL AND ts < TIMESTAMP '2019-08-01' GROUP BY symbol""",
    }
