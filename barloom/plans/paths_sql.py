"""SQL that goes bar by bar, for the evaluators whose state depends on what came before: recursive queries."""

from __future__ import annotations

from barloom import constants as K
from barloom.operators.analytic import HIGH, LOW, Plan
from barloom.operators.signal import Account
from barloom.plans.shared import PANEL


def tier_case(field: int, notional: str) -> str:
    """A field of the margin tier of a notional, by the column `tier`."""

    def case(name: str) -> str:
        t = K.TIERS[name]
        return "CASE " + " ".join(f"WHEN abs({notional}) <= {x[0]!r} THEN {x[field]!r}" for x in t[:-1]) + f" ELSE {t[-1][field]!r} END"

    return f"CAST(CASE tier WHEN 'BTC_LIKE' THEN {case('BTC_LIKE')} WHEN 'MAJOR_ALT' THEN {case('MAJOR_ALT')} ELSE {case('LONG_TAIL')} END AS DOUBLE)"


TIER_OF = f"CASE WHEN symbol IN {K.BTC_SYMBOLS} THEN 'BTC_LIKE' WHEN symbol IN {K.MAJOR_SYMBOLS} THEN 'MAJOR_ALT' ELSE 'LONG_TAIL' END AS tier"


def paths(plan: Plan, leverages: tuple[float, ...], take: float | None = None, stop: float | None = None, gate: str = "true", step: int = 24, gate_ctes: str = "") -> str:
    """CTEs up to ended(symbol, s, lev, reason, e, value, put, paid, dd, loss, under): every step-th start, one bar at a time."""
    h = plan.horizon
    take_if = f"WHEN gain / put >= {take!r} THEN 2" if take is not None else ""
    stop_if = f"WHEN gain / put <= {-stop!r} THEN 3" if stop is not None else ""
    return f"""WITH RECURSIVE {PANEL}{gate_ctes},
gated AS MATERIALIZED (SELECT *, {gate} AS open_gate FROM {'g' if gate_ctes else 'panel'}),
size AS (SELECT symbol, count(*) AS n FROM gated GROUP BY symbol),
path AS (
  SELECT symbol, {TIER_OF}, bar_idx AS s, lev, CAST(-1 AS BIGINT) AS e, 0.0::DOUBLE AS wallet, 0.0::DOUBLE AS qty, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS put, 0.0::DOUBLE AS idle,
         0.0::DOUBLE AS paid, 0.0::DOUBLE AS peak, 0.0::DOUBLE AS dd, 0 AS loss, 0 AS under, CAST(NULL AS INTEGER) AS reason, 0.0::DOUBLE AS value
  FROM gated JOIN size USING (symbol), (SELECT unnest({[float(x) for x in leverages]!r}) AS lev)
  WHERE bar_idx % {step} = 0 AND bar_idx < n - {h} - 1
  UNION ALL
  SELECT symbol, tier, s, lev, e, CASE WHEN dead THEN wallet ELSE cash END, CASE WHEN dead THEN qty ELSE q2 END, c2, CASE WHEN dead THEN put0 ELSE put END, i2, paid + CASE WHEN dead THEN 0.0 ELSE due END,
         greatest(peak, gain), CASE WHEN dead THEN greatest(dd1, peak + put0) ELSE greatest(dd1, greatest(peak, gain) - gain) END,
         loss + CASE WHEN NOT dead AND gain < 0 THEN 1 ELSE 0 END, under + CASE WHEN NOT dead AND gain < greatest(peak, gain) - 1e-12 THEN 1 ELSE 0 END,
         CASE WHEN dead THEN 1 {take_if} {stop_if} WHEN e = {h} THEN 0 END,
         CASE WHEN dead THEN 0.0 ELSE cash + q2 * close * {1 - plan.c_out!r} - c2 END
  FROM (SELECT *, cash + q2 * close - c2 - put AS gain FROM (
    SELECT *, wallet + dep - due AS cash FROM (
    SELECT *, q2 * close * funding_rate AS due, put0 + dep AS put FROM (
    SELECT *, qty + go * lev / (close * {1 + plan.c_in!r}) AS q2, cost + go * lev AS c2, idle + dep - go AS i2 FROM (
    SELECT *, CASE WHEN open_gate THEN idle + dep ELSE 0.0 END AS go FROM (
    SELECT r.symbol, r.tier, r.s, r.lev, r.e + 1 AS e, r.wallet, r.qty, r.cost, r.put AS put0, r.idle, r.paid, r.peak, r.loss, r.under, p.close, p.funding_rate, p.open_gate,
           r.qty > 0 AND r.wallet + r.qty * p.low - r.cost <= r.qty * p.low * {tier_case(1, 'r.qty * p.low')} - {tier_case(2, 'r.qty * p.low')} AS dead,
           CASE WHEN r.qty > 0 THEN greatest(r.dd, r.peak - (r.wallet + r.qty * p.low - r.cost - r.put)) ELSE r.dd END AS dd1,
           CASE WHEN (r.e + 1) % {plan.stride} = 0 AND (r.e + 1) // {plan.stride} < {plan.n} THEN {plan.amount!r} ELSE 0.0 END AS dep
    FROM path r JOIN gated p ON p.symbol = r.symbol AND p.bar_idx = r.s + r.e + 1 WHERE r.reason IS NULL AND r.e < {h}))))))),
ended AS (SELECT * FROM path WHERE reason IS NOT NULL)"""


PATH_COLUMNS = """SELECT symbol, s AS start_idx, CAST(reason AS BIGINT) AS exit_reason, e AS exit_bar, reason = 1 AS liquidated, round(value / put, 6) AS terminal_multiple, round(dd / put, 6) AS max_dd_total,
  round(loss / (e + 1.0), 6) AS frac_time_in_loss, round(paid, 6) + 0.0 AS funding_paid FROM ended"""


def deals(signals: str, a: Account) -> str:
    """CTEs up to deal(...) and line(symbol, bar_idx, equity): one account per symbol, one bar at a time.

    `signals` are CTEs up to sig(symbol, bar_idx, entry, exit).
    """
    lim = lambda c, sign: f"fill {'+' if sign > 0 else '-'} side * {c!r} * cash / qty"
    hit = lambda c, sign, path: "false" if c is None else f"{'-' if sign < 0 else ''}side * ({path} - ({lim(c, sign)})) >= 0"
    steps = ["SELECT *, CASE WHEN side > 0 THEN low ELSE high END AS bad, CASE WHEN side > 0 THEN high ELSE low END AS good, acc - side * qty * close * funding_rate AS acc2 FROM bar"]
    steps.append("SELECT *, cash + least(acc, acc2) AS w, fill AS l0 FROM s0")
    for i in range(3):
        r, c = tier_case(1, f"qty * l{i}"), tier_case(2, f"qty * l{i}")
        steps.append(f"SELECT *, greatest((qty * fill - side * (w + {c})) / nullif(qty * (1.0 - side * {r}), 0), 0.0) AS l{i + 1} FROM s{i + 1}")
    hold = "false" if a.max_hold is None else f"bar_idx - opened >= {a.max_hold}"
    why = f"CASE WHEN side = 0 OR bar_idx <= opened THEN NULL WHEN side * (bad - l3) <= 0 THEN 'liquidation' WHEN {hit(a.stop_loss, -1, 'bad')} THEN 'stop_loss' WHEN {hit(a.take_profit, 1, 'good')} THEN 'take_profit' WHEN {hold} THEN 'max_hold' WHEN leave OR bar_idx = n - 1 THEN 'signal' END"
    steps.append(f"SELECT *, {why} AS why FROM s4")
    price = f"CASE why WHEN 'liquidation' THEN l3 WHEN 'stop_loss' THEN ({lim(a.stop_loss or 0.0, -1)}) * (1.0 - side * {a.cost!r}) WHEN 'take_profit' THEN ({lim(a.take_profit or 0.0, 1)}) * (1.0 - side * {a.cost!r}) ELSE close * (1.0 - side * {a.cost!r}) END"
    steps.append(f"SELECT *, CASE WHEN why IS NOT NULL THEN {price} END AS out_price FROM s5")
    steps.append("SELECT *, CASE WHEN why = 'liquidation' THEN -cash WHEN why IS NOT NULL THEN side * qty * (out_price - fill) + acc2 END AS pnl FROM s6")
    # A signal of the bar before opens here, if the account was free then and there is a bar left to leave in.
    opens = "side = 0 AND cash > 0 AND asked <> 0 AND bar_idx <= n - 2"
    nested = steps[0]
    for i, q in enumerate(steps[1:]):
        nested = q.replace(f"FROM s{i}", f"FROM ({nested})")
    return f"""{signals},
m AS MATERIALIZED (SELECT p.symbol, p.bar_idx, p.close, p.high, p.low, p.funding_rate, CAST(s.entry AS INTEGER) AS entry, s.exit AS leaving, count(*) OVER (PARTITION BY p.symbol) AS n, {TIER_OF.replace('symbol IN', 'p.symbol IN')}
  FROM panel p JOIN sig s ON s.symbol = p.symbol AND s.bar_idx = p.bar_idx),
walk AS (
  SELECT symbol, CAST(-1 AS BIGINT) AS bar_idx, CAST(0 AS INTEGER) AS asked, {a.capital!r}::DOUBLE AS cash, 0 AS side, CAST(0 AS BIGINT) AS opened, 0.0::DOUBLE AS fill, 0.0::DOUBLE AS qty, 0.0::DOUBLE AS acc, false AS leave,
         CAST(0 AS BIGINT) AS trade, CAST(NULL AS VARCHAR) AS why, 0.0::DOUBLE AS out_price, 0.0::DOUBLE AS pnl, 0.0::DOUBLE AS funding, 0.0::DOUBLE AS equity,
         0 AS o_side, CAST(0 AS BIGINT) AS o_at, 0.0::DOUBLE AS o_fill, 0.0::DOUBLE AS o_qty
  FROM (SELECT DISTINCT symbol FROM m)
  UNION ALL
  SELECT symbol, bar_idx, CASE WHEN why IS NOT NULL THEN 0 ELSE entry END, CASE WHEN why IS NOT NULL THEN cash + pnl ELSE cash END,
         CASE WHEN why IS NOT NULL THEN 0 WHEN {opens} THEN sign(asked) ELSE side END, CASE WHEN {opens} THEN bar_idx ELSE opened END,
         CASE WHEN {opens} THEN close * (1.0 + sign(asked) * {a.cost!r}) ELSE fill END, CASE WHEN {opens} THEN cash * {a.leverage!r} / (close * (1.0 + sign(asked) * {a.cost!r})) ELSE qty END,
         CASE WHEN {opens} THEN 0.0 ELSE acc2 END, leaving, trade + CASE WHEN why IS NOT NULL THEN 1 ELSE 0 END, why, out_price, pnl, acc2,
         CASE WHEN why IS NOT NULL THEN cash + pnl WHEN {opens} THEN cash * (1 + {a.leverage!r} * sign(asked) * (1.0 / (1.0 + sign(asked) * {a.cost!r}) - 1.0))
              WHEN side <> 0 THEN greatest(cash + side * qty * (close - fill) + acc2, 0.0) ELSE cash END, side, opened, fill, qty
  FROM ({nested.replace('FROM bar', '''FROM (SELECT w.symbol, m.bar_idx, w.asked, w.cash, w.side, w.opened, w.fill, w.qty, w.acc, w.leave, w.trade, m.close, m.high, m.low, m.funding_rate, m.entry, m.leaving, m.n, m.tier
    FROM walk w JOIN m ON m.symbol = w.symbol AND m.bar_idx = w.bar_idx + 1)''')})),
line AS (SELECT symbol, bar_idx, equity FROM walk WHERE bar_idx >= 0),
deal AS (SELECT symbol, trade - 1 AS trade, CAST(o_side AS BIGINT) AS side, o_at AS entry_bar, bar_idx AS exit_bar, bar_idx - o_at AS bars_held, o_fill AS entry_price, out_price AS exit_price, why AS reason, o_qty AS qty,
         funding, CASE WHEN why = 'liquidation' THEN pnl - funding ELSE o_side * o_qty * (out_price - o_fill) END AS gross, pnl, CASE WHEN why = 'liquidation' THEN 0.0 ELSE cash END AS equity_after
  FROM walk WHERE why IS NOT NULL)"""


def rates(value: str, put: float, n: int, gap: float, years: str, source: str, keys: str = "symbol, start_idx", count: str | None = None, steps: int = 80) -> str:
    """CTEs up to solved(keys, rate): bisection, one half at a time; `count` is a column of deposits made, n at most."""
    made = lambda j: f"{put!r} * pow(1 + RATE, {-gap * j!r})" if count is None else f"CASE WHEN {count} > {j} THEN {put!r} * pow(1 + RATE, {-gap * j!r}) ELSE 0.0 END"
    form = f"({value} * pow(1 + RATE, -({years})) - " + " - ".join(made(j) for j in range(n)) + ")"
    npv = lambda r: form.replace("RATE", r)
    kept = ", ".join(dict.fromkeys([*keys.split(", "), value, *([count] if count else []), *([years] if years.isidentifier() else [])]))
    mid = "(lo + hi) / 2"
    return f"""halves AS (
  SELECT {kept}, {LOW!r}::DOUBLE AS lo, {HIGH!r}::DOUBLE AS hi, 0 AS i FROM {source} WHERE {value} > 1e-12 AND sign({npv(repr(LOW))}) <> sign({npv(repr(HIGH))})
  UNION ALL
  SELECT {kept}, CASE WHEN {npv(mid)} > 0 THEN {mid} ELSE lo END, CASE WHEN {npv(mid)} > 0 THEN hi ELSE {mid} END, i + 1 FROM halves WHERE i < {steps}),
solved AS (SELECT {keys}, (lo + hi) / 2 AS rate FROM halves WHERE i = {steps}
  UNION ALL SELECT {keys}, CASE WHEN {value} <= 1e-12 THEN -1.0 WHEN {npv(repr(LOW))} < 0 THEN {LOW!r} ELSE {HIGH!r} END FROM {source} WHERE {value} <= 1e-12 OR sign({npv(repr(LOW))}) = sign({npv(repr(HIGH))}))"""
