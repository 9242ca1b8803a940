import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import analytic, grid, inference, ledger, ops, robustness, surface, verdict, report
from barloom.operators.analytic import Plan
from barloom.operators.grid import Hypothesis
from barloom.operators.signal import Account
from barloom.plans import search

T0 = dt.datetime(2024, 1, 1)


# Grids


def hyp(**kw):
    base = dict(id="H1", family="f", claim="c", kill_condition="k", universe=("B", "A"), grid={"x": [1, 2, 3], "y": ["p", "q"]}, fixed={"z": 1.0})
    return Hypothesis(**(base | kw))


def test_expansion_and_ordinals(spark):
    cells = hyp().expand()
    assert len(cells) == 12 and cells[0] == {"z": 1.0, "x": 1, "y": "p", "symbol": "A"} and cells[1]["y"] == "q"
    d = hyp().cell_frame(spark).orderBy("cell").collect()
    assert [(r.x_ord, r.y_ord, r.symbol) for r in d][:7] == [(0, 0, "A"), (0, 1, "A"), (1, 0, "A"), (1, 1, "A"), (2, 0, "A"), (2, 1, "A"), (0, 0, "B")]


def test_registration_hash_and_refusals():
    h = hyp()
    assert hyp(registered_hash=h.registration()).expand()
    assert h.registration() == hyp(universe=("A", "B")).registration() != hyp(track="B").registration()
    for bad in (dict(registered_hash="0" * 64), dict(fixed={"x": 1}), dict(universe=()), dict(grid={"x": []}), dict(grid={"x": [True, False, True], "y": ["p"]}), dict(grid={"x": list(range(3000))})):
        with pytest.raises(ValueError):
            hyp(**bad).expand()


def test_canonical_forms():
    assert grid.canonical_hash({"a": 1, "b": 2.0}) == grid.canonical_hash({"b": 2, "a": np.float64(1.0)})
    assert grid.canonical_hash({"a": True}) != grid.canonical_hash({"a": 1})
    assert grid.canonical([math.nan, math.inf, -math.inf, (1,)]) == ["__nan__", "__inf__", "__-inf__", [1]]
    assert not grid.is_ordinal([0.1, 0.25, None]) and grid.is_ordinal([1, 2.5, 3])
    with pytest.raises(TypeError):
        grid.canonical(object())


# Ledger

ROW = "trial_id bigint, created_utc string, hypothesis_id string, symbol string, evaluator string, config_hash string, panel_hash string, code_hash string, metrics_json string"


def trials(spark, rows):
    return spark.createDataFrame([(i, f"2024-01-{d:02d}", h, "S", "e", c, "p", "k", m) for i, d, h, c, m in rows], ROW)


def test_the_first_write_wins_and_every_attribution_stays(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ledger.Ledger(spark, f"file://{tmp_path}/none")
    book = ledger.Ledger(spark, f"file://{tmp_path}/book", create=True)
    with pytest.raises(ValueError):
        book.merge(trials(spark, []))
    one = trials(spark, [(1, 2, "H1", "a", '{"m": 1}'), (2, 1, "H2", "a", '{"m": 2}'), (3, 1, None, "b", None)])
    assert book.record(one) == 2 and book.record(one) == 0
    assert book.merge(trials(spark, [(9, 3, "H3", "a", None), (10, 3, "H3", "c", None)])) == 1
    assert sorted(r.trial_id for r in book.trials().collect()) == [2, 3, 10]
    each = {(r.config_hash, r.trial_id, r.was_new) for r in book.record_each(trials(spark, [(20, 9, "H", "a", None), (21, 9, "H", "d", None), (22, 8, "H", "d", None)])).collect()}
    assert each == {("a", 2, False), ("d", 22, True)}
    assert not any(hasattr(book, n) for n in ("update", "delete", "overwrite"))
    att = {(r.trial_id, r.hypothesis_id) for r in ledger.attributions(one).collect()}
    assert att == {(2, "H1"), (2, "H2")}


def test_null_parts_of_an_identity_are_equal(spark):
    d = trials(spark, [(1, 1, "H", None, None), (2, 2, "H", None, None)])
    assert ledger.first_of_identity(d).count() == 1
    assert ledger.new_rows(d, d).count() == 0


def test_best_ignores_what_is_no_number(spark):
    d = trials(spark, [(1, 1, "H", "a", '{"m": 2}'), (2, 1, "H", "b", '{"m": "x"}'), (3, 1, "H", "c", '{"m": 2.0}'), (4, 1, "H", "d", "broken"), (5, 1, "H", "e", '{"m": 1}')])
    assert [r.trial_id for r in ledger.best(d, "m", 2).collect()] == [1, 3]


# Surfaces


def brute_plateau(v):
    peak = max(v.values())
    if peak <= 0:
        return "UNMEASURABLE"
    if len(v) < 3:
        return "NONE"
    i, j = min((k for k in v if v[k] == peak))
    near = [v[k] for k in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if k in v]
    if not near:
        return "NONE"
    r = np.mean(near) / peak
    return "PLATEAU" if r > 0.9 else "SLOPE" if r > 0.7 else "SPIKE"


@pytest.mark.parametrize("seed", range(6))
def test_shapes(spark, seed):
    rng = np.random.default_rng(seed)
    v = {(i, j): float(rng.normal(1, [0.02, 0.1, 0.5][seed % 3])) for i in range(3) for j in range(4) if rng.random() > 0.15}
    d = spark.createDataFrame([("A", 4 * i + j, i, j, x) for (i, j), x in v.items()], "symbol string, cell int, i int, j int, v double")
    assert surface.plateau(d, "v", "cell", ["i", "j"]).first().shape == brute_plateau(v)


def test_shapes_of_little(spark):
    s = "symbol string, cell int, i int, v double"
    shape = lambda rows: surface.plateau(spark.createDataFrame(rows, s), "v", "cell", ["i"]).first().shape
    assert shape([("A", 0, 0, -1.0), ("A", 1, 1, -2.0), ("A", 2, 2, 0.0)]) == "UNMEASURABLE"
    assert shape([("A", 0, 0, 1.0), ("A", 1, 1, 1.0)]) == "NONE"
    assert shape([("A", 0, 0, None), ("A", 1, 1, float("nan")), ("A", 2, 2, None)]) == "NONE"
    d = spark.createDataFrame([("A", 5, 0, 1.0), ("A", 3, 1, 1.0)], s)
    assert surface.best_cell(d, "v", "cell").first().cell == 3


# Inference


def brute_pbo(m, blocks=6):
    parts = np.array_split(np.arange(len(m)), blocks)
    logits, worse = [], []
    for mask in inference.half_splits(blocks):
        inside = [b for b in range(blocks) if mask >> b & 1]
        i = np.concatenate([parts[b] for b in inside])
        o = np.concatenate([parts[b] for b in range(blocks) if b not in inside])
        mi, mo = m[i].mean(axis=0), m[o].mean(axis=0)
        k = int(np.argmax(mi))
        w = (np.argsort(np.argsort(mo, kind="stable"), kind="stable")[k] + 1) / (m.shape[1] + 1)
        logits.append(math.log(w / (1 - w)))
        worse.append(mo[k] < mi[k])
    return np.mean(np.array(logits) <= 0), np.mean(worse), np.median(logits)


@pytest.mark.parametrize("seed", range(3))
def test_overfitting_agrees_with_brute_force(spark, seed):
    m = np.random.default_rng(seed).normal(size=(50, 7))
    rows = [("A", i, j, float(m[i, j])) for i in range(50) for j in range(7)] + [("A", i, 99, None if i == 4 else 5.0) for i in range(50)]
    d = spark.createDataFrame(rows, "symbol string, row int, cfg int, v double")
    s = inference.split_scores(d, row="row", cfg="cfg", value="v", by=["symbol"], blocks=6)
    r = inference.overfitting(s, cfg="cfg", by=["symbol"]).first()
    assert (r.splits, r.configurations) == (20, 7)
    assert (r.pbo, r.degraded_fraction, r.median_logit) == pytest.approx(brute_pbo(m))
    with pytest.raises(ValueError):
        inference.split_scores(d, row="row", cfg="cfg", value="v", blocks=3)


def test_common_starts_and_modes(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("b", 2)], "cfg string, start int")
    assert [r.start for r in inference.common_starts(d, "cfg", "start").collect()] == [2]
    e = spark.createDataFrame([("A", 7, 1), ("A", 5, 0), ("A", 5, 3), ("A", 7, 2)], "symbol string, h int, k int")
    assert inference.modal(e, "h", "k", ["symbol"]).first().h == 5


def test_synthetic_paths_resample_the_returns(spark):
    rng = np.random.default_rng(0)
    c = np.exp(np.cumsum(rng.normal(size=100)))
    p = spark.createDataFrame([("A", i, float(x)) for i, x in enumerate(c)] + [("B", 0, 5.0)], "symbol string, bar_idx bigint, close double")
    d = inference.synthetic_paths(spark, p, paths=5, block=7).toPandas()
    assert set(d.symbol) == {"A"} and len(d) == 500
    r = np.diff(np.log(c))
    for _, g in d.sort_values("bar_idx").groupby("path_id"):
        x = np.diff(np.log(g.close.to_numpy()))
        assert g.close.iloc[0] == pytest.approx(c[0]) and np.abs(x[:, None] - r).min(axis=1).max() < 1e-9
        at = np.abs(x[:, None] - r).argmin(axis=1)
        ok = (np.diff(at) % 99) == 1
        assert ok[[i for i in range(98) if (i + 1) % 7]].all()  # blocks run on and wrap
    again = inference.synthetic_paths(spark, p.repartition(3), paths=5, block=7).toPandas()
    key = ["path_id", "bar_idx"]
    assert np.allclose(d.sort_values(key).close, again.sort_values(key).close)


def test_p_values(spark):
    null = spark.createDataFrame([("A", p, c, float(p)) for p in range(99) for c in (0, 1)] + [("A", 200, 0, None)], "symbol string, path_id int, cell int, v double")
    obs = lambda x: spark.createDataFrame([("A", x)], "symbol string, v double")
    r = inference.best_of_grid(null, obs(95.0), value="v", paths=99).first()
    assert (r.paths_scored, r.at_least, r.p_value, r.status) == (99, 4, 0.05, "explained by search")
    assert inference.best_of_grid(null, obs(98.5), value="v", paths=99).first().status == "survives"
    assert inference.best_of_grid(null, obs(98.5), value="v", paths=500).first().p_value is None
    assert inference.best_of_grid(null, obs(None), value="v", paths=99).first().status == "no observation"


def test_best_of_grid_searches_the_whole_grid_on_every_hour(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.symbol: r for r in search.best_of_grid(spark, sf).collect()}
    want = {r.symbol: r.tm_q05 for r in search.surface_best(spark, sf).collect()}
    assert set(got) == set(want) and all(got[s].observed == pytest.approx(want[s], abs=1e-6) for s in want)
    assert all(r.paths_scored == 199 for r in got.values())


def test_synthetic_paths_are_as_many_as_the_search_needs(spark):
    d = search.synthetic_paths(spark, "/root/testdata/sf0.001").groupBy("symbol").agg(F.count_distinct("path_id").alias("n")).collect()
    assert d and {r.n for r in d} == {199}


def test_split_validation_judges_the_best_cell_of_the_whole_grid(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.symbol: r for r in search.overfitting_best(spark, sf).collect()}
    assert {s: r.best for s, r in got.items()} == {r.symbol: r.cell for r in search.surface_best(spark, sf).collect()}
    share = [sum(p.horizon == search.PLANS[r.best].horizon for p in search.PLANS) for r in got.values()]
    assert all(r.cells == n and (r.verdict is not None) == (r.status == "ok") and (r.status == "ok" or n < 2 or r.verdict is None) for r, n in zip(got.values(), share))


def test_path_scores_are_those_of_the_written_paths(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i, float(x)) for s, n in (("A", 90), ("B", 61), ("C", 1)) for i, x in enumerate(np.exp(np.cumsum(rng.normal(scale=0.05, size=n))))]
    p = spark.createDataFrame(rows, "symbol string, bar_idx bigint, close double")
    plans = [Plan(stride=k, n=n, hold=4) for n in (2, 3) for k in (5, 8)]

    def scores(d):
        d = analytic.evaluate_many(d.withColumn("ts", F.lit(None).cast("timestamp_ntz")), plans)
        return d.groupBy("symbol", "cell").agg(F.percentile("terminal_multiple", 0.05).alias("value"))

    key = ["symbol", "path_id", "cell"]
    want = inference.null_scores(inference.synthetic_paths(spark, p, paths=9, block=7), scores).union(scores(p).selectExpr("symbol", "-1", "cell", "value"))
    want = want.toPandas().sort_values(key)
    got = inference.path_scores(p, lambda c: analytic.grid_quantiles(c, plans, 0.05), paths=9, block=7, per_task=4).toPandas().sort_values(key)
    assert len(got) == 2 * 10 * 4 and got[key].to_numpy().tolist() == want[key].to_numpy().tolist()
    assert np.allclose(got.value, want.value, rtol=1e-12)


# Verdicts


def test_reasons_come_in_order_and_unmeasured_is_no_pass(spark):
    s = "best double, shape string, paths double, pbo double, covers boolean, p double, ok boolean"
    why = lambda *row: spark.createDataFrame([row], s).select(verdict.disqualifiers(F.col("best"), F.lit(1.0), *[F.col(c) for c in ("shape", "paths", "pbo", "covers", "p", "ok")]).alias("w")).first().w
    assert why(None, None, None, None, None, None, None) == ["at or below 1.0", "shape unmeasured", "path count unmeasured", "PBO unmeasured", "search test unmeasured"]
    assert why(1.5, "PLATEAU", 9.0, 0.1, True, 0.01, True) == []
    assert why(0.5, "SPIKE", 3.0, 0.6, True, 0.2, False) == ["at or below 1.0", "spike", "3.00 paths", "PBO 0.60", "p=0.200 vs a random search"]
    assert why(1.5, "SLOPE", 9.0, 0.1, False, 0.01, True) == ["PBO unmeasured"]


def test_targets_count_one_set_of_parameters(spark):
    rows = [("H", "s1", x, 1.2, 0.2) for x in "ABC"] + [("H", "s2", "D", 9.0, 0.1), ("H", "s3", "E", 1.2, 0.3), ("H", "s3", "F", float("nan"), 0.1), ("H", "s3", "G", None, 0.1)]
    c = verdict.candidates(spark.createDataFrame(rows, "h string, sig string, symbol string, cagr double, dd double"), hypothesis="h", signature="sig", symbol="symbol", cagr="cagr", drawdown="dd")
    assert sorted((r.sig, r.n_symbols) for r in c.collect()) == [("s1", 3), ("s2", 1)]
    state = lambda *v: verdict.checked_state(spark.createDataFrame([v], "n_symbols int, d boolean, r boolean, e boolean, h boolean"), disqualified="d", robust="r", executed="e", holdout="h").first().state
    assert state(3, False, True, True, True) == "COMPLETE"
    assert state(3, False, True, True, None) == "VERIFIED_ON_DEVELOPMENT"
    assert state(3, False, None, True, None) == state(2, False, True, True, True) == state(3, True, True, True, True) == "CANDIDATE_UNVERIFIED"


def test_stop_states_name_what_failed_and_what_is_unmeasured(spark):
    rows = [(3, False, True, True, True), (3, True, None, True, None), (1, False, True, None, False)]
    d = verdict.checked_state(spark.createDataFrame(rows, "n_symbols int, d boolean, r boolean, e boolean, h boolean"), disqualified="d", robust="r", executed="e", holdout="h")
    assert {(r.failed, r.unmeasured) for r in d.collect()} == {("", ""), ("not_disqualified", "holdout,robustness"), ("holdout,symbols", "execution")}
    assert verdict.overall_state(d).first().state == "COMPLETE" and verdict.overall_state(d.where("n_symbols = 9")).first().state == "NO_CANDIDATE"


def test_cycle_report(spark):
    t = spark.createDataFrame([("f", "H1", "2024"), ("f", "H2", "2025"), ("g", "H3", "2023")], "family string, hypothesis_id string, created_utc string")
    head = spark.createDataFrame([("H1", "A", 1.5, ""), ("H2", "A", 0.5, "spike"), ("H3", "B", 9.0, "spike")], "hypothesis_id string, symbol string, value double, reasons string")
    closed = spark.createDataFrame([("H3", "answered")], "hypothesis_id string, reason string")
    d = report.cycle_report(t, head, closed)
    assert sorted((r.section, r.subject, r.text) for r in d.collect()) == [
        ("closed", "H3", "answered"), ("family", "f", "2"), ("family", "g", "1"), ("headline", "H1", "CLEARS EVERY CHECK"), ("headline", "H2", "spike"), ("project", "trials", "2025"),
    ]
    text = report.render(d, lines=1)
    assert "## Headline" in text and "The first 1 rows" in text and "No cell clears" not in text


def test_votes(spark):
    v = spark.createDataFrame([("x", "a", "CLOSE"), ("x", "b", "CLOSE"), ("y", "a", "CLOSE"), ("y", "b", "CONTINUE"), ("z", "a", "CLOSE"), ("z", "a", "CONTINUE"), ("z", "b", "CONTINUE")], "s string, v string, t string")
    assert {r.s: (r.voters, r.outcome) for r in verdict.vote_tally(v, subject="s", voter="v", vote="t").collect()} == {"x": (2, "CLOSE"), "y": (2, "SPLIT"), "z": (1, "CONTINUE")}


# Robustness and operational views


def test_blocks_walks_and_drift(spark):
    p = spark.createDataFrame([("A", i, float(i)) for i in range(10)], "symbol string, bar_idx bigint, close double")
    edges = [10 * i // 4 for i in range(5)]
    got = {(r.block, r.bar_idx): r.close for r in robustness.block_panels(p, least=2).collect()}
    assert got == {(b, k): float(edges[b] + k) for b in range(4) for k in range(edges[b + 1] - edges[b])}
    assert robustness.block_panels(p).count() == 0 and robustness.short_blocks(p, least=3).first().bars == 10 and robustness.short_blocks(p, least=2).count() == 0
    s = spark.createDataFrame([("A", b, c, v) for c, vs in (("x", (2.0, 2.0, 1.5, 1.5)), ("y", (1.0, 1.0, 9.0, 9.0))) for b, v in enumerate(vs)], "symbol string, block int, cell string, value double")
    w = robustness.walk_forward(s).first()
    assert (w.chosen, w.retention, w.holds) == ("x", 0.75, True)
    assert robustness.cost_stressed(Account()).cost == pytest.approx(2 * Account().cost)
    a, b = (spark.createDataFrame([("A", x), (y, 1.0)], "symbol string, v double") for x, y in ((1.0, "B"), (1.05, "C")))
    d = {r.symbol: r.agrees for r in robustness.clock_drift(a, b, value="v").collect()}
    assert d == {"A": True, "B": None, "C": None}


def test_duty_cycle_merges_overlaps(spark):
    m = lambda x: T0 + dt.timedelta(minutes=x)
    d = spark.createDataFrame([("f", m(a), m(b)) for a, b in ((0, 10), (5, 8), (10, 12), (30, 40), (50, 45))] + [("g", m(0), m(0))], "k string, a timestamp_ntz, b timestamp_ntz")
    r = {x.k: x for x in ops.duty_cycle(d, by=["k"], begin="a", end="b").collect()}
    assert (r["f"].spans, r["f"].islands, r["f"].busy_s, r["f"].window_s, r["f"].largest_gap_s) == (4, 2, 22 * 60, 40 * 60, 18 * 60)
    assert r["g"].duty is None


def test_timelines_and_findings(spark):
    log = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, at int, note string")
    led = spark.createDataFrame([("a", 9, "led"), ("c", 3, "only")], "k string, at int, note string")
    assert {(r.k, r.at, r.note) for r in ops.merged_timeline(log, led, "k").collect()} == {("a", 1, "led"), ("b", 2, "x"), ("c", 3, "only")}
    known = spark.createDataFrame([("f", "w")], "file string, what string").withColumn("finding_id", ops.finding_id(F.col("file"), F.col("what")))
    new = spark.createDataFrame([("f", "w"), ("f", "v"), ("f", "v")], "file string, what string")
    assert sorted((r.what, r.is_new) for r in ops.merge_findings(known, new).collect()) == [("v", True), ("w", False)]


def test_funding_statistics_and_samples(spark):
    d = spark.createDataFrame([("A", x) for x in (1e-4, 3e-4, -1e-4, 0.0, None)], "symbol string, funding_rate double")
    r = ops.funding_stats(d).first()
    assert (r.settlements, r.pct_positive) == (3, pytest.approx(2 / 3)) and r.naive_annualised_pct == pytest.approx(1e-4 * 1095 * 100)
    s = spark.createDataFrame([(f"S{i}",) for i in range(50)], "symbol string")
    pick = lambda d: [r.symbol for r in ops.hashed_sample(d, "symbol", 5, 1).collect()]
    assert pick(s) == pick(s.repartition(7)) and len(set(pick(s))) == 5
    assert list(itertools.islice(inference.half_splits(4), 6)) == [3, 5, 6, 9, 10, 12]


# Trials


def test_routing_and_recording(spark, tmp_path):
    from barloom.operators import analytic, runner
    from barloom.operators.cleaning import panel_hash
    from tests.test_tracks import market, panel

    p = panel(spark, A=market(400, 1), B=market(60, 2))
    cells = [
        {"stride_days": 1.0, "n_contributions": 4, "include_funding": False},
        {"stride_days": 1.0, "n_contributions": 4, "include_funding": False, "symbol": "A", "contribution": 7.0},
        {"stride_days": 1.0, "n_contributions": 4, "gate": "dip:0.01:2", "leverage": 2.0},
        {"gate": "moon"},
        {"stride_days": 0.001},
    ]
    d, skipped = runner.run_dca(p, cells)
    got = {(r.symbol, r.cell): r for r in d.collect()}
    assert skipped == [(3, "gate_not_understood(moon)"), (4, "stride_under_one_bar")]
    assert set(got) == {("A", 0), ("A", 1), ("A", 2)}  # B is shorter than the horizon
    assert got[("A", 0)].evaluator == "analytic" and got[("A", 2)].evaluator == "simulate"
    assert got[("A", 0)].tm_q50 == pytest.approx(got[("A", 1)].tm_q50) and got[("A", 0)].mwrr_q50 == pytest.approx(got[("A", 1)].mwrr_q50)
    want = [r.terminal_multiple for r in analytic.evaluate(p, analytic.Plan(stride=24, n=4)).where("symbol = 'A'").collect()]
    assert got[("A", 0)].tm_q50 == pytest.approx(np.median(want)) and got[("A", 0)].n_starts == len(want)
    rows = runner.as_trials(d, cells, run_id="r", family="f", hypothesis_id="H", panel_hashes=panel_hash(p, ["close"]), code_hash="c", created_utc="2024-01-01")
    book = ledger.Ledger(spark, f"file://{tmp_path}/runs", create=True)
    assert book.record(rows) == 3 and book.record(rows) == 0
    assert ledger.best(book.trials(), "tm_q50", 1).count() == 1
    s, skipped = runner.run_signals(p, [{"rule": "cci_reversion", "lookback_days": 1.0}, {"rule": "none"}, {"rule": "cci_reversion", "lookback_days": 1.0, "leverage": 60.0}])
    assert skipped[0][0] == 1 and {r.cell for r in s.collect()} == {0}


def test_a_large_grid_is_one_plan(spark):
    from barloom.operators import runner

    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i, 100.0 + i % 7, 99.0, 0.0) for i in range(300)]
    p = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, bar_idx bigint, close double, low double, funding_rate double")
    cells = [{"stride_days": s / 24, "n_contributions": n, "hold_days": 0.5, "leverage": lev, "include_funding": f} for s in range(2, 11) for n in (2, 3, 4) for lev in (1.0, 2.0, 3.0) for f in (True, False)]
    d, skipped = runner.run_dca(p, cells)
    plan = d._jdf.queryExecution().analyzed().toString()
    assert len(cells) == 162 and not skipped
    assert plan.count("FlatMapGroupsInPandas") == 1
    got = {r.cell: (r.evaluator, r.n_starts) for r in d.collect()}
    assert len(got) == 162 and got[0][0] == "simulate" and sum(e == "analytic" for e, _ in got.values()) == 27
