import datetime as dt

import pytest

from barloom.operators import asof, cleaning, panel

T0 = dt.datetime(2024, 1, 1)
RAW = "row_id bigint, symbol string, ts string, open double, high double, low double, close double, volume double, quote_volume double, trades bigint"


def raw(spark, rows):
    return spark.createDataFrame([(i, s, t, float(o), float(h), float(l), float(c), None if v is None else float(v), 1.0, 1) for i, (s, t, o, h, l, c, v) in enumerate(rows)], RAW)


def minute(i):
    return (T0 + dt.timedelta(minutes=i)).strftime("%Y-%m-%d %H:%M:%S")


ROWS = [
    ("A", minute(0), 1, 2, 1, 2, 5),
    ("A", minute(0), 9, 9, 9, 9, 5),  # repeat: the first stays
    ("A", minute(1), 2, 2, 2, 2, 0),  # padding
    ("A", minute(2), 2, 2, 2, 2, 3),  # flat, but traded
    ("A", "n/a", 1, 1, 1, 1, 1),
    ("A", minute(5), 0, 2, 1, 2, 5),  # not positive
    ("A", minute(9), 2, 1, 3, 2, 5),  # violates, is kept
    ("A", minute(10), 2, 2, 2, 2, None),  # padding unknown: lost
    ("A", minute(11), 1, 2, 1, 2, None),  # not flat, so not padding
]


def test_cleaning_and_its_record(spark):
    df = raw(spark, ROWS)
    assert sorted(r.row_id for r in cleaning.clean_bars(df).collect()) == [0, 3, 6, 8]
    q = cleaning.quality_report(df, min_bars=2, seal="2025-01-01").first()
    assert (q.rows_raw, q.rows_dropped_padding, q.rows_dropped_duplicate, q.rows_final) == (9, 1, 1, 4)
    assert (q.gap_count, q.largest_gap_minutes, q.nonpositive_price_rows, q.ohlc_violation_rows) == (3, 6, 1, 1)
    assert (q.first_ts, q.last_ts, q.usable, q.reject_reason) == (minute(0), minute(11), True, None)
    few = cleaning.quality_report(df, min_bars=5).first()
    assert (few.first_ts, few.usable, few.reject_reason) == ("", False, "only 4 bars, need 5")
    late = cleaning.quality_report(df, min_bars=2, seal="2023-01-01").first()
    assert late.reject_reason == "listed after the seal; no development history"
    assert cleaning.quality_report(df.where("false")).count() == 0


def test_tumble_and_one_bar_per_slot(spark):
    df = raw(spark, [("A", minute(i), i + 1, i + 2, i + 0.5, i + 1.5, 1) for i in (0, 59, 60, 130)])
    t = cleaning.tumble(cleaning.clean_bars(df), 60).orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.minutes_present) for r in t] == [(1, 61, 0.5, 60.5, 2), (61, 62, 60.5, 61.5, 1), (131, 132, 130.5, 131.5, 1)]
    b = spark.createDataFrame([("A", T0 + dt.timedelta(minutes=3), 1.0, 1, T0), ("A", T0 + dt.timedelta(minutes=30), 2.0, 2, T0 + dt.timedelta(days=1)), ("A", T0 + dt.timedelta(minutes=50), 3.0, 3, T0), (None, T0, 9.0, 9, T0)], "symbol string, ts timestamp_ntz, close double, bar_id int, ingested_at timestamp")
    assert [(r.ts, r.close) for r in panel.one_bar_per_slot(b, 60).collect()] == [(T0, 2.0)]


def bars(spark, hours, symbol="A"):
    return spark.createDataFrame([(symbol, T0 + dt.timedelta(hours=h)) for h in hours], "symbol string, ts timestamp_ntz")


def test_clock_and_gaps(spark):
    g = cleaning.gap_report(bars(spark, [0, 1, 5, 6, 9]), 60).first()
    assert (g.gap_count, g.largest_gap) == (2, 3)
    assert cleaning.clock_report(bars(spark, range(300)), 60).first().valid
    assert not cleaning.clock_report(bars(spark, [0, 1, 1, 2]), 60).first().valid
    assert not cleaning.clock_report(bars(spark, [0, 1, 1.5, 2]), 60).first().valid
    assert not cleaning.clock_report(bars(spark, [0, 1, 50]), 60).first().valid
    assert cleaning.clock_report(bars(spark, [0]), 60).first().valid
    with pytest.raises(ValueError):
        cleaning.require_clock(bars(spark, [0, 50]), 60)


def test_the_seal_is_never_crossed(spark):
    b = bars(spark, range(48))
    assert cleaning.development(b, "2024-01-02").count() == 24 and cleaning.sealed(b, "2024-01-02").count() == 24
    cleaning.require_development(cleaning.development(b, "2024-01-02"), "2024-01-02")
    with pytest.raises(ValueError):
        cleaning.require_development(b, "2024-01-02")


def test_settlements_land_on_their_bars(spark):
    e = spark.createDataFrame(
        [("A", T0 - dt.timedelta(seconds=1), 9.0), ("A", T0, 1.0), ("A", T0 + dt.timedelta(minutes=59), 2.0), ("A", T0 + dt.timedelta(hours=1, seconds=1), 0.0), ("A", T0 + dt.timedelta(hours=2, minutes=59), 4.0), ("A", T0 + dt.timedelta(hours=3), 8.0), ("A", T0 + dt.timedelta(hours=2), None)],
        "symbol string, ts timestamp_ntz, funding_rate double",
    )
    got = [(r.funding_rate, r.funding_settled) for r in asof.settle_onto_bars(bars(spark, [0, 1, 2]), e).orderBy("ts").collect()]
    # Before the first bar and a step after the last one is dropped; a rate of 0 is a settlement.
    assert got == [(3.0, True), (0.0, True), (4.0, True)]
    one = asof.settle_onto_bars(bars(spark, [0]), e).first()
    assert one.funding_rate == 15.0  # no step, no bound
    assert asof.settle_onto_bars(bars(spark, []), e).count() == 0
    assert not asof.settle_onto_bars(bars(spark, [0]), e.where("false")).first().funding_settled


def test_levels_and_closed_blocks(spark):
    r = spark.createDataFrame([("A", T0, 1.0, 1), ("A", T0, 2.0, 2), ("A", T0 + dt.timedelta(minutes=90), None, 3), ("A", T0 + dt.timedelta(hours=2), 5.0, 4), ("B", T0, 7.0, 5)], "symbol string, ts timestamp_ntz, oi double, k int")
    got = [x.oi for x in asof.level_asof(bars(spark, [-1, 0, 1, 2, 3]), r, "oi", tie="k").orderBy("ts").collect()]
    assert got == [None, 2.0, 2.0, 5.0, 5.0]
    blocks = spark.createDataFrame([("A", T0, 1.0), ("A", T0 + dt.timedelta(hours=4), 2.0)], "symbol string, ts timestamp_ntz, v double")
    got = [x.v for x in asof.closed_block_asof(bars(spark, range(9)), blocks, ["v"], block_minutes=240, step_minutes=60).orderBy("ts").collect()]
    # The bar that ends with the block sees it.
    assert got == [None, None, None, 1.0, 1.0, 1.0, 1.0, 2.0, 2.0]


def test_panel_hash_sees_every_change(spark):
    s = "symbol string, bar_idx bigint, close double, settled boolean"
    base = [("A", 0, 1.0, True), ("A", 1, 2.0, False), ("A", 2, None, False)]
    h = lambda rows: cleaning.panel_hash(spark.createDataFrame(rows, s), ["close", "settled"]).first().panel_hash
    same = h(base)
    assert len(same) == 32 and h(base[::-1]) == same
    for other in ([base[0], base[1]], [("A", 0, 2.0, True), ("A", 1, 1.0, False), base[2]], [("A", 0, 1.0, False), *base[1:]], [*base[:2], ("A", 2, 0.0, False)]):
        assert h(other) != same


def test_coverage_and_finite_inputs(spark):
    rec = spark.createDataFrame([("A", T0 + dt.timedelta(hours=2))], "symbol string, ts timestamp_ntz")
    assert cleaning.covered(bars(spark, range(5)).unionByName(bars(spark, range(5), "B")), rec).count() == 3
    d = spark.createDataFrame([("A", 1.0), ("A", None), ("A", float("nan")), ("A", float("-inf"))], "symbol string, x double")
    r = cleaning.finite_report(d, ["x"]).first()
    assert (r.missing, r.infinite) == (2, 1)
