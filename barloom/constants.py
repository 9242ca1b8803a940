"""Settings whose numbers decide results."""

from __future__ import annotations

import datetime as dt

SEAL = dt.date(2024, 3, 1)
TAKER_BPS, MAKER_BPS, SLIPPAGE_BPS = 4.5, 1.8, 1.0
MIN_BARS = 129_600
MAX_MISSING_FRACTION = 0.005
CCI_FACTOR = 0.015
BOOTSTRAP_BLOCK, BOOTSTRAP_PATHS, ALPHA, SEED = 24, 199, 0.05, 20260902
BARS_PER_DAY = {"1h": 24, "1m": 1440}
BARS_PER_YEAR = {"1h": 8760, "1m": 525_600}
MIN_YEARS_TO_ANNUALISE = 1.0
MIN_DRAWDOWN_FOR_CALMAR = 1e-9
QUANTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
PLATEAU_ABOVE, SLOPE_ABOVE = 0.90, 0.70
PBO_USELESS, FEW_PATHS = 0.5, 5
BREAK_EVEN = {"tm_q05": 1.0, "calmar": 0.0, "mwrr_q05": 0.0}
TARGET_CAGR, TARGET_MAX_DRAWDOWN, TARGET_SYMBOLS = 1.0, 0.25, 3
POSITIONING_ROWS_PER_DAY, POSITIONING_MAX_MISSING = 288, 0.25
COST_STRESS, MAX_CLOCK_DRIFT, RETENTION, REGIME_DAYS = 2.0, 0.10, 0.5, 30
CSCV_BLOCKS = 10
MIN_BLOCK_BARS = 720

# Margin tiers as (cap, maintenance rate, cumulative amount, largest leverage).
TIERS = {
    "BTC_LIKE": [
        (50_000.0, 0.004, 0.0, 125.0),
        (600_000.0, 0.005, 50.0, 100.0),
        (3_000_000.0, 0.01, 3_050.0, 50.0),
        (12_000_000.0, 0.025, 48_050.0, 20.0),
        (70_000_000.0, 0.05, 348_050.0, 10.0),
        (100_000_000.0, 0.1, 3_848_050.0, 5.0),
        (230_000_000.0, 0.125, 6_348_050.0, 4.0),
        (480_000_000.0, 0.15, 11_098_050.0, 3.0),
        (600_000_000.0, 0.25, 59_098_050.0, 2.0),
        (800_000_000.0, 0.5, 209_098_050.0, 1.0),
    ],
    "MAJOR_ALT": [
        (10_000.0, 0.0065, 0.0, 75.0),
        (100_000.0, 0.01, 35.0, 50.0),
        (500_000.0, 0.02, 1_035.0, 25.0),
        (2_000_000.0, 0.05, 16_035.0, 10.0),
        (10_000_000.0, 0.1, 116_035.0, 5.0),
        (30_000_000.0, 0.125, 366_035.0, 4.0),
    ],
    "LONG_TAIL": [
        (5_000.0, 0.01, 0.0, 25.0),
        (50_000.0, 0.025, 75.0, 20.0),
        (250_000.0, 0.05, 1_325.0, 10.0),
        (1_000_000.0, 0.1, 13_825.0, 5.0),
        (5_000_000.0, 0.125, 38_825.0, 4.0),
    ],
}

# Symbols of the two more liquid tier tables.
BTC_SYMBOLS = ("BTCUSDT", "BTCUSDC", "BTCBUSD")
MAJOR_SYMBOLS = ("ETHUSDT", "BNBUSDT", "SOLUSDT", "XRPUSDT", "ADAUSDT", "DOGEUSDT", "AVAXUSDT", "LINKUSDT", "LTCUSDT", "BCHUSDT")
