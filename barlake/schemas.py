"""Column lists and JSON field lists of the datasets."""

from __future__ import annotations

# --- Fixed values: field names of the source JSON and of the output tables ---
KLINE_JSON = ["ts", "open", "high", "low", "close", "volume", "turnover", "raw", "extra"]
FUNDING_JSON = ["symbol", "ts", "fundingRateTimestamp", "fundingRate"]
OPEN_INTEREST_JSON = ["ts", "timestamp", "openInterest"]
ACCOUNT_RATIO_JSON = ["symbol", "ts", "timestamp", "buyRatio", "sellRatio"]
RISK_LIMIT_JSON = [
    "id", "riskLimitValue", "maintenanceMargin", "initialMargin", "isLowestRisk", "maxLeverage", "mmDeduction",
]

PRICE_COLUMNS = ["open", "high", "low", "close"]

# the one-minute wide table, in output order
WIDE_COLUMNS = [
    "symbol", "ts_ms", "ts",
    "kline_open", "kline_high", "kline_low", "kline_close", "kline_volume", "kline_turnover",
    "mark_open", "mark_high", "mark_low", "mark_close",
    "index_open", "index_high", "index_low", "index_close",
    "premium_open", "premium_high", "premium_low", "premium_close",
    "open_interest", "buy_ratio", "sell_ratio", "long_short_ratio", "basis_bps",
]

# what a chart of one symbol reads
SERIES_COLUMNS = [
    "kline_open", "kline_high", "kline_low", "kline_close",
    "mark_close", "index_close", "premium_close",
    "kline_volume", "kline_turnover", "open_interest",
    "buy_ratio", "sell_ratio", "long_short_ratio", "basis_bps",
]

# carried through a resample as "last finite value in the bucket"
LAST_VALUE_COLUMNS = [
    "mark_close", "index_close", "premium_close", "open_interest",
    "buy_ratio", "sell_ratio", "long_short_ratio", "basis_bps",
]

TIMEFRAMES = {
    "1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60,
    "2h": 120, "4h": 240, "8h": 480, "12h": 720, "1d": 1440,
}

EVENT_HORIZON_HOURS = [1, 2, 3, 4, 5, 6, 8, 20]
# ------------------------------------------------------------------------------


def json_struct(fields: list[str], mark: str = "") -> str:
    """DDL of a struct that reads the listed JSON fields as text; names may start with a mark."""
    return f"STRUCT<{', '.join(f'`{mark}{f}`: STRING' for f in fields)}>"
