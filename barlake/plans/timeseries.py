"""The wide one-minute table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions import basis_bps, ts_from_ms
from barlake.schemas import PRICE_COLUMNS, WIDE_COLUMNS

KEY = ["symbol", "ts_ms"]
WIDE_INPUTS = [
    "market_kline", "mark_price_kline", "index_price_kline", "premium_index_price_kline",
    "open_interest", "account_ratio",
]


def minute_klines(klines: DataFrame, prefix: str, columns: list[str] = PRICE_COLUMNS) -> DataFrame:
    """One-minute candles with prefixed columns; ``interval`` is a partition column, so this prunes folders."""
    return klines.where(F.col("interval") == "1").select(*KEY, *[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def five_minute(metrics: DataFrame, columns: list[str]) -> DataFrame:
    period: Column = F.col("period")
    return metrics.where((period == "5min") | period.isNull()).select(*KEY, *columns)


def wide_1m(
    market: DataFrame, mark: DataFrame, index: DataFrame, premium: DataFrame,
    open_interest: DataFrame, account_ratio: DataFrame,
) -> DataFrame:
    """Trade candles with every other series of exactly the same (symbol, ts_ms) beside them.

    No filling: five-minute metrics appear on their own minutes only. Rows
    come unsorted (sort where they are used); all six inputs shuffle once on
    the same key and the joins chain on it.
    """
    candles = minute_klines(market, "kline", [*PRICE_COLUMNS, "volume", "turnover"])
    # rows without a time match nothing: they go round the joins, where they would be one hot key per symbol
    joined = candles.where(F.col("ts_ms").isNotNull())
    for other in (
        minute_klines(mark, "mark"),
        minute_klines(index, "index"),
        minute_klines(premium, "premium"),
        five_minute(open_interest, ["open_interest"]),
        five_minute(account_ratio, ["buy_ratio", "sell_ratio", "long_short_ratio"]),
    ):
        joined = joined.join(other, KEY, "left")
    joined = joined.unionByName(candles.where(F.col("ts_ms").isNull()), allowMissingColumns=True)
    return joined.withColumns({
        "ts": ts_from_ms(F.col("ts_ms")),
        "basis_bps": basis_bps(F.col("mark_close"), F.col("index_close")),
    }).select(*WIDE_COLUMNS)


def open_wide(tables: dict[str, DataFrame]) -> DataFrame | None:
    """The wide table as temp view ``symbol_timeseries_1m``; None unless all six inputs exist."""
    if any(name not in tables for name in WIDE_INPUTS):
        return None
    wide = wide_1m(*[tables[name] for name in WIDE_INPUTS])
    wide.createOrReplaceTempView("symbol_timeseries_1m")
    return wide
