"""Bars of any timeframe from one-minute rows.

A bucket takes the first finite open (close where open is missing), the
extremes over highs / lows and closes, the last finite close and metrics, and
the sum of finite volume and turnover, whatever the order of addition. Buckets
without rows do not appear; buckets without finite values do. All aggregates
combine map-side, so a symbol with most of the rows costs no more shuffle than
its bucket count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions import bucket_floor, exact_sum, finite, timeframe_ms
from barlake.schemas import LAST_VALUE_COLUMNS, SERIES_COLUMNS, TIMEFRAMES

BAR_COLUMNS = ["symbol", "ts_ms", *SERIES_COLUMNS]
BASE = "5m"  # the finest bar every coarser one nests in


def _first(value: Column, order: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), order))


def _last(value: Column, order: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), order))


def bar_aggregates(order: Column | None = None, last_order: Column | None = None) -> list[Column]:
    """Aggregates of one bucket. ``order`` defaults to ``ts_ms``; pass a struct that ends in
    a unique column to fix which of several rows of one minute is first and last.
    ``last_order``, where last rows are looked for in another order, defaults to ``order``."""
    order = F.col("ts_ms") if order is None else order
    last_order = order if last_order is None else last_order
    o, h, l, c = (finite(F.col(f"kline_{p}")) for p in ("open", "high", "low", "close"))
    return [
        _first(F.coalesce(o, c), order).alias("kline_open"),
        F.max(F.greatest(h, c)).alias("kline_high"),
        F.min(F.least(l, c)).alias("kline_low"),
        _last(c, last_order).alias("kline_close"),
        exact_sum(finite(F.col("kline_volume"))).alias("kline_volume"),
        exact_sum(finite(F.col("kline_turnover"))).alias("kline_turnover"),
        *[_last(finite(F.col(m)), last_order).alias(m) for m in LAST_VALUE_COLUMNS],
    ]


def resample(rows: DataFrame, timeframe: str, order: Column | None = None) -> DataFrame:
    """One row per (symbol, bucket), ``ts_ms`` = bucket start. 1m or unknown: rows unchanged."""
    width = timeframe_ms(timeframe)
    if width <= 60_000:
        return rows.select(*BAR_COLUMNS)
    return (
        rows.where(F.col("ts_ms").isNotNull())
        .groupBy("symbol", bucket_floor(F.col("ts_ms"), width).alias("_bucket"))
        .agg(*bar_aggregates(order))
        .withColumnRenamed("_bucket", "ts_ms")
        .select(*BAR_COLUMNS)
    )


def resample_all(rows: DataFrame, timeframes: list[str] | None = None) -> DataFrame:
    """Bars of several timeframes at once, with a ``timeframe`` column.

    The one-minute rows are shuffled once, to five-minute bars. Those are then
    placed by (symbol, day) - at most 288 rows each - where every coarser
    bucket nests, so all coarser bars come from that one placement.
    """
    wanted = list(TIMEFRAMES) if timeframes is None else timeframes
    coarse = [tf for tf in wanted if timeframe_ms(tf) > timeframe_ms(BASE)]
    parts = [rows.select(F.lit(tf).alias("timeframe"), *BAR_COLUMNS) for tf in wanted if timeframe_ms(tf) <= 60_000]
    if coarse or BASE in wanted:
        parts.append(_nested_bars(resample(rows, BASE), [tf for tf in wanted if timeframe_ms(tf) > 60_000]))
    bars = parts[0]
    for part in parts[1:]:
        bars = bars.unionByName(part)
    return bars


def _nested_bars(base: DataFrame, timeframes: list[str]) -> DataFrame:
    targets = F.array(*[
        F.struct(F.lit(tf).alias("timeframe"), bucket_floor(F.col("ts_ms"), timeframe_ms(tf)).alias("bucket"))
        for tf in timeframes
    ])
    return (
        base.withColumn("_day", bucket_floor(F.col("ts_ms"), timeframe_ms("1d")))
        .repartition("symbol", "_day")
        .select("*", F.inline(targets))
        .groupBy("symbol", "_day", "timeframe", "bucket")
        .agg(*bar_aggregates())
        .withColumnRenamed("bucket", "ts_ms")
        .select("timeframe", *BAR_COLUMNS)
    )


def resample_funding(funding: DataFrame, timeframe: str) -> DataFrame:
    """Last finite funding rate per bucket. 1m or unknown: rows unchanged."""
    width = timeframe_ms(timeframe)
    if width <= 60_000:
        return funding.select("symbol", "ts_ms", "funding_rate")
    rate = finite(F.col("funding_rate"))
    return (
        funding.where(F.col("ts_ms").isNotNull() & rate.isNotNull())
        .groupBy("symbol", bucket_floor(F.col("ts_ms"), width).alias("_bucket"))
        .agg(F.max_by(rate, "ts_ms").alias("funding_rate"))
        .withColumnRenamed("_bucket", "ts_ms")
    )
