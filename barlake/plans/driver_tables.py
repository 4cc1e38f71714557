"""Market datasets derived from the given tables, as plain functions of whole tables.

``events`` becomes ticks: the event type is the symbol, ``value`` a price and
``props.k`` (0-99) a size. Candles and metrics aggregate every tick; the mark,
index and premium candles are cut half, a quarter and three quarters of a
minute off the trade candles, so their minutes match only in part.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions import bucket_floor, guarded_ratio
from barlake.plans.timeseries import wide_1m
from barlake.settings import configure

MINUTE_MS = 60_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def file_ranks(events: DataFrame) -> dict[str, int]:
    """Where each file of a table stands among the others, in the order of their names."""
    names = dict.fromkeys(unquote(f).rpartition("/")[2] for f in sorted(events.inputFiles()))
    return {name: rank for rank, name in enumerate(names)}


def ticks_of(events: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Ticks of a Parquet table, with their ``place`` in it: the rank of the row's file, then the row's number in it.

    Files that came after the ranks were taken (of a stream) stand behind all others.
    """
    ts = F.col("ts").cast("timestamp")
    rows = events.select("event_id", "ts", "user_id", "event_type", "value", "props", "_metadata.file_name", "_metadata.row_index")
    later = F.lit(8_000_000) + F.pmod(F.xxhash64("file_name"), F.lit(1_000_000))
    if len(ranks) > 1:
        known = events.sparkSession.createDataFrame(list(ranks.items()), "file_name string, rank long")
        rows = rows.join(F.broadcast(known), "file_name", "left")
        file = F.coalesce("rank", later)
    else:
        file = F.when(F.col("file_name").isin(list(ranks)), F.lit(0)).otherwise(later)
    return rows.select(
        "event_id", "user_id", (file * 10**12 + F.col("row_index")).alias("place"),
        F.upper("event_type").alias("symbol"),
        F.unix_millis(ts).alias("ms"), F.unix_micros(ts).alias("us"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return ticks_of(events, file_ranks(events))


def tick_order(time: str, last: bool = False) -> Column:
    """Order in which a first (or ``last``) tick is looked for: of several at one time, the one that stands first in the table counts.

    One decimal instead of a struct, so that aggregates by it stay hash aggregates.
    """
    at = F.col(time).cast("decimal(19, 0)") * F.lit(Decimal(10**19))
    return at - F.col("place") if last else at + F.col("place")


def candles(ticks: DataFrame, price: Column, interval: str = "1", shift_ms: int = 0, volume: bool = False) -> DataFrame:
    start = bucket_floor(F.col("ms") + shift_ms, int(interval) * MINUTE_MS).alias("ts_ms")
    sums = [F.sum("price").alias("volume"), F.sum(F.col("price") * F.col("price")).alias("turnover")]
    return ticks.groupBy("symbol", start).agg(
        F.min_by(price, tick_order("us")).alias("open"), F.max(price).alias("high"),
        F.min(price).alias("low"), F.max_by(price, tick_order("us", last=True)).alias("close"),
        *(sums if volume else []),
    ).withColumn("interval", F.lit(interval))


def market_kline(ticks: DataFrame) -> DataFrame:
    """Trade candles at 1, 5 and 60 minutes, as a source holds several intervals."""
    return reduce(DataFrame.unionByName, [candles(ticks, F.col("price"), i, volume=True) for i in ("1", "5", "60")])


def mark_price_kline(ticks: DataFrame) -> DataFrame:
    return candles(ticks, F.col("price") * 1.001, shift_ms=30_000)


def index_price_kline(ticks: DataFrame) -> DataFrame:
    return candles(ticks, F.col("size"), shift_ms=15_000)


def premium_index_price_kline(ticks: DataFrame) -> DataFrame:
    return candles(ticks, (F.col("price") - F.col("size")) / 100, shift_ms=45_000)


def _five_minutes(ticks: DataFrame, *aggregates: Column) -> DataFrame:
    start = bucket_floor(F.col("ms"), 5 * MINUTE_MS).alias("ts_ms")
    return ticks.groupBy("symbol", start).agg(*aggregates).withColumn("period", F.lit("5min"))


def open_interest(ticks: DataFrame) -> DataFrame:
    return _five_minutes(ticks, F.sum("size").alias("open_interest"))


def account_ratio(ticks: DataFrame) -> DataFrame:
    rows = _five_minutes(ticks, (F.avg("size") / 99).alias("buy_ratio"))
    rows = rows.withColumn("sell_ratio", 1 - F.col("buy_ratio"))
    return rows.withColumn("long_short_ratio", guarded_ratio(F.col("buy_ratio"), F.col("sell_ratio")))


def funding(ticks: DataFrame) -> DataFrame:
    """Hourly funding: the last tick's price in points."""
    start = bucket_floor(F.col("ms"), 60 * MINUTE_MS).alias("ts_ms")
    return ticks.groupBy("symbol", start).agg((F.max_by("price", tick_order("us", last=True)) / 10000).alias("funding_rate"))


def market_tables(ticks: DataFrame) -> dict[str, DataFrame]:
    return {
        "market_kline": market_kline(ticks),
        "mark_price_kline": mark_price_kline(ticks),
        "index_price_kline": index_price_kline(ticks),
        "premium_index_price_kline": premium_index_price_kline(ticks),
        "open_interest": open_interest(ticks),
        "account_ratio": account_ratio(ticks),
    }


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_1m(*market_tables(ticks(spark, sf_dir)).values())


# --- raw JSON texts ------------------------------------------------------------


def _text(template: str, **parts: Column) -> Column:
    """Fill ``<name>`` places of a JSON template with column texts."""
    pieces: list[Column] = []
    rest = template
    while "<" in rest:
        before, _, rest = rest.partition("<")
        name, _, rest = rest.partition(">")
        pieces += [F.lit(before), parts[name].cast("string")]
    return F.concat(*pieces, F.lit(rest))


def by_size(cases: dict[int, Column], default: Column) -> Column:
    """Pick a text by the tick's size, so that odd lines are spread over the whole table."""
    chosen = default
    for size, text in cases.items():
        chosen = F.when(F.col("size") == size, text).otherwise(chosen)
    return chosen


def kline_texts(ticks: DataFrame) -> DataFrame:
    """One kline line per tick, with blank, broken and odd lines among them."""
    parts = {"ms": F.col("ms"), "p": F.col("price"), "s": F.col("size")}
    raw7 = '["<ms>","<p>","<p>","<p>","<p>","<s>","<s>"]'

    def line(ts="<ms>", open_='"open": "<p>", ', raw=f', "raw": {raw7}, "extra": []') -> Column:
        return _text(
            '{"ts": ' + ts + ", " + open_ + '"high": <p>, "low": "<p>", "close": " <p> ", "volume": "<s>"' + raw + "}",
            **parts,
        )

    cases = {
        0: F.lit(""), 1: F.lit("   "), 2: F.lit("{bad"), 3: F.lit("[1,2]"), 4: F.lit('"x"'),
        5: F.concat(line(), F.lit(" tail")), 6: F.lit("{}"), 7: line(open_=""), 8: line(open_='"open": "", '),
        9: line(ts='"<ms>.9"'), 10: line(raw=', "raw": ["<ms>",1,true,null,"x"]'), 11: line(raw=', "raw": {"a": 1}'),
        12: line(open_='"open": NaN, '), 13: line(open_='"open": true, '), 14: line(open_='"open": "x", '),
        15: line(raw=""), 16: line(raw=', "raw": "[1]", "extra": [ 1, {"z": "b", "a": 1.50} ]'),
        17: F.concat(line(), F.lit(',"x":2')), 18: F.concat(line(), F.lit(',"end":[]')),
        19: F.concat(line(), F.lit(',"doc":{"ts":9}')), 20: F.concat(line(), F.lit(" "), line()),
        21: F.concat(line(), F.lit('],"doc":['), line()), 22: line(open_='"open": "true", '),
        23: line(ts="9223372036854775807"),
    }
    return ticks.select(
        "event_id", F.col("symbol").alias("path_symbol"), by_size(cases, line()).alias("value"),
        F.lit("market_kline").alias("dataset"),
        F.format_string("symbols/%s/kline_%s.jsonl", "symbol", "user_id").alias("path"),
    )


def funding_texts(ticks: DataFrame) -> DataFrame:
    """Small sizes leave out the symbol, large ones the collector time."""
    symbol = F.when(F.col("size") < 30, F.lit("")).otherwise(F.concat(F.lit("REC_"), "symbol"))
    collector = F.when(F.col("size") < 60, F.col("ms").cast("string")).otherwise(F.lit("null"))
    text = _text(
        '{"symbol": "<y>", "ts": <c>, "fundingRateTimestamp": "<f>", "fundingRate": "<r>"}',
        y=symbol, c=collector, f=bucket_floor(F.col("ms"), 60 * MINUTE_MS), r=F.col("price"),
    )
    return ticks.select("event_id", F.col("symbol").alias("path_symbol"), text.alias("value"))


def open_interest_texts(ticks: DataFrame) -> DataFrame:
    timed = '"ts": <ms>, "timestamp": "<f>"'
    parts = {"ms": F.col("ms"), "f": bucket_floor(F.col("ms"), 5 * MINUTE_MS), "s": F.col("size")}
    text = by_size(
        {1: _text('{"timestamp": "<f>", "openInterest": "<s>"}', **parts),
         2: _text('{"ts": "", "timestamp": "<f>", "openInterest": ""}', **parts),
         3: _text('{"openInterest": <s>}', **parts)},
        _text("{" + timed + ', "openInterest": <s>}', **parts),
    )
    return ticks.select("event_id", F.col("symbol").alias("path_symbol"), text.alias("value"))


def account_ratio_texts(ticks: DataFrame) -> DataFrame:
    """Buy is size / 99, sell the rest: size 99 has sell 0, size 0 has no sell at all."""
    parts = {"ms": F.col("ms"), "b": F.col("size") / 99, "s": 1 - F.col("size") / 99}
    text = by_size(
        {0: _text('{"symbol": null, "timestamp": <ms>, "buyRatio": "<b>"}', **parts)},
        _text('{"symbol": "", "timestamp": "<ms>", "buyRatio": "<b>", "sellRatio": "<s>"}', **parts),
    )
    return ticks.select("event_id", F.col("symbol").alias("path_symbol"), text.alias("value"))


def generic_texts(ticks: DataFrame) -> DataFrame:
    """Every line has an id of 20 digits, an object that is 1 to 30 levels deep (by size), keys that meet when joined, and braces in a text."""
    depth = F.pmod(F.col("size").cast("int"), F.lit(30)) + 1
    deep = F.concat(F.repeat(F.lit('{"k":'), depth), F.lit("7"), F.repeat(F.lit("}"), depth))
    text = _text(
        '{"ts": 0, "timestamp": "", "time": "<ms>", "a": {"b": {"c": "<s>", "d": {}}, "e": <p>}, '
        '"list": [1, "<s>", {"x": [2]}], "x": {"y_z": <s>, "y": {"z": -<u>}}, "text": " }user <u>{ ", "none": null, "u": <u>, "u": -<u>, "id": 12345678901<d>, "deep": <deep>}',
        d=F.lpad(F.col("user_id").cast("string"), 9, "0"), deep=deep, ms=F.col("ms"), s=F.col("size"), p=F.col("price"), u=F.col("user_id"),
    )
    return ticks.select("event_id", F.col("symbol").alias("path_symbol"), text.alias("value"))


def risk_limit_texts(orders: DataFrame) -> DataFrame:
    text = _text(
        '{"symbol": "", "generatedAtIso": "<d>", "rows": ['
        '{"id": "<k>", "riskLimitValue": "<v>", "maintenanceMargin": 0.5, "isLowestRisk": true}, 5, "{}", '
        '{"id": <k>.7, "riskLimitValue": <v>, "initialMargin": "1e-2", "isLowestRisk": "0", "maxLeverage": "12.5", '
        '"mmDeduction": ""}]}',
        d=F.date_format("o_orderdate", "yyyy-MM-dd"), k=F.col("o_orderkey"), v=F.col("o_totalprice"),
    )
    return orders.select(F.col("o_orderpriority").alias("path_symbol"), text.alias("value"))


def meta_texts(customers: DataFrame) -> DataFrame:
    text = _text(
        '{"symbol": "<n>", "listingTimeMs": "<t>", "collectedFromMs": <t>, "note": " seg <m> ", '
        '"endpointState": {"kline": {"next": "<k>", "deep": {"z": <k>}}, "flag": true}, "extra": {"x": [<k>]}}',
        n=F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")), t=F.col("c_custkey") * 86_400_000,
        m=F.col("c_mktsegment"), k=F.col("c_custkey"),
    )
    return customers.select(F.col("c_mktsegment").alias("path_symbol"), text.alias("value"))


def instrument_texts(parts: DataFrame) -> DataFrame:
    text = _text(
        '{"symbol": "<n>", "priceFilter": {"tickSize": "<p>", "range": {"min": 0, "max": <k>}}, '
        '"status": " <b> ", "tags": [ "<y>", 1 ]}',
        n=F.col("p_name"), p=F.col("p_retailprice"), k=F.col("p_partkey"), b=F.col("p_brand"), y=F.col("p_type"),
    )
    return parts.select(F.col("p_partkey").cast("string").alias("path_symbol"), text.alias("value"))


def supplier_documents(suppliers: DataFrame, template: str) -> DataFrame:
    """One document for each supplier, by its number: small numbers have no note."""
    text = _text(
        template, n=F.col("s_name"), k=F.col("s_suppkey"), b=F.col("s_acctbal"), t=F.col("s_suppkey") * 86_400_000,
        p=F.when(F.col("s_suppkey") < 3, "").otherwise(F.concat(F.lit("N"), "s_nationkey")),
    )
    return suppliers.select(F.format_string("S%d", "s_suppkey").alias("path_symbol"), text.alias("value"))


# Documents of one object each, as a source has them in files of their own.
INSTRUMENT_FILE = '{"symbol": "<n>", "priceFilter": {"tickSize": "<b>", "range": {"max": <k>}}, "status": " <p> ", "tags": ["<k>", 1]}'
CHANGED_INSTRUMENT_FILE = '{"symbol": "<n>", "priceFilter": {"tickSize": "x<b>", "range": {"max": <k>.5}}, "tags": []}'
TICKER_FILE = '{"lastPrice": "<b>", "turnover": <k>.5, "phone": "<p>"}'
META_FILE = '{"symbol": "", "listingTimeMs": "<t>", "endpointState": {"kline": {"next": "<k>", "deep": {"z": <k>}}}, "note": "<p>"}'


# The symbols and timeframes that conversations are spread over.
NOTE_SYMBOLS = ["CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW"]
NOTE_TIMEFRAMES = ["", "1h", "4h", "15m", "1m", "bad"]


def note_texts(conversations: DataFrame) -> DataFrame:
    """Every turn as a note; its number decides title, times, timeframe and x-range."""
    def nth(values: list[str], n: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(n, F.lit(len(values))).cast("int"))

    conv, turn = F.col("conv_id"), F.col("turn")
    start = F.timestamp_millis(F.lit(1704067200000) + F.pmod(conv, F.lit(28)) * 86_400_000)
    day = F.date_format(start, "yyyy-MM-dd")
    x_range = F.when(turn != 1, F.array(day, F.date_format(start + F.expr("interval 30 hours"), "yyyy-MM-dd HH:mm:ss")))
    note = F.struct(
        F.concat(day, F.lit("T00:00:00+00:00")).alias("saved_at"),
        F.when(F.col("role") == "user", "").otherwise(F.concat(day, F.lit("T12:00"))).alias("created_at"),
        F.concat(F.lit(" "), F.lower(nth(NOTE_SYMBOLS, conv))).alias("symbol"),
        F.when(turn != 2, F.concat(F.lit("turn "), turn)).otherwise(" \t\n").alias("title"),
        F.when(F.pmod(conv, F.lit(7)) != 3, F.col("text")).otherwise("\n\t").alias("body"),
        nth(NOTE_TIMEFRAMES, turn).alias("timeframe"),
        F.struct(F.lit("8h").alias("timeframe"), F.struct(x_range.alias("x_range")).alias("view_state")).alias("snapshot"),
        F.when(F.col("role") == "assistant", F.struct(F.lit(" ok ").alias("status"))).alias("ai_summary"),
    )
    return conversations.select(
        nth(NOTE_SYMBOLS, conv).alias("folder_symbol"),
        F.format_string("c%d_%d", conv, turn).alias("id"),
        F.to_json(note).alias("value"),
    )
