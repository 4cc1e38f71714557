"""Fixed-schema datasets: texts in, typed rows out.

Every function takes raw texts with ``value`` and ``path_symbol`` (the symbol
of the source folder); other columns, such as ``path`` or a label, are carried.
``symbol`` is the record's own symbol where the dataset has one, else the
folder's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake import schemas
from barlake.functions import guarded_ratio, symbol_or, to_float, to_int, ts_from_ms
from barlake.sources.lines import MARK, marked, unmarked, valid_docs


def _docs(texts: DataFrame, fields: list[str]) -> tuple[DataFrame, list[str]]:
    """The documents, each field as it stands in the text: strings marked, lists and objects as compact JSON. One parse a line."""
    carried = [c for c in texts.columns if c not in ("value", "path_symbol")]
    return valid_docs(texts.withColumn("value", marked(F.col("value"))), schemas.json_struct(fields, MARK)), carried


def _field(name: str) -> Column:
    return F.col(f"doc.`{MARK}{name}`")


def _unquoted(text: Column) -> Column:
    return F.substring(text, F.lit(2), F.length(text))


def _plain(name: str) -> Column:
    """Text of a field, whatever it is."""
    return F.when(_field(name).startswith(MARK), _unquoted(_field(name))).otherwise(unmarked(_field(name)))


def _scalar(text: Column) -> Column:
    """Text of a scalar: JSON true / false as 1 / 0, the literals for infinity as inf; quoted words stay words."""
    literal = F.when(text == "true", "1").when(text == "false", "0").when(text == '"Infinity"', "inf").when(text == '"-Infinity"', "-inf")
    return F.when(text.startswith(MARK), _unquoted(text)).otherwise(F.coalesce(literal, text))


def _with_times(rows: DataFrame, *names: str) -> DataFrame:
    """Put a timestamp beside each ``<name>_ms``; a step of its own, so that the number is parsed once."""
    columns: list[str | Column] = []
    for column in rows.columns:
        columns.append(column)
        if column.removesuffix("_ms") in names:
            columns.append(ts_from_ms(F.col(column)).alias(column.removesuffix("_ms")))
    return rows.select(*columns)


def _list(name: str) -> Column:
    """A list field as it was read; null for anything that is not a list."""
    return F.when(_field(name).startswith("["), _field(name))


def klines(texts: DataFrame) -> DataFrame:
    """Trade, mark, index and premium candles."""
    docs, carried = _docs(texts, schemas.KLINE_JSON)
    raw = _list("raw")
    rows = docs.select(
        F.col("path_symbol").alias("symbol"),
        to_int(_scalar(_field("ts"))).alias("ts_ms"),
        # the list is short: its first element and its length are looked up in its own text
        to_int(_scalar(F.get_json_object(raw, "$[0]"))).alias("ts_from_raw_ms"),
        *[to_float(_scalar(_field(c))).alias(c) for c in [*schemas.PRICE_COLUMNS, "volume", "turnover"]],
        F.coalesce(F.json_array_length(raw) >= 7, F.lit(False)).alias("has_volume_turnover"),
        unmarked(raw).alias("raw_json"),
        unmarked(_list("extra")).alias("extra_json"),
        "path_symbol", *carried,
    )
    return _with_times(rows, "ts", "ts_from_raw")


def _collected(docs: DataFrame, source_field: str, source_name: str) -> DataFrame:
    """Collector and source times; the row's own time prefers the collector's."""
    parsed = docs.withColumns({
        "collector_ts_ms": to_int(_scalar(_field("ts"))),
        f"{source_name}_ms": to_int(_scalar(_field(source_field))),
        f"{source_name}_raw": _plain(source_field),
    })
    return parsed.withColumn("ts_ms", F.coalesce("collector_ts_ms", f"{source_name}_ms"))


def _time_columns(source_name: str) -> list[str]:
    return ["ts_ms", "collector_ts_ms", f"{source_name}_ms", f"{source_name}_raw"]


def funding_history(texts: DataFrame) -> DataFrame:
    docs, carried = _docs(texts, schemas.FUNDING_JSON)
    rows = _collected(docs, "fundingRateTimestamp", "funding_rate_timestamp").select(
        symbol_or(_plain("symbol"), F.col("path_symbol")).alias("symbol"),
        *_time_columns("funding_rate_timestamp"),
        to_float(_scalar(_field("fundingRate"))).alias("funding_rate"),
        "path_symbol", *carried,
    )
    return _with_times(rows, "ts", "collector_ts", "funding_rate_timestamp")


def open_interest(texts: DataFrame) -> DataFrame:
    docs, carried = _docs(texts, schemas.OPEN_INTEREST_JSON)
    rows = _collected(docs, "timestamp", "source_timestamp").select(
        F.col("path_symbol").alias("symbol"),
        *_time_columns("source_timestamp"),
        to_float(_scalar(_field("openInterest"))).alias("open_interest"),
        "path_symbol", *carried,
    )
    return _with_times(rows, "ts", "collector_ts", "source_timestamp")


def account_ratio(texts: DataFrame) -> DataFrame:
    docs, carried = _docs(texts, schemas.ACCOUNT_RATIO_JSON)
    ratios = {"buy_ratio": to_float(_scalar(_field("buyRatio"))), "sell_ratio": to_float(_scalar(_field("sellRatio")))}
    rows = _collected(docs, "timestamp", "source_timestamp").withColumns(ratios).select(
        symbol_or(_plain("symbol"), F.col("path_symbol")).alias("symbol"),
        *_time_columns("source_timestamp"),
        "buy_ratio", "sell_ratio",
        guarded_ratio(F.col("buy_ratio"), F.col("sell_ratio")).alias("long_short_ratio"),
        "path_symbol", *carried,
    )
    return _with_times(rows, "ts", "collector_ts", "source_timestamp")


RISK_LIMIT_DOC = "STRUCT<symbol: STRING, generatedAtIso: STRING, rows: ARRAY<VARIANT>>"


def risk_limit(texts: DataFrame) -> DataFrame:
    """One row per object in ``rows``; numbering counts the non-objects it skips."""
    docs = valid_docs(texts, RISK_LIMIT_DOC)
    carried = [c for c in docs.columns if c not in ("doc", "path_symbol")]
    entries = docs.select(
        symbol_or(F.col("doc.symbol"), F.col("path_symbol")).alias("symbol"),
        F.col("doc.generatedAtIso").alias("generated_at_iso"),
        "path_symbol", *carried,
        F.posexplode("doc.rows").alias("pos", "entry"),
    ).where(F.schema_of_variant("entry").startswith("OBJECT<"))
    # texts first, so that each field is looked up once
    def text(field: str) -> Column:
        value = F.try_variant_get("entry", f"$.{field}", "variant")
        is_flag = F.schema_of_variant(value) == "BOOLEAN"
        return F.when(is_flag, value.try_cast("boolean").cast("int").cast("string")).otherwise(value.try_cast("string"))

    fields = entries.withColumns({f: text(f) for f in schemas.RISK_LIMIT_JSON})
    return fields.select(
        "symbol", "generated_at_iso",
        (F.col("pos") + 1).alias("row_num"),
        to_int(F.col("id")).alias("id"),
        to_float(F.col("riskLimitValue")).alias("risk_limit_value"),
        to_float(F.col("maintenanceMargin")).alias("maintenance_margin"),
        to_float(F.col("initialMargin")).alias("initial_margin"),
        to_int(F.col("isLowestRisk")).alias("is_lowest_risk"),
        to_float(F.col("maxLeverage")).alias("max_leverage"),
        to_float(F.col("mmDeduction")).alias("mm_deduction"),
        "path_symbol", *carried,
    )
