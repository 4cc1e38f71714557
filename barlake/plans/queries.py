"""Registered queries: every operator over the whole given tables.

Sums are rounded (their last digits depend on the order of addition);
everything else is exact. Timestamps are compared as epoch milliseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions import (
    bucket_floor, clean_key, interval_of, iso_utc, iso_utc_millis, marker_times, maybe_numeric, mixed_time_ms,
    slug, symbol_in_path, to_float, to_int,
)
from barlake.operators import events, notes, resample, series
from barlake.plans import driver_tables as dt
from barlake.plans.timeseries import open_wide
from barlake.schemas import SERIES_COLUMNS, WIDE_COLUMNS
from barlake.settings import shared_dir
from barlake.sources import dynamic, ingest, market, report, routing, tables
from barlake.sources.lines import write_documents
from barlake.sources.notes import parse_notes, read_notes
from barlake.streaming.ingest import stream_ingest
from barlake.streaming.resample import latest_bars, run_append, run_updates, stream_resample

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SUMMED = ["kline_volume", "kline_turnover"]

# Parameters of the single-symbol queries.
SYMBOL, START_MS, END_MS = "purchase", 1704240000000, 1705536000000


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(rows: DataFrame, columns: list[str] = SUMMED, digits: int = 6) -> DataFrame:
    return rows.withColumns({c: F.round(c, digits) for c in columns})


def millis(*names: str) -> list[Column]:
    return [F.unix_millis(n).alias(f"{n}_at") for n in names]


# --- ingest ---------------------------------------------------------------------


@query
def jsonl_kline_ingest(spark, sf_dir):
    rows = market.klines(dt.kline_texts(dt.ticks(spark, sf_dir)).drop("dataset", "path"))
    return rows.select(
        "event_id", "symbol", "ts_ms", *millis("ts"), "ts_from_raw_ms", *millis("ts_from_raw"),
        "open", "high", "low", "close", "volume", "turnover", "has_volume_turnover", "raw_json", "extra_json",
    )


@query
def jsonl_funding_ingest(spark, sf_dir):
    rows = market.funding_history(dt.funding_texts(dt.ticks(spark, sf_dir)))
    return rows.select(
        "event_id", "symbol", "path_symbol", "ts_ms", *millis("ts"), "collector_ts_ms", *millis("collector_ts"),
        "funding_rate_timestamp_ms", *millis("funding_rate_timestamp"), "funding_rate_timestamp_raw", "funding_rate",
    )


@query
def jsonl_open_interest_ingest(spark, sf_dir):
    rows = market.open_interest(dt.open_interest_texts(dt.ticks(spark, sf_dir)))
    return rows.select(
        "event_id", "symbol", "ts_ms", "collector_ts_ms", "source_timestamp_ms", *millis("source_timestamp"),
        "source_timestamp_raw", "open_interest",
    )


@query
def jsonl_account_ratio_ingest(spark, sf_dir):
    rows = market.account_ratio(dt.account_ratio_texts(dt.ticks(spark, sf_dir)))
    return rows.select(
        "event_id", "symbol", "ts_ms", "collector_ts_ms", "source_timestamp_ms", "source_timestamp_raw",
        "buy_ratio", "sell_ratio", "long_short_ratio",
    )


@query
def jsonl_generic_flatten(spark, sf_dir):
    rows = dynamic.generic_jsonl(dt.generic_texts(dt.ticks(spark, sf_dir)))
    return dynamic.long_form(rows).select(
        "event_id", "symbol", "ts_ms", "field", "value_str", "value_long", "value_double"
    )


@query
def jsonl_generic_wide(spark, sf_dir):
    rows = dynamic.generic_jsonl(dt.generic_texts(dt.ticks(spark, sf_dir)))
    wide = dynamic.widen(rows, {"a_b_c": "double", "a_e": "double", "list": "string", "text": "bigint", "u": "bigint"})
    return wide.select("event_id", "symbol", "ts_ms", "a_b_c", "a_e", "list", "text", "u")


@query
def generic_field_names(spark, sf_dir):
    return dynamic.field_names(dynamic.generic_jsonl(dt.generic_texts(dt.ticks(spark, sf_dir))))


@query
def ingest_report(spark, sf_dir):
    return report.ingest_report(dt.kline_texts(dt.ticks(spark, sf_dir)))


@query
def duplicate_keys(spark, sf_dir):
    ticks = dt.ticks(spark, sf_dir)
    return report.duplicate_keys(ticks.select("symbol", bucket_floor(F.col("ms"), dt.MINUTE_MS).alias("ts_ms")))


@query
def risk_limit_explode(spark, sf_dir):
    rows = market.risk_limit(dt.risk_limit_texts(dt.table(spark, sf_dir, "orders")))
    return rows.drop("path_symbol").withColumn("row_num", F.col("row_num").cast("bigint"))


@query
def meta_expand(spark, sf_dir):
    rows = dynamic.meta(dt.meta_texts(dt.table(spark, sf_dir, "customer")))
    rows = rows.select("symbol", *millis("listing_time", "collected_from", "collected_to"), "endpoint_state_json", "fields")
    return dynamic.widen(rows, {
        "kline_next": "bigint", "kline_deep": "string", "flag": "boolean", "note": "string", "extra": "string",
    })


@query
def snapshot_flatten(spark, sf_dir):
    rows = dynamic.snapshot(dt.instrument_texts(dt.table(spark, sf_dir, "part")))
    return dynamic.long_form(rows)


def _opened_view(spark: SparkSession, sf_dir: str, file_name: str, template: str, view: str) -> DataFrame:
    """One source file per supplier, converted by a refresh and opened as a view with its keys as columns."""
    root = shared_dir(spark, f"view-{view}")
    texts = dt.supplier_documents(dt.table(spark, sf_dir, "supplier"), template)
    _write_documents(texts, f"{root}/source/{file_name}")
    ingest.refresh(spark, f"{root}/source", f"{root}/lake")
    tables.open_tables(spark, f"{root}/lake")
    return spark.table(view)


@query
def instrument_view(spark, sf_dir):
    rows = _opened_view(spark, sf_dir, "raw/instrument.json", dt.INSTRUMENT_FILE, "instrument")
    return rows.select("symbol", "record_symbol", "priceFilter_tickSize", "priceFilter_range_max", "status", "tags")


@query
def ticker_view(spark, sf_dir):
    rows = _opened_view(spark, sf_dir, "raw/ticker.json", dt.TICKER_FILE, "ticker")
    return rows.select("symbol", "record_symbol", "lastPrice", "turnover", "phone")


@query
def meta_view(spark, sf_dir):
    rows = _opened_view(spark, sf_dir, "meta.json", dt.META_FILE, "meta")
    return rows.select(
        "symbol", "record_symbol", *millis("listing_time"), "listingTimeMs", "kline_next", "kline_deep", "note", "endpoint_state_json")


@query
def instrument_view_second_run(spark, sf_dir):
    """The view after a second refresh: one supplier in five has text where numbers were, one has lost its document."""
    root = shared_dir(spark, "view-second-run")
    suppliers = dt.table(spark, sf_dir, "supplier")
    texts = dt.supplier_documents(suppliers, dt.INSTRUMENT_FILE)
    _write_documents(texts, f"{root}/source/raw/instrument.json")
    ingest.refresh(spark, f"{root}/source", f"{root}/lake")
    changed = dt.supplier_documents(suppliers.where("s_suppkey % 5 = 1"), dt.CHANGED_INSTRUMENT_FILE)
    changed = changed.withColumn("value", F.when(F.col("path_symbol") == "S1", " ").otherwise(F.col("value")))
    _write_documents(changed, f"{root}/source/raw/instrument.json")
    ingest.refresh(spark, f"{root}/source", f"{root}/lake")
    tables.open_tables(spark, f"{root}/lake")
    return spark.table("instrument").select("symbol", "record_symbol", "priceFilter_tickSize", "priceFilter_range_max", "tags")


# --- symbols, routing, labels -----------------------------------------------------


def _symbol_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = dt.table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" ")).alias("symbol"))
    types = dt.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"))
    blanks = dt.table(spark, sf_dir, "nation").select(F.lit(" \t\n").alias("symbol"))
    return routing.select_symbols(segments, types, blanks)


@query
def symbol_selection(spark, sf_dir):
    return _symbol_lists(spark, sf_dir)


# Source file names, of every dataset and of none.
FILE_NAMES = [
    "kline_1.jsonl", "mark_price_kline_1.jsonl", "index_price_kline_15.jsonl", "premium_index_price_kline_D.jsonl",
    "funding_history.jsonl", "open_interest_5min.jsonl", "account_ratio_1h.jsonl", "liquidations.jsonl",
    "risk_limit.json", "meta.json", "raw/instrument.json", "raw/ticker.json", "other.json", "raw/kline_1.jsonl",
    "kline_5.jsonl/part-00001.txt",
]


def _source_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in FILE_NAMES])
    name = F.element_at(names, (F.pmod(F.col("user_id"), F.lit(len(FILE_NAMES))) + 1).cast("int"))
    return dt.ticks(spark, sf_dir).select(
        "event_id", "ms", "size",
        F.concat(F.lit("/data/symbols/"), F.lower("symbol"), F.lit("/"), name).alias("path"),
    )


@query
def missing_symbols(spark, sf_dir):
    return routing.missing_symbols(routing.route(_source_paths(spark, sf_dir)), _symbol_lists(spark, sf_dir))


@query
def selected_files(spark, sf_dir):
    files = routing.route(_source_paths(spark, sf_dir))
    counts = routing.for_symbols(files, _symbol_lists(spark, sf_dir)).groupBy("path_symbol", "dataset")
    return counts.agg(F.count("*").alias("files"))


@query
def dataset_routing(spark, sf_dir):
    return routing.route(_source_paths(spark, sf_dir)).select("event_id", "path", "path_symbol", "dataset", "label")


@query
def path_labels(spark, sf_dir):
    ticks = dt.ticks(spark, sf_dir)
    path = F.format_string("/lake/symbol=%s/mark_price_kline_%s.parquet", "symbol", "user_id")
    return ticks.select("event_id", path.alias("path")).select(
        "event_id",
        symbol_in_path(F.col("path")).alias("symbol_partition"),
        interval_of(F.col("path"), "mark_price_kline").alias("interval"),
        interval_of(F.col("path"), "kline").alias("no_interval"),
    )


@query
def union_by_name(spark, sf_dir):
    ticks = dt.ticks(spark, sf_dir)
    return tables.union_by_name(
        dt.mark_price_kline(ticks), dt.open_interest(ticks), dt.account_ratio(ticks)
    )


# --- wide table, series, listings ---------------------------------------------------


@query
def timeseries_1m_wide(spark, sf_dir):
    wide = rounded(dt.wide(spark, sf_dir))
    return wide.select(*[F.unix_millis("ts").alias("ts_at") if c == "ts" else c for c in WIDE_COLUMNS])


@query
def basis_bps(spark, sf_dir):
    wide = dt.wide(spark, sf_dir)
    return wide.groupBy("symbol").agg(
        F.count("basis_bps").alias("n"), F.min("basis_bps").alias("lowest"), F.max("basis_bps").alias("highest"),
        F.count_if((F.col("index_close") == 0)).alias("zero_index"),
    )


@query
def series_filter_bounds(spark, sf_dir):
    return rounded(series.series(dt.wide(spark, sf_dir), SYMBOL, START_MS, END_MS))


@query
def funding_series(spark, sf_dir):
    return series.funding_series(dt.funding(dt.ticks(spark, sf_dir)), f" {SYMBOL} ", START_MS, None)


@query
def view_counts(spark, sf_dir):
    ticks = dt.ticks(spark, sf_dir)
    views = {**dt.market_tables(ticks), "funding_history": dt.funding(ticks)}
    return series.row_counts({**views, "symbol_timeseries_1m": dt.wide(spark, sf_dir)})


@query
def sql_over_views(spark, sf_dir):
    """The chart query as SQL text with bound parameters, over the temp views."""
    open_wide(dt.market_tables(dt.ticks(spark, sf_dir)))
    return rounded(spark.sql(
        """SELECT symbol, ts_ms, kline_close, mark_close, index_close, premium_close, kline_volume, kline_turnover,
                  open_interest, buy_ratio, sell_ratio, long_short_ratio, basis_bps
           FROM symbol_timeseries_1m
           WHERE symbol = :symbol AND (:start IS NULL OR ts_ms >= :start) AND (:end IS NULL OR ts_ms <= :end)
           ORDER BY ts_ms""",
        args={"symbol": SYMBOL.upper(), "start": START_MS, "end": None},
    ))


@query
def symbol_list(spark, sf_dir):
    ticks = dt.ticks(spark, sf_dir)
    market_1m = dt.market_kline(ticks).where(F.col("interval") == "1")
    return series.symbol_list([None, market_1m, dt.funding(ticks)])


@query
def stored_symbols(spark, sf_dir):
    """Symbols of the first stored table that has any, by its folders."""
    root = shared_dir(spark, "stored-symbols")
    lines = dt.funding_texts(dt.ticks(spark, sf_dir).where("symbol <> 'VIEW'"))
    rows = market.funding_history(lines.select("value", "path_symbol"))
    tables.write_dataset(rows, root, routing.BY_NAME["funding_history"])
    return tables.listed_symbols(spark, root, ["market_kline", "funding_history"])


@query
def series_coverage(spark, sf_dir):
    return series.coverage(dt.wide(spark, sf_dir))


@query
def series_empty(spark, sf_dir):
    wide = dt.wide(spark, sf_dir).withColumn("open_interest", F.lit(None).cast("double"))
    return series.empty_series(series.coverage(wide))


# --- resample -------------------------------------------------------------------------


def _resampled(timeframe: str) -> Query:
    return lambda spark, sf_dir: rounded(resample.resample(dt.wide(spark, sf_dir), timeframe))


for _timeframe in ("1m", "5m", "15m", "30m", "1h", "2h", "4h", "8h", "12h", "1d"):
    QUERIES[f"resample_{_timeframe}"] = _resampled(_timeframe)


@query
def resample_all_timeframes(spark, sf_dir):
    return rounded(resample.resample_all(dt.wide(spark, sf_dir)))


@query
def resample_funding_8h(spark, sf_dir):
    return resample.resample_funding(dt.funding(dt.ticks(spark, sf_dir)), "8h")


def _with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table with NaN and infinities in some series, by the minute."""
    wide, minute = dt.wide(spark, sf_dir), F.floor(F.col("ts_ms") / dt.MINUTE_MS)

    def every(n: int, value: float, column: str) -> Column:
        return F.when(F.pmod(minute, F.lit(n)) == 0, F.lit(value)).otherwise(F.col(column))

    inf, nan = float("inf"), float("nan")
    return wide.withColumns({
        "kline_open": every(2, nan, "kline_open"), "kline_close": every(3, inf, "kline_close"), "kline_high": every(5, -inf, "kline_high"),
        "kline_volume": every(7, nan, "kline_volume"), "mark_close": every(2, inf, "mark_close"), "basis_bps": every(3, nan, "basis_bps"),
    })


@query
def nonfinite_resample_1h(spark, sf_dir):
    return rounded(resample.resample(_with_gaps(spark, sf_dir), "1h"))


@query
def nonfinite_coverage(spark, sf_dir):
    return series.coverage(_with_gaps(spark, sf_dir))


@query
def nonfinite_pack(spark, sf_dir):
    pages = series.pack(_with_gaps(spark, sf_dir), ["kline_open", "mark_close"])
    whole = [_csv(F.transform(c, lambda x: F.round(x * 100).cast("bigint"))).alias(c) for c in ("kline_open", "mark_close")]
    return pages.select("symbol", "page_ms", "rows", *whole)


# --- parallel arrays --------------------------------------------------------------------


def _csv(values: Column) -> Column:
    return F.array_join(values, ",", "null")


@query
def series_pack(spark, sf_dir):
    """Day pages of minute rows with funding beside them; arrays as text."""
    pages = series.pack_with_funding(dt.wide(spark, sf_dir), dt.funding(dt.ticks(spark, sf_dir)))
    return pages.select(
        "symbol", "page_ms", "rows", _csv(F.col("ts")).alias("ts"), _csv(F.col("funding_ts")).alias("funding_ts"),
        *[_csv(F.transform(c, lambda x: F.round(x * 100).cast("bigint"))).alias(c) for c in SERIES_COLUMNS],
        _csv(F.transform("funding_rate", lambda x: F.round(x * 1000000).cast("bigint"))).alias("funding_rate"),
    )


@query
def series_pack_1h(spark, sf_dir):
    """Pages of resampled bars."""
    pages = series.pack(resample.resample(dt.wide(spark, sf_dir), "1h"), page="1d")
    return pages.select(
        "symbol", "page_ms", "rows", _csv(F.col("ts")).alias("ts"),
        _csv(F.transform("kline_high", lambda x: F.round(x * 100).cast("bigint"))).alias("kline_high"),
    )


@query
def series_unpack(spark, sf_dir):
    pages = series.pack(dt.wide(spark, sf_dir))
    return rounded(series.unpack(pages))


# --- event study --------------------------------------------------------------------------


def _study(spark: SparkSession, sf_dir: str, by_symbol: bool) -> DataFrame:
    result = events.event_study(
        dt.wide(spark, sf_dir), F.col("basis_bps") > 0, by_symbol=by_symbol, work_path=shared_dir(spark, "event-study"),
    )
    result = result.withColumn("horizon_hours", F.col("horizon_hours").cast("bigint"))
    return rounded(result, ["mean_move", "median_move"])


@query
def event_study_overall(spark, sf_dir):
    return _study(spark, sf_dir, by_symbol=False)


@query
def event_study_by_symbol(spark, sf_dir):
    return _study(spark, sf_dir, by_symbol=True)


@query
def event_forward_moves(spark, sf_dir):
    moves = events.forward_moves(dt.wide(spark, sf_dir), F.col("kline_volume") > 50, [1, 20])
    return moves.withColumn("horizon_hours", F.col("horizon_hours").cast("bigint"))


@query
def event_study_ticks(spark, sf_dir):
    """Several rows of one time: the price is that of the row with the largest id, not the highest."""
    rows = dt.ticks(spark, sf_dir).select("symbol", bucket_floor(F.col("ms"), 3_600_000).alias("ts_ms"), "event_id", "price", "size")
    result = events.event_study(rows, F.col("size") > 90, [1, 4], "price", by_symbol=True, order=F.col("event_id"))
    return rounded(result.withColumn("horizon_hours", F.col("horizon_hours").cast("bigint")), ["mean_move", "median_move"])


@query
def event_study_markdown(spark, sf_dir):
    """The counts of a study as lines of a markdown table."""
    counts = _study(spark, sf_dir, by_symbol=True).select("symbol", "horizon_hours", "event_count", "up_count", "down_count")
    return events.markdown_rows(counts)


@query
def event_study_csv(spark, sf_dir):
    """The counts of a study written as CSV and read back."""
    path = shared_dir(spark, "study-csv")
    counts = _study(spark, sf_dir, by_symbol=True).select("symbol", "horizon_hours", "event_count", "up_count", "down_count")
    events.write_csv(counts, path)
    return spark.read.schema(counts.schema).option("header", "true").csv(path)


# --- scalars --------------------------------------------------------------------------------


@query
def iso_text(spark, sf_dir):
    return dt.ticks(spark, sf_dir).select(
        "event_id", iso_utc(F.col("ms")).alias("iso"), iso_utc_millis(F.col("ms")).alias("iso_millis"),
        iso_utc(bucket_floor(F.col("ms"), dt.MINUTE_MS)).alias("iso_minute"),
    )


def _time_texts() -> Column:
    """The same instant in several spellings, seconds precise, and some that do not parse."""
    second = bucket_floor(F.col("ms"), 1000)
    at = F.timestamp_millis(second)
    return F.array(
        second.cast("string"), (second / 1000).cast("bigint").cast("string"),
        F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.concat(F.date_format(at + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")),
        F.concat(F.date_format(at - F.expr("interval 5 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-0500")),
        F.date_format(at, "yyyy-MM-dd"), F.lit("bad"), F.lit(""), F.date_format(at, "yyyy-MM"),
        F.concat(F.lit("\n"), F.date_format(at, "yyyy-MM-dd"), F.lit("\t")),
    )


@query
def timestamp_normalise(spark, sf_dir):
    texts = dt.ticks(spark, sf_dir).select("event_id", F.posexplode(_time_texts()).alias("spelling", "text"))
    return texts.select("event_id", F.col("spelling").cast("bigint").alias("spelling"), mixed_time_ms(F.col("text")).alias("ms"))


@query
def marker_list_normalise(spark, sf_dir):
    return dt.ticks(spark, sf_dir).select("event_id", _csv(marker_times(_time_texts())).alias("markers"))


@query
def slugify(spark, sf_dir):
    urls = dt.table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("t"))
    texts = dt.table(spark, sf_dir, "conversations").select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("t"))
    return urls.unionByName(texts).select("kind", "id", slug(F.col("t"), "note").alias("slug"))


@query
def numeric_parse(spark, sf_dir):
    n = F.col("user_id").cast("string")
    texts = F.array(
        F.concat(F.lit(" "), n, F.lit(" ")), F.concat(n, F.lit(".9")), F.concat(F.lit("-"), n, F.lit(".9")),
        F.concat(n, F.lit("e3")), F.concat(F.lit("x"), n), F.lit(""), F.lit("true"), F.concat(n, F.lit(".")),
        F.concat(F.lit("."), n), F.concat(F.lit("+"), n), F.concat(n, F.lit("d")), F.lit("1e400"),
        F.concat(F.lit("\n"), n, F.lit(".5\t")), F.concat(F.lit("\u2003"), n, F.lit("\xa0")),
    )
    rows = dt.ticks(spark, sf_dir).select("event_id", F.posexplode(texts).alias("spelling", "text"))
    as_float = to_float(F.col("text"))
    return rows.select(
        "event_id", F.col("spelling").cast("bigint").alias("spelling"),
        to_int(F.col("text")).alias("as_int"),
        F.when(F.abs(as_float) < float("inf"), as_float).alias("as_float"),
        maybe_numeric(F.col("text")).alias("m"),
    ).select("event_id", "spelling", "as_int", "as_float", "m.value_str", "m.value_long", "m.value_double")


@query
def clean_symbols(spark, sf_dir):
    names = dt.table(spark, sf_dir, "part").select(
        "p_partkey", clean_key(F.concat(F.lit(" \t"), F.col("p_name"), F.lit("\n\u3000"))).alias("symbol"))
    return names.groupBy("symbol").agg(F.count("*").alias("n"))


# --- notes ------------------------------------------------------------------------------------


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_notes(dt.note_texts(dt.table(spark, sf_dir, "conversations")))


@query
def snapshot_index(spark, sf_dir):
    return notes.newest_first(notes.snapshot_index(_notes(spark, sf_dir)))


@query
def snapshots_of_symbol(spark, sf_dir):
    return notes.snapshots_of(_notes(spark, sf_dir), SYMBOL)


@query
def snapshot_by_id(spark, sf_dir):
    return notes.snapshot(_notes(spark, sf_dir), "view", "c4_0").select("id", "title", "body", "timeframe")


@query
def snapshot_counts(spark, sf_dir):
    return notes.snapshot_counts(_notes(spark, sf_dir))


@query
def note_validation(spark, sf_dir):
    return notes.validate_notes(_notes(spark, sf_dir)).select(
        "id", "symbol", "title", "body", "timeframe", "created_at", "valid", "reject_reason"
    )


@query
def snapshot_views(spark, sf_dir):
    return notes.snapshot_view(_notes(spark, sf_dir))


@query
def snapshot_charts(spark, sf_dir):
    return notes.snapshot_charts(_notes(spark, sf_dir))


@query
def snapshot_bars(spark, sf_dir):
    """Bars per chart that notes show, from a stored wide table (it is read several times)."""
    path = shared_dir(spark, "wide")
    tables.write_by_symbol(dt.wide(spark, sf_dir).drop("ts"), path)
    return rounded(notes.snapshot_bars(_notes(spark, sf_dir), spark.read.parquet(path)))


@query
def note_files(spark, sf_dir):
    """Notes written as files, those of one conversation in ten written again, and all read with which ones are newer."""
    root = shared_dir(spark, "note-files")
    turns = dt.table(spark, sf_dir, "conversations").where("turn < 2")

    def land(rows: DataFrame) -> None:
        texts = dt.note_texts(rows).select("value", F.col("folder_symbol").alias("symbol"), "id")
        write_documents(texts, f"{root}/note.json", ["symbol", "id"])

    land(turns)
    first = read_notes(spark, root).agg(F.max("modified_at")).first()[0]
    land(turns.where("conv_id % 10 = 3").withColumn("role", F.lit("assistant")).withColumn("text", F.lit("again")))
    newer = read_notes(spark, root, since=first).select("folder_symbol", "id", F.lit(True).alias("again"))
    found = read_notes(spark, root).join(newer.hint("shuffle_hash"), ["folder_symbol", "id"], "left")
    return found.select(
        F.col("folder_symbol").alias("symbol"), "id", "body", F.coalesce("again", F.lit(False)).alias("again"))


# --- incremental and streaming ------------------------------------------------------------------


@query
def incremental_changed_files(spark, sf_dir):
    """Files that changed after a manifest that holds an earlier state of about half of them."""
    seen = routing.route(_source_paths(spark, sf_dir)).where(F.col("dataset").isNotNull())
    units = ["path", *ingest.UNIT]
    files = seen.groupBy(*units).agg(F.max(F.timestamp_millis("ms")).alias("modified_at"))
    manifest = seen.where(F.col("size") < 50).select("path", F.timestamp_millis("ms").alias("modified_at"))
    rebuild = ingest.files_to_rebuild(files, ingest.changed_files(files, manifest))
    return rebuild.select(*units, F.unix_millis("modified_at").alias("modified_ms"))


# Columns of the funding table that the queries over it return.
FUNDING_COLUMNS = ["symbol", "record_symbol", "ts_ms", "collector_ts_ms", "funding_rate_timestamp_ms", "funding_rate"]


class _FundingLake:
    """Funding lines as source files that come in two parts, and the table made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str, purpose: str):
        self.spark, self.root = spark, shared_dir(spark, purpose)
        self.ticks = dt.ticks(spark, sf_dir)

    def land(self, rows: DataFrame, mode: str = "append") -> None:
        texts = dt.funding_texts(rows).select("value", F.col("path_symbol").alias("symbol"))
        texts.write.mode(mode).partitionBy("symbol").text(f"{self.root}/source/funding_history.jsonl")

    def refresh(self) -> None:
        ingest.refresh(self.spark, f"{self.root}/source", f"{self.root}/lake")

    def stream(self) -> None:
        stream_ingest(
            self.spark, f"{self.root}/source", f"{self.root}/lake", f"{self.root}/checkpoint", "funding_history",
        ).awaitTermination()

    def rows(self) -> DataFrame:
        return tables.read_dataset(self.spark, f"{self.root}/lake", "funding_history").select(FUNDING_COLUMNS)


@query
def stream_ingest_funding(spark, sf_dir):
    """Funding lines written as source files, streamed into a typed table, read back."""
    lake = _FundingLake(spark, sf_dir, "stream-ingest")
    lake.land(lake.ticks)
    lake.stream()
    return lake.rows()


@query
def refresh_then_stream(spark, sf_dir):
    """Half of the lines converted by a refresh, the other half by a stream on the same table."""
    lake = _FundingLake(spark, sf_dir, "refresh-then-stream")
    lake.land(lake.ticks.where("size < 50"))
    lake.refresh()
    lake.land(lake.ticks.where("size >= 50"))
    lake.stream()
    return lake.rows()


@query
def stream_then_refresh(spark, sf_dir):
    """The other order: a stream first, then a refresh on the same table."""
    lake = _FundingLake(spark, sf_dir, "stream-then-refresh")
    lake.land(lake.ticks.where("size < 50"))
    lake.stream()
    lake.land(lake.ticks.where("size >= 50"))
    lake.refresh()
    return lake.rows()


@query
def refresh_second_run(spark, sf_dir):
    """A second refresh after one symbol's source was emptied, one is new and the others got more lines."""
    lake = _FundingLake(spark, sf_dir, "refresh-second-run")
    lake.land(lake.ticks.where("size < 50 and symbol <> 'VIEW'"))
    lake.refresh()
    lake.land(lake.ticks.where("size >= 50 and symbol <> 'SIGNUP'"))
    spark.range(1).select(F.lit(" ").alias("value")).write.mode("overwrite").text(
        f"{lake.root}/source/funding_history.jsonl/symbol=SIGNUP")
    lake.refresh()
    return lake.rows()


def _write_texts(texts: DataFrame, folder: str) -> None:
    texts.select("value", F.col("path_symbol").alias("symbol")).write.partitionBy("symbol").text(folder)


def _write_documents(texts: DataFrame, folder: str) -> None:
    write_documents(texts.select("value", F.col("path_symbol").alias("symbol")), folder, ["symbol"])


def _candle_texts(candles: DataFrame) -> DataFrame:
    fields = [c for c in ("open", "high", "low", "close", "volume", "turnover") if c in candles.columns]
    return candles.select(
        F.col("symbol").alias("path_symbol"), F.to_json(F.struct(F.col("ts_ms").alias("ts"), *fields)).alias("value"))


@query
def ingest_to_wide(spark, sf_dir):
    """Source files to typed tables to the stored wide table, read back."""
    root = shared_dir(spark, "ingest-to-wide")
    ticks = dt.ticks(spark, sf_dir)
    sources = {
        "kline_1": _candle_texts(dt.candles(ticks, F.col("price"), volume=True)),
        "kline_60": _candle_texts(dt.candles(ticks, F.col("price"), "60", volume=True)),
        "mark_price_kline_1": _candle_texts(dt.mark_price_kline(ticks)),
        "index_price_kline_1": _candle_texts(dt.index_price_kline(ticks)),
        "premium_index_price_kline_1": _candle_texts(dt.premium_index_price_kline(ticks)),
        "open_interest_5min": dt.open_interest(ticks).select(
            F.col("symbol").alias("path_symbol"),
            F.to_json(F.struct(F.col("ts_ms").alias("timestamp"), F.col("open_interest").alias("openInterest"))).alias("value")),
        "account_ratio_5min": dt.account_ratio(ticks).select(
            F.col("symbol").alias("path_symbol"),
            F.to_json(F.struct(F.col("ts_ms").alias("ts"), F.col("buy_ratio").alias("buyRatio"),
                               F.col("sell_ratio").alias("sellRatio"))).alias("value")),
    }
    for name, texts in sources.items():
        _write_texts(texts, f"{root}/source/{name}.jsonl")
    ingest.refresh(spark, f"{root}/source", f"{root}/lake")
    wide = open_wide(tables.open_tables(spark, f"{root}/lake"))
    tables.write_by_symbol(wide.drop("ts"), f"{root}/wide")
    return rounded(spark.read.parquet(f"{root}/wide"))


def _streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars over a stream of the events table, each tick a row of its own."""
    batch = dt.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/{{events}}.parquet")  # as a pattern, a file or a folder
    rows = dt.ticks_of(stream, dt.file_ranks(batch)).select(
        "symbol", F.col("ms").alias("ts_ms"), "place",
        *[F.col("price").alias(f"kline_{p}") for p in ("open", "high", "low", "close")],
        F.col("size").alias("kline_volume"), (F.col("size") * F.col("price")).alias("kline_turnover"),
        *[F.col("size").alias(c) for c in SERIES_COLUMNS if not c.startswith("kline_")],
    )
    return stream_resample(rows, "1h", "1 day", dt.tick_order("ts_ms"), dt.tick_order("ts_ms", last=True))


@query
def stream_resample_1h(spark, sf_dir):
    """Every bar, as of the newest batch."""
    root = shared_dir(spark, "stream-resample")
    run_updates(_streamed_bars(spark, sf_dir), f"{root}/bars", f"{root}/checkpoint").awaitTermination()
    return rounded(latest_bars(spark, f"{root}/bars"))


@query
def stream_append_1h(spark, sf_dir):
    """Only bars the watermark has closed: those that end a day before the newest tick."""
    root = shared_dir(spark, "stream-append")
    run_append(_streamed_bars(spark, sf_dir), f"{root}/bars", f"{root}/checkpoint").awaitTermination()
    return rounded(spark.read.parquet(f"{root}/bars"))
