"""Research notes as tables: validation, snapshot index, and the bars a snapshot pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions import bucket_floor, clean_key, mixed_time_ms, note_label, slug
from barlake.functions.text import stripped
from barlake.operators.resample import BAR_COLUMNS, resample_all
from barlake.schemas import TIMEFRAMES

DAY_MS = 86_400_000


def _filled(text: Column) -> Column:
    return F.nullif(stripped(text), F.lit(""))


def validate_notes(notes: DataFrame) -> DataFrame:
    """Trimmed notes with ``reject_reason``: the first of symbol, title, body that is missing."""
    cleaned = {
        "symbol": F.upper(_filled(F.col("symbol"))),
        "title": _filled(F.col("title")),
        "body": _filled(F.col("body")),
        "timeframe": _filled(F.col("timeframe")),
        "created_at": _filled(F.col("created_at")),
    }
    reason = F.coalesce(*[
        F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in ("symbol", "title", "body")
    ])
    return notes.withColumns(cleaned).withColumn("reject_reason", reason).withColumn("valid", reason.isNull())


def snapshot_index(notes: DataFrame) -> DataFrame:
    """What a picker of saved snapshots lists. Order it with :func:`newest_first`."""
    return notes.select(
        F.col("folder_symbol").alias("symbol"),
        "id",
        note_label(F.col("created_at"), F.col("saved_at"), F.col("title"), F.col("id")).alias("label"),
        F.coalesce(stripped(F.col("title")), F.lit("")).alias("title"),
        _filled(F.col("saved_at")).alias("saved_at"),
        _filled(F.col("created_at")).alias("created_at"),
        _filled(F.col("timeframe")).alias("timeframe"),
        F.when(F.col("ai_summary").isNotNull(), F.coalesce(stripped(F.col("ai_summary.status")), F.lit(""))).alias("ai_status"),
    )


def newest_first(index: DataFrame) -> DataFrame:
    return index.orderBy(F.coalesce("saved_at", "created_at", "id").desc())


def snapshots_of(notes: DataFrame, symbol: str) -> DataFrame:
    """Index of one symbol, newest first; the folder carries the symbol's slug."""
    folder = slug(F.lit(symbol.strip().upper()), "UNKNOWN")
    return newest_first(snapshot_index(notes.where(F.col("folder_symbol") == folder)))


def snapshot(notes: DataFrame, symbol: str, snapshot_id: str) -> DataFrame:
    """One snapshot by exact id; an id that is not a safe folder name matches nothing."""
    wanted = F.lit(snapshot_id.strip())
    folder = slug(F.lit(symbol.strip().upper()), "UNKNOWN")
    return notes.where((F.col("folder_symbol") == folder) & (F.col("id") == wanted) & (slug(wanted) == wanted))


def snapshot_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy(F.col("folder_symbol").alias("symbol")).agg(F.count("*").alias("snapshots"))


def snapshot_view(notes: DataFrame) -> DataFrame:
    """Per note: symbol, timeframe (note's, else snapshot's, else 1m) and x-range in ms (null: whole series)."""
    known = F.array(*[F.lit(tf) for tf in TIMEFRAMES])

    def known_or_null(tf: Column) -> Column:
        return F.when(F.array_contains(known, tf), tf)

    x = F.col("snapshot.view_state.x_range")
    bounds = F.when(F.size(x) == 2, x)
    chosen = F.coalesce(_filled(F.col("timeframe")), _filled(F.col("snapshot.timeframe")), F.lit("1m"))
    return notes.select(
        clean_key(F.col("folder_symbol")).alias("symbol"), "id",
        F.coalesce(known_or_null(chosen), F.lit("1m")).alias("timeframe"),
        mixed_time_ms(bounds[0]).alias("x0_ms"), mixed_time_ms(bounds[1]).alias("x1_ms"),
    )


CHART = ["symbol", "timeframe", "x0_ms", "x1_ms"]


def chart_id(view: DataFrame) -> DataFrame:
    """Views with ``chart``, one id for each different symbol, timeframe and x-range."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CHART]
    return view.withColumn("chart", F.concat_ws("|", *parts))


def snapshot_charts(notes: DataFrame) -> DataFrame:
    """Which chart each note shows; the bars of charts are in :func:`snapshot_bars`."""
    return chart_id(snapshot_view(notes)).select("id", "chart")


def snapshot_bars(notes: DataFrame, rows: DataFrame) -> DataFrame:
    """Bars of each different chart that notes show: those whose start lies in its x-range.

    Charts are laid out by day (every bar lies within one). Only rows of a
    (symbol, day) that some chart shows become bars; bars are made once, by
    aggregates that combine map-side, and meet their charts on (symbol,
    timeframe, day). An open range is closed by the extent of the symbol's rows.
    """
    charts = chart_id(snapshot_view(notes)).select("chart", *CHART).distinct()
    extent = rows.groupBy("symbol").agg(F.min("ts_ms").alias("_first"), F.max("ts_ms").alias("_last"))
    first_day = bucket_floor(F.greatest("x0_ms", "_first"), DAY_MS)
    last_day = bucket_floor(F.least("x1_ms", "_last"), DAY_MS)
    days = F.when(first_day <= last_day, F.sequence(first_day, last_day, F.lit(DAY_MS).cast("bigint")))
    placed = charts.join(extent, "symbol").select("chart", *CHART, F.explode(days).alias("_day"))
    coarse = [tf for tf in TIMEFRAMES if tf != "1m"]

    def shown(wanted: DataFrame, timeframes: list[str]) -> DataFrame:
        dated = rows.withColumn("_day", bucket_floor(F.col("ts_ms"), DAY_MS))
        needed = dated.join(wanted.select("symbol", "_day").distinct(), ["symbol", "_day"], "left_semi").drop("_day")
        bars = resample_all(needed, timeframes).withColumn("_day", bucket_floor(F.col("ts_ms"), DAY_MS))
        return bars.join(wanted, ["symbol", "timeframe", "_day"]).where(
            F.coalesce(F.col("ts_ms") >= F.col("x0_ms"), F.lit(True))
            & F.coalesce(F.col("ts_ms") <= F.col("x1_ms"), F.lit(True))
        ).select("chart", "timeframe", *BAR_COLUMNS)

    # apart, so that without one-minute charts the one-minute rows need not be joined
    minute = F.col("timeframe") == "1m"
    return shown(placed.where(~minute), coarse).unionByName(shown(placed.where(minute), ["1m"]))
