"""Series of a symbol, listings, coverage, and packing into parallel arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions import bucket_floor, finite, iso_utc, timeframe_ms
from barlake.functions.numbers import is_finite
from barlake.schemas import SERIES_COLUMNS


def in_bounds(rows: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Inclusive time bounds; a bound of None is open."""
    if start_ms is not None:
        rows = rows.where(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        rows = rows.where(F.col("ts_ms") <= end_ms)
    return rows


def series(wide: DataFrame, symbol: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """One symbol's chart rows in time order. The filter reaches every scan of the wide table."""
    rows = wide.where(F.col("symbol") == symbol.strip().upper())
    return in_bounds(rows, start_ms, end_ms).select("symbol", "ts_ms", *SERIES_COLUMNS).orderBy("ts_ms")


def funding_series(
    funding: DataFrame, symbol: str, start_ms: int | None = None, end_ms: int | None = None
) -> DataFrame:
    rows = funding.where(F.col("symbol") == symbol.strip().upper())
    return in_bounds(rows, start_ms, end_ms).select("symbol", "ts_ms", "funding_rate").orderBy("ts_ms")


# --- listings -----------------------------------------------------------------


def symbols_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("symbol").isNotNull() & (F.col("symbol") != "")).select("symbol").distinct()


def symbol_list(sources: list[DataFrame | None]) -> DataFrame | None:
    """Sorted symbols of the first source that has any; missing sources are passed over."""
    for rows in sources:
        if rows is not None and not symbols_of(rows).isEmpty():
            return symbols_of(rows).orderBy("symbol")
    return None


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and distinct symbols per table. Counts per symbol first, so both come from one small group."""
    parts = [
        rows.groupBy("symbol").agg(F.count("*").alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("symbol").alias("symbols")
        ).select(F.lit(name).alias("table_name"), "rows", "symbols")
        for name, rows in tables.items()
    ]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    return counts


def coverage(rows: DataFrame, columns: list[str] = SERIES_COLUMNS) -> DataFrame:
    """Per symbol and series: finite values, and whether there is any."""
    wide = rows.groupBy("symbol").agg(*[F.count_if(is_finite(F.col(c))).alias(c) for c in columns])
    return (
        wide.unpivot("symbol", columns, "series", "finite_rows")
        .withColumn("has_data", F.col("finite_rows") > 0)
    )


def empty_series(covered: DataFrame) -> DataFrame:
    """Per symbol: number of series without data."""
    return covered.groupBy("symbol").agg(F.count_if(~F.col("has_data")).alias("empty_series"))


# --- parallel arrays ----------------------------------------------------------


def pack(rows: DataFrame, values: list[str] = SERIES_COLUMNS, page: str = "1d") -> DataFrame:
    """Rows as pages of parallel arrays in time order: ``ts``, one array per column, ``rows``.

    A page is one symbol's slice of a plain time grid (``page`` is a timeframe
    id), never a whole symbol; a smaller grid makes smaller pages. Rows of one
    minute all stay. Nulls stay; NaN and infinities become null.
    """
    timed = rows.where(F.col("ts_ms").isNotNull()).select("symbol", "ts_ms", *[finite(F.col(c)).alias(c) for c in values])
    row = F.struct("ts_ms", *values)
    page_ms = bucket_floor(F.col("ts_ms"), timeframe_ms(page)).alias("page_ms")
    gathered = timed.groupBy("symbol", page_ms).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    return gathered.select(
        "symbol", "page_ms",
        F.size("_rows").cast("bigint").alias("rows"),
        F.transform("_rows", lambda r: iso_utc(r["ts_ms"])).alias("ts"),
        F.col("_rows.ts_ms").alias("ts_ms"),
        *[F.col(f"_rows.{c}").alias(c) for c in values],
    )


def pack_with_funding(bars: DataFrame, funding: DataFrame, page: str = "1d") -> DataFrame:
    """Pages of bars with the funding arrays of the same slice beside them.

    Funding keeps its own time axis and is never joined row by row. A slice
    with only funding still appears when the symbol has bars elsewhere.
    """
    pages = pack(bars, SERIES_COLUMNS, page)
    of_listed = funding.join(symbols_of(bars), "symbol", "left_semi")
    rates = pack(of_listed, ["funding_rate"], page).select(
        "symbol", "page_ms", F.col("ts").alias("funding_ts"), F.col("ts_ms").alias("funding_ts_ms"), "funding_rate",
    )
    joined = pages.join(rates, ["symbol", "page_ms"], "full")
    arrays = [c for c in joined.columns if c not in ("symbol", "page_ms", "rows")]
    return joined.withColumns({
        "rows": F.coalesce("rows", F.lit(0).cast("bigint")),
        **{c: F.coalesce(c, F.array().cast(joined.schema[c].dataType)) for c in arrays},
    })


def unpack(pages: DataFrame, values: list[str] = SERIES_COLUMNS) -> DataFrame:
    """Inverse of :func:`pack`: one row per array position."""
    zipped = F.arrays_zip("ts_ms", *values)
    return pages.select("symbol", F.inline(zipped))
