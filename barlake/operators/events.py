"""Event study: what the price does after an event, over all symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions import finite
from barlake.operators.quantiles import exact_median
from barlake.schemas import EVENT_HORIZON_HOURS

HOUR_MS = 3_600_000
STATISTICS = [
    "event_count", "up_count", "down_count", "mean_move", "median_move", "max_up", "max_down", "win_rate",
]


def forward_moves(
    bars: DataFrame, predicate: Column, horizons: list[int] | None = None, price: str = "kline_close",
    order: Column | None = None,
) -> DataFrame:
    """One row per event and horizon: ``move`` = price at exactly ``ts_ms + h`` over the event's price, less 1.

    A horizon is a time offset, not a row offset; with no bar at that minute
    (or no price) the move is null. Rows of one minute collapse to one bar
    first (event if any row is one), so copies neither pair up nor pile onto one
    task; the same shuffle then serves the join. The bar's price is the last one
    of the minute by ``order``, which should be or end in a unique column; rows
    that have none are taken to be copies, of which the highest price counts.
    """
    value = finite(F.col(price))
    own = F.max(value) if order is None else F.max_by(value, F.when(value.isNotNull(), order))
    hours = EVENT_HORIZON_HOURS if horizons is None else horizons
    minutes = bars.groupBy("symbol", "ts_ms").agg(
        own.alias("_price"),
        F.max(F.coalesce(predicate, F.lit(False))).alias("_event"),
    )
    targets = F.array(*[
        F.struct(F.lit(h).alias("horizon_hours"), (F.col("ts_ms") + h * HOUR_MS).alias("_target")) for h in hours
    ])
    events = minutes.where("_event").select(
        "symbol", F.col("ts_ms").alias("event_ts_ms"), F.col("_price").alias("_start"), F.inline(targets)
    )
    later = minutes.select("symbol", F.col("ts_ms").alias("_target"), F.col("_price").alias("_later"))
    move = F.when(F.col("_start") != 0, F.col("_later") / F.col("_start") - 1)
    return events.join(later, ["symbol", "_target"], "left").select(
        "symbol", "event_ts_ms", "horizon_hours", finite(move).alias("move")
    )


def event_study(
    bars: DataFrame, predicate: Column, horizons: list[int] | None = None, price: str = "kline_close",
    by_symbol: bool = False, work_path: str | None = None, order: Column | None = None,
) -> DataFrame:
    """Statistics of the forward moves per horizon (and symbol).

    The statistics read the moves several times. With ``work_path``, a folder
    every executor can reach, the moves are stored there first, so that the
    join behind them runs once; do so for any large study.
    """
    moves = forward_moves(bars, predicate, horizons, price, order).select("symbol", "horizon_hours", "move")
    if work_path is not None:
        moves.write.mode("overwrite").parquet(work_path)
        moves = bars.sparkSession.read.parquet(work_path)
    return move_statistics(moves, by_symbol)


def move_statistics(moves: DataFrame, by_symbol: bool = False) -> DataFrame:
    """Statistics per horizon (and symbol) of a moves table.

    ``event_count`` counts all events; the other figures cover the events
    that have a move. Up and down are strict; an unchanged price is neither.
    """
    keys = ["symbol", "horizon_hours"] if by_symbol else ["horizon_hours"]
    move = F.col("move")
    totals = moves.groupBy(*keys).agg(
        F.count("*").alias("event_count"),
        F.count("move").alias("move_count"),
        F.count_if(move > 0).alias("up_count"),
        F.count_if(move < 0).alias("down_count"),
        F.avg("move").alias("mean_move"),
        F.max("move").alias("max_up"),
        F.min("move").alias("max_down"),
        F.avg((move > 0).cast("double")).alias("win_rate"),
    )
    medians = exact_median(moves.where(move.isNotNull()), keys, "move")
    return (
        totals.join(medians.withColumnRenamed("median", "median_move"), keys, "left")
        .select(*keys, "event_count", "move_count", *STATISTICS[1:])
    )


# --- result files (a few rows per symbol) --------------------------------------


def write_csv(result: DataFrame, path: str) -> None:
    # a few rows, gathered after the aggregates and not by running those in one task
    result.repartition(1).write.mode("overwrite").option("header", "true").csv(path)


def markdown_rows(result: DataFrame) -> DataFrame:
    """The result as markdown table lines, in order."""
    def row(cells: list[Column]) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    names = result.columns
    keys = [c for c in ("symbol", "horizon_hours") if c in names]
    body = result.select(
        *keys, F.lit(2).alias("_part"),
        row([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]).alias("value"),
    )
    head = [(0, "| " + " | ".join(names) + " |"), (1, "|" + " --- |" * len(names))]
    top = result.sparkSession.createDataFrame(head, "_part INT, value STRING")
    return body.unionByName(top, allowMissingColumns=True).orderBy("_part", *keys).select("value")


def write_markdown(result: DataFrame, path: str) -> None:
    markdown_rows(result).write.mode("overwrite").text(path)
