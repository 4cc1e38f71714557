"""Bars over a stream of one-minute rows, in tumbling event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from barlake.functions import ts_from_ms
from barlake.operators.resample import BAR_COLUMNS, bar_aggregates
from barlake.schemas import TIMEFRAMES


def stream_resample(
    rows: DataFrame, timeframe: str, late_by: str = "1 day", order: Column | None = None, last_order: Column | None = None,
) -> DataFrame:
    """Streaming twin of the batch resample; rows later than ``late_by`` are dropped by the watermark.

    Without an order, which of several rows of one time is first and last is left open.
    """
    window = F.window("_time", f"{TIMEFRAMES[timeframe]} minutes")
    return (
        rows.where(F.col("ts_ms").isNotNull())
        .withColumn("_time", ts_from_ms(F.col("ts_ms")))
        .withWatermark("_time", late_by)
        .groupBy("symbol", window.alias("_window"))
        .agg(*bar_aggregates(order, last_order))
        .withColumn("ts_ms", F.unix_millis("_window.start"))
        .select(*BAR_COLUMNS)
    )


#: Batches between two compactions, and how far behind the newest bar a bar is taken to be closed.
CYCLE, OPEN_MS = 8, 2 * 86_400_000


def _newest(versions: DataFrame) -> DataFrame:
    """Of every bar the version of the latest batch."""
    values = F.struct(*[c for c in BAR_COLUMNS if c not in ("symbol", "ts_ms")])
    found = versions.groupBy("symbol", "ts_ms").agg(F.max_by(values, "batch").alias("_bar"), F.max("batch").alias("batch"))
    return found.select("symbol", "ts_ms", "_bar.*", "batch")


def run_updates(bars: DataFrame, path: str, checkpoint: str, cycle: int = CYCLE, open_ms: int = OPEN_MS) -> StreamingQuery:
    """Keep the changed bars of a stream under ``path``, compacted every ``cycle`` batches.

    Each batch has a folder of versions, used again a cycle later. The last
    batch of a cycle merges the open bars of the cycle before with the cycle's
    versions. Bars more than ``open_ms`` behind the newest one go to a folder of
    closed bars that is never read here again, the rest to one of two folders of
    open bars in turn. So closed bars are stored once, and the work of a batch
    grows with the open bars alone. ``open_ms`` below the lateness of the
    stream costs space, not correctness: :func:`latest_bars` goes by batch numbers.

    Until a compaction has ended, all it read is still there, and a repeated
    batch replaces what it wrote before, so a lost run leaves nothing double.
    ``cycle`` must stay the same for a checkpoint. A reader that listed files
    before a folder was used again has to read again.
    """
    schema = StructType([*bars.schema.fields, StructField("batch", LongType()), StructField("part", StringType())])

    def save(batch: DataFrame, batch_id: int) -> None:
        turn, slot = divmod(batch_id, cycle)
        batch.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{path}/part=slot-{slot}")
        if slot < cycle - 1:
            return
        parts = [f"slot-{i}" for i in range(cycle)] + [f"open-{(turn + 1) % 2}"]
        versions = batch.sparkSession.read.schema(schema).parquet(path).where(F.col("part").isin(parts))
        merged = _newest(versions)
        border = merged.agg(F.max("ts_ms") - open_ms).first()[0]
        closed = F.coalesce(F.col("ts_ms") < F.lit(border).cast("bigint"), F.lit(False))
        merged.where(closed).write.mode("overwrite").parquet(f"{path}/part=closed-{turn}")
        merged.where(~closed).write.mode("overwrite").parquet(f"{path}/part=open-{turn % 2}")

    return (
        bars.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_bars(spark: SparkSession, path: str) -> DataFrame:
    """Current state of every bar: its version from the newest batch."""
    return _newest(spark.read.parquet(path)).drop("batch")


def run_append(bars: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every bar once, when the watermark has closed it (exactly-once Parquet sink)."""
    return (
        bars.writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
