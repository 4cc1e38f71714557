"""Convert newly landed source files as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barlake.settings import configure
from barlake.sources.ingest import append_new
from barlake.sources.routing import route


def stream_ingest(
    spark: SparkSession, source_root: str, table_root: str, checkpoint: str, dataset: str | None = None,
    max_files: int = 10_000, **write_options,
) -> StreamingQuery:
    """Append the rows of every file not seen before, then stop.

    A batch reads its own new files only, at most ``max_files``, and leaves
    stored rows alone. ``dataset`` restricts it to one dataset. Stream and
    refresh share one manifest, so they may take turns on a table in any order:
    files that a refresh has converted are skipped, and a batch that runs again
    after a failure has its partitions rebuilt instead of appended twice. A file
    that changes after the stream has seen it is left to the next refresh.
    """
    configure(spark)
    listing = spark.readStream.format("binaryFile").schema(
        "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
    ).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(source_root)
    datasets = [dataset] if dataset else None

    def convert(batch: DataFrame, batch_id: int) -> None:
        files = route(batch).where(F.col("dataset").isin(datasets) if datasets else F.col("dataset").isNotNull())
        append_new(files, source_root, table_root, datasets, **write_options)

    return (
        listing.select("path", F.col("modificationTime").alias("modified_at")).writeStream.foreachBatch(convert)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
