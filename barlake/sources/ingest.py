"""Convert source files to typed tables: in full, only what changed, or only what is new."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.settings import configure, delete, shared_dir
from barlake.sources.lines import decoded, document_texts, read_texts
from barlake.sources.routing import BUCKETS, DATASETS, DOCUMENTS, Dataset, bucket_of, for_symbols, route, source_files
from barlake.sources.tables import append_key_types, read_stored, stored_files, table_path, write_dataset, write_key_types

T = TypeVar("T")

UNIT = ["dataset", "label", "path_symbol"]  # one source, and one table partition where it is no document
FOLDER = ["dataset", "label", "folder"]  # one folder of a table
MANIFEST = "manifest"
MANIFEST_SCHEMA = "path STRING, modified_at TIMESTAMP, in_buckets BOOLEAN"
ROUND_FILES = 20_000  # files of lines that one round converts, some more where a table partition has more


def dataset_texts(spark: SparkSession, paths: list[str], dataset: Dataset) -> DataFrame:
    """Raw texts of one dataset with path, symbol and label columns."""
    texts = route(read_texts(spark, paths, dataset.whole_files))
    return texts.withColumnRenamed("label", dataset.label) if dataset.label else texts.drop("label")


def parse_files(spark: SparkSession, paths: list[str], dataset: Dataset) -> DataFrame:
    return dataset.parse(dataset_texts(spark, paths, dataset)).drop("path", "modified_at", "dataset")


def _documents(files: DataFrame, dataset: Dataset) -> DataFrame:
    """Parsed documents of a file plan. Tasks open the files, so that no file name passes through the driver."""
    mine = files.where((F.col("dataset") == dataset.name) & _by_tasks())
    texts = document_texts(mine.select("path", "path_symbol").repartition(BUCKETS, "path_symbol"))
    return dataset.parse(texts).drop("path")


def _by_tasks() -> Column:
    """Whether tasks can open a file of a plan on their own."""
    return F.col("dataset").isin(DOCUMENTS) & F.col("path").startswith("file:/")


def ingest(
    spark: SparkSession, source_root: str, table_root: str, symbols: DataFrame | None = None, **write_options,
) -> None:
    """Convert every selected source file. One job per dataset and round covers many symbols."""
    configure(spark)
    files = source_files(spark, source_root)
    files = files if symbols is None else for_symbols(files, symbols)

    def convert(plan: DataFrame) -> None:
        for part in _rounds(plan):
            _ingest_files(spark, part, table_root, **write_options)
            _note_key_types(spark, part, table_root)

    with_plan(files, convert)


def with_plan(files: DataFrame, use: Callable[[DataFrame], T]) -> T:
    """Call ``use`` on a stored copy of a file list: a file touched while it is converted is left to the next run."""
    spark = files.sparkSession
    folder = shared_dir(spark, "file-plan")
    files.select("path", "modified_at", *UNIT).write.parquet(folder)
    try:
        return use(spark.read.parquet(folder))
    finally:
        delete(spark, folder)


def _rounds(plan: DataFrame) -> Iterator[DataFrame]:
    """The plan in parts of whole table folders, so that a list of file names on the driver stays short."""
    placed = plan.withColumn("folder", folder())
    count = -(-plan.where(~_by_tasks()).count() // ROUND_FILES)
    if count < 2:
        if not plan.isEmpty():
            yield placed
        return
    part = F.pmod(F.xxhash64(*FOLDER), F.lit(count))
    for number in range(count):
        yield placed.where(F.when(F.col("dataset").isin(DOCUMENTS), F.lit(0)).otherwise(part) == number)


def folder() -> Column:
    """The folder of a table, below its label, that the rows of a source file lie in."""
    symbol = F.col("path_symbol")
    return F.when(F.col("dataset").isin(DOCUMENTS), bucket_of(symbol).cast("string")).otherwise(symbol)


def _ingest_files(spark: SparkSession, files: DataFrame, table_root: str, **write_options) -> None:
    # File names only, as any file scan plans them on the driver; at most a round's or a batch's.
    paths: dict[str, list[str]] = {}
    for row in files.where(~_by_tasks()).select("dataset", "path").toLocalIterator():
        paths.setdefault(row["dataset"], []).append(row["path"])
    by_tasks = _datasets(files.where(_by_tasks()))
    for dataset in DATASETS:
        parts = [_documents(files, dataset)] if dataset in by_tasks else []
        if dataset.name in paths:
            parts.append(parse_files(spark, paths[dataset.name], dataset))
        if parts:
            rows = reduce(DataFrame.unionByName, parts)
            write_dataset(rows, table_root, dataset, **write_options)
            if write_options.get("mode") == "append" and dataset.keys_from_data:
                append_key_types(spark, table_root, dataset, rows)


def _note_key_types(spark: SparkSession, files: DataFrame, table_root: str) -> None:
    """Key types of the partitions that these files make, for datasets whose keys come from the data."""
    for dataset in _datasets(files):
        if dataset.keys_from_data:
            label = [F.col("label").alias(dataset.label)] if dataset.label else []
            units = files.where(F.col("dataset") == dataset.name).select(*label, F.col("path_symbol").alias("symbol"))
            write_key_types(spark, table_root, dataset, units)


def _datasets(files: DataFrame) -> list[Dataset]:
    names = {r["dataset"] for r in files.select("dataset").distinct().collect()}  # at most one row for each dataset
    return [d for d in DATASETS if d.name in names]


# --- incremental refresh ------------------------------------------------------


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new, or newer than when they were last converted."""
    done = manifest.groupBy("path").agg(F.max("modified_at").alias("_done_at")).hint("shuffle_hash")
    return (
        files.join(done, "path", "left")
        .where(F.col("_done_at").isNull() | (F.col("modified_at") > F.col("_done_at")))
        .drop("_done_at")
    )


def files_to_rebuild(files: DataFrame, changed: DataFrame, unit: list[str] = UNIT) -> DataFrame:
    """All files of every table partition that has a changed file."""
    return _in_units(files, changed, unit)


def _in_units(rows: DataFrame, wanted: DataFrame, unit: list[str]) -> DataFrame:
    """Rows of the units that ``wanted`` has. Never broadcast: there may be as many units as files."""
    units = wanted.select(*[F.col(c).alias(f"_{c}") for c in unit]).distinct().hint("shuffle_hash")
    return rows.join(units, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in unit], "left_semi")


def read_manifest(spark: SparkSession, table_root: str) -> DataFrame:
    """Converted files with the modification time they had; empty before the first run.

    A row without a time says that a file's rows were about to be appended.
    Documents that were stored with a folder for each symbol count as not converted.
    """
    rows = read_stored(spark, f"{table_root}/{MANIFEST}", schema=MANIFEST_SCHEMA)
    if rows is None:
        return spark.createDataFrame([], MANIFEST_SCHEMA).drop("in_buckets")
    here = F.col("in_buckets") | F.coalesce(~F.col("dataset").isin(DOCUMENTS), F.lit(True))
    return route(rows).where(here).select("path", "modified_at")


def record(files: DataFrame, table_root: str, done: bool) -> None:
    """Note files in the manifest as converted, or as about to be appended."""
    time = F.col("modified_at") if done else F.lit(None).cast("timestamp")
    rows = files.select("path", time.alias("modified_at"), F.lit(True).alias("in_buckets"))
    rows.coalesce(1).write.mode("append").parquet(f"{table_root}/{MANIFEST}")


def _table_files(spark: SparkSession, table_root: str, plan: DataFrame) -> DataFrame | None:
    """Stored files of the table folders that a plan rebuilds; None where there are none."""
    def part(key: str) -> Column:
        return decoded(F.regexp_extract("path", f"/{key}=([^/]*)/", 1))

    found = []
    for dataset in _datasets(plan):
        files = stored_files(spark, table_path(table_root, dataset))
        if files is not None:
            label = part(dataset.label) if dataset.label else F.lit(None).cast("string")
            found.append(files.select(
                "path", F.lit(dataset.name).alias("dataset"), label.alias("label"), part(dataset.folders[-1]).alias("folder")))
    if not found:
        return None
    return _in_units(reduce(DataFrame.unionAll, found), plan, FOLDER).select("path")


def _replace(spark: SparkSession, plan: DataFrame, table_root: str, **write_options) -> None:
    """Write the plan's partitions, drop those that lost all rows, note key types, then record the files."""
    before = _table_files(spark, table_root, plan)
    kept = shared_dir(spark, "files-before")
    if before is not None:
        before.write.parquet(kept)
    _ingest_files(spark, plan, table_root, mode="overwrite", **write_options)
    if before is not None:
        # A partition that got rows has other files now; what is still there belongs to one that got none.
        left = _table_files(spark, table_root, plan).join(spark.read.parquet(kept), "path", "left_semi")
        emptied = left.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
        for row in emptied.toLocalIterator():
            delete(spark, row["folder"])
        delete(spark, kept)
    _note_key_types(spark, plan, table_root)
    record(plan, table_root, done=True)


def refresh(
    spark: SparkSession, source_root: str, table_root: str, symbols: DataFrame | None = None,
    overwrite: bool = False, datasets: list[str] | None = None, **write_options,
) -> int:
    """Rebuild the partitions whose source changed since the last run; returns the file count.

    ``symbols`` and ``datasets`` restrict it to some of the source files. The
    file plan is a stored table, converted in rounds of whole partitions. Each
    round records its files when its tables are written, so a run that dies is
    continued by the next one, and readers see a partition as it was or as it is.
    """
    configure(spark)
    files = source_files(spark, source_root)
    files = files if symbols is None else for_symbols(files, symbols)
    files = files if datasets is None else files.where(F.col("dataset").isin(datasets))

    def replace(plan: DataFrame) -> int:
        for part in _rounds(plan):
            _replace(spark, part, table_root, **write_options)
        return plan.count()

    def rebuild(listing: DataFrame) -> int:
        changed = listing if overwrite else changed_files(listing, read_manifest(spark, table_root))
        return with_plan(files_to_rebuild(*[d.withColumn("folder", folder()) for d in (listing, changed)], FOLDER), replace)

    return with_plan(files, rebuild)


# --- files that are new ---------------------------------------------------------


def append_new(
    files: DataFrame, source_root: str, table_root: str, datasets: list[str] | None = None, **write_options,
) -> int:
    """Append the rows of files that were not converted yet; returns the file count.

    Only these files are read, and stored rows stay as they are. The files are
    noted in the manifest before their rows are appended and again afterwards.
    A file that is noted but not done (an earlier run died in between), or is
    newer than its note, may have rows in the table already: then a refresh
    rebuilds its partition instead, and so it does with documents that are
    stored with a folder for each symbol yet.
    """
    spark = configure(files.sparkSession)
    manifest = read_manifest(spark, table_root)

    def append(plan: DataFrame) -> int:
        count = plan.count()
        if not count:
            return 0
        outdated = any(
            d.whole_files and read_stored(spark, table_path(table_root, d)) is None and stored_files(spark, f"{table_root}/{d.name}")
            for d in _datasets(plan))
        if outdated or not plan.join(manifest, "path", "left_semi").isEmpty():
            return refresh(spark, source_root, table_root, datasets=datasets, **write_options)
        record(plan, table_root, done=False)
        _ingest_files(spark, plan, table_root, mode="append", **write_options)
        record(plan, table_root, done=True)
        return count

    return with_plan(changed_files(files, manifest), append)
