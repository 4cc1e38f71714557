"""Typed Parquet tables: one per dataset, partitioned by its label and symbol."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.functions import bucket_floor
from barlake.settings import configure
from barlake.sources.dynamic import key_types, with_key_columns
from barlake.sources.lines import decoded
from barlake.sources.routing import BUCKET, BY_NAME, DOCUMENTS, Dataset, bucket_of


DAY_MS = 86_400_000


def table_path(root: str, dataset: Dataset) -> str:
    return f"{root}/documents/{dataset.name}" if dataset.whole_files else f"{root}/{dataset.name}"


def write_dataset(
    rows: DataFrame, root: str, dataset: Dataset, mode: str = "overwrite",
    compression: str = "zstd", max_records_per_file: int = 0,
) -> None:
    """Store a parsed dataset; the folder's symbol becomes the partition, the record's own
    symbol stays as ``record_symbol``. Overwriting replaces only partitions that get rows.

    Map-only: a split of a source file lies in one table partition and is in
    time order already, so rows are sorted within their task and written with
    no shuffle. A symbol with most of the rows is simply many splits.

    Documents have one row a symbol, and a folder for each row takes longer to
    write and list than all rows together: they lie in a fixed number of
    folders, sorted by symbol.
    """
    stored = rows.withColumnRenamed("symbol", "record_symbol").withColumnRenamed("path_symbol", "symbol")
    keys = [*dataset.folders, *(["ts_ms"] if "ts_ms" in stored.columns else [])]
    if dataset.whole_files:
        others = [c for c in stored.columns if c != "symbol"]
        symbol = F.nullif(F.col("symbol"), F.lit(""))  # as a folder's name would have it
        stored = stored.select(*others, symbol.alias("symbol"), bucket_of(F.col("symbol")).alias(BUCKET))
        keys.append("symbol")
    (
        stored.sortWithinPartitions(*keys).write.mode(mode)
        .partitionBy(*dataset.folders)
        .option("compression", compression)
        .option("maxRecordsPerFile", max_records_per_file)
        .option("partitionOverwriteMode", "dynamic")
        .parquet(table_path(root, dataset))
    )


def write_by_symbol(rows: DataFrame, path: str, compression: str = "zstd") -> None:
    """Store a computed table (the wide one, or bars) partitioned by symbol, in time order.

    Replaces the symbols that ``rows`` holds and keeps the others, so after a
    refresh only changed symbols need rewriting. Rows gather by (symbol, day);
    adaptive execution then merges small and splits large pieces, so no symbol
    or day ends up in one task.
    """
    placed = rows.withColumn("_day", bucket_floor(F.col("ts_ms"), DAY_MS)).hint("rebalance", "symbol", "_day")
    (
        placed.drop("_day").sortWithinPartitions("symbol", "ts_ms").write.mode("overwrite")
        .partitionBy("symbol").option("compression", compression)
        .option("partitionOverwriteMode", "dynamic").parquet(path)
    )


def read_stored(spark: SparkSession, path: str, merge_schema: bool = False, schema: str | None = None) -> DataFrame | None:
    """A folder of Parquet files; None when there are none."""
    reader = configure(spark).read.option("mergeSchema", str(merge_schema).lower())
    try:
        return (reader.schema(schema) if schema else reader).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def stored_files(spark: SparkSession, path: str) -> DataFrame | None:
    """Listing of the Parquet files below a folder, none of which is opened; None when there is no folder."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    try:
        return listing.load(path).select("path")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_dataset(
    spark: SparkSession, root: str, name: str, extra: list[Column] | None = None, merge_schema: bool = False,
) -> DataFrame | None:
    """A stored dataset with ``symbol_partition`` and any extra columns; None when there are no files.

    ``symbol`` is the bare partition column, so a symbol filter prunes folders
    (of documents: row groups). All files written here share one schema;
    ``merge_schema`` reads every footer, for tables that other writers add
    columns to. Documents that were stored with a folder for each symbol are
    read from there until a refresh has stored them anew.
    """
    rows = read_stored(spark, table_path(root, BY_NAME[name]), merge_schema) if name in DOCUMENTS else None
    rows = read_stored(spark, f"{root}/{name}", merge_schema) if rows is None else rows.drop(BUCKET)
    if rows is None:
        return None
    return rows.withColumn("symbol_partition", F.col("symbol")).select("*", *(extra or []))


KEY_TYPES = "key_notes"


def write_key_types(spark: SparkSession, root: str, dataset: Dataset, units: DataFrame) -> None:
    """Note the key types of some partitions of a stored dynamic dataset, in place of what was noted of these.

    ``units`` has the partition columns. A unit that lost all its rows gets a
    row without a key. Where nothing was noted yet, all stored partitions are.
    """
    keys = dataset.partitions
    rows = read_dataset(spark, root, dataset.name)
    noted = units.select(*keys).distinct()
    if rows is not None and read_key_types(spark, root, dataset.name) is None:
        noted = noted.union(rows.select(*keys)).distinct()
    if rows is None:
        found = noted.select(*keys, F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("type"))
    else:
        # never broadcast: there may be as many partitions as documents
        here = rows.select(*keys, "fields").join(noted.hint("shuffle_hash"), keys, "left_semi")
        found = noted.join(key_types(here, tuple(keys)).hint("shuffle_hash"), keys, "left")
    _add_notes(spark, root, dataset, found, whole=True)


def append_key_types(spark: SparkSession, root: str, dataset: Dataset, rows: DataFrame) -> None:
    """Note the key types of parsed rows that were appended to their partitions, beside what is noted of these."""
    here = rows.drop("symbol").withColumnRenamed("path_symbol", "symbol")
    keys = dataset.partitions
    if read_key_types(spark, root, dataset.name) is None:
        write_key_types(spark, root, dataset, here.select(*keys))
    else:
        _add_notes(spark, root, dataset, key_types(here.select(*keys, "fields"), tuple(keys)), whole=False)


def _add_notes(spark: SparkSession, root: str, dataset: Dataset, found: DataFrame, whole: bool) -> None:
    """Append notes under the next number. They are one table, as the manifest is: a folder for each partition costs
    more time than the notes of thousands of partitions."""
    path = f"{root}/{KEY_TYPES}/{dataset.name}"
    before = read_stored(spark, path)
    number = 0 if before is None else before.agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0] + 1
    rows = found.select("field", "type", *dataset.partitions, F.lit(whole).alias("whole"), F.lit(number).cast("bigint").alias("number"))
    rows.write.mode("append").parquet(path)


def read_key_types(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """(field, type, partition columns): of every partition its last whole note, and what was noted beside it since."""
    notes = read_stored(spark, f"{root}/{KEY_TYPES}/{name}")
    if notes is None:
        return None
    last = F.max(F.when(F.col("whole"), F.col("number"))).over(Window.partitionBy(*BY_NAME[name].partitions))
    return notes.withColumn("_last", last).where("number >= coalesce(_last, 0)").drop("_last", "whole", "number")


def open_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every dataset that has files, registered as a temp view of the same name.

    Keys of documents that are not known beforehand are typed columns of their
    views. Their types were noted when the partitions were written, so opening
    reads no rows; only a table that was written without notes is read once.
    """
    found = {name: read_dataset(spark, root, name) for name in BY_NAME}
    tables = {
        name: with_key_columns(rows, read_key_types(spark, root, name)) if "fields" in rows.columns else rows
        for name, rows in found.items() if rows is not None
    }
    for name, rows in tables.items():
        rows.createOrReplaceTempView(name)
    return tables


def listed_symbols(spark: SparkSession, root: str, names: list[str]) -> DataFrame | None:
    """Sorted symbols of the first stored dataset that has any, by the names of its folders: no file is opened (of documents: by the column)."""
    for name in names:
        if name in DOCUMENTS:
            rows = read_dataset(spark, root, name)
            if rows is None:
                continue
            found = rows.select("symbol")
        else:
            files = stored_files(spark, f"{root}/{name}")
            if files is None:
                continue
            found = files.select(decoded(F.regexp_extract("path", "/symbol=([^/]*)/", 1)).alias("symbol"))
        symbols = found.where("symbol <> ''").distinct()
        if not symbols.isEmpty():
            return symbols.orderBy("symbol")
    return None


def union_by_name(*parts: DataFrame) -> DataFrame:
    """Rows of all parts under the union of their columns; a part's missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
