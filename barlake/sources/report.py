"""Counts about an ingest: rows, files, bad lines, duplicate keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.sources.lines import BLANK, MALFORMED, NOT_OBJECT, OK, with_doc


def file_report(texts: DataFrame) -> DataFrame:
    """Per source file: lines by outcome. Needs ``value``, ``path_symbol``, ``dataset``, ``path``."""
    keys = ["path_symbol", "dataset", "path"]

    def count(status: str):
        return F.count_if(F.col("status") == status)

    # a struct of one unlikely field: the parser checks the rest of an object and skips it
    checked = with_doc(texts.select("value", *keys), "STRUCT<`_`: STRING>")
    return checked.groupBy(*keys).agg(
        F.count("*").alias("lines"),
        count(OK).alias("rows"),
        count(BLANK).alias("blank"),
        count(MALFORMED).alias("malformed"),
        count(NOT_OBJECT).alias("not_object"),
    )


def ingest_report(texts: DataFrame) -> DataFrame:
    """Per symbol and dataset: files and lines by outcome (adds up the per-file counts)."""
    sums = [F.sum(c).alias(c) for c in ("lines", "rows", "blank", "malformed", "not_object")]
    return (
        file_report(texts).groupBy(F.col("path_symbol").alias("symbol"), "dataset")
        .agg(F.count("*").alias("files"), *sums)
    )


def duplicate_keys(rows: DataFrame, keys: tuple[str, ...] = ("symbol", "ts_ms")) -> DataFrame:
    """Keys held by more than one row; such rows multiply in the wide join."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
