"""Which source file feeds which dataset, and which symbols to take.

Source layout: ``<root>/<SYMBOL>/<file>``. A "file" may also be a folder of
part files, with or without ``symbol=<SYMBOL>`` folders inside it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions import clean_key, symbol_in_path, symbol_or
from barlake.functions.text import stripped
from barlake.sources import dynamic, market
from barlake.sources.lines import listed, visible_names


@dataclass(frozen=True)
class Dataset:
    name: str
    pattern: str  # of the source file; group 1, if any, is the label
    parse: Callable[[DataFrame], DataFrame]
    label: str | None = None
    whole_files: bool = False
    keys_from_data: bool = False

    @property
    def partitions(self) -> list[str]:
        """What tells the parts of a table that are rebuilt and noted on their own."""
        return [self.label, "symbol"] if self.label else ["symbol"]

    @property
    def folders(self) -> list[str]:
        """Columns whose values are the folders of the table. Documents, one a symbol, share a fixed number of these."""
        return [BUCKET] if self.whole_files else self.partitions


# File name patterns; the first match decides.
DATASETS = [
    Dataset("market_kline", r"^kline_(.*)\.jsonl$", market.klines, "interval"),
    Dataset("mark_price_kline", r"^mark_price_kline_(.*)\.jsonl$", market.klines, "interval"),
    Dataset("index_price_kline", r"^index_price_kline_(.*)\.jsonl$", market.klines, "interval"),
    Dataset("premium_index_price_kline", r"^premium_index_price_kline_(.*)\.jsonl$", market.klines, "interval"),
    Dataset("funding_history", r"^funding_history\.jsonl$", market.funding_history),
    Dataset("open_interest", r"^open_interest_(.*)\.jsonl$", market.open_interest, "period"),
    Dataset("account_ratio", r"^account_ratio_(.*)\.jsonl$", market.account_ratio, "period"),
    Dataset("other", r"^([^/]*)\.jsonl$", dynamic.generic_jsonl, "stem", keys_from_data=True),
    Dataset("risk_limit", r"^risk_limit\.json$", market.risk_limit, whole_files=True),
    Dataset("meta", r"^meta\.json$", dynamic.meta, whole_files=True, keys_from_data=True),
    Dataset("instrument", r"^raw/instrument\.json$", dynamic.snapshot, whole_files=True, keys_from_data=True),
    Dataset("ticker", r"^raw/ticker\.json$", dynamic.snapshot, whole_files=True, keys_from_data=True),
]
BY_NAME = {d.name: d for d in DATASETS}
DOCUMENTS = [d.name for d in DATASETS if d.whole_files]

BUCKET, BUCKETS = "bucket", 64


def bucket_of(symbol: Column) -> Column:
    """Folder of a symbol's document: the task of ``repartition(BUCKETS, symbol)``, so that a task writes one folder."""
    return F.pmod(F.hash(symbol), F.lit(BUCKETS))


def source_file(path: Column) -> Column:
    """File name inside the symbol folder (``raw/`` kept); '' when it is no JSON source."""
    return F.regexp_extract(path, r"(?:^|/)((?:raw/)?[^/]+\.jsonl?)(?:/.*)?$", 1)


def source_symbol(path: Column) -> Column:
    folder = F.regexp_extract(path, r"(?:^|/)([^/]+)/(?:raw/)?[^/]+\.jsonl?(?:/.*)?$", 1)
    return clean_key(symbol_or(symbol_in_path(path), folder))


def route(files: DataFrame) -> DataFrame:
    """Add ``path_symbol``, ``dataset`` (null: not ingested) and ``label`` to rows with a ``path``."""
    name = F.col("_file")
    dataset = F.coalesce(*[F.when(name.rlike(d.pattern), F.lit(d.name)) for d in DATASETS])
    label = F.coalesce(*[
        F.when(F.col("dataset") == d.name, F.regexp_extract(name, d.pattern, 1)) for d in DATASETS if d.label
    ])
    return (
        files.withColumn("path_symbol", source_symbol(F.col("path")))
        .withColumn("_file", source_file(F.col("path")))
        .withColumn("dataset", dataset)
        .withColumn("label", label)
        .drop("_file")
    )


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """Listing of every source file under ``root``: path, modified_at, bytes and its route."""
    visible = visible_names()
    listing = listed(spark, root, lambda parts: visible(parts[-1]))
    if listing is None:
        listing = (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("bytes"))
        )
    return route(listing).where(F.col("dataset").isNotNull())


def read_symbols_file(spark: SparkSession, path: str) -> DataFrame:
    """One symbol per line; blank lines and # comments are skipped."""
    lines = spark.read.text(path).select(stripped(F.col("value")).alias("symbol"))
    return lines.where((F.col("symbol") != "") & ~F.col("symbol").startswith("#"))


def select_symbols(*lists: DataFrame) -> DataFrame:
    """Union of symbol lists: upper-cased, trimmed, blanks dropped, each once."""
    union = reduce(DataFrame.unionByName, [df.select(clean_key(F.col("symbol")).alias("symbol")) for df in lists])
    return union.where(F.col("symbol") != "").distinct()


def for_symbols(files: DataFrame, symbols: DataFrame) -> DataFrame:
    return files.join(symbols.select(F.col("symbol").alias("path_symbol")), "path_symbol", "left_semi")


def missing_symbols(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Selected symbols without a source folder."""
    found = files.select(F.col("path_symbol").alias("symbol"))
    return symbols.join(found, "symbol", "left_anti")
