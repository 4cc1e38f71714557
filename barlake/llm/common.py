"""Helpers the operators share: stored tables, Arrow batches, word rules, sized caches."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from barlake.settings import shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# What separates words, as bytes and as a class for regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
WORD_PATTERN = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str, compression: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and is computed once."""
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{purpose}")
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(text: Column) -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def reach_workers(spark: SparkSession) -> None:
    """Workers on this machine find the package even where it is not installed."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


def map_columns(df: DataFrame, make: Callable[[Iterator[dict[str, list]]], Iterable[dict]], schema: str, rows: int | None = None) -> DataFrame:
    """Run a generator over Arrow batches given as dicts of Python lists.

    ``make`` gets an iterator of batches and yields dicts of columns; it is the
    only Python in a task, so state such as caches lives in its scope. Batches
    are given in parts of at most ``rows`` rows, where what is made of them is large.
    """
    kind = StructType.fromDDL(schema)
    # workers on this machine find the package even where it is not installed
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        parts = (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows or max(1, b.num_rows)))
        for out in make(dict(zip(b.schema.names, (c.to_pylist() for c in b.columns), strict=True)) for b in parts):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def filter_rows(df: DataFrame, column: str, good: Callable[[list], list[bool]]) -> DataFrame:
    """The rows, with all their columns, for whose values in one column ``good`` says so; whatever the columns are called."""
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(good(batch.column(column).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


class WordMemo:
    """Remember a value per word; ``compute`` gets the list of new words.

    The first ``hot`` words stay, which in running text are the frequent ones.
    Later ones stay until ``recent`` of them have come together. Memory is
    bounded; results do not depend on it.
    """

    def __init__(self, compute: Callable[[list], Iterable], hot: int = 250_000, recent: int = 100_000):
        self.compute, self.room, self.recent_size = compute, hot, recent
        self.values: dict = {}
        self.recent: list = []

    def learn(self, words: Iterable) -> dict:
        """A dict that holds at least these words."""
        words = set(words)
        new = words.difference(self.values)
        if new:
            if len(self.recent) > self.recent_size:
                for word in self.recent:
                    del self.values[word]
                self.recent = []
                new = words.difference(self.values)
            new = list(new)
            self.values.update(zip(new, self.compute(new), strict=True))
            stay = min(self.room, len(new))
            self.room -= stay
            self.recent += new[stay:]
        return self.values


#: Kept by a Python worker from one task to the next: the state of the operator it works for, no other's.
_KEPT: dict = {}


def kept(key: tuple, make: Callable):
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Let go of what another operator has kept, in tasks that keep nothing themselves."""
    _KEPT.clear()


def byte_letters() -> dict[str, int]:
    """The letters byte-level vocabularies write bytes with: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers

    return public_tokenizers.path(name)
