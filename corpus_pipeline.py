"""Documents to token ids, stage by stage.

Each stage is one operator on all that the stage before kept. What it decides
takes effect: texts scored as bad go, one document of each near-duplicate group
stays, secrets are replaced, documents are used as often as the mix says, and
what is left becomes sampled piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlake.llm import compression_quality, mixing, piece_sampling, secret_scan, simhash_join
from barlake.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; labels of rows held out are not used."""
    return compression_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return simhash_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts, also encoded ones, replaced."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources uses it."""
    return mixing.repeat(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document; copies of one document get the same ones."""
    return piece_sampling.encode(docs, "piece_bpe_32k.model", keep=("doc_id", "source"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixture", mixture), ("pieces", pieces)]

# The stages train a model, hash word shingles and sample pieces: SQL has no words for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on all documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
