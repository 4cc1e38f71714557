"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import (
    compression_quality,
    line_labels,
    mixing,
    page_wrappers,
    permutation_index,
    piece_sampling,
    prefix_counts,
    ranked_search,
    secret_scan,
    simhash_join,
    sliced_index,
    spelling_groups,
    token_files,
)
from barlake.llm.common import table
from barlake.settings import shared_dir


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op2_simhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "llm-token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, "word_bpe_49k.json", end_id=1)
    return token_files.read(spark, path).drop("ids")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(table(spark, sf_dir, "documents"))


def op5_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_wrappers.extract(table(spark, sf_dir, "pages"))


def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", with_ids=False)


def op8_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", limit=1024)


def op9_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_labels.judge(docs, line_labels.fit(docs, table(spark, sf_dir, "labels")))


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.group(table(spark, sf_dir, "documents"), least=2, ratio=10)


def op13_sliced_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliced_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_simhash_join": op2_simhash_join,
    "op3_token_files": op3_token_files,
    "op4_mixing": op4_mixing,
    "op5_page_wrappers": op5_page_wrappers,
    "op6_compression_quality": op6_compression_quality,
    "op7_piece_sampling": op7_piece_sampling,
    "op8_prefix_counts": op8_prefix_counts,
    "op9_line_labels": op9_line_labels,
    "op10_permutation_index": op10_permutation_index,
    "op11_ranked_search": op11_ranked_search,
    "op12_spelling_groups": op12_spelling_groups,
    "op13_sliced_index": op13_sliced_index,
}

ORACLES: dict[str, str] = {
    "op11_ranked_search": ranked_search.SEARCH_SQL,
    "op12_spelling_groups": spelling_groups.GROUP_SQL,
    "op13_sliced_index": sliced_index.SEARCH_SQL,
}
