"""Bounded labelled samples for fitting small models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import stored


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept for testing: crc32 of the id as text leaves 0 modulo 5. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, rows_per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows_per_class`` ids of either label, none held out, written to the shared folder.

    The ids with the smallest hashes are taken, so the choice does not depend on
    partitioning. An id with several labels has the one most of its rows have,
    with several texts the least of them; null ids, labels and texts have no part.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .withColumn("own_order", F.xxhash64("doc_id"))
    )
    chosen = [known.where(F.col("label") == k).orderBy("own_order", "doc_id").limit(rows_per_class).select("doc_id", "label") for k in (0, 1)]
    # at most 2 * rows_per_class pairs of numbers
    ids = stored(chosen[0].unionByName(chosen[1]), "sample-ids")
    texts = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull())
    return stored(texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), "sample")
