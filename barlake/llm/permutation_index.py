"""Nearest neighbours by a permutation index.

A vector is represented by its nearest pivots, in order. Each block of vectors
has an inverted file per pivot, with the vector and the pivot's place in its
order for the first ``post`` pivots. A query reads the files of its own first
``probe`` pivots and sums the footrule distance of the two orders from them: a
shared pivot adds the difference of its places, one that only one of them has
adds ``probe``. Nothing but posted places is touched. The nearest ``share`` of a
block by that distance is measured exactly.

Blocks of vectors meet blocks of queries; vectors are spread by hash, so no
block is large, whatever lies close together. Equal vectors are one entry with
its smallest ids, as many as any answer can use, and equal queries are searched once.

Bounds: ``pivots`` vectors, those with the smallest hashes, are gathered to be
pivots; all else is joined and grouped on Spark. A query reads about
``post * probe / pivots`` places for each vector (three with these parameters)
and measures a tenth of them. On random unit vectors of 64 components, whose
nearest are hardly nearer than the rest, recall against brute force is stated in
the README for three sizes; tests/llm measures it on each run.

Defined cases: vectors that are null, zero, of another length than most, or
hold null or non-finite components, and rows without an id, take no part; rows
that repeat an id with one vector count once; an id with several vectors has
for any other the least of the distances; ties go to the smaller id; with few
vectors all are found; an empty table gives no rows; extra columns change
nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.common import reach_workers, stored

PIVOTS, POST, PROBE, SHARE, LEAST = 1024, 48, 64, 0.1, 96
STORED_ROWS, QUERY_ROWS = 16_384, 2_048


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v): rows that take part, repeated ones once."""
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    found = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    found = found.where(F.col("vec_id").isNotNull() & v.isNotNull() & sound)
    most = found.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return stored(found.where(F.size("v") == (most["n"] if most else 0)).distinct(), "vectors")


def choose_pivots(vectors: DataFrame, pivots: int) -> np.ndarray:
    """The vectors with the smallest hashes, each once."""
    rows = vectors.select("v", F.xxhash64(F.lit(3), "v").alias("h")).groupBy("v", "h").agg(F.lit(1)).orderBy("h", "v").limit(pivots).select("v").collect()
    return np.array([r.v for r in rows])


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, first: int) -> np.ndarray:
    """The first pivots of each vector from nearest on, by number; of pivots equally far the smaller number comes first."""
    square = (pivots**2).sum(1) - 2 * vectors @ pivots.T
    first = min(first, len(pivots))
    found = np.sort(np.argpartition(square, first - 1, axis=1)[:, :first], axis=1)
    order = np.argsort(np.take_along_axis(square, found, axis=1), axis=1, kind="stable")
    return np.take_along_axis(found, order, axis=1).astype(np.int32)


class Files:
    """The inverted files of one block: for every pivot the vectors that have it among their first, and its place there."""

    def __init__(self, first: np.ndarray, pivots: int):
        self.rows = len(first)
        order = np.argsort(first, axis=None, kind="stable")
        self.vector, self.place = np.divmod(order, first.shape[1])
        self.begin = np.searchsorted(first.ravel()[order], np.arange(pivots + 1))

    def nearest(self, first: np.ndarray, wanted: int, least: int) -> np.ndarray:
        """The ``wanted`` vectors of least footrule distance to an order, and those as near as the last of them.

        The distance is ``probe`` for each pivot less what shared ones save, so the largest savings are wanted.
        Vectors that share no pivot come, in their order, only where fewer than ``least`` do.
        """
        spans = [slice(self.begin[p], self.begin[p + 1]) for p in first]
        vector = np.concatenate([self.vector[s] for s in spans])
        saved = np.concatenate([len(first) - np.abs(self.place[s] - at) for at, s in enumerate(spans)])
        total = np.bincount(vector, np.maximum(saved, 0), self.rows)
        wanted = min(wanted, self.rows)
        bound = np.partition(total, self.rows - wanted)[self.rows - wanted]
        if bound > 0:
            return np.flatnonzero(total >= bound)
        shared = np.flatnonzero(total > 0)
        return np.concatenate([shared, np.flatnonzero(total == 0)[:max(0, least - len(shared))]])


def _in_blocks(rows: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
    """Each row in one block of its side, once for every block of the other side."""
    own_block = F.pmod(F.xxhash64(F.lit(5), "v"), F.lit(own_blocks)).cast("int").alias(own)
    return rows.select("*", own_block, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))).alias(other))


def search(
    rows: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
    pivots: int = PIVOTS, post: int = POST, probe: int = PROBE, share: float = SHARE, least: int = LEAST,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest others found for each row that ``is_query`` (of vec_id) names."""
    vectors = usable(rows, id_column, vector_column)
    chosen = choose_pivots(vectors, pivots)
    schema = "query long, query_hash long, vec_id long, score double"
    # of equal vectors the k + 1 smallest ids are all that an answer can use
    smallest = vectors.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(f"n <= {k + 1}")
    entries = smallest.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = vectors.where(is_query)
    queries = asked.groupBy("v").agg(F.min("vec_id").alias("query")).withColumn("query_hash", F.xxhash64("v"))
    queries = stored(queries, "queries")
    if not len(chosen):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    entries = stored(entries, "entries")
    sides, asks = -(-entries.count() // STORED_ROWS), max(1, -(-queries.count() // QUERY_ROWS))
    one = _in_blocks(entries, "side", sides, "ask", asks).groupBy("side", "ask")
    two = _in_blocks(queries, "ask", asks, "side", sides).groupBy("side", "ask")

    def compare(entry: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(entry) and len(query):
            entry = entry.iloc[np.argsort([i[0] for i in entry["ids"]])]
            own, ask, ids = np.stack(entry["v"].to_numpy()), np.stack(query["v"].to_numpy()), entry["ids"].to_numpy()
            files = Files(nearest_pivots(own, chosen, post), len(chosen))
            wanted = max(least, int(np.ceil(share * len(own))))
            for n, (name, h, first) in enumerate(zip(query["query"], query["query_hash"], nearest_pivots(ask, chosen, probe), strict=True)):
                here = files.nearest(first, wanted, least)
                distance = np.sqrt(((own[here] - ask[n]) ** 2).sum(axis=1))
                if len(here) > k + 1:
                    near = distance <= np.partition(distance, k)[k]
                    here, distance = here[near], distance[near]
                met = sorted((float(d), int(i)) for d, e in zip(distance, here, strict=True) for i in ids[e])
                out += [(name, h, i, d) for d, i in met[:k + 1]]
        return pd.DataFrame(out, columns=["query", "query_hash", "vec_id", "score"])

    reach_workers(rows.sparkSession)
    found = one.cogroup(two).applyInPandas(compare, schema)
    best = Window.partitionBy("query", "query_hash").orderBy("score", "vec_id")
    # several vectors of one id: the nearest counts
    found = found.groupBy("query", "query_hash", "vec_id").agg(F.min("score").alias("score")).withColumn("n", F.row_number().over(best)).where(f"n <= {k + 1}").drop("n")
    names = asked.withColumn("query_hash", F.xxhash64("v")).join(queries, ["v", "query_hash"]).select(F.col("vec_id").alias("query_id"), "query", "query_hash")
    found = names.join(found, ["query", "query_hash"]).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
