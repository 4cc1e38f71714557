"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to whole numbers and put into blocks of rows. In a block
every component is an attribute that starts at its smallest value there; bit b
of attribute d is a bitmap over the rows, one bit a row. A query's score is a
sum of attributes by the query's own whole numbers:

* Bit j of a query component and slice b of an attribute give a bitmap that
  counts 2 ** (j + b). Bitmaps of one weight are added three at a time by
  exclusive or and majority, all rows at once, and carry over to the next
  weight; what is left is the sum as slices, one bitmap per bit. For a negative
  component the complement of the slices is added and the constant moves.
* Weights under a bound are left out of the sum. What they could add at most is
  known, and kept to ``slack`` of the greatest sum.
* From the most significant slice downward, the rows with the largest sums are
  selected: rows with the bit set, if they are k or more, else those and the
  best of the rest. This gives the k-th largest sum.
* Rows whose sum comes within what was left out of it lie at the boundary.
  Only these are resolved by the exact inner product of the whole numbers, so
  the result is exact whatever was left out.

Bounds: blocks hold 2 ** 20 components (16,384 rows of 64), or 64 rows; queries
come in blocks of ``QUERY_ROWS``. Blocks of rows meet blocks of queries, and a
pair of blocks returns k rows a query. Nothing is gathered on the driver but the
number of blocks for each length of vectors.

Defined cases: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; so do vectors with a component of 32,768 or
more either way, whose products could leave 64 bits; zero and empty vectors take
part; vectors meet those of their own length; rows that repeat an id are one row
with the least of their vectors; ties go to the smaller id; with few vectors all
are returned; an empty table gives no rows; extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.common import reach_workers, stored

SCALE, LARGEST = 1024, 32_768
BLOCK_VALUES, LEAST_ROWS, QUERY_ROWS, SLOT_BLOCKS = 1 << 20, 64, 1024, 4
SLACK = 1 / 64


def quantised(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v): whole numbers of the rows that take part, one row for each id."""
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    found = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    found = found.where(F.col("vec_id").isNotNull() & v.isNotNull() & sound)
    return found.select("vec_id", F.transform(v, lambda x: F.floor(x * SCALE).cast("int")).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


BLOCKS = "dims int, block long, ids binary, numbers binary"


def blocks(vectors: DataFrame, values: int = BLOCK_VALUES) -> DataFrame:
    """Rows of one length together, as many as make ``values`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        open_blocks: dict[int, list] = {}

        def closed(dims: int) -> pa.RecordBatch:
            ids, parts = zip(*open_blocks.pop(dims), strict=True)
            return pa.RecordBatch.from_arrays([
                pa.array([dims], pa.int32()), pa.array([next(numbers)], pa.int64()),
                pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(parts).tobytes()], pa.binary()),
            ], ["dims", "block", "ids", "numbers"])

        for batch in batches:
            ids, v = batch.column(0).to_numpy(), batch.column(1)
            lengths = v.value_lengths().to_numpy()
            for dims in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dims)
                flat = v.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), dims)
                most = max(LEAST_ROWS, values // max(1, dims))
                while len(rows):
                    held = open_blocks.setdefault(dims, [])
                    room = most - sum(len(i) for i, _ in held)
                    held.append((ids[rows[:room]], flat[:room]))
                    rows, flat = rows[room:], flat[room:]
                    if sum(len(i) for i, _ in held) == most:
                        yield closed(dims)
                # many lengths at once: their blocks close earlier
                if sum(p.size for held in open_blocks.values() for _, p in held) > 4 * values:
                    for other in list(open_blocks):
                        yield closed(other)
        for dims in list(open_blocks):
            yield closed(dims)

    reach_workers(vectors.sparkSession)
    return vectors.mapInArrow(run, BLOCKS)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    raw = np.packbits(bits, axis=-1, bitorder="little")
    return np.ascontiguousarray(np.pad(raw, [(0, 0)] * (raw.ndim - 1) + [(0, -raw.shape[-1] % 8)])).view(np.uint64)


class SlicedBlock:
    """One block of rows as bit slices: ``slices[d, b]`` has bit b of attribute d."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray):
        self.ids, self.numbers = ids, numbers
        self.low = numbers.min(axis=0).astype(np.int64) if numbers.size else np.zeros(numbers.shape[1], np.int64)
        above = (numbers - self.low).T
        self.depth = int(above.max(initial=0)).bit_length()
        self.high = (1 << self.depth) - 1  # where the complement of an attribute starts
        self.slices = packed((above[:, None, :] >> np.arange(self.depth)[None, :, None] & 1).astype(bool))
        self.rows = packed(np.ones((1, len(ids)), bool))[0]

    def sums(self, query: np.ndarray, slack: float) -> tuple[list[np.ndarray], int, int, int]:
        """The slices of all rows' sums, the weight of the lowest, what was left out at most, and the constant to add."""
        size = np.abs(query)
        constant = int((query * self.low).sum() + (query[query < 0] * self.high).sum())
        d, j = np.nonzero(size[:, None] >> np.arange(int(size.max(initial=0)).bit_length())[None] & 1)
        column = (j[:, None] + np.arange(self.depth)[None]).ravel()
        attribute, bit = np.repeat(d, self.depth), np.tile(np.arange(self.depth), len(d))
        if not len(column):
            return [], 0, 0, constant
        worth = np.bincount(column) * (1 << np.arange(column.max() + 1))
        lowest = int(np.searchsorted(np.cumsum(worth), slack * worth.sum(), side="right"))
        left_out = int(worth[:lowest].sum())
        flip = np.where(query < 0, ~np.uint64(0), np.uint64(0))
        out, carried, at = [], [], lowest
        while at < len(worth) or carried:
            here = np.flatnonzero(column == at)
            stack = self.slices[attribute[here], bit[here]] ^ flip[attribute[here], None]
            stack, carried = np.concatenate([stack, *carried]), []
            while len(stack) > 2:
                third = len(stack) // 3
                x, y, z = stack[:third], stack[third:2 * third], stack[2 * third:3 * third]
                odd = x ^ y
                carried.append(x & y | odd & z)
                stack = np.concatenate([odd ^ z, stack[3 * third:]])
            if len(stack) == 2:
                carried.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            out.append(stack[0] if len(stack) else np.zeros_like(self.rows))
            at += 1
        return out, lowest, left_out, constant

    @staticmethod
    def kth_largest(slices: list[np.ndarray], rows: np.ndarray, k: int) -> int:
        """The k-th largest sum of these rows, slice by slice from the top; 0 if there are fewer."""
        value, sure, equal = 0, 0, rows
        for b in range(len(slices) - 1, -1, -1):
            with_bit = equal & slices[b]
            n = int(np.bitwise_count(with_bit).sum())
            if sure + n >= k:
                equal, value = with_bit, value | 1 << b
            else:
                sure, equal = sure + n, equal & ~slices[b]
        return value

    @staticmethod
    def at_least(slices: list[np.ndarray], rows: np.ndarray, bound: int) -> np.ndarray:
        """The rows whose sum reaches a bound."""
        if bound <= 0:
            return rows
        if bound >> len(slices):
            return np.zeros_like(rows)
        more, equal = np.zeros_like(rows), rows
        for b in range(len(slices) - 1, -1, -1):
            if bound >> b & 1:
                equal = equal & slices[b]
            else:
                more, equal = more | equal & slices[b], equal & ~slices[b]
        return more | equal

    def best(self, query_id: int, query: np.ndarray, k: int, least: int | None = None, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best other rows, ties to smaller ids; rows below ``least`` may be missing."""
        rows = self.rows & ~packed((self.ids == query_id)[None])[0]
        slices, lowest, left_out, constant = self.sums(query, slack)
        bound = self.kth_largest(slices, rows, k) - (left_out >> lowest)
        if least is not None:
            bound = max(bound, -((constant + left_out - least) >> lowest))
        boundary = np.flatnonzero(np.unpackbits(self.at_least(slices, rows, bound).view(np.uint8), bitorder="little"))
        score = self.numbers[boundary].astype(np.int64) @ query
        order = np.lexsort((self.ids[boundary], -score))[:k]
        return self.ids[boundary][order], score[order]


def search(
    rows: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
    block_values: int = BLOCK_VALUES, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k other rows of largest inner product for each row that ``is_query`` (of vec_id) names."""
    vectors = stored(quantised(rows, id_column, vector_column), "quantised")
    index = stored(blocks(vectors, block_values), "row-blocks")
    asked = vectors.where(is_query)
    # queries of all tasks together, dealt to blocks of a known number of rows
    parts = max(1, -(-asked.count() // query_rows))
    queries = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("dims", F.size("v"))
    # one row for each length
    slots = stored(index.groupBy("dims").agg(F.ceil(F.count("*") / SLOT_BLOCKS).cast("int").alias("slots")), "slots")
    left = index.join(slots, "dims").select(
        "dims", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("block"), F.col("slots")).cast("int").alias("slot"), "ids", "numbers",
    )
    right = queries.join(slots, "dims").select("dims", "part", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "vec_id", "v")

    def compare(found: pa.Table, asks: pa.Table) -> pa.Table:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        ids = asks["vec_id"].to_pylist()
        vectors = [np.array(v, np.int64) for v in asks["v"].to_pylist()]
        for own_ids, numbers in zip(found["ids"], found["numbers"], strict=True) if ids else ():
            block = SlicedBlock(np.frombuffer(own_ids.as_buffer(), np.int64), np.frombuffer(numbers.as_buffer(), np.int32).reshape(len(own_ids.as_buffer()) // 8, len(vectors[0])))
            for query_id, query in zip(ids, vectors, strict=True):
                had = best.get(query_id)
                least = int(had[1][-1]) if had and len(had[1]) == k else None
                more = block.best(query_id, query, k, least)
                if had:
                    near, score = np.append(had[0], more[0]), np.append(had[1], more[1])
                    order = np.lexsort((near, -score))[:k]
                    more = near[order], score[order]
                best[query_id] = more
        return pa.table({
            "query_id": pa.array(np.repeat(np.array(list(best), np.int64), [len(b[0]) for b in best.values()]), pa.int64()),
            "vec_id": pa.array(np.concatenate([np.empty(0, np.int64), *(b[0] for b in best.values())]), pa.int64()),
            "score": pa.array(np.concatenate([np.empty(0, np.int64), *(b[1] for b in best.values())]), pa.int64()),
        })

    reach_workers(rows.sparkSession)
    keys = ("dims", "part", "slot")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


#: The same in SQL, for queries whose id is divisible by 100.
SEARCH_SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scores QUALIFY rank <= 10
"""
