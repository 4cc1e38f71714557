"""Mixing overlapping sources to target weights by min-cost flow.

Documents with the same set of sources are one pattern with one capacity, the
sum of their sizes. Capacity flows from patterns to the sources they belong to,
up to each source's target; a pattern's first use is free and each further use
of the same documents costs more, so repeats come last and spread out. The
flow then says how often a pattern is used: that many whole times for all of
its documents, and once more for a seeded choice that makes up the rest.

The choice orders documents by a hash of the seed and the row and takes the
front of that order. A histogram over hash ranges finds the range in which the
rest is reached, that range alone is ordered, and the few last words are made
up by taking in or leaving out the documents that bring the sum closest. No source is gathered in one task.

The flow is solved on the driver over one row per pattern and source: its size
is the number of different source sets, not of documents.

Defined cases: a null text has size 0, a null source is a source of its own,
last in order; a null set of sources is empty and never used; rows equal in id, sources and text are taken together; documents
of size 0 follow their pattern; without any words targets are 0 and nothing is
taken; extra columns change nothing.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.llm.common import WORD, stored

WEIGHTS = (1, 2, 3)
MOST = 3
RANGES = 1 << 14
ROUNDS = 4


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Shares of ``total`` by weight; none above ``most`` times its size, what is over goes to the others by weight."""
    out = [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        full = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in sorted(full):
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ -= full
    return out


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], most: int = MOST) -> list[int]:
    """How much of each (sources, size) pattern is used so that quotas are met as far as they can be, repeats as few as can be.

    Successive shortest paths with potentials; the k-th use of a pattern costs
    2 ** k - 1 for each word, so costs are convex. Words beyond reach stay unmet.
    """
    n, m = len(patterns), len(quotas)
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, capacity: int, price: int) -> None:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)

    uses = []
    for i, (members, size) in enumerate(patterns):
        uses.append([len(to) + 2 * k for k in range(most)])
        for k in range(most):
            arc(source, i, size, (1 << k) - 1)
        for s in members:
            arc(i, n + s, most * size, 0)
    for s, quota in enumerate(quotas):
        arc(n + s, sink, quota, 0)
    height = [0] * len(graph)
    while True:
        distance, by = {source: 0}, {}
        heap = [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > distance[x]:
                continue
            for e in graph[x]:
                if room[e] and (far := d + cost[e] + height[x] - height[to[e]]) < distance.get(to[e], 1 << 62):
                    distance[to[e]], by[to[e]] = far, e
                    heapq.heappush(heap, (far, to[e]))
        if sink not in distance:
            break
        for x in range(len(graph)):
            height[x] += min(distance.get(x, distance[sink]), distance[sink])
        path, x = [], sink
        while x != source:
            path.append(by[x])
            x = to[by[x] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    return [sum(room[e ^ 1] for e in own) for own in uses]


def plan(documents: DataFrame, most: int = MOST, weights: tuple[float, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """From (own_sources, own_size): (source, source_size, target) and (own_sources, whole, rest): uses of all and words of one more."""
    spark = documents.sparkSession
    # one row per different set of sources
    rows = documents.groupBy("own_sources").agg(F.sum("own_size").alias("size")).collect()
    names = sorted({s for r in rows for s in r.own_sources}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    rows.sort(key=lambda r: [number[s] for s in r.own_sources])
    sizes = [sum(r["size"] for r in rows if s in r.own_sources) for s in names]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], sum(r["size"] for r in rows), most)
    used = route([(tuple(number[s] for s in r.own_sources), r["size"]) for r in rows], [round(g) for g in goals], most)
    goal_rows = [(s, size, g) for s, size, g in zip(names, sizes, goals, strict=True)]
    use_rows = [(r.own_sources, *(divmod(u, r["size"]) if r["size"] else (0, 0))) for r, u in zip(rows, used, strict=True)]
    return (
        spark.createDataFrame(goal_rows, "source string, source_size long, target double"),
        spark.createDataFrame(use_rows, "own_sources array<string>, whole long, rest long"),
    )


def choose(documents: DataFrame, uses: DataFrame, ranges: int = RANGES, rounds: int = ROUNDS) -> DataFrame:
    """Hashes (own_sources, own_hash) of the documents used once more: the front of the hash order, then single moves.

    Rows with one hash are one item. After the front, up to ``rounds`` times,
    each pattern takes in or leaves out the one item that brings it closest to
    its rest, if any brings it closer.
    """
    spark = documents.sparkSession
    items = documents.groupBy("own_sources", "own_hash").agg(F.sum("own_size").alias("size")).where("size > 0")
    items = stored(items.join(F.broadcast(uses.where("rest > 0")), "own_sources").withColumn("range", F.pmod("own_hash", F.lit(ranges))), "mix-items")
    # at most ``ranges`` rows for each pattern
    sums = items.groupBy("own_sources", "rest", "range").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.partitionBy("own_sources").orderBy("range")) - F.col("size")
    edges = sums.select("own_sources", "range", before.alias("before"), (before + F.col("size")).alias("upto"))
    placed = items.join(edges, ["own_sources", "range"])
    # only the range in which the rest is reached is ordered, a share of 1 / ranges of the pattern
    last = placed.where("upto > rest and before < rest")
    last = last.withColumn("own_in", F.col("before") + F.sum("size").over(Window.partitionBy("own_sources").orderBy("own_hash")) <= F.col("rest"))
    state = placed.where("upto <= rest or before >= rest").withColumn("own_in", F.expr("upto <= rest")).unionByName(last)
    state = stored(state.select("own_sources", "own_hash", "size", "rest", "own_in"), "mix-state")
    turned: dict[tuple, bool] = {}
    for _ in range(rounds):
        now = _turn(spark, state, turned)
        gaps = now.groupBy("own_sources", "rest").agg(F.sum(F.when(F.col("own_in"), F.col("size")).otherwise(0)).alias("taken"))
        gaps = F.broadcast(gaps.select("own_sources", (F.col("rest") - F.col("taken")).alias("gap")))  # one row per pattern
        move = F.when(F.col("own_in"), -F.col("size")).otherwise(F.col("size"))
        moved = now.join(gaps, "own_sources").withColumn("off", F.abs(F.col("gap") - move)).where("off < abs(gap)")
        best = moved.groupBy("own_sources").agg(F.min(F.struct("off", "own_hash")).alias("best"))
        found = [(tuple(r.own_sources), r.best.own_hash) for r in best.collect()]
        if not found:
            break
        for key in found:
            turned[key] = not turned.get(key, False)
    return _turn(spark, state, turned).where("own_in").select("own_sources", "own_hash")


def _turn(spark: SparkSession, state: DataFrame, turned: dict[tuple, bool]) -> DataFrame:
    """The state with the moves made so far, at most one per round and pattern."""
    moves = [(list(s), h) for (s, h), odd in turned.items() if odd]
    if not moves:
        return state
    moves = F.broadcast(spark.createDataFrame(moves, "own_sources array<string>, own_hash long").withColumn("own_turn", F.lit(True)))
    now = state.join(moves, ["own_sources", "own_hash"], "left")
    return now.withColumn("own_in", F.col("own_in") != F.coalesce("own_turn", F.lit(False))).drop("own_turn")


def row_hash(sources: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.array_join(sources, "\u0001", "\u0002"), F.col("text"))


def mix(docs: DataFrame, sources: Column, seed: int = 11, most: int = MOST, weights: tuple[float, ...] = WEIGHTS, keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(kept columns, own_sources, own_size, own_uses) of every document, and (source, source_size, target).

    ``sources`` is an array of the sources a document belongs to.
    """
    sources = F.coalesce(sources, F.array().cast("array<string>"))
    rows = docs.select(
        *keep, F.array_sort(F.array_distinct(sources)).alias("own_sources"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("own_size"),
        row_hash(sources, seed).alias("own_hash"),
    )
    rows = stored(rows, "mix-rows")
    goals, uses = plan(rows, most, weights)
    more = choose(rows, uses).withColumn("own_more", F.lit(1))
    used = rows.join(more, ["own_sources", "own_hash"], "left").join(F.broadcast(uses), "own_sources")
    uses_of = F.col("whole") + F.coalesce("own_more", F.lit(0))
    return used.select(*keep, "own_sources", "own_size", uses_of.alias("own_uses"), "own_hash"), goals


def mix_by_source(docs: DataFrame, seed: int = 11) -> DataFrame:
    """(doc_id, size, source_size, target, taken) where a document has the one source its row names."""
    used, goals = mix(docs, F.array("source"), seed)
    goals = goals.select(F.array("source").alias("own_sources"), "source_size", "target")
    # one row per source
    return used.join(F.broadcast(goals), "own_sources").select(
        "doc_id", F.col("own_size").alias("size"), "source_size", "target", (F.col("own_size") * F.col("own_uses")).alias("taken"),
    )


def repeat(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The mix itself: each document as often as it is used, with its columns."""
    used, _ = mix(docs, F.array("source"), seed)
    # a hash stands for equal rows, so its uses are one number
    often = used.groupBy("own_hash").agg(F.max("own_uses").alias("own_uses")).where("own_uses > 0")
    # the row itself is one column, so no name of its own gets in the way
    rows = docs.select(row_hash(F.array("source"), seed).alias("own_hash"), F.struct("*").alias("own_row"))
    found = rows.join(often, "own_hash").select("own_row", F.explode(F.sequence(F.lit(1), F.col("own_uses").cast("int"))).alias("own_copy"))
    return found.select("own_row.*")
