"""Ranked lexical search, term at a time over short lists and document at a time over long ones.

Documents become an inverted index that is cut by documents: every task turns
the texts it reads into shards with one posting list per term, so a term that
stands in every document is a list in every shard, and no term is one task.
Lists of terms that no item asks for are dropped by a join. A shard is searched
for a block of items at once:

* The lists of an item that are short in the shard are summed into accumulators.
  Their documents in order, with their sums and the largest sum, are then one
  iterator with a bound, like any list.
* This iterator and the long lists are followed document at a time, in windows
  of neighbouring documents. Every iterator has a bound per window. A window
  whose bounds together stay below the k-th best score so far is skipped.
  Otherwise the iterators with the smallest bounds that together stay below it
  name no candidates: they are only looked up for documents the others name,
  from the largest bound down, as long as a document can still reach that score.

The best k of each shard and item meet in one window over items.

Scores are whole numbers: a term's weight w is floor(1000 * ln((2N + 2) / (2df + 1))),
a document's m is 50 + (50 n N) div L, and a term adds
w * ((10^9 tf) div (1000 tf + 20 m)). N counts documents with a term, L all their
terms, n those of one document, df the documents with the term, tf its places there.

Bounds: a shard closes at ``shard_bytes`` of text or 2 ** 17 documents (one longer
text is a shard of its own); a block has about ``block_items`` items; the driver
sees N, L and the number of items.

Defined cases: a null or empty text has no terms, such an item gets no rows; a
document without an id counts in N, L and df but is not returned; rows that
repeat an id are documents of their own; rows that repeat an item's id are one
item with the terms of all; an item without an id takes no part; equal scores go
by ascending id; an empty table gives no rows; extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.common import reach_workers, stored, utf8

SHARD_BYTES, SHARD_DOCS, BLOCK_ITEMS, WINDOW = 24_000_000, 1 << 17, 512, 1024
#: A list is short in a shard if it holds at most one document of so many.
SHORT = 16

#: Bytes of terms, with A-Z as a-z; all other ASCII separates (0). Bytes of other letters stay.
FOLD = np.array([b if b >= 0x80 or chr(b).isalnum() else 0 for b in range(256)], np.uint8)
FOLD[ord("A"):ord("Z") + 1] += 32

#: The posting list of no term: it holds the documents themselves.
NO_TERM = b""


def terms_of(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of texts in order, and the number of the text that each comes from."""
    data = FOLD[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    inside = data != 0
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    begin, end = edge[::2], edge[1::2]
    offsets = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(end - begin, out=offsets[1:])
    terms = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return terms.dictionary_encode(), np.searchsorted(starts, begin, side="right") - 1


POSTINGS = "shard long, term binary, docs array<int>, counts array<int>, ids array<long>"


def _shard(number: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    terms, owner = terms_of(texts)
    n = len(texts)
    keys, counts = np.unique(terms.indices.to_numpy().astype(np.int64) * n + owner, return_counts=True)
    starts = np.searchsorted(keys, np.arange(len(terms.dictionary)) * n)
    lengths = np.bincount(owner, minlength=n)
    own = [
        pa.array([number] * (len(starts) + 1), pa.int64()),
        pa.chunked_array([pa.array([NO_TERM], pa.binary()), terms.dictionary]).combine_chunks(),
        # the documents' own row first, with the number of terms of each
        pa.ListArray.from_arrays(pa.array([0, *starts, len(keys)], pa.int32()), pa.array((keys % n).astype(np.int32))),
        pa.ListArray.from_arrays(
            pa.array([0, *(starts + n), len(keys) + n], pa.int32()), pa.array(np.concatenate([lengths, counts]).astype(np.int32)),
        ),
        pa.ListArray.from_arrays(pa.array([0] + [n] * (len(starts) + 1), pa.int32()), pa.array(ids, pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(own, ["shard", "term", "docs", "counts", "ids"])


def index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Posting lists by shard: documents by their place in the shard, ascending, and how often they hold the term.

    The list of the empty term has the ids of all documents of the shard and their numbers of terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= shard_bytes or len(ids) >= SHARD_DOCS:
                    yield from _sliced(_shard(next(numbers), ids, texts))
                    ids, texts, size = [], [], 0
        if ids:
            yield from _sliced(_shard(next(numbers), ids, texts))

    reach_workers(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), utf8(F.col(text_column)).alias("text"))
    return rows.mapInArrow(run, POSTINGS)


def _sliced(batch: pa.RecordBatch, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def item_terms(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item_id, term): the terms of each item, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, owner = terms_of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), terms.dictionary_decode()], ["item_id", "term"])

    reach_workers(items.sparkSession)
    rows = items.select(F.col(id_column).cast("long").alias("item_id"), utf8(F.col(text_column)).alias("text")).where("item_id is not null")
    return rows.mapInArrow(run, "item_id long, term binary").distinct()


class Shard:
    """Posting lists of one shard, with the score that each posting adds."""

    def __init__(self, rows: pa.Table, documents: int, terms: int):
        rows = rows.combine_chunks()
        names = np.array([t == NO_TERM for t in rows["term"].to_pylist()])
        own = int(np.flatnonzero(names)[0])
        ids = rows["ids"][own].values
        self.ids = ids.fill_null(0).to_numpy()
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        n = rows["counts"][own].values.to_numpy().astype(np.int64)
        self.size = len(n)
        m = 50 + 50 * n * documents // max(1, terms)
        weights = rows["w"].to_numpy()
        self.windows = -(-self.size // WINDOW)
        self.docs, self.scores, self.tops, self.cuts = {}, {}, {}, {}
        docs, counts = rows["docs"].chunk(0) if rows["docs"].num_chunks else None, rows["counts"].chunk(0) if rows["counts"].num_chunks else None
        flat_docs, doc_at = docs.values.to_numpy(), docs.offsets.to_numpy()
        flat_counts, count_at = counts.values.to_numpy(), counts.offsets.to_numpy()
        edges = np.arange(self.windows + 1) * WINDOW
        for j in np.flatnonzero(~names):
            at, tf = flat_docs[doc_at[j]:doc_at[j + 1]], flat_counts[count_at[j]:count_at[j + 1]].astype(np.int64)
            score = weights[j] * (1_000_000_000 * tf // (1000 * tf + 20 * m[at]))
            if not named.all():
                at, score = at[named[at]], score[named[at]]
            cuts = np.searchsorted(at, edges)
            tops = np.zeros(self.windows, np.int64)
            full = np.flatnonzero(np.diff(cuts))
            if len(full):
                tops[full] = np.maximum.reduceat(score, cuts[full])
            self.docs[j], self.scores[j], self.tops[j], self.cuts[j] = at, score, tops, cuts

    def best(self, lists: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best documents by these lists, those with score 0 left out."""
        short = [j for j in lists if len(self.docs[j]) * SHORT <= self.size]
        long = [j for j in lists if len(self.docs[j]) * SHORT > self.size]
        sums = np.zeros(self.size, np.int64)
        if short:
            np.add.at(sums, np.concatenate([self.docs[j] for j in short]), np.concatenate([self.scores[j] for j in short]))
        summed = np.flatnonzero(sums)
        sum_cuts = np.searchsorted(summed, np.arange(self.windows + 1) * WINDOW)
        # k documents reach at least this
        least = int(np.partition(sums[summed], -k)[-k]) if len(summed) >= k else 1
        best_ids, best_scores = np.empty(0, np.int64), np.empty(0, np.int64)
        tops = np.array([self.tops[j] for j in long], np.int64).reshape(len(long), self.windows)
        for w in range(self.windows):
            found = summed[sum_cuts[w]:sum_cuts[w + 1]]
            bounds = np.append(tops[:, w], sums[found].max() if len(found) else 0)
            if bounds.sum() < least:
                continue
            docs, scores = self._window(w, [*long, None], bounds, found, sums, least)
            keep = scores >= least
            best_ids, best_scores = np.append(best_ids, self.ids[docs[keep]]), np.append(best_scores, scores[keep])
            if len(best_ids) > k:
                order = np.lexsort((best_ids, -best_scores))[:k]
                best_ids, best_scores = best_ids[order], best_scores[order]
                least = max(least, int(best_scores[-1]))
            elif len(best_ids) == k:
                least = max(least, int(best_scores.min()))
        return best_ids, best_scores

    def _window(self, w: int, lists: list, bounds: np.ndarray, found: np.ndarray, sums: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of one window that may reach ``least``, with their scores; the list None stands for the sums."""
        begin = w * WINDOW
        order = np.argsort(bounds, kind="stable")
        below = np.cumsum(bounds[order])
        named_by = int(np.searchsorted(below, least))  # the iterators before this one together stay below
        score, seen = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, bool)

        def postings(i: int) -> tuple[np.ndarray, np.ndarray]:
            j = lists[i]
            if j is None:
                return found, sums[found]
            part = slice(self.cuts[j][w], self.cuts[j][w + 1])
            return self.docs[j][part], self.scores[j][part]

        for i in order[named_by:]:
            at, more = postings(i)
            score[at - begin] += more
            seen[at - begin] = True
        docs = np.flatnonzero(seen)
        for place in range(named_by - 1, -1, -1):
            docs = docs[score[docs] + below[place] >= least]
            at, more = postings(order[place])
            if not len(docs):
                break
            if len(at):
                # skip to the candidates
                hit = np.minimum(np.searchsorted(at, docs + begin), len(at) - 1)
                score[docs] += np.where(at[hit] == docs + begin, more[hit], 0)
        return docs + begin, score[docs]


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", shard_bytes: int = SHARD_BYTES, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    asked = stored(item_terms(items, item_column, item_text_column), "item-terms")
    blocks = max(1, -(-asked.select("item_id").distinct().count() // block_items))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    wanted = stored(
        asked.groupBy("term", block.alias("block")).agg(F.sort_array(F.collect_list("item_id")).alias("items"))
        # every block needs the documents themselves
        .unionByName(docs.sparkSession.range(blocks).select(F.lit(NO_TERM).alias("term"), F.col("id").cast("int").alias("block"), F.expr("array()").cast("array<long>").alias("items"))),
        "wanted-terms",
    )
    lists = index(docs, id_column, text_column, shard_bytes)
    lists = stored(lists.join(wanted.select("term").distinct(), "term", "left_semi"), "postings")
    totals = lists.where(F.col("term") == NO_TERM).select(
        F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("terms"), F.size(F.filter("counts", lambda x: x > 0)).alias("docs"),
    ).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    in_all, of_all = int(totals["docs"]), int(totals["terms"])
    df = lists.where(F.col("term") != NO_TERM).groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * in_all + 2) / (2 * F.col("df") + 1)))
    weighed = stored(
        wanted.join(df, "term", "left").where(F.col("df").isNotNull() | (F.col("term") == NO_TERM)).select("term", "block", "items", F.coalesce(weight, F.lit(0)).alias("w")),
        "weights",
    )
    schema = "item_id long, doc_id long, score long"

    def rank(rows: pa.Table) -> pa.Table:
        shard = Shard(rows, in_all, of_all)
        of_item: dict[int, list[int]] = {}
        for j, own in enumerate(rows["items"].to_pylist()):
            for item in own:
                of_item.setdefault(item, []).append(j)
        out = [(item, *shard.best(own, k)) for item, own in of_item.items()]
        return pa.table({
            "item_id": pa.array(np.repeat(np.array([o[0] for o in out], np.int64), [len(o[1]) for o in out]), pa.int64()),
            "doc_id": pa.array(np.concatenate([np.empty(0, np.int64), *(o[1] for o in out)]), pa.int64()),
            "score": pa.array(np.concatenate([np.empty(0, np.int64), *(o[2] for o in out)]), pa.int64()),
        })

    found = lists.join(weighed, "term").groupBy("shard", "block").applyInArrow(rank, schema)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("item_id", "rank", "doc_id", "score")


#: The ranking in SQL, for documents and benchmark items; only A-Z are lower-cased.
SEARCH_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
weights AS (
  SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs CROSS JOIN totals GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) CROSS JOIN totals GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
