"""Token ids of whole texts in compact binary files, and back.

Ids of a document are those of a public tokenizer, an end id after each. The
files hold documents in ascending id order as blocks of a range asymmetric
numeral system (see rans.py) under one frequency table counted over all ids.

Folder layout: ``table`` has (symbol, freq), ``blocks`` one row per block:
part and seq give the order, part_offset the ids before it in its part,
doc_ids and lengths its documents, block its bytes. A block is read, checked
and decoded without any other.

Defined cases: a null text is empty and still gets its end id; a null doc_id
sorts first; rows that share a doc_id are ordered by checksum and length, equal
rows in any order; an empty table gives empty files.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.llm.common import WordMemo, byte_letters, kept, map_columns, stored, tokenizer_file, utf8
from barlake.llm.rans import Table, decode, encode

BLOCK_IDS = 1 << 19


# The tokenizer's splitting rule for lower-case text of the characters PLAIN has, where
# lower case is one character for one and no character combines with another.
PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017e]+")
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\u017e]+|[0-9]|[^a-z0-9\xdf-\u017e]+")

BYTE_LETTERS = {b: c for c, b in byte_letters().items()}


class WordEncoder:
    """Ids of a text as the library gives them, word by word.

    This tokenizer drops white space, and neither its rules for characters nor
    its merges look across it, so a text's ids are those of its words in turn.
    Only ASCII white space splits here. Words of plain Latin letters are split
    further by the tokenizer's rule and its merges asked for each new part;
    all others go to the library whole.
    """

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file(name))
        self.model = self.library.model
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.parts = WordMemo(self._encode_parts, hot=150_000, recent=100_000)
        self.memo = WordMemo(self._encode)

    def _encode_parts(self, parts: list[str]) -> Iterator[bytes]:
        for part in parts:
            letters = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_LETTERS)
            yield array("H", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _encode(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in words]
        plain = [PLAIN.fullmatch(t) is not None and not any(x in t for x in self.special) for t in texts]
        splits = [SPLIT.findall(t.lower()) if p else [] for t, p in zip(texts, plain, strict=True)]
        parts = self.parts.learn(chain.from_iterable(splits))
        rest = [t for t, p in zip(texts, plain, strict=True) if not p]
        found = iter(self.library.encode_batch_fast(rest, add_special_tokens=False)) if rest else iter(())
        return [
            b"".join([parts[x] for x in split]) if p else array("H", next(found).ids).tobytes()
            for p, split in zip(plain, splits, strict=True)
        ]

    def __call__(self, text: bytes) -> bytes:
        """Ids as 16-bit integers."""
        words = text.split()
        return b"".join(map(self.memo.learn(words).__getitem__, words))


def encode_texts(docs: DataFrame, name: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, ids): ids as 16-bit integers, the checksum over 32-bit ones."""
    end = array("H", [end_id]).tobytes()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = kept(("words", name), lambda: WordEncoder(name))
        for batch in batches:
            ids = [encoder(text) + end for text in batch["text"]]
            yield {
                "doc_id": batch["doc_id"], "n_tokens": [len(x) // 2 for x in ids],
                "ids_crc32": [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids], "ids": ids,
            }

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), utf8(F.col(text_column)).alias("text"))
    return map_columns(rows, run, "doc_id long, n_tokens long, ids_crc32 long, ids binary")


def count_symbols(encoded: DataFrame) -> DataFrame:
    """(symbol, n) over all ids; each task sends one row per symbol it has."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch["ids"]), "<u2"), minlength=len(total))
            found[:len(total)] += total
            total = found
        seen = np.flatnonzero(total)
        yield {"symbol": seen.tolist(), "n": total[seen].tolist()}

    return map_columns(encoded.select("ids"), run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def _table(rows: list) -> np.ndarray:
    dense = np.zeros(1 + max((r[0] for r in rows), default=0), np.int64)
    for symbol, value in rows:
        dense[symbol] = value
    return dense


def write(docs: DataFrame, path: str, name: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Encode all documents into the files under ``path``."""
    spark = docs.sparkSession
    encoded = stored(encode_texts(docs, name, end_id), "ids")
    # bounded by the vocabulary, whatever the number of documents
    scaled = Table.scaled(_table(count_symbols(encoded).collect()))
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(scaled) if f], "symbol int, freq long").coalesce(1).write.parquet(f"{path}/table")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        table, part, seq, offset = Table(scaled), TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        doc_ids: list = []
        size = 0

        def block() -> dict:
            symbols = np.frombuffer(b"".join(ids), "<u2")
            return {
                "part": [part], "seq": [seq], "part_offset": [offset], "n_tokens": [len(symbols)], "doc_ids": [list(doc_ids)],
                "lengths": [[len(x) // 2 for x in ids]], "block": [encode(symbols, table)],
            }

        for batch in batches:
            for doc_id, own in zip(batch["doc_id"], batch["ids"], strict=True):
                ids.append(own)
                doc_ids.append(doc_id)
                size += len(own) // 2
                if size >= block_ids:
                    yield block()
                    seq, offset, size = seq + 1, offset + size, 0
                    ids.clear()
                    doc_ids.clear()
        if ids:
            yield block()

    order = ["doc_id", "ids_crc32", "n_tokens"]
    rows = encoded.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    schema = "part int, seq int, part_offset long, n_tokens long, doc_ids array<long>, lengths array<int>, block binary"
    map_columns(rows, run, schema).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) decoded from the files, block by block."""
    # bounded by the vocabulary
    freqs = _table(spark.read.parquet(f"{path}/table").collect())
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        table = Table(freqs)
        for batch in batches:
            for part, offset, doc_ids, lengths, block in zip(*(batch[c] for c in ("part", "part_offset", "doc_ids", "lengths", "block")), strict=True):
                raw = decode(block, table).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                ids = [raw[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lengths, strict=True)]
                yield {
                    "part": [part] * len(ids), "doc_id": doc_ids, "at": (ends - lengths + offset).tolist(), "n_tokens": lengths,
                    "ids_crc32": [zlib.crc32(x) for x in ids], "ids": ids,
                }

    found = map_columns(
        blocks.select("part", "part_offset", "doc_ids", "lengths", "block"), run,
        "part int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary",
    )
    # one row per part, so bounded by the number of partitions written
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")
