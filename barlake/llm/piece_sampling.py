"""Sampled segmentations over a piece vocabulary, and lossless decoding.

A text is cut where no piece can cross: before a run of spaces and around line
ends. Each unit is a lattice whose edges are pieces; a character without a
piece has an edge of byte pieces. Forward filtering gives every node the
weight of all ways to reach it; backward sampling then draws, from the end, the
last piece of each prefix in proportion to that weight. The draws come from a
hash of the row's key, the unit's place and the step, so the same row always
gets the same pieces, whatever the partitioning. Lattices of units are kept and
reused: many units are filtered together, and all units of a group of texts are
sampled together, one vector step per piece.

Piece weights: the vocabulary orders its pieces by rank; a piece of rank r
weighs (r + 1) ** -alpha. A larger alpha keeps closer to the fewest, most
frequent pieces.

Decoding joins pieces, bytes included, and takes off the one leading space that
encoding adds. A literal U+2581 is written with byte pieces, so it stays apart
from a space and every text comes back as it was.

Defined cases: a null or empty text has no pieces; the key may be null; rows
that share a key and a text get the same pieces; extra columns change nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import kept, map_columns, tokenizer_file

UNIT = re.compile(r" *[^ \n]+| +|\n")
SPACE_MARK = "▁"
# odd constants of a 64-bit mixing function
STEP, MIX_A, MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
BASE = np.uint64(0x100000001B3)
# rows of a batch that are held as Python texts and ids at once
ROWS = 500


def units_of(text: str) -> list[str]:
    """The units of a text with its leading space."""
    text = " " + text
    if "  " in text or "\0" in text:
        return UNIT.findall(text)
    return list(filter(None, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))


def uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit keys."""
    x = keys.copy()
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(12)).astype(np.float64) * 2.0**-52


def slot(hashes: np.ndarray) -> np.ndarray:
    """Places of hashes in a table of 2 ** 18."""
    return ((hashes * MIX_A) >> np.uint64(46)).astype(np.int64)


class PieceSampler:
    def __init__(self, name: str, alpha: float = 1.0, hot: int = 150_000, recent: int = 60_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name))
        self.byte_id: dict[int, int] = {}
        self.piece_bytes: list[bytes] = []
        by_length: dict[int, list[tuple[int, int, float]]] = {}
        normal = []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
                self.piece_bytes.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.piece_bytes.append(b"")
            else:
                normal.append((i, piece.replace(SPACE_MARK, " ")))
                self.piece_bytes.append(normal[-1][1].encode())
        crossing = [p for _, p in normal if "\n" in p or " " in p.lstrip(" ")]
        if crossing:
            raise ValueError(f"pieces cross the cuts between units: {crossing[:3]}")
        order = sorted(range(len(normal)), key=lambda k: (-model.get_score(normal[k][0]), k))
        for rank, k in enumerate(order):
            i, piece = normal[k]
            by_length.setdefault(len(piece), []).append((self._hash(piece), i, float(rank + 1) ** -alpha, piece))
        self.longest = max(by_length)
        if self.longest > np.iinfo(np.int16).max:
            raise ValueError("a piece is too long for the lattices")
        self.pieces, self.letters, self.taken = {}, {}, {}
        for length, found in by_length.items():
            found.sort()
            hashes, ids, weights, texts = zip(*found, strict=True)
            if len(set(hashes)) < len(hashes):
                raise ValueError("two pieces have one hash")
            letters = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").reshape(-1, length).astype(np.uint64)
            self.letters[length] = letters
            self.taken[length] = np.zeros(1 << 18, bool)
            self.taken[length][slot(np.array(hashes, np.uint64))] = True
            self.pieces[length] = np.array(hashes, np.uint64), np.array(ids, np.int32), np.array(weights, np.float64)
        self.byte_weight = float(len(normal)) ** -alpha
        self.hot, self.recent = hot, recent
        self.base: dict[str, int] = {}
        self.late: list[str] = []
        self.nodes = self.kept_nodes = self.edges = self.kept_edges = 0
        self.cumulative, self.edge_id, self.edge_length = np.zeros(1024), np.zeros(1024, np.int32), np.zeros(1024, np.int16)
        self.first_edge = np.zeros(1024, np.int64)  # of each node; its other edges follow

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    # lattices

    def _learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.base]
        if new and len(self.late) > self.recent:
            for u in self.late:
                del self.base[u]
            self.late, self.nodes, self.edges = [], self.kept_nodes, self.kept_edges
            new = [u for u in units if u not in self.base]
        new.sort(key=len)
        at = 0
        while at < len(new):  # units of like length, so that little is padded
            size = max(1, min(4096, 400_000 // (len(new[at]) * self.longest)))
            group = new[at:at + size]
            while len(group) > 1 and len(group[-1]) > len(group[0]) + 8:
                group.pop()
            self._filter(group)
            at += len(group)
        if new:
            if len(self.base) - len(self.late) <= self.hot and not self.late:
                self.kept_nodes, self.kept_edges = self.nodes, self.edges
            else:
                self.late += new

    def _filter(self, units: list[str]) -> None:
        """Forward filtering of several lattices at once."""
        n, size = len(units), max(map(len, units))
        lengths = np.array([len(u) for u in units])
        padded = "".join([u.ljust(size, "\0") for u in units]).encode("utf-32-le", "surrogatepass")
        chars = np.frombuffer(padded, "<u4").reshape(n, size).astype(np.uint64)
        widest = min(self.longest, size)
        weight = np.zeros((n, size, widest))  # by end position and length less one
        piece = np.zeros((n, size, widest), np.int32)
        piece[:, :, 0], weight[:, :, 0] = -chars.astype(np.int64) - 1, self.byte_weight  # a character spelt in bytes
        h = np.zeros((n, size), np.uint64)
        for length in range(1, widest + 1):
            h = h[:, :size - length + 1] * BASE + (chars[:, length - 1:] + np.uint64(1))
            if length not in self.pieces:
                continue
            hashes, ids, weights = self.pieces[length]
            row, end = np.nonzero(self.taken[length][slot(h)])  # few places pass, only those are searched
            own = h[row, end]
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            hit = hashes[at] == own
            row, end, at = row[hit], end[hit], at[hit]
            if length > 1:  # a hash of the same value is not yet the piece
                same = (chars[row[:, None], end[:, None] + np.arange(length)] == self.letters[length][at]).all(axis=1)
                row, end, at = row[same], end[same], at[same]
            piece[row, end + length - 1, length - 1] = ids[at]
            weight[row, end + length - 1, length - 1] = weights[at]
        ways = np.zeros((n, size + 1))
        ways[:, 0] = 1.0
        for end in range(1, size + 1):
            k = min(end, widest)
            reach = weight[:, end - 1, :k] * ways[:, end - k:end][:, ::-1]
            np.cumsum(reach, axis=1, out=weight[:, end - 1, :k])
            total = weight[:, end - 1, k - 1].copy()
            weight[:, end - 1, :k] /= total[:, None]
            # only ratios within a piece's length matter, so the scale may be reset
            ways[:, end] = total
            if end % 16 == 0:
                ways[:, max(0, end - widest):end + 1] /= total[:, None]
        step = weight.copy()
        step[:, :, 1:] -= weight[:, :, :-1]
        there = (step > 0) & (np.arange(size)[None, :, None] < lengths[:, None, None])
        unit, end, length = np.nonzero(there)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) + self.nodes
        node = first[unit] + end
        cumulative = weight[unit, end, length]
        final = np.append(node[1:] != node[:-1], True)
        cumulative[final] = 1.0
        begins = np.flatnonzero(np.append(True, final[:-1])) + self.edges
        self.first_edge = self._grown("first_edge", self.nodes, self.nodes + len(begins))
        self.first_edge[self.nodes:self.nodes + len(begins)] = begins
        self._append(node + cumulative, piece[unit, end, length], length + 1)
        self.base.update(zip(units, first.tolist(), strict=True))
        self.nodes += int(lengths.sum())

    def _grown(self, name: str, used: int, upto: int) -> np.ndarray:
        old = getattr(self, name)
        if upto <= len(old):
            return old
        out = np.empty(max(upto, len(old) + len(old) // 4), old.dtype)  # a worker's memory is short: little room ahead
        out[:used] = old[:used]
        return out

    def _append(self, *columns: np.ndarray) -> None:
        upto = self.edges + len(columns[0])
        for name, new in zip(("cumulative", "edge_id", "edge_length"), columns, strict=True):
            out = self._grown(name, self.edges, upto)
            out[self.edges:upto] = new
            setattr(self, name, out)
        self.edges = upto

    # sampling

    def sample(self, texts: list[str], keys: list[int], group: int = 1_500_000) -> Iterator[np.ndarray]:
        """Piece ids of each text; texts of about ``group`` characters are sampled together."""
        waiting: list[list[str]] = []
        seeds: list[int] = []
        size = 0
        for text, key in zip(texts, keys, strict=True):
            waiting.append(units_of(text) if text else [])
            seeds.append(key)
            size += len(text)
            if size >= group:
                yield from self._sample(waiting, seeds)
                waiting, seeds, size = [], [], 0
        if waiting:
            yield from self._sample(waiting, seeds)

    def _sample(self, units: list[list[str]], seeds: list[int]) -> Iterator[np.ndarray]:
        self._learn(set(chain.from_iterable(units)))
        counts = np.array([len(u) for u in units])
        n = int(counts.sum())
        at = np.fromiter(map(self.base.__getitem__, chain.from_iterable(units)), np.int64, n)
        left = np.fromiter(map(len, chain.from_iterable(units)), np.int32, n)
        texts = np.repeat(np.arange(len(units)), counts)
        place = np.arange(n) - (np.cumsum(counts) - counts)[texts]
        key = np.array(seeds, np.int64).astype(np.uint64)[texts] + place.astype(np.uint64) * STEP
        key = (key ^ (key >> np.uint64(29))) * MIX_B
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        taken = np.zeros(n, np.int64)
        active = np.arange(n)
        node = at + left - 1
        draw = 0
        while len(active):
            draw += 1
            chance = uniform(key + np.uint64(draw * int(STEP) & 0xFFFFFFFFFFFFFFFF))
            target = node + np.minimum(chance, 1 - 1e-7)
            edge = self.first_edge[node]
            further = np.flatnonzero(self.cumulative[edge] <= target)
            while len(further):
                edge[further] += 1
                further = further[self.cumulative[edge[further]] <= target[further]]
            steps.append((active, self.edge_id[edge]))
            taken[active] += 1
            length = self.edge_length[edge]
            node, left = node - length, left - length
            on = left > 0
            active, node, left, key = active[on], node[on], left[on], key[on]
        ends = np.cumsum(taken)
        out = np.empty(int(ends[-1]) if n else 0, np.int64)
        for k, (who, piece) in enumerate(steps):
            out[ends[who] - 1 - k] = piece
        sizes = np.bincount(texts, weights=taken, minlength=len(units)).astype(np.int64)
        if (out < 0).any():
            out, sizes = self._spell(out, sizes)
        at = 0
        for size in sizes.tolist():
            yield out[at:at + size].astype(np.int32)
            at += size

    def _spell(self, out: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put byte pieces for characters that have no piece."""
        code = -out - 1
        width = np.where(out >= 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        begins = np.cumsum(width) - width
        spelt = np.repeat(out, width)
        for c in np.unique(out[out < 0]).tolist():
            where = begins[out == c]
            for k, b in enumerate(chr(-c - 1).encode("utf-8", "surrogatepass")):
                spelt[where + k] = self.byte_id[b]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return spelt, np.bincount(owner, weights=width, minlength=len(sizes)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.piece_bytes.__getitem__, ids.tolist())).decode()[1:]


def encode(docs: DataFrame, name: str, seed: int = 7, alpha: float = 1.0, key: Column | None = None, text: Column | None = None, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """The kept columns, n_chars, n_tokens, ids (if asked for), ids_crc32 and whether decoding gave the text back."""
    key = F.col("doc_id") if key is None else key
    text = F.col("text") if text is None else text

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        sampler = kept(("pieces", name, alpha), lambda: PieceSampler(name, alpha))
        for batch in batches:
            ids = list(sampler.sample(batch["own_text"], batch["own_key"]))
            yield {
                **{c: batch[f"k_{c}"] for c in keep}, "n_chars": [len(t) for t in batch["own_text"]], "n_tokens": [len(x) for x in ids],
                **({"ids": ids} if with_ids else {}), "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
                "lossless": [sampler.decode(x) == t for x, t in zip(ids, batch["own_text"], strict=True)],
            }

    rows = docs.select(
        *(F.col(c).alias(f"k_{c}") for c in keep), F.xxhash64(F.lit(seed), key).alias("own_key"), F.coalesce(text, F.lit("")).alias("own_text"),
    )
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    made = f"{kinds}, n_chars long, n_tokens long, {'ids array<int>, ' if with_ids else ''}ids_crc32 long, lossless boolean"
    return map_columns(rows, run, made, rows=ROWS)
