"""Exact token counts of every prefix of a text, by prefix dynamic programming.

A byte-pair encoding has, for every prefix of a piece of text, one last token:
the vocabulary token that ends there and may follow the last token of what is
before it. So one pass fills, per prefix, its last token and its count, which
is one more than that of the shorter prefix. Texts are cut into chunks at white
space as the tokenizer's own splitting rule does, chunks are remembered, and
the counts of a whole text are running sums over its chunks. ``Prefixes``
answers how many tokens any prefix has and how long a prefix fits a budget,
without encoding again.

Defined cases: a null text is empty and has no tokens; a special token's string
counts as the one special token, as the library takes it by default; a prefix
that ends inside such a string counts as plain text; rows are independent, so
repeated ids, null ids, ties and extra columns change nothing.
"""

from __future__ import annotations

import bisect
import json
import math
import re
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import WordMemo, byte_letters, kept, map_columns, tokenizer_file

# Unicode white space, the tokenizer's splitting rule, and chunks of it that
# never share a match of that rule: white space before the last one, or a run of text with one space before.
RARE = r"\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = rf" \n{RARE}"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
UNUSUAL = re.compile(rf"[\x00{RARE}]")
BLANKS = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c))


def chunks_of(text: str) -> list[str]:
    """The matches of CHUNK; plain text with single spaces and line ends between words needs no pattern."""
    if (
        not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        or UNUSUAL.search(text)
    ):
        return CHUNK.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


class TokensByEnd:
    """The longest token that ends at each byte, for many bytes at once.

    An automaton over token bytes from last to first: its edges lie in one open
    hash table, so a step back is one lookup, and most tokens part after few.
    ``shorter`` leads from a token to the longest other one that ends it.
    """

    BITS = 20

    def __init__(self, tokens: dict[bytes, int]):
        ids = {t: i for t, i in tokens.items() if t}
        nodes: dict[int, int] = {}
        token_of = [-1]
        for token, i in ids.items():
            at = 0
            for byte in reversed(token):
                key = at << 8 | byte
                if key not in nodes:
                    nodes[key] = len(token_of)
                    token_of.append(-1)
                at = nodes[key]
            token_of[at] = i
        self.token_of = np.array(token_of, np.int32)
        most = max(ids.values()) + 1
        self.length, self.shorter = [0] * most, [-1] * most
        for token, i in ids.items():
            self.length[i] = len(token)
            self.shorter[i] = next((ids[token[k:]] for k in range(1, len(token)) if token[k:] in ids), -1)
        while len(nodes) > 1 << self.BITS - 1:
            self.BITS += 1
        self.keys, self.targets = np.full(1 << self.BITS, -1, np.int64), np.zeros(1 << self.BITS, np.int32)
        slots = self._slot(np.fromiter(nodes, np.int64, len(nodes))).tolist()
        mask = (1 << self.BITS) - 1
        for (key, node), slot in zip(nodes.items(), slots, strict=True):
            while self.keys[slot] >= 0:
                slot = slot + 1 & mask
            self.keys[slot], self.targets[slot] = key, node

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """Where edges lead; 0 for an edge that is not there."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.targets[slot], 0)
        wait = np.flatnonzero((there != keys) & (there >= 0))
        while len(wait):
            slot[wait] = slot[wait] + 1 & (1 << self.BITS) - 1
            there = self.keys[slot[wait]]
            hit = there == keys[wait]
            out[wait[hit]] = self.targets[slot[wait[hit]]]
            wait = wait[~hit & (there >= 0)]
        return out

    def longest(self, data: np.ndarray, before: np.ndarray) -> np.ndarray:
        """For each byte, the longest token that ends there and starts at most ``before`` bytes earlier."""
        alive, node = np.arange(len(data)), np.zeros(len(data), np.int64)
        found = np.full(len(data), -1, np.int32)
        back = 0
        while len(alive):
            node = self._step(node << 8 | data[alive - back]).astype(np.int64)
            token = self.token_of[node]
            found[alive[token >= 0]] = token[token >= 0]
            back += 1
            go_on = (node > 0) & (before[alive] >= back)
            alive, node = alive[go_on], node[go_on]
        return found


class PrefixCounter:
    """Counts for one vocabulary. Tokens are numbers; ``splits`` has the two parts a merged token is made of."""

    def __init__(self, name: str):
        import regex

        with open(tokenizer_file(name), encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {t["content"] for t in spec["added_tokens"] if t["special"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.token = {bytes(map(letters.__getitem__, t)): i for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.splits: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = vocab[left], vocab[right]
            self.rank[pair] = rank
            self.splits.setdefault(vocab[left + right], (*pair, rank))
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(SPLIT)
        self.edges: tuple[dict, dict] = ({}, {})
        self.fits: dict[int, bool] = {}
        self.ends = TokensByEnd(self.token)
        self.lengths = np.array(self.ends.length)
        self.pieces = WordMemo(self._piece_counts, hot=250_000, recent=200_000)
        self.chunks = WordMemo(self._chunk_counts, hot=350_000, recent=250_000)

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at the left (0) or right (1) edge while a token is being merged, each with the rank that ends it."""
        known = self.edges[side]
        if token not in known:
            path, at, until = [], token, math.inf
            while True:
                path.append((at, until))
                if at not in self.splits:
                    break
                until, at = self.splits[at][2], self.splits[at][side]
            known[token] = path[::-1]
        return known[token]

    def _may_follow(self, before: int, token: int) -> bool:
        """No merge across the boundary comes before both tokens are complete."""
        key = before << 20 | token
        if key in self.fits:
            return self.fits[key]
        left, right, i, j, rank = self._edge(before, 1), self._edge(token, 0), 0, 0, self.rank
        while True:
            x, x_until = left[i]
            y, y_until = right[j]
            across = rank.get((x, y))
            if across is not None and across < x_until and across <= y_until:
                break  # of merges with one rank, the leftmost comes first
            if x_until <= y_until:
                i += 1
            else:
                j += 1
            if i == len(left) or j == len(right):
                break
        self.fits[key] = fits = i == len(left) or j == len(right)
        return fits

    def _piece_counts(self, pieces: list[str], group: int = 2_000_000) -> Iterator[bytes | array]:
        """Counts at every character of matches of the splitting rule; the tokens that end in ``group`` bytes are found at once."""
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        waiting, size = [], 0
        for piece in pieces:
            waiting.append(piece.encode())
            size += len(waiting[-1])
            if size >= group:
                yield from self._fill(waiting)
                waiting, size = [], 0
        if waiting:
            yield from self._fill(waiting)

    def _fill(self, pieces: list[bytes]) -> Iterator[bytes | array]:
        """Prefix by prefix: the last token is the longest one that ends there and may follow what is before it."""
        sizes = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        longest = self.ends.longest(data, place)
        if (longest < 0).any():
            raise ValueError("a byte without a token")
        begins = (place + 1 - self.lengths[longest]).tolist()
        longest, length, shorter, known, may_follow = longest.tolist(), self.ends.length, self.ends.shorter, self.fits.get, self._may_follow
        at = 0
        for piece in pieces:
            last, counts, end = [0], [0], 0
            for token, begin in zip(longest[at:at + len(piece)], begins[at:at + len(piece)], strict=True):
                end += 1
                while begin:
                    fits = known(last[begin] << 20 | token)
                    if fits or (fits is None and may_follow(last[begin], token)):
                        break
                    token = shorter[token]
                    begin = end - length[token]
                last.append(token)
                counts.append(counts[begin] + 1)
            at += len(piece)
            if not piece.isascii():  # only ends of characters
                counts = [c for c, byte in zip(counts, [*piece, 0], strict=True) if byte & 0xC0 != 0x80]
            yield bytes(counts) if max(counts) < 256 else array("I", counts)

    def _split_counts(self, pieces: list[str]) -> bytes | array:
        """Counts of pieces in a row, as small numbers where they fit."""
        known = self.pieces.values
        out = known[pieces[0]]
        for piece in pieces[1:]:
            counts, total = known[piece], out[-1]
            more = [total + c for c in counts[1:]]
            out = out + bytes(more) if type(out) is bytes and more[-1] < 256 else array("I", [*out, *more])
        return out

    def _chunk_counts(self, chunks: list[str]) -> Iterator[bytes | array]:
        """Counts at every character of chunks, as small numbers in a row."""
        splits = list(map(self.split.findall, chunks))
        cut = {c[:k]: self.split.findall(c[:k]) for c in chunks if "'" in c for k in self._cut_contractions(c)}
        self.pieces.learn(chain.from_iterable([*splits, *cut.values()]))
        known = self.pieces.values
        for chunk, pieces in zip(chunks, splits, strict=True):
            out = known[pieces[0]] if len(pieces) == 1 else self._split_counts(pieces)
            if cut and "'" in chunk and (cuts := self._cut_contractions(chunk)):
                own = list(out)
                for k in cuts:
                    own[k] = self._split_counts(cut[chunk[:k]])[-1]
                out = bytes(own) if max(own) < 256 else array("I", own)
            yield out

    def _cut_contractions(self, chunk: str) -> list[int]:
        """Where a prefix ends inside a contraction, which then is none."""
        return [k for m in self.split.finditer(chunk) if m[0][0] == "'" and len(m[0]) > 2 for k in range(m.start() + 1, m.end())]

    def counts(self, texts: list[str], limit: int | None = None, group: int = 6_000_000) -> Iterator[tuple[int, int]]:
        """Tokens of whole texts, and the longest prefix within the limit; new chunks of about ``group`` characters are learnt together."""
        waiting, size = [], 0
        for text in texts:
            special = self.special is not None and self.special.search(text)
            waiting.append((text, None if special else chunks_of(text)))
            size += len(text)
            if size >= group:
                yield from self._count_waiting(waiting, limit)
                waiting, size = [], 0
        yield from self._count_waiting(waiting, limit)

    def _count_waiting(self, waiting: list, limit: int | None) -> Iterator[tuple[int, int]]:
        known = self.chunks.learn(set(chain.from_iterable(chunks for _, chunks in waiting if chunks)))
        plain = [chunks and [known[c][-1] for c in chunks] for _, chunks in waiting]
        for (text, chunks), counts in zip(waiting, plain, strict=True):
            if chunks is None:
                n = self.count(text)
                yield n, len(text) if limit is None or n <= limit else self.prefixes(text, limit).fit(limit)
            elif limit is None or (n := sum(counts)) <= limit:
                yield sum(counts), len(text)
            else:
                yield n, self._fit(text, chunks, counts, limit)

    def _fit(self, text: str, chunks: list[str], counts: list[int], limit: int) -> int:
        """The longest prefix within the limit: it reaches past the last place that ends no white space and fits."""
        at = total = safe = spent = 0
        for chunk, n in zip(chunks, counts, strict=True):
            if total > limit:
                break
            if at and text[at - 1] not in BLANKS:
                safe, spent = at, total
            at, total = at + len(chunk), total + n
        return safe + self.prefixes(text[safe:], limit - spent).fit(limit - spent)

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last value of its prefixes."""
        if self.special is not None and (cuts := list(self.special.finditer(text))):
            edges = [0, *(x for m in cuts for x in m.span()), len(text)]
            return len(cuts) + sum(self.count(text[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True))
        chunks = chunks_of(text)
        known = self.chunks.learn(chunks)
        return sum([known[c][-1] for c in chunks])

    def prefixes(self, text: str, upto: float = math.inf) -> Prefixes:
        return Prefixes(self, text, upto)


class Prefixes:
    """Token counts of every prefix of one text, in characters; with ``upto`` of prefixes until well over so many tokens."""

    def __init__(self, counter: PrefixCounter, text: str, upto: float = math.inf):
        self.counter, self.text, self.most = counter, text, upto + 64
        self.starts: list[int] = []
        self.totals: list[int] = []
        self.counts: list = []
        self.run: tuple = (0, 0, 0, b"")
        begin = 0
        for m in counter.special.finditer(text) if counter.special is not None else ():
            if self.totals and self.totals[-1] > self.most:
                break
            self._plain(text[begin:m.start()])
            self._add(len(m[0]), None, 1)
            begin = m.end()
        self._plain(text[begin:])
        self.total = self.totals.pop() if len(self.totals) > len(self.starts) else 0

    def _add(self, length: int, counts: bytes | array | None, tokens: int) -> None:
        at, total = (self._end, self.totals.pop()) if self.totals else (0, 0)
        self.starts.append(at)
        self.counts.append(counts)
        self.totals += [total, total + tokens]
        self._end = at + length

    def _plain(self, part: str) -> None:
        # a chunk has one token at least
        chunks = chunks_of(part) if self.most == math.inf else [m[0] for m in islice(CHUNK.finditer(part), int(self.most))]
        known = self.counter.chunks.learn(chunks)
        for chunk in chunks:
            if self.totals and self.totals[-1] > self.most:
                break
            self._add(len(chunk), known[chunk], known[chunk][-1])

    def count(self, length: int) -> int:
        """Tokens of the first ``length`` characters."""
        if length <= 0:
            return 0
        if length >= len(self.text):
            return self.total
        i = bisect.bisect_right(self.starts, length - 1) - 1
        if self.text[length - 1] in BLANKS:
            # white space at the end is one run there, and its prefixes have a table
            start, base, counts = self._run(length)
            return base + counts[length - start]
        if self.counts[i] is None and length < self._end_of(i):
            # a cut special string is plain text: it reaches two chunks back at most
            back = max(0, i - 2)
            return self.totals[back] + self.counter.count(self.text[self.starts[back]:length])
        return self.totals[i] + (1 if self.counts[i] is None else self.counts[i][length - self.starts[i]])

    def _end_of(self, i: int) -> int:
        return self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text)

    def _run(self, length: int) -> tuple[int, int, bytes | array]:
        """The run of white space around the character before ``length``: its start, the tokens before it, its prefix counts."""
        if not self.run[0] < length <= self.run[1]:
            start, end = length - 1, length
            while start and self.text[start - 1] in BLANKS:
                start -= 1
            while end < len(self.text) and self.text[end] in BLANKS:
                end += 1
            counts = self.counter.pieces.learn([self.text[start:end]])[self.text[start:end]]
            self.run = (start, end, self.count(start), counts)
        return self.run[0], self.run[2], self.run[3]

    def fit(self, budget: int) -> int:
        """The longest prefix, in characters, of at most so many tokens."""
        if budget > self.most - 64:
            raise ValueError("counts were made up to a smaller budget")
        if self.total <= budget:
            return len(self.text)
        # a cut can lower a count only by what white space or a special string at the end is worth
        for i in range(bisect.bisect_right(self.totals, budget + 16) - 1, -1, -1):
            start, end = self.starts[i], self._end_of(i)
            blank = self.text[end - 1] in BLANKS
            if blank:  # all of it is white space
                run, base, counts = self._run(end)
                counts = counts[start - run:end - run + 1]
            elif self.counts[i] is None:
                counts, base = [0, *(self.count(at) for at in range(start + 1, end + 1))], 0
            else:
                counts, base = self.counts[i], self.totals[i]
            fitting = np.flatnonzero(np.array(list(counts), np.int64)[1:] + base <= budget) + 1
            if not blank and len(fitting) and self.text[start] in BLANKS and fitting[0] == 1 and self.count(start + 1) > budget:
                fitting = fitting[1:]
            if len(fitting):
                return start + int(fitting[-1])
            if not blank and self.text[start] in BLANKS and self.count(start + 1) <= budget:
                return start + 1
        return 0


def token_counts(docs: DataFrame, name: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars): fit_chars is the longest prefix within the limit."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        counter = kept(("prefixes", name), lambda: PrefixCounter(name))
        for batch in batches:
            found = list(counter.counts(batch["text"], limit))
            yield batch | {"n_tokens": [n for n, _ in found], "over_limit": [n > limit for n, _ in found], "fit_chars": [f for _, f in found]}

    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"),
        F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return map_columns(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
