"""Static range asymmetric numeral system over interleaved lanes.

One frequency table, scaled to a power of two, codes any number of independent
blocks. Inside a block, symbol i belongs to lane i % lanes; all lanes take one
step together, so a step is a few vector operations. Checkpoints hold the lane
states and the word position at regular steps, so a reader may start at any
of them; a checksum over the block guards what is read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
WORD_BITS = np.uint64(32)
HEADER = struct.Struct("<4sHHIIII")
MAGIC = b"RNS1"


class Table:
    """Scaled frequencies of symbols 0..n-1; symbols never counted cannot be coded."""

    def __init__(self, scaled: np.ndarray):
        self.freq = np.asarray(scaled, dtype=np.uint64)
        if self.freq.size and int(self.freq.sum()) not in (0, 1 << SCALE_BITS):
            raise ValueError("scaled frequencies must fill the range")
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if self.freq.size else self.freq
        self.symbol = np.repeat(np.arange(self.freq.size, dtype=np.uint32), self.freq.astype(np.int64))

    @staticmethod
    def scaled(counts: np.ndarray) -> np.ndarray:
        """Counts scaled to sum to 2**SCALE_BITS, each counted symbol at least 1."""
        counts = np.asarray(counts, dtype=np.int64)
        total = int(counts.sum())
        if not total:
            return np.zeros_like(counts)
        out = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) / total * (1 << SCALE_BITS)).astype(np.int64)), 0)
        off = (1 << SCALE_BITS) - int(out.sum())
        order = np.argsort(-out, kind="stable")
        for i in order:  # the largest symbols take up the difference
            if not off:
                break
            step = off if off > 0 else max(off, 1 - int(out[i]))
            out[i] += step
            off -= step
        if off:
            raise ValueError("more symbols than the range has room for")
        return out


def encode(symbols: np.ndarray, table: Table, lanes: int = 1024, every: int = 128) -> bytes:
    """One block: header, checkpoints, words, checksum."""
    n = len(symbols)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    room, limit = np.uint64(1 << SCALE_BITS), np.uint64(31 - SCALE_BITS + 32)
    emitted = 0
    freqs, starts = table.freq[symbols], table.start[symbols]
    if not freqs.all():
        raise ValueError("symbol without a frequency")
    limits = freqs << limit
    for t in range(steps - 1, -1, -1):
        now = slice(t * lanes, (t + 1) * lanes)
        freq = freqs[now]
        x = state[:len(freq)]
        full = np.flatnonzero(x >= limits[now])
        if len(full):
            out = x[full]
            words.append(out.astype(np.uint32))
            emitted += len(out)
            x[full] = out >> WORD_BITS
        quotient = x // freq
        # x + quotient * (2**SCALE_BITS - freq) + start, in place
        x += quotient * (room - freq)
        x += starts[now]
        if t % every == 0:
            marks.append((emitted, state.copy()))
    marks.reverse()
    words.reverse()
    stream = np.concatenate(words) if words else np.empty(0, np.uint32)
    head = HEADER.pack(MAGIC, SCALE_BITS, every, lanes, n, len(stream), len(marks))
    body = b"".join([head, *(struct.pack("<I", emitted - at) + s.astype("<u8").tobytes() for at, s in marks), stream.astype("<u4").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Symbols first..last-1 of a block, starting at the checkpoint before ``first``."""
    if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("block checksum differs")
    magic, bits, every, lanes, n, n_words, n_marks = HEADER.unpack_from(block)
    if magic != MAGIC or bits != SCALE_BITS:
        raise ValueError("not a block of this format")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.empty(0, np.uint32)
    mark_size, marks_at = 4 + 8 * lanes, HEADER.size
    stream = np.frombuffer(block, "<u4", n_words, marks_at + n_marks * mark_size)
    mark = first // lanes // every
    at = marks_at + mark * mark_size
    # a checkpoint counts the words still unwritten when it was taken, which are those before it for a reader
    position = struct.unpack_from("<I", block, at)[0]
    state = np.frombuffer(block, "<u8", lanes, at + 4).astype(np.uint64)
    begin, end = mark * every, -(-last // lanes)
    out = np.empty((end - begin) * lanes, np.uint32)
    shift, mask = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)
    for t in range(begin, end):
        k = min(lanes, n - t * lanes)
        x = state[:k]
        slot = x & mask
        symbol = table.symbol[slot]
        out[(t - begin) * lanes:(t - begin) * lanes + k] = symbol
        x = table.freq[symbol] * (x >> shift) + slot - table.start[symbol]
        low = np.flatnonzero(x < LOW)
        if m := len(low):
            x[low] = (x[low] << WORD_BITS) | stream[position:position + m]
            position += m
        state[:k] = x
    return out[first - begin * lanes:last - begin * lanes]
