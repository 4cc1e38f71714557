"""Secrets in texts, also below layers of encoding.

A worklist starts with the text itself. Every layer is scanned for secrets and
then unwrapped: percent escapes, Unicode and character escapes, runs of base64,
and compressed data inside those or written as escapes of its bytes. Base64 is
read at all four offsets and over lines of any width, text is UTF-8 or the ASCII
characters of UTF-16, and all streams that follow each other are opened. What comes out is a new layer, until none
does. A layer keeps, for every character, the span of the text it came from, so
whatever is found in any layer is reported as a span of the text itself. A layer
with a content and place seen before is not taken up again, which ends cycles.

Spans are in code points, ends exclusive. The spans of the text itself always
stay; layers only add to them.

Defined cases: a null text is empty and has no secrets; base64 that is neither
text nor compressed data is no layer; compressed data that would unpack to more
than ``most_unpacked`` bytes is reported as a span of kind ``packed`` and not
opened, so it never passes unseen; rows are independent, so repeated or null
ids, ties and extra columns change nothing.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import forget, map_columns

# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "packed")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the leftmost runs of 16 or more are the whole runs
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18

# A percent escape, also of percent signs escaped over and over; likewise for the other escapes.
PERCENT = re.compile(r"%(?:25)*[0-9A-Fa-f]{2}")
ESCAPE = re.compile(
    r"\\(?:u005[cC])*(?:u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]{1,6}\}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2})"
    r"|&(?:amp;|#38;|#[xX]26;)*(?:#[0-9]{1,7};|#[xX][0-9A-Fa-f]{1,6};|(?:quot|apos|amp|lt|gt|equals|colon|nbsp);)"
)
# Lines of any width and indent are one run; a run may have other letters glued to it.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n[\x20\t>]*+[A-Za-z0-9+/_-]++)++={0,2}|[A-Za-z0-9+/_-]{16,}+={0,2}")
BASE64_LINE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LEAST_LETTERS = 16
# Bytes written as escapes, with the bytes between them that stand for themselves.
PERCENT_BYTES = re.compile(r"%(?:25)*[0-9A-Fa-f]{2}|[!-$&-~]")
ESCAPE_BYTES = re.compile(r"""\\(?:x[0-9A-Fa-f]{2}|u00[0-9A-Fa-f]{2}|[abfnrtv0\\'"/])|[\x20-\[\]-~]""")
PERCENT_RUN = re.compile(f"(?:{PERCENT_BYTES.pattern})++")
ESCAPE_RUN = re.compile(f"(?:{ESCAPE_BYTES.pattern})++")
SIMPLE = dict(zip("abfnrtv0", b"\a\b\f\n\r\t\v\0", strict=True))
MARKS = {b"\x1f\x8b": "gzip", b"\x78\x01": "zlib", b"\x78\x5e": "zlib", b"\x78\x9c": "zlib", b"\x78\xda": "zlib", b"BZh": "bz2", b"\xfd7zXZ\0": "xz", b"\x28\xb5\x2f\xfd": "zstd"}
MOST_UNPACKED = 1 << 28


class TooLarge(Exception):
    pass


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the secrets of one layer."""
    found = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= ASSIGN_LENGTH:
            found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


MARK = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
# Runs of text, UTF-8 or ASCII characters in UTF-16, between whatever bytes.
UTF8 = re.compile(rb"(?:[\t\n\x0b\x0c\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})++")
LITTLE, BIG = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){12,}+"), re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){12,}+")
LEAST_BYTES = 12


def _member(kind: str, data: bytes, most: int) -> tuple[bytes, int, bool]:
    """What the first stream of compressed data holds, the bytes it takes, and whether it is complete."""
    if kind == "zstd":
        import zstandard

        # the library does not say where a frame ends: up to the next one's mark
        with zstandard.ZstdDecompressor().stream_reader(data) as stream:
            out = stream.read(most + 1)
        following = data.find(b"\x28\xb5\x2f\xfd", 4)
        return out, len(data) if following < 0 else following, True
    reader = {"gzip": lambda: zlib.decompressobj(47), "zlib": lambda: zlib.decompressobj(47), "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[kind]()
    out = reader.decompress(data, most + 1)
    return out, len(data) - len(reader.unused_data), reader.eof


def unpack(data: bytes, most: int, complete: bool = False) -> tuple[bytes, int] | None:
    """What all streams that follow each other hold, and the bytes they take; None if data isn't compressed; TooLarge beyond ``most`` bytes."""
    out, at, left = [], 0, most
    while kind := next((k for mark, k in MARKS.items() if data.startswith(mark, at)), None):
        try:
            part, taken, whole = _member(kind, data[at:], left)
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError, MemoryError):
            break
        except Exception as error:  # zstandard has an error class of its own
            if type(error).__name__ != "ZstdError":
                raise
            break
        if len(part) > left:
            raise TooLarge
        if complete and not whole:
            break
        out.append(part)
        left -= len(part)
        at += taken
        padding = at
        while kind != "zstd" and data[padding:padding + 1] == b"\0":
            padding += 1
        if any(data.startswith(mark, padding) for mark in MARKS):
            at = padding
    return (b"".join(out), at) if out else None


def texts(data: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Runs of text in bytes, with the first and last byte of each character; shorter ones only if they are all there is."""
    for m in UTF8.finditer(data):
        if len(m[0]) < LEAST_BYTES and len(m[0]) < len(data):
            continue
        text = m[0].decode("utf-8", "replace")
        widths = np.array([len(c.encode()) for c in text])
        last = m.start() + np.cumsum(widths) - 1
        if last[-1] != m.end() - 1:  # surrogates and the like as bytes: place by place
            text = m[0].decode("latin-1")
            last, widths = np.arange(m.start(), m.end()), 1
        yield text, last - widths + 1, last
    if b"\0" in data:
        for pattern, code in ((LITTLE, "utf-16-le"), (BIG, "utf-16-be")):
            for m in pattern.finditer(data):
                first = np.arange(m.start(), m.end(), 2)
                yield m[0].decode(code), first, first + 1


def opened(data: bytes, most: int, complete: bool = False) -> tuple[list[bytes], int] | None:
    """What compressed data holds at its innermost, also what stands behind the streams inside it, and the bytes taken."""
    found = unpack(data, most, complete)
    if found is None:
        return None
    out, seen, work = [], {hashlib.sha256(data).digest()}, [found[0]]
    while work:
        inner = work.pop()
        digest = hashlib.sha256(inner).digest()
        if digest in seen:  # data that unpacks to itself
            continue
        seen.add(digest)
        more = unpack(inner, most)
        if more is None:
            out.append(inner)
            continue
        work += [more[0], inner[more[1]:]]
    return out, found[1]


class Layer:
    """A text and, for each character, the span of the root text it came from (None: the root itself)."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def root(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def key(self) -> tuple:
        """Content and place: the same text from the same place is the same layer."""
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), self.root(0, len(self.text)) if self.text else ()


def _escaped(layer: Layer, pattern: re.Pattern, value) -> Layer | None:
    """A layer with all matches of an escape pattern replaced; adjacent ones are decoded together."""
    text, parts, starts, ends, at = layer.text, [], [], [], 0
    spans = [m.span() for m in pattern.finditer(text)]
    if not spans:
        return None
    i = 0
    while i < len(spans):
        j = i + 1
        while j < len(spans) and spans[j][0] == spans[j - 1][1]:
            j += 1
        begin = spans[i][0]
        parts.append(text[at:begin])
        starts.append(np.arange(at, begin))
        ends.append(np.arange(at + 1, begin + 1))
        for out, first, last in value(text, spans[i:j]):
            parts.append(out)
            starts.append(np.full(len(out), first))
            ends.append(np.full(len(out), last))
        at, i = spans[j - 1][1], j
    parts.append(text[at:])
    starts.append(np.arange(at, len(text)))
    ends.append(np.arange(at + 1, len(text) + 1))
    made = "".join(parts)
    if made == text:
        return None
    start, end = np.concatenate(starts), np.concatenate(ends)
    if layer.starts is not None and len(made):
        start, end = layer.starts[start], layer.ends[end - 1]
    return Layer(made, start, end)


def _percent(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """Characters of a run of percent escapes, each with where its bytes stood."""
    data = bytes(int(text[e - 2:e], 16) for _, e in spans)
    at = 0
    for c in data.decode("utf-8", "replace"):
        # a byte that is no UTF-8 becomes one replacement character
        width = len(c.encode()) if data[at:at + len(c.encode())] == c.encode() else 1
        yield c, spans[at][0], spans[min(at + width, len(spans)) - 1][1]
        at = min(at + width, len(spans) - 1)


def _escape(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    values = []
    for s, e in spans:
        raw = text[s:e]
        if raw[0] == "&":
            values.append(html.unescape("&" + re.sub(r"^&(?:amp;|#38;|#[xX]26;)*(?=[#a-zA-Z])", "", raw)))
            continue
        digits = re.search(r"(?:u\{([0-9A-Fa-f]+)\}|[uUx]([0-9A-Fa-f]+))$", raw)
        code = int(digits[1] or digits[2], 16)
        values.append(chr(code) if code <= 0x10FFFF else raw)
    i = 0
    while i < len(spans):  # two halves of a surrogate pair are one character
        c = values[i]
        if len(c) == 1 and "\ud800" <= c <= "\udbff" and i + 1 < len(spans) and len(values[i + 1]) == 1 and "\udc00" <= values[i + 1] <= "\udfff":
            yield chr(0x10000 + ((ord(c) - 0xD800) << 10) + ord(values[i + 1]) - 0xDC00), spans[i][0], spans[i + 1][1]
            i += 2
        else:
            yield ("\ufffd" if len(c) == 1 and "\ud800" <= c <= "\udfff" else c), *spans[i]
            i += 1


def _base64(layer: Layer, most: int) -> Iterator[Layer | tuple[int, int]]:
    """Layers in runs of base64; a root span for one that is too large to open."""
    done: set[tuple[int, int]] = set()
    candidates = [m.span() for m in BASE64.finditer(layer.text)]
    candidates += [(s + a.start(), s + a.end()) for s, e in candidates if "\n" in layer.text[s:e] for a in BASE64_LINE.finditer(layer.text[s:e])]
    for s, e in candidates:
        if (s, e) in done or e - s < LEAST_LETTERS:
            continue
        done.add((s, e))
        run = layer.text[s:e]
        places = np.array([i for i, c in enumerate(run) if c not in "\r\n\t >="]) + s
        if len(places) < LEAST_LETTERS:
            continue
        every = re.sub(r"[\r\n\t >=]", "", run).replace("-", "+").replace("_", "/")
        for offset in range(4):  # letters may be glued to the front
            letters = every[offset:]
            letters = letters[:len(letters) - (len(letters) % 4 == 1)]
            try:
                data = base64.b64decode(letters + "=" * (-len(letters) % 4), validate=True)
            except (binascii.Error, ValueError):
                continue

            def span(first, last, places=places[offset:]):
                # byte i lies in letters i * 4 // 3 and the next one
                starts, ends = places[first * 4 // 3], places[np.minimum(last * 4 // 3 + 1, len(places) - 1)] + 1
                return (starts, ends) if layer.starts is None else (layer.starts[starts], layer.ends[ends - 1])

            whole = False
            for text, first, last in texts(data):
                whole = whole or last[-1] - first[0] + 1 >= len(data) - 1
                yield Layer(text, *span(first, last))

            def place(a, b, offset=offset, size=len(data)):
                end = e if b >= size else int(places[min(offset + (b - 1) * 4 // 3 + 1, len(places) - 1)]) + 1
                return int(places[offset + a * 4 // 3]), end

            taken = yield from _packed(layer, data, place, most)
            if whole or taken >= len(data) - 1:
                break


def _packed(layer: Layer, data: bytes, place, most: int):
    """Layers and root spans for the compressed data in bytes; ``place`` gives the span of the bytes from a to b. Returns the end of the last."""
    at = 0
    while m := MARK.search(data, at):
        a = m.start()
        try:
            found = opened(data[a:], most, complete=a > 0)
        except TooLarge:
            yield layer.root(*place(a, len(data)))
            return len(data)
        if found is None:
            at = a + 1
            continue
        at = a + max(found[1], 1)
        start, end = layer.root(*place(a, at))
        for part in found[0]:
            for text, _, _ in texts(part):
                yield Layer(text, np.full(len(text), start), np.full(len(text), end))
    return at


def _bytes(layer: Layer, most: int) -> Iterator[Layer | tuple[int, int]]:
    """Layers in compressed data that is written as escapes of its bytes; a root span for one that is too large to open."""
    for sign, run, token, plus in (("%", PERCENT_RUN, PERCENT_BYTES, True), ("%", PERCENT_RUN, PERCENT_BYTES, False), ("\\", ESCAPE_RUN, ESCAPE_BYTES, False)):
        if sign not in layer.text:
            continue
        for m in run.finditer(layer.text):
            if m[0].count(sign) < 2 or (plus and "+" not in m[0]):
                continue
            spans = [t.span() for t in token.finditer(layer.text, m.start(), m.end())]
            data = bytes(_byte(layer.text[s:e], plus) for s, e in spans)
            yield from _packed(layer, data, lambda a, b, spans=spans: (spans[a][0], spans[b - 1][1]), most)


def _byte(raw: str, plus: bool) -> int:
    if len(raw) == 1:
        return 0x20 if plus and raw == "+" else ord(raw)
    if raw[0] == "%" or raw[1] in "xu":
        return int(raw[-2:], 16)
    return SIMPLE.get(raw[1], ord(raw[1]))


def layered(text: str, most_unpacked: int = MOST_UNPACKED) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in the text itself of what its inner layers hold."""
    found: set[tuple[int, int, int]] = set()
    work, seen = [Layer(text)], set()
    while work:
        layer = work.pop()
        if layer.starts is not None:
            key = layer.key()
            if key in seen:
                continue
            seen.add(key)
            for start, kind, end in find(layer.text):
                a, b = layer.root(start, end)
                found.add((a, kind, b))
        inner = []
        if "%" in layer.text:
            inner.append(_escaped(layer, PERCENT, _percent))
        if "\\" in layer.text or "&" in layer.text:
            inner.append(_escaped(layer, ESCAPE, _escape))
        work += [x for x in inner if x is not None and x.text]
        for x in itertools.chain(_bytes(layer, most_unpacked), _base64(layer, most_unpacked)):
            if isinstance(x, Layer):
                work.append(x)
            else:
                found.add((x[0], 3, x[1]))
    return list(found)


def scan_text(text: str, most_unpacked: int = MOST_UNPACKED) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans of the text itself, and all spans with those of its layers; both by start, kind, end."""
    base = sorted(find(text))
    inner = layered(text, most_unpacked)
    return base, sorted({*base, *inner}) if inner else base


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_column: str = "doc_id", text: Column | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            found = [scan_text(t) for t in batch["text"]]
            counts = [[sum(x[1] == k for x in base) for base, _ in found] for k in range(3)]
            yield {
                "doc_id": batch["doc_id"], "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2],
                "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found],
                "spans": [joined(every) for _, every in found],
            }

    text = F.col("text") if text is None else text
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return map_columns(rows, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_text(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    for start, _, end in scan_text(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """All rows and columns, secrets in the text replaced and the length column counted anew; null texts stay null."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        forget()
        for batch in batches:
            clean = [None if t is None else redact_text(t) for t in batch[text_column]]
            lengths = [n if c is None or c is t else len(c) for n, c, t in zip(batch[length_column], clean, batch[text_column], strict=True)]
            yield batch | {text_column: clean, length_column: lengths}

    return map_columns(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
